"""Formats, routing, archives and polyglots."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamperlens.functions.findings import flat
from tamperlens.operators import archives, formats, keras, polyglot
from tamperlens.plans import inputs as I
from tamperlens.plans.registry import finding, q, query, table_of
from tamperlens.rules import markers as M
from tamperlens.sources import chunks, members

_ART = f"art AS MATERIALIZED (SELECT path, hex(content) AS h, octet_length(content) AS size FROM ({I.portable(I.ARTIFACTS)}))"
_MAGIC = "CASE " + " ".join(f"WHEN h LIKE '{raw.hex().upper()}%' THEN '{name}'" for raw, name in M.MAGIC) + " END"
_EXT = (
    "CASE WHEN lower(path) LIKE '%.tar.gz' THEN '.tar.gz' WHEN lower(path) LIKE '%.tar.bz2' THEN '.tar.bz2' "
    "ELSE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(\\.[^.]*)$', 1)) END"
)
_PLAIN_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '(\\.[^.]*)$', 1))"
_CAT = table_of([(e, n) for e, n, *_ in M.CATALOGUE], "c", "ext, name")
_RESOLVED = f"""{_ART}, named AS (SELECT path, h, size, {_EXT} AS extension, {_PLAIN_EXT} AS plain, {_MAGIC} AS magic FROM art),
joined AS (SELECT named.*, c.name FROM named LEFT JOIN {_CAT} ON c.ext = named.extension),
resolved AS (SELECT path, h, size, extension, plain, magic,
    CASE WHEN extension = '.tar.gz' THEN 'tar_gzip' WHEN extension = '.tar.bz2' THEN 'tar_bzip2'
         WHEN magic IS NULL THEN coalesce(name, 'unknown')
         WHEN magic = 'zip' AND extension IN ('.pth', '.pt', '.keras') THEN name
         WHEN magic = 'hdf5' AND extension IN ('.h5', '.hdf5') THEN name
         ELSE magic END AS format,
    CASE WHEN extension = '.tar.gz' OR extension = '.tgz' THEN 'tar:gz' WHEN extension = '.tar.bz2' THEN 'tar:bz2'
         WHEN extension = '.tar' THEN 'tar' WHEN extension IN ('.zip', '.npz', '.keras', '.pth', '.pt', '.whl') THEN 'zip'
         WHEN magic = 'zip' THEN 'zip' END AS archive_kind FROM joined)"""


def _artifacts(spark, sf_dir):
    return I.derive(spark, sf_dir, I.ARTIFACTS).select("path", "content")


@query(
    "src_artifacts",
    f"WITH {_ART} SELECT path, size AS length, md5(h) AS digest FROM art WHERE {_EXT} IN ({', '.join(q(e) for e, *_ in M.CATALOGUE)})",
)
def src_artifacts(spark, sf_dir):
    kept = _artifacts(spark, sf_dir).where(formats.full_suffix(F.col("path")).isin([e for e, *_ in M.CATALOGUE]))
    return kept.select("path", F.octet_length("content").alias("length"), F.md5(F.encode(F.hex("content"), "UTF-8")).alias("digest"))


@query("fmt_magic", f"WITH {_ART} SELECT path, {_MAGIC} AS magic FROM art")
def fmt_magic(spark, sf_dir):
    return _artifacts(spark, sf_dir).select("path", formats.magic_format(F.col("content")).alias("magic"))


@query("fmt_resolve", f"WITH {_RESOLVED} SELECT path, extension, magic, format, archive_kind FROM resolved")
def fmt_resolve(spark, sf_dir):
    return formats.resolve(_artifacts(spark, sf_dir)).select("path", "extension", "magic", "format", "archive_kind")


_FIRST: dict[str, tuple] = {}
for _e, _n, _f, _a, _c in M.CATALOGUE:
    _FIRST.setdefault(_n, (_n, _e, _f, str(_a).lower(), str(_c).lower()))


@query(
    "fmt_catalog",
    f"WITH {_RESOLVED} SELECT r.format, c.extension, c.framework, coalesce(c.runs = 'true', true) AS can_execute_code, count(*) AS n "
    f"FROM resolved r LEFT JOIN {table_of(list(_FIRST.values()), 'c', 'name, extension, framework, archive, runs')} "
    "ON c.name = r.format GROUP BY ALL",
)
def fmt_catalog(spark, sf_dir):
    resolved = formats.resolve(_artifacts(spark, sf_dir)).select("format", "can_execute_code")
    counts = resolved.groupBy("format", "can_execute_code").agg(F.count(F.lit(1)).alias("n"))
    known = formats.catalogue_formats(spark).select(F.col("name").alias("format"), "extension", "framework")
    return counts.join(known, "format", "left").select("format", "extension", "framework", "can_execute_code", "n")


@query(
    "fmt_directory",
    f"""WITH t AS (SELECT regexp_replace(path, '/[^/]*$', '') AS directory, regexp_extract(path, '[^/]*$') AS name FROM ({I.portable(I.TREE)}))
    SELECT directory, CASE WHEN bool_or(name = 'saved_model.pb') THEN 'tensorflow_saved_model'
      WHEN bool_or(name IN ('config.json', 'pytorch_model.bin', 'model.safetensors')) THEN 'huggingface_model' ELSE 'directory' END AS format,
      count(*) AS files FROM t GROUP BY directory""",
)
def fmt_directory(spark, sf_dir):
    return formats.directory_formats(I.derive(spark, sf_dir, I.TREE))


_ROUTE_ROWS = table_of([(s, t) for s, ts in M.ROUTES.items() for t in ts], "r", "scanner, token")
_ROUTED = (
    f"routed AS (SELECT DISTINCT path, extension, format, r.scanner FROM resolved JOIN {_ROUTE_ROWS} "
    "ON r.token = plain OR r.token = extension OR r.token = format OR r.token = '.' || format OR r.token = '*')"
)


@query("route_scanners", f"WITH {_RESOLVED}, {_ROUTED} SELECT path, scanner FROM routed WHERE scanner NOT IN ('guarddog', 'modelscan')")
def route_scanners(spark, sf_dir):
    resolved = formats.resolve(_artifacts(spark, sf_dir))
    return formats.routes(resolved, exclude=["guarddog", "modelscan"])


@query("find_scanners_executed", f"WITH {_RESOLVED}, {_ROUTED} SELECT scanner, count(*) AS artifacts FROM routed GROUP BY scanner")
def find_scanners_executed(spark, sf_dir):
    return formats.scanners_executed(formats.routes(formats.resolve(_artifacts(spark, sf_dir))))


@query(
    "find_issues",
    f"""WITH {_RESOLVED} SELECT path, 'zip_slip' AS scanner, 'warning' AS kind FROM resolved
    WHERE archive_kind IS NULL AND format = 'unknown'
    UNION ALL SELECT path, 'gguf', CASE WHEN h LIKE '47474D4C%' THEN 'warning' ELSE 'error' END FROM resolved
    WHERE extension IN ('.gguf', '.ggml') AND h NOT LIKE '47475546%'""",
)
def find_issues(spark, sf_dir):
    from tamperlens.operators import gguf

    files = _artifacts(spark, sf_dir)
    named = files.where(formats.full_suffix(F.col("path")).isin(".gguf", ".ggml"))
    return (
        formats.unresolved(formats.resolve(files)).unionByName(gguf.header_issues(named)).select("path", "scanner", "kind")
    )


_TEXT_ODD = "'[\\x00-\\x06\\x0b\\x0e-\\x1a\\x1c-\\x1f\\x7f]'"


@query(
    "fmt_is_binary",
    f"""WITH {_ART}, bytes AS (SELECT path, size, [CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS INTEGER) FOR i IN range(0, least(size, 8192))] AS b FROM art),
    odd AS (SELECT path, size, list_contains(b, 0) AS nul, len(b) AS n,
       len([x FOR x IN b IF NOT (x IN (7, 8, 9, 10, 12, 13, 27) OR (x >= 32 AND x <> 127))]) AS k FROM bytes)
    SELECT path, size > 0 AND (nul OR k / n > 0.3) AS is_binary FROM odd
    UNION ALL SELECT 'doc/' || doc_id, regexp_matches(text, '\\x00') OR
       len(regexp_extract_all(text, {_TEXT_ODD})) > 0.3 * least(strlen(text), 8192) FROM documents""",
)
def fmt_is_binary(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return _artifacts(spark, sf_dir).unionByName(docs).select("path", formats.is_binary(F.col("content")).alias("is_binary"))


_SOUGHT = ["token", "the ", "\n", "zq"]


@query(
    "byte_find",
    " UNION ALL ".join(
        f"""SELECT 'doc/' || doc_id AS path, '{p.encode().hex()}' AS pattern, CAST(place AS BIGINT) AS "offset" FROM (
        SELECT doc_id, n, sum(strlen(piece) + {len(p)}) OVER (PARTITION BY doc_id ORDER BY n) - {len(p)} AS place, last FROM (
          SELECT doc_id, unnest(pieces) AS piece, unnest(range(0, len(pieces))) AS n, len(pieces) - 1 AS last
          FROM (SELECT doc_id, string_split(text, {"chr(10)" if p == chr(10) else q(p)}) AS pieces FROM documents))) WHERE n < last"""
        for p in _SOUGHT
    ),
)
def byte_find(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return formats.pattern_offsets(docs, [p.encode() for p in _SOUGHT])


@query(
    "artifact_hash",
    """SELECT 'doc/' || doc_id AS path, sha256(text) AS sha256, sha1(text) AS sha1, md5(text) AS md5,
    left(md5(strlen(text) || text), 16) AS quick_id FROM documents""",
)
def artifact_hash(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    return formats.digests(docs)


# --- archives -------------------------------------------------------------------

_MEM = f"members AS ({I.portable(I.MEMBERS)})"
_ITEMS = "CAST(to_json(list_sort(list_distinct(list({0})))[:{1}]) AS VARCHAR)"


def _archive_sql(kind: str, level: str, score: str, cwe: str, where: str, item: str = "entry") -> str:
    return (
        f"WITH {_MEM} SELECT "
        + finding("path", "zip_slip", q(kind), q(level), score, cwe, entries=_ITEMS.format(item, 10), total="count(*)")
        + f" FROM members WHERE {where} GROUP BY path"
    )


def _archive(name, rule, sql):
    @query(name, sql)
    def run(spark, sf_dir):
        return flat(rule(I.derive(spark, sf_dir, I.MEMBERS)), "entries", "total")


_archive("zip_traversal", archives.zip_traversal,
         _archive_sql("Zip Slip - Path Traversal", "High", "7.5", "CWE-22", "origin = 'central' AND contains(entry, '..')"))
_archive("zip_symlink", archives.zip_symlink,
         _archive_sql("Zip Slip - Symlink Attack", "High", "7.0", "CWE-59", "origin = 'central' AND (unix_mode & 61440) = 40960"))
_archive("zip_absolute", archives.zip_absolute,
         _archive_sql("Zip Slip - Absolute Path", "Medium", "6.0", "CWE-22",
                      "origin = 'central' AND (entry LIKE '/%' OR substr(entry, 2, 1) = ':')"))
_archive("tar_traversal", archives.tar_traversal,
         _archive_sql("Tar Slip - Path Traversal", "High", "7.5", "CWE-22", "origin = 'tar' AND contains(entry, '..')"))
_archive("tar_symlink", archives.tar_symlink,
         _archive_sql("Tar Slip - Dangerous Symlink", "High", "7.5", "CWE-59",
                      "origin = 'tar' AND is_link AND (link_target LIKE '/%' OR contains(link_target, '..'))",
                      "entry || ' -> ' || link_target"))
_archive(
    "zip_header_mismatch", archives.header_mismatch,
    f"""WITH {_MEM}, c AS (SELECT DISTINCT path, entry FROM members WHERE origin = 'central'),
    l AS (SELECT DISTINCT path, entry FROM members WHERE origin = 'local'),
    d AS (SELECT coalesce(c.path, l.path) AS path, CASE WHEN c.path IS NULL THEN 'local: ' || l.entry ELSE 'central: ' || c.entry END AS item
          FROM c FULL OUTER JOIN l ON c.path = l.path AND c.entry = l.entry WHERE c.path IS NULL OR l.path IS NULL)
    SELECT """
    + finding("path", "zip_slip", "'Zip Slip - Header Mismatch'", "'High'", "7.5", "CWE-22", "CVE-2025-1944",
              entries=_ITEMS.format("item", 5), total="count(*)")
    + " FROM d GROUP BY path",
)


@query(
    "keras_zip_traversal",
    f"WITH {_MEM} SELECT "
    + finding("path", "lambda_layer", "'Keras - ZIP Path Traversal'", "'High'", "8.0", "CWE-22", malicious_path="entry")
    + " FROM members WHERE origin = 'central' AND (contains(entry, '..') OR entry LIKE '/%' OR entry LIKE chr(92) || '%')",
)
def keras_zip_traversal(spark, sf_dir):
    return flat(keras.zip_traversal(I.derive(spark, sf_dir, I.MEMBERS)), "malicious_path")


@query(
    "src_members",
    f"""SELECT 'z/' || file || '.zip' AS path, row_number() OVER (PARTITION BY file ORDER BY line) - 1 AS ordinal, entry, 'central' AS origin,
      mode AS unix_mode, mode = 41471 AS is_link FROM ({I.portable(I.LINES)})
    UNION ALL SELECT 'z/' || file || '.zip', row_number() OVER (PARTITION BY file ORDER BY line) - 1, entry, 'local', NULL, false
      FROM ({I.portable(I.LINES)})""",
)
def src_members(spark, sf_dir):
    return members.members(I.zip_files(spark, sf_dir)).select("path", "ordinal", "entry", "origin", "unix_mode", "is_link")


@query(
    "src_members_safe",
    f"""WITH {_MEM} SELECT path, entry, origin, count(*) AS n FROM members
    WHERE entry NOT IN ('../outside.txt', 'a/../../b', '/etc/x') AND NOT (origin = 'tar' AND is_link)
      AND entry NOT IN ('../outside.txt.bak', 'a/../../b.bak', '/etc/x.bak') GROUP BY ALL""",
)
def src_members_safe(spark, sf_dir):
    kept = archives.safe_members(I.derive(spark, sf_dir, I.MEMBERS))
    return kept.groupBy("path", "entry", "origin").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_member_contents",
    f"SELECT 'z/' || file || '.zip' AS path, entry, bits AS content FROM ({I.portable(I.LINES)})",
)
def src_member_contents(spark, sf_dir):
    return members.member_contents(I.zip_files(spark, sf_dir)).select("path", "entry", F.hex("content").alias("content"))


@query(
    "src_chunks",
    """SELECT 'doc/' || doc_id AS path, greatest(ceil(strlen(text) / 1000), 1)::BIGINT AS chunks, strlen(text)::BIGINT AS bytes_scanned,
    greatest(0, strlen(text) - 1000 * (greatest(ceil(strlen(text) / 1000), 1) - 1))::BIGINT AS last_chunk FROM documents""",
)
def src_chunks(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    cut = chunks.in_memory(docs, 1000, 64)
    last = cut.groupBy("path").agg(F.max_by(F.octet_length("bytes").cast("bigint"), "chunk_no").alias("last_chunk"))
    return chunks.coverage(cut).join(last, "path")


# --- polyglots ------------------------------------------------------------------

_SIGNED_BY = {
    name: "(" + " OR ".join(f"h LIKE '{raw.hex().upper()}%'" for raw in raws) + ")" for name, raws in M.SIGNATURES
}
_FORMAT_LIST = "list_sort([x FOR x IN [" + ", ".join(
    f"CASE WHEN {test} THEN '{name}' END" for name, test in _SIGNED_BY.items()
) + "] IF x IS NOT NULL])"
_SIGNED = f"{_ART}, signed AS (SELECT path, h, size, {_FORMAT_LIST} AS formats, {_PLAIN_EXT} AS ext FROM art)"
_SPACED = "regexp_replace(h, '(..)', '\\1 ', 'g')"


def _signed(spark, sf_dir):
    return polyglot.with_signatures(_artifacts(spark, sf_dir))


@query("poly_signatures", f"WITH {_SIGNED} SELECT path, array_to_string(formats, ',') AS formats FROM signed")
def poly_signatures(spark, sf_dir):
    return _signed(spark, sf_dir).select("path", F.array_join("formats", ",").alias("formats"))


@query(
    "poly_mismatch",
    f"WITH {_SIGNED} SELECT "
    + finding("path", "polyglot", "'Polyglot - Format Mismatch'", "'Medium'", "6.0", "CWE-434", extension="ext",
              claimed_format="c.claimed", detected_formats="array_to_string(formats, ',')", magic_bytes="lower(left(h, 32))")
    + f" FROM signed JOIN {table_of(list(M.CLAIMED_FORMATS.items()), 'c', 'suffix, claimed')} ON c.suffix = ext "
    "WHERE len(formats) > 0 AND NOT list_contains(formats, c.claimed)",
)
def poly_mismatch(spark, sf_dir):
    found = polyglot.mismatch(_signed(spark, sf_dir))
    return flat(found, "extension", "claimed_format", "detected_formats", "magic_bytes")


@query("poly_multiple", f"WITH {_SIGNED} SELECT count(*) FILTER (len(formats) > 1) AS findings, count(*) AS artifacts FROM signed")
def poly_multiple(spark, sf_dir):
    signed = _signed(spark, sf_dir).select("path", "source", "formats", F.lit(1).alias("artifact"))
    found = polyglot.multiple(signed).select(F.lit(1).alias("finding"), F.lit(None).cast("int").alias("artifact"))
    rows = found.unionByName(signed.select(F.lit(None).cast("int").alias("finding"), "artifact"))
    return rows.agg(F.count("finding").alias("findings"), F.count("artifact").alias("artifacts"))


def _place(raws) -> str:
    cases = []
    for raw in raws:
        spaced = " ".join(f"{b:02X}" for b in raw) + " "
        # Places are searched byte by byte: every byte is three characters.
        head = f"nullif(strpos(substr(sp, 193, 3 * 65472), '{spaced}'), 0)"
        tail = f"nullif(strpos(right(sp, 3072), '{spaced}'), 0)"
        cases.append(f"CAST(CAST((({head}) - 1) / 3 + 64 AS BIGINT) AS VARCHAR), 'tail+' || CAST((({tail}) - 1) / 3 AS BIGINT)")
    return "coalesce(" + ", ".join(cases) + ")"


_EMBED = " UNION ALL ".join(
    f"SELECT path, formats, '{name}' AS embedded, {_place(raws)} AS place FROM spaced WHERE NOT list_contains(formats, '{name}')"
    for name, raws in M.SIGNATURES
)


@query(
    "poly_embedded",
    f"WITH {_SIGNED}, spaced AS MATERIALIZED (SELECT path, formats, {_SPACED} AS sp FROM signed), hits AS ({_EMBED}) SELECT "
    + finding(
        "path", "polyglot", "'Polyglot - Embedded Format'",
        "CASE WHEN embedded IN ('pickle', 'exe_mz', 'elf', 'shell') THEN 'High' ELSE 'Medium' END",
        "CASE WHEN embedded IN ('pickle', 'exe_mz', 'elf', 'shell') THEN 7.5 ELSE 5.0 END", "CWE-434",
        primary_format="coalesce(formats[1], 'unknown')", embedded_format="embedded",
    )
    + ", place FROM hits WHERE place IS NOT NULL",
)
def poly_embedded(spark, sf_dir):
    found = polyglot.embedded(_signed(spark, sf_dir))
    return flat(found, "primary_format", "embedded_format", place="offset")


_AFTER = """CASE WHEN list_contains(formats, 'jpeg') AND contains(sp, 'FF D9 ') THEN list_last(string_split(sp, 'FF D9 '))
WHEN list_contains(formats, 'png') AND contains(sp, '49 45 4E 44 ') THEN substr(sp, strpos(sp, '49 45 4E 44 ') + 24)
WHEN list_contains(formats, 'gif') AND contains(sp, '3B ') THEN list_last(string_split(sp, '3B ')) END"""
_REST_FORMAT = "(list_sort([x FOR x IN [" + ", ".join(
    f"CASE WHEN {test.replace('h LIKE', 'rest LIKE')} THEN '{name}' END" for name, test in _SIGNED_BY.items()
) + "] IF x IS NOT NULL]))[1]"


@query(
    "poly_trailing",
    f"""WITH {_SIGNED}, spaced AS (SELECT path, formats, {_SPACED} AS sp FROM signed),
    cut AS (SELECT path, replace({_AFTER}, ' ', '') AS rest FROM spaced),
    kept AS (SELECT path, CAST(length(rest) / 2 AS BIGINT) AS n, coalesce({_REST_FORMAT}, 'unknown') AS f FROM cut WHERE length(rest) > 20)
    SELECT """
    + finding("path", "polyglot", "'Polyglot - Trailing Data'",
              "CASE WHEN f IN ('pickle', 'exe_mz', 'zip') THEN 'High' ELSE 'Medium' END",
              "CASE WHEN f IN ('pickle', 'exe_mz', 'zip') THEN 7.0 ELSE 5.5 END", "CWE-434",
              trailing_format="f", trailing_size="n")
    + " FROM kept",
)
def poly_trailing(spark, sf_dir):
    return flat(polyglot.trailing(_signed(spark, sf_dir)), "trailing_format", "trailing_size")


_HAS = lambda name: f"bool_or(regexp_extract(entry, '[^/]*$') = '{name}')"


@query(
    "poly_pytorch_variants",
    f"""WITH {_MEM}, z AS (SELECT path, bool_or(origin = 'tar') AS tar, {_HAS('data.pkl')} AS d, {_HAS('constants.pkl')} AS c,
      {_HAS('attributes.pkl')} AS a, {_HAS('model.json')} AS j, {_HAS('version')} AS v, bool_or(entry LIKE '%.py') AS py,
      bool_or(entry LIKE '%.pkl') AS p FROM members GROUP BY path),
    f AS (SELECT path, list_sort([x FOR x IN [CASE WHEN j THEN 'TorchScript v1.0' END, CASE WHEN j AND a THEN 'TorchScript v1.1' END,
      CASE WHEN d AND c THEN 'TorchScript v1.3' END, CASE WHEN d AND c AND v THEN 'TorchScript v1.4' END,
      CASE WHEN d THEN 'PyTorch v1.3' END, CASE WHEN py AND p THEN 'PyTorch model archive format' END] IF x IS NOT NULL]) AS vs
      FROM z WHERE NOT tar) SELECT """
    + finding("path", "polyglot", "'Polyglot - Multiple PyTorch Formats'", "'High'", "7.0", "CWE-434",
              pytorch_formats="array_to_string(vs, ',')")
    + " FROM f WHERE len(vs) > 1",
)
def poly_pytorch_variants(spark, sf_dir):
    return flat(polyglot.pytorch_findings(I.derive(spark, sf_dir, I.MEMBERS)), "pytorch_formats")
