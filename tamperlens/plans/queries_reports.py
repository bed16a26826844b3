"""Dependencies, scores, reports, external tools and incremental scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamperlens.functions.findings import flat
from tamperlens.operators import cvss, deps, external, reports, textscan
from tamperlens.plans import inputs as I
from tamperlens.plans.queries_text import _RANK, BASE_SQL, base_findings, secrets_sql  # noqa: F401
from tamperlens.plans.registry import finding, q, query, table_of
from tamperlens.rules import markers as M
from tamperlens.sources import reports as report_source
from tamperlens.streaming import incremental

# --- dependencies ---------------------------------------------------------------


def _spec(column: str) -> str:
    return f"trim(split_part({column}, ';', 1))"


def _parsed(rows: str, spec: str) -> str:
    """Dependency rows of (source, line) rows, the requirement being ``spec``."""
    s = _spec(spec)
    return f"""SELECT source, CASE WHEN regexp_matches({s}, '^(git\\+|https?://)') THEN '__url_dependency__'
      ELSE lower(regexp_extract({s}, '^[a-zA-Z0-9_-]+')) END AS name, {s} AS raw,
      CASE WHEN regexp_matches({s}, '^(git\\+|https?://)') THEN 'url' ELSE 'package' END AS dep_type FROM ({rows})
      WHERE regexp_matches({s}, '^(git\\+|https?://|[a-zA-Z0-9_-])')"""


_REQ_LINES = f"SELECT source, trim(unnest(string_split(text, chr(10)))) AS line FROM ({I.portable(I.REQUIREMENTS)})"
_DEPS = f"""deps AS MATERIALIZED (SELECT source, '__custom_index__' AS name, line AS raw, 'custom_index' AS dep_type FROM ({_REQ_LINES})
  WHERE line LIKE '-%' AND (contains(line, '--index-url') OR contains(line, '--extra-index-url'))
  UNION ALL {_parsed(f"SELECT * FROM ({_REQ_LINES}) WHERE line <> '' AND line NOT LIKE '#%' AND line NOT LIKE '-%'", "line")})"""


def _deps(spark, sf_dir):
    return deps.requirements(I.derive(spark, sf_dir, I.REQUIREMENTS))


@query("dep_requirements", f"WITH {_DEPS} SELECT source, name, raw, dep_type FROM deps")
def dep_requirements(spark, sf_dir):
    return _deps(spark, sf_dir).drop("path")


_PY_LINES = f"""SELECT source, line, n, contains(lower(line), 'dependencies') AND contains(line, '=') AS opens, trim(line) LIKE ']%' AS closes FROM (
  SELECT source, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM ({I.portable(I.PYPROJECT)}))"""
_PY_INSIDE = f"""SELECT source, regexp_extract(line, '"([^"]+)"', 1) AS quoted, opens,
  last_value(CASE WHEN opens THEN true WHEN closes THEN false END IGNORE NULLS) OVER (PARTITION BY source ORDER BY n) AS inside FROM ({_PY_LINES})"""
_PY_DEPS = _parsed(f"SELECT * FROM ({_PY_INSIDE}) WHERE inside AND NOT opens AND quoted <> ''", "quoted")


@query("dep_pyproject", _PY_DEPS)
def dep_pyproject(spark, sf_dir):
    return deps.pyproject(I.derive(spark, sf_dir, I.PYPROJECT)).drop("path")


@query(
    "dep_setup_py",
    _parsed(
        f"""SELECT source, unnest(regexp_extract_all(regexp_extract(text, '(?s)install_requires\\s*=\\s*\\[(.*?)\\]', 1), '["'']([^"'']+)["'']', 1)) AS spec
        FROM ({I.portable(I.SETUP_PY)})""", "spec"),
)
def dep_setup_py(spark, sf_dir):
    return deps.setup_py(I.derive(spark, sf_dir, I.SETUP_PY)).drop("path")


@query(
    "dep_wheel",
    _parsed(
        f"""SELECT source, trim(substr(line, 15)) AS spec FROM (SELECT source, unnest(string_split(text, chr(10))) AS line
        FROM ({I.portable(I.WHEEL)})) WHERE line LIKE 'Requires-Dist:%'""", "spec"),
)
def dep_wheel(spark, sf_dir):
    return deps.wheel(I.derive(spark, sf_dir, I.WHEEL)).drop("path")


@query(
    "dep_sources",
    f"""WITH t AS (SELECT path, NULL AS entry FROM ({I.portable(I.TREE)}) UNION ALL
      SELECT path, entry FROM (SELECT 'w/' || l_orderkey || CASE WHEN l_linenumber % 2 = 0 THEN '.whl' ELSE '.zip' END AS path,
        CASE l_suppkey % 4 WHEN 0 THEN 'x.dist-info/METADATA' WHEN 1 THEN 'sub/requirements.txt' WHEN 2 THEN 'metadata.json' ELSE 'a.py' END AS entry FROM lineitem)),
    p AS (SELECT path, CASE WHEN entry IS NULL THEN CASE WHEN regexp_matches(path, '/(requirements.*\\.txt|requirements\\.in)$') THEN 'requirements'
        WHEN path LIKE '%/pyproject.toml' THEN 'pyproject' WHEN path LIKE '%/setup.py' THEN 'setup_py' END
      WHEN path LIKE '%.whl' THEN CASE WHEN entry LIKE '%METADATA' OR entry LIKE '%metadata.json' THEN 'wheel' END
      WHEN entry LIKE '%requirements.txt' THEN 'requirements' END AS parser FROM t)
    SELECT path, parser, count(*) AS n FROM p WHERE parser IS NOT NULL GROUP BY ALL""",
)
def dep_sources(spark, sf_dir):
    inside = I.table(spark, sf_dir, "lineitem").select(
        F.expr("concat('w/', cast(l_orderkey AS string), if(l_linenumber % 2 = 0, '.whl', '.zip'))").alias("path"),
        F.expr(
            "CASE l_suppkey % 4 WHEN 0 THEN 'x.dist-info/METADATA' WHEN 1 THEN 'sub/requirements.txt' "
            "WHEN 2 THEN 'metadata.json' ELSE 'a.py' END"
        ).alias("entry"),
    )
    paths = I.derive(spark, sf_dir, I.TREE).unionByName(inside)
    return deps.dependency_files(paths).groupBy("path", "parser").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dep_names_pep621",
    f"""SELECT source, trim(regexp_extract(quoted, '^([^\\[><=!]*)', 1)) AS name FROM ({_PY_INSIDE})
    WHERE inside AND NOT opens AND trim(regexp_extract(quoted, '^([^\\[><=!]*)', 1)) <> ''""",
)
def dep_names_pep621(spark, sf_dir):
    quoted = deps.quoted_requirements(I.derive(spark, sf_dir, I.PYPROJECT))
    return quoted.select("source", deps.requirement_names(F.col("quoted")).alias("name")).where(F.col("name") != "")


@query(
    "dep_custom_index",
    f"WITH {_DEPS} SELECT " + finding("source", "dependency", "'Dependency Hijacking - Custom Index'", "'High'", "7.5", "CWE-494", raw="raw")
    + " FROM deps WHERE dep_type = 'custom_index'",
)
def dep_custom_index(spark, sf_dir):
    return flat(deps.custom_index(_deps(spark, sf_dir)), "raw")


_HOSTS = " OR ".join(f"contains(lower(raw), {q(h)})" for h in M.SUSPICIOUS_HOSTS)


@query(
    "dep_url",
    f"WITH {_DEPS} SELECT " + finding("source", "dependency", "'Dependency Hijacking - URL Dependency'",
                                      f"CASE WHEN {_HOSTS} THEN 'High' ELSE 'Medium' END", f"CASE WHEN {_HOSTS} THEN 7.0 ELSE 5.5 END", "CWE-829", raw="raw")
    + " FROM deps WHERE dep_type = 'url'",
)
def dep_url(spark, sf_dir):
    return flat(deps.url_dependency(_deps(spark, sf_dir)), "raw")


_NORMAL = "replace(replace(lower({0}), '-', ''), '_', '')"
_EDITS = f"""popular AS (SELECT p.name AS popular, {_NORMAL.format('p.name')} AS t FROM {table_of([(p,) for p in M.POPULAR_PACKAGES], 'p', 'name')}),
names AS (SELECT DISTINCT name, {_NORMAL.format('name')} AS s FROM deps WHERE dep_type = 'package'),
fresh AS (SELECT * FROM names WHERE s NOT IN (SELECT t FROM popular)),
edits AS (SELECT name, popular, CASE WHEN length(s) = length(t) THEN 0.95 ELSE 0.92 END AS similarity
  FROM fresh JOIN popular ON abs(length(s) - length(t)) <= 1 AND levenshtein(s, t) = 1),
best AS (SELECT name, popular AS target, similarity, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, popular) AS n FROM edits)"""


@query("dep_typosquat_edits", f"WITH {_DEPS}, {_EDITS} SELECT name, target, similarity FROM best WHERE n = 1")
def dep_typosquat_edits(spark, sf_dir):
    packages = _deps(spark, sf_dir).where(F.col("dep_type") == "package")
    return deps.single_edit_lookalikes(packages, deps.popular_packages(spark))


# Matching blocks by recursion over rows: a pair of texts leaves the pairs before and behind its longest common block.
_BLOCK = """list_filter(flatten(list_transform(range(length(x), 0, -1), lambda n: list_transform(range(1, length(x) - n + 2),
    lambda i: substr(x, i, n)))), lambda s: contains(y, s))[1]"""
_RATIOS = f"""near AS (SELECT DISTINCT s, t FROM fresh JOIN popular ON least(length(s), length(t)) * 2 >= 0.85 * (length(s) + length(t))),
cut(s, t, x, y, block) AS (SELECT s, t, x, y, {_BLOCK} FROM (SELECT s, t, s AS x, t AS y FROM near)
  UNION ALL SELECT s, t, x, y, {_BLOCK} FROM (
    SELECT s, t, CASE side WHEN 0 THEN substr(x, 1, instr(x, block) - 1) ELSE substr(x, instr(x, block) + length(block)) END AS x,
      CASE side WHEN 0 THEN substr(y, 1, instr(y, block) - 1) ELSE substr(y, instr(y, block) + length(block)) END AS y
    FROM cut, (VALUES (0), (1)) AS sides(side) WHERE block IS NOT NULL) WHERE x <> '' AND y <> ''),
ratios AS (SELECT s, t, 2.0 * sum(coalesce(length(block), 0)) / (length(s) + length(t)) AS ratio FROM cut GROUP BY s, t),
alike AS (SELECT name, popular, greatest(ratio, coalesce(similarity, 0)) AS similarity
  FROM fresh JOIN ratios USING (s) JOIN popular USING (t) LEFT JOIN edits USING (name, popular)
  UNION ALL SELECT name, popular, similarity FROM edits),
imitations AS (SELECT name, popular AS target, similarity FROM alike WHERE similarity >= 0.85
  QUALIFY row_number() OVER (PARTITION BY name ORDER BY similarity DESC, popular) = 1)"""
_SIMILAR = f"WITH RECURSIVE {_DEPS}, {_EDITS}, {_RATIOS}"


@query(
    "dep_typosquat",
    f"{_SIMILAR} SELECT "
    + finding("source", "dependency", "'Dependency Hijacking - Typosquatting'", "'High'", "8.0", "CWE-494",
              suspicious_package="name", likely_target="target", similarity="round(similarity, 6)")
    + " FROM deps JOIN imitations USING (name) WHERE dep_type = 'package'",
)
def dep_typosquat(spark, sf_dir):
    found = _deps(spark, sf_dir)
    similar = deps.lookalikes(found.where(F.col("dep_type") == "package"), deps.popular_packages(spark))
    return flat(deps.typosquat(found, similar), "suspicious_package", "likely_target", "similarity")


_SHAPE = "CASE " + " ".join(f"WHEN regexp_matches(name, {q('(?i)' + p)}) THEN {q(d)}" for p, d in M.SUSPICIOUS_NAMES) + " END"


@query(
    "dep_suspicious_name",
    f"{_SIMILAR} SELECT "
    + finding("source", "dependency", "'Dependency Hijacking - Suspicious Name'", "'Medium'", "5.0", "CWE-494", package="name", pattern=_SHAPE)
    + f" FROM deps WHERE dep_type = 'package' AND {_SHAPE} IS NOT NULL AND name NOT IN (SELECT name FROM imitations)",
)
def dep_suspicious_name(spark, sf_dir):
    found = _deps(spark, sf_dir)
    similar = deps.lookalikes(found.where(F.col("dep_type") == "package"), deps.popular_packages(spark))
    return flat(deps.suspicious_names(found, similar), "package", "pattern")


# --- scores ---------------------------------------------------------------------


def _case(column: str, table: dict, default: float) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default}::DOUBLE END"


_W = M.CVSS_WEIGHTS
_SCORED = f"""v AS (SELECT *, {_case('av', _W['AV'], 0.85)} AS wav, {_case('ac', _W['AC'], 0.77)} AS wac,
   CASE WHEN sc = 'C' THEN {_case('pr', _W['PR_CHANGED'], 0.85)} ELSE {_case('pr', _W['PR'], 0.85)} END AS wpr, {_case('ui', _W['UI'], 0.85)} AS wui,
   1 - (1 - {_case('ci', _W['IMPACT'], 0)}) * (1 - {_case('ii', _W['IMPACT'], 0)}) * (1 - {_case('ai', _W['IMPACT'], 0)}) AS loss FROM ({{0}})),
 e AS (SELECT *, 8.22::DOUBLE * wav * wac * wpr * wui AS ease, CASE WHEN sc = 'U' THEN 6.42::DOUBLE * loss
   ELSE 7.52::DOUBLE * (loss - 0.029::DOUBLE) - 3.25::DOUBLE * pow(loss - 0.02::DOUBLE, 15) END AS impact FROM v),
 s AS (SELECT *, CASE WHEN impact <= 0 THEN 0.0::DOUBLE ELSE
   round_even(least(CASE WHEN sc = 'U' THEN impact + ease ELSE 1.08::DOUBLE * (impact + ease) END, 10) * 10, 0) / 10 END AS score FROM e),
 r AS (SELECT *, CASE WHEN score >= 9 THEN 'Critical' WHEN score >= 7 THEN 'High' WHEN score >= 4 THEN 'Medium' WHEN score > 0 THEN 'Low' ELSE 'Info' END AS level,
   'CVSS:3.1/AV:' || av || '/AC:' || ac || '/PR:' || pr || '/UI:' || ui || '/S:' || sc || '/C:' || ci || '/I:' || ii || '/A:' || ai AS normal_vector FROM s)"""
_VECTORS = _SCORED.format(I.portable(I.VECTORS))


@query("cvss_score", f"WITH {_VECTORS} SELECT cvss_vector, normal_vector, score, level, count(*) AS n FROM r GROUP BY ALL")
def cvss_score(spark, sf_dir):
    counted = I.derive(spark, sf_dir, I.VECTORS).groupBy("cvss_vector").agg(F.count(F.lit(1)).alias("n"))
    return cvss.score(counted).select("cvss_vector", "normal_vector", "score", "level", "n")


@query("cvss_distribution", f"WITH {_VECTORS} SELECT level, count(*) AS vectors, round(avg(score), 6) AS mean_score FROM r GROUP BY level")
def cvss_distribution(spark, sf_dir):
    return cvss.distribution(I.derive(spark, sf_dir, I.VECTORS).select("cvss_vector"))


@query(
    "cvss_presets",
    f"WITH {_VECTORS} SELECT p.preset, r.level, r.score, l.low::DOUBLE AS low, l.high::DOUBLE AS high, count(*) AS n FROM r JOIN {table_of(M.CVSS_PRESETS, 'p', 'preset, vector')} "
    "ON p.vector = r.normal_vector JOIN (VALUES ('Critical', 9.0, 10.0), ('High', 7.0, 8.9), ('Medium', 4.0, 6.9), ('Low', 0.1, 3.9), ('Info', 0.0, 0.0)) "
    "AS l(level, low, high) ON l.level = r.level GROUP BY ALL",
)
def cvss_presets(spark, sf_dir):
    scored = cvss.score(I.derive(spark, sf_dir, I.VECTORS).select("cvss_vector")).select("normal_vector", "level", "score")
    counts = scored.groupBy("normal_vector", "level", "score").agg(F.count(F.lit(1)).alias("n"))
    named = cvss.presets(spark).select("preset", "normal_vector")
    return counts.join(named, "normal_vector").join(cvss.level_ranges(spark), "level").drop("normal_vector")


# --- reports --------------------------------------------------------------------

_RULE = "CASE " + " ".join(f"WHEN contains(lower(vulnerability_type), '{w}') THEN '{n:03d}'" for w, n in M.SARIF_KEYWORDS) + " ELSE '000' END"
_SARIF_LEVEL = "CASE level WHEN 'Critical' THEN 'error' WHEN 'High' THEN 'error' WHEN 'Medium' THEN 'warning' WHEN 'Low' THEN 'note' ELSE 'none' END"


@query(
    "sarif_results",
    f"WITH {BASE_SQL} SELECT path AS target, source AS uri, 'RULE' || {_RULE} AS rule_id, {_SARIF_LEVEL} AS level, vulnerability_type, cvss_score, cwe_id, r.name AS rule_name "
    f"FROM findings LEFT JOIN {table_of([(f'{n:03d}', name) for n, name, *_ in M.SARIF_RULES], 'r', 'id, name')} ON r.id = {_RULE}",
)
def sarif_results(spark, sf_dir):
    rows = reports.sarif_results(base_findings(spark, sf_dir))
    rules = reports.sarif_rules(spark).select("rule_id", F.col("name").alias("rule_name"))
    return rows.join(F.broadcast(rules), "rule_id", "left").select(
        "target", "uri", "rule_id", "level", "vulnerability_type", "cvss_score", "cwe_id", "rule_name"
    )


@query(
    "sarif_documents",
    f"WITH {BASE_SQL} SELECT path AS target, source AS uri, 'RULE' || {_RULE} AS rule_id, {_SARIF_LEVEL} AS level FROM findings",
)
def sarif_documents(spark, sf_dir):
    # Read back from the documents, in parts of at most a few findings.
    documents = reports.sarif_documents(incremental.kept(base_findings(spark, sf_dir), "findings"), part_size=3)
    result = "struct<ruleId:string,level:string,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>>"
    parsed = F.from_json("document", f"struct<runs:array<struct<results:array<{result}>>>>")
    rows = documents.select("target", F.explode(parsed["runs"][0]["results"]).alias("r"))
    return rows.select(
        "target", F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("uri"),
        F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"),
    )


@query(
    "sink_json",
    f"""WITH {BASE_SQL}, g AS (SELECT path AS target, count(*) AS n, count(*) FILTER (level = 'Critical') AS critical FROM findings GROUP BY path)
    SELECT target, n AS findings, '{{"total_vulnerabilities":' || n || ',"critical":' || critical || '}}' AS counts, true AS redacted FROM g""",
)
def sink_json(spark, sf_dir):
    made = reports.json_reports(incremental.kept(base_findings(spark, sf_dir), "findings"), part_size=4, include_evidence=False, include_references=False)
    counts = F.from_json("summary", "struct<total_vulnerabilities:bigint,critical:bigint>")
    rows = F.from_json("vulnerabilities", "array<struct<id:string,evidence:map<string,string>,references:array<string>>>")
    hidden = F.forall(rows, lambda r: (r["evidence"]["redacted"] == "true") & r["references"].isNull())
    return made.groupBy("target").agg(
        F.sum(F.size(rows)).alias("findings"), F.to_json(F.first(counts)).alias("counts"), F.bool_and(hidden).alias("redacted")
    )


@query(
    "src_report",
    f"WITH {BASE_SQL} SELECT source, scanner, vulnerability_type, level, cvss_score, cwe_id FROM findings",
)
def src_report(spark, sf_dir):
    found = incremental.kept(base_findings(spark, sf_dir), "findings")
    documents = reports.json_documents(reports.json_reports(found, part_size=100))
    read = report_source.parse(documents.select(F.col("target").alias("path"), F.col("document").alias("text")))
    return flat(read).select("source", "scanner", "vulnerability_type", "level", "cvss_score", "cwe_id")


_MS_LEVEL = "CASE word WHEN 'CRITICAL' THEN 'Critical' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Medium' ELSE 'Low' END"
_MS_SCORE = "CASE word WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 7.5 WHEN 'MEDIUM' THEN 5.5 WHEN 'LOW' THEN 3.0 ELSE 5.5 END"
_MS_CWE = "CASE module " + " ".join(f"WHEN '{m}' THEN '{c}'" for m, c in M.MODELSCAN_CWE.items()) + " ELSE 'CWE-502' END"


@query(
    "src_external_modelscan",
    f"""WITH m AS ({I.portable(I.MODELSCAN)}), i AS (SELECT path, word, module, 'f' AS operator FROM m UNION ALL SELECT path, 'LOW2', 'unknown', 'g' FROM m)
    SELECT """ + finding("path", "modelscan", "'ModelScan - Unsafe Operator (' || word || ')'", _MS_LEVEL, _MS_SCORE, "@" + _MS_CWE, module="module", operator="operator")
    + " FROM i",
)
def src_external_modelscan(spark, sf_dir):
    return flat(external.modelscan(I.derive(spark, sf_dir, I.MODELSCAN).select("path", "text")), "module", "operator")


_GD_WORD = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{w}'" for r, w in M.GUARDDOG_LEVELS.items()) + " ELSE 'MEDIUM' END"
_GD_CWE = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{c}'" for r, c in M.GUARDDOG_CWE.items()) + " ELSE 'CWE-1357' END"


@query(
    "src_external_guarddog",
    f"""WITH g AS ({I.portable(I.GUARDDOG)}), i AS (SELECT path, rule FROM g WHERE custkey % 3 <> 0 UNION ALL SELECT path, rule FROM g
      UNION ALL SELECT path, 'empty_information' FROM g), w AS (SELECT path, rule, {_GD_WORD} AS word FROM i) SELECT """
    + finding("path", "guarddog", "'GuardDog - ' || rule", _MS_LEVEL,
              "CASE word WHEN 'CRITICAL' THEN 9.5 WHEN 'HIGH' THEN 8.0 ELSE 5.5 END", "@" + _GD_CWE, rule="rule")
    + " FROM w",
)
def src_external_guarddog(spark, sf_dir):
    return flat(external.guarddog(I.derive(spark, sf_dir, I.GUARDDOG).select("path", "text")), "rule")


# --- incremental scans ------------------------------------------------------------


@query("stream_scan", secrets_sql("SELECT 'doc/' || doc_id AS source, text FROM documents"))
def stream_scan(spark, sf_dir):
    """Secrets in the documents, read as a stream and written by batches."""
    work = f"{incremental.checkpoint_dir(spark, 'stream_scan')}/{spark.sparkContext.applicationId}-{incremental.stamp()}"
    path = f"{sf_dir}/documents.parquet"
    documents = incremental.table_stream(spark, path, spark.read.parquet(path).schema)
    texts = documents.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("source"),
        "text",
    )
    incremental.scan_stream(texts, textscan.secrets_scan, f"{work}/findings", f"{work}/progress").awaitTermination()
    return flat(spark.read.parquet(f"{work}/findings"), "masked", "matches")


@query(
    "stream_changed_only",
    """SELECT 'doc/' || d.doc_id AS path, left(md5(strlen(d.text) || d.text), 16) AS quick_id FROM documents d
    LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.quality = 0""",
)
def stream_changed_only(spark, sf_dir):
    """Two runs of one stream: the labelled documents in earlier versions, of which those labelled good have not changed
    since, then all documents as they are; what the second run takes up is still to scan."""
    docs = I.table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    # Texts are digested where they are read; what is joined is their digests.
    good = F.col("quality").eqNullSafe(1)
    labels = I.table(spark, sf_dir, "labels").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), good.alias("good"))
    same = incremental.digested(docs, 0).join(labels.where("good").select("path"), "path")
    other = docs.select("path").join(labels.where("not good"), "path").select("path", F.encode(F.lit("old"), "UTF-8").alias("content"))
    before = same.unionByName(incremental.digested(other, 0))
    work = f"{incremental.checkpoint_dir(spark, 'stream_changed_only')}/{spark.sparkContext.applicationId}-{incremental.stamp()}"
    for run, drop in enumerate((before, incremental.digested(docs, 1))):
        drop.write.mode("append").parquet(f"{work}/inbox")
        stream = incremental.versions(spark, f"{work}/inbox")
        incremental.scan_changed_stream(stream, lambda rows: rows, f"{work}/changed-{run}", f"{work}/progress").awaitTermination()
    todo = spark.read.schema(incremental.VERSIONS).parquet(f"{work}/changed-1").select("path")
    return incremental.with_quick_id(docs).select("path", "quick_id").join(todo, "path")
