"""A scan of files of any size by their paths.

No row holds a file. Its first and last bytes are read once for what stands
there; its chunks are read once, each by its own task, and leave *signals*: which
rule, operator, marker or URL was met, where first, and how often. Signals of a
file are combined before and behind one shuffle, and findings are made of the
combined ones. Parsers of structure page through the file themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions import bytesx as B
from tamperlens.functions.findings import findings_of, hits_if
from tamperlens.functions.groups import first_per_key
from tamperlens.operators import algebra, formats, gguf, graphs, metadata, polyglot, refs, textscan
from tamperlens.rules import markers as M
from tamperlens.rules import text_rules as R
from tamperlens.schema import MEMBER_CONTENTS
from tamperlens.sources import members
from tamperlens.sources.chunks import CHUNK, aligned, plan, read
from tamperlens.sources.paged import Pages, ends, per_file

# Bytes read behind a chunk: a zip record with the longest possible name fits.
HALO = (1 << 16) + 64
# What a chunk needs to know of its file.
CARRIED = ("length", "scanners", "archive_kind", "formats")


def routed_files(files: DataFrame, include: list[str] | None, exclude: list[str] | None) -> DataFrame:
    """Files (path) with their first and last bytes (``content``, ``tail``), routed to detectors."""
    opened = ends(files, metadata.HEADER_WINDOW, polyglot.SEARCH_TAIL)
    resolved = formats.resolve(opened).withColumn("source", F.col("path"))
    return resolved.withColumns(
        {
            "scanners": formats.scanners_for(F.col("path"), F.col("extension"), F.col("format"), include, exclude),
            "formats": polyglot.signature_formats(F.substring("content", 1, 32)),
        }
    )


def head_findings(routed: DataFrame) -> DataFrame:
    """What the first and last bytes of a file show."""
    content, signed = F.col("content"), F.col("formats")
    on = lambda name, hits: F.when(F.array_contains("scanners", name), hits)
    header = gguf.header_columns(
        B.unsigned_le(content, 4, 4).cast("bigint"), B.unsigned_le(content, 8, 8), B.unsigned_le(content, 16, 8), F.col("length")
    )
    views = routed.withColumns(
        {"window": B.latin1(content), "head": B.latin1(F.substring(content, 1, polyglot.SEARCH_HEAD)), "last": B.latin1(F.col("tail"))}
    )
    groups = [
        on("metadata", F.concat(metadata.long_segment_columns(F.col("window")), metadata.code_pattern_columns(F.col("window")))),
        on("gguf", F.when(B.starts_with(content, b"GGUF"), header)),
        on(
            "polyglot",
            F.concat(
                polyglot.mismatch_columns(F.col("path"), content, signed),
                polyglot.multiple_columns(signed),
                polyglot.embedded_columns(F.col("head"), F.col("last"), signed),
            ),
        ),
    ]
    return findings_of(views, F.flatten(F.array_compact(F.array(*groups))))


def _signal(kind: str, key, at=None, n=None, text=None) -> Column:
    cells = (("kind", F.lit(kind), "string"), ("key", key, "string"), ("at", at, "bigint"), ("n", n, "bigint"), ("text", text, "string"))
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).cast(t).alias(name) for name, c, t in cells])


def _met(tests: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(test, signal) for test, signal in tests]))


def signals(chunks: DataFrame) -> DataFrame:
    """(path, kind, key, first, last, n, text, last_text): what the chunks of a file show, combined.

    ``text`` belongs to the first place, ``last_text`` to the last one. Patterns
    are sought in a chunk and the bytes behind it; what is counted is counted in
    aligned texts, which do not overlap.
    """
    text, lowered, own, start = F.col("text"), F.col("lowered"), F.col("own"), F.col("offset")
    views = chunks.withColumns({"text": B.latin1(F.concat("bytes", "halo")), "own": F.col("aligned")}).withColumns(
        {"lowered": F.lower("text"), "own_lowered": F.lower("own")}
    )
    on = lambda name, found: F.when(F.array_contains("scanners", name), found)
    secrets = []
    for i, rule in enumerate(R.SECRETS):
        masked, matches = textscan.secret_matches(own, rule)
        secrets.append((textscan.matches_rule(own, F.col("own_lowered"), rule), _signal("secret", str(i), start, matches, masked)))
    template = F.array_compact(F.array(gguf.template_match(text)))
    places = [(B.find_offset(text, raw), i) for i, (raw, *_) in enumerate(M.GGUF_BYTE_MARKERS)]
    picture = polyglot.picture_ends(B.latin1(F.concat("bytes", F.substring("halo", 1, 3))), text, F.col("formats"))
    unzipped = ~F.coalesce(F.col("archive_kind") == "zip", F.lit(False))
    listed = lambda kind, urls: F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: _signal(kind, u, None, 1))
    groups = [
        on("lambda_layer", F.transform(textscan.rule_numbers(text, lowered), lambda i: _signal("rule", i.cast("string")))),
        on("secrets", _met(secrets)),
        on("graph_injection", F.transform(graphs.ops_in(text), lambda op: _signal("op", op))),
        on(
            "gguf",
            F.concat(
                # Of several patterns the first rule counts, at its first place.
                F.transform(
                    template,
                    lambda m: _signal("template", F.concat(F.lpad(m["rule"].cast("string"), 4, "0"), F.lit(" "), m["pattern"]), start + m["offset"], None, gguf.template_context(text, m)),
                ),
                _met([(gguf.traversal_test(text, p), _signal("traversal", str(i))) for i, p in enumerate(R.PATH_TRAVERSAL)]),
                _met([(at.isNotNull(), _signal("marker", str(i), start + at)) for at, i in places]),
            ),
        ),
        on("polyglot", F.transform(picture, lambda p: _signal("end", p["format"], start + p["at"], None, p["text"]))),
        on("external_ref", F.when(unzipped, F.concat(listed("url", refs.urls_in(own)), listed("internal", refs.internal_urls_in(own))))),
        on(
            "pickle",
            _met(
                [
                    (F.contains(lowered, F.lit("base64")), _signal("mark", "base64")),
                    (F.contains(text, F.lit("eval(")) | F.contains(text, F.lit("exec(")), _signal("mark", "evaluator")),
                ]
            ),
        ),
    ]
    met = views.select("path", F.inline(F.flatten(F.array_compact(F.array(*groups)))))
    return met.groupBy("path", "kind", "key").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.sum("n").alias("n"), F.min_by("text", "at").alias("text"), F.max_by("text", "at").alias("last_text")
    )


def signal_findings(found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Findings of combined signals; ``lengths`` has (path, length)."""
    of = lambda kind: found.where(F.col("kind") == kind).withColumn("source", F.col("path"))
    number = F.col("key").cast("int")
    table = textscan.rule_details()
    rules = findings_of(of("rule"), F.array(F.element_at(table, number)))
    secrets = findings_of(of("secret"), hits_if(*[(number == i, textscan.secret_hit(r, F.col("text"), F.col("n"))) for i, r in enumerate(R.SECRETS)]))
    ops = of("op").groupBy("path", "source").agg(F.array_sort(F.collect_set("key")).alias("ops"))
    first_rule = first_per_key(of("template"), ["path", "source"], ["key", "first"])
    templates = findings_of(first_rule, F.array(gguf.template_hit(F.substring("key", 6, 2**30), F.col("first"), F.col("text"))))
    traversal = findings_of(of("traversal"), hits_if(*[(number == i, gguf.traversal_hit(p)) for i, p in enumerate(R.PATH_TRAVERSAL)]))
    marks = findings_of(of("marker"), hits_if(*[(number == i, gguf.marker_hit(raw, kind, F.col("first"))) for i, (raw, kind, _) in enumerate(M.GGUF_BYTE_MARKERS)]))
    place, opening = (F.when(F.col("key") == "png", F.col(a)).otherwise(F.col(b)) for a, b in (("first", "last"), ("text", "last_text")))
    behind = of("end").join(lengths, "path").withColumns({"size": F.col("length") - place, "opening": opening}).where("size > 10")
    trailing = findings_of(behind, F.array(polyglot.trailing_hit(polyglot.format_of(F.col("opening")), F.col("size"))))
    each = lambda kind: of(kind).select("path", "source", F.col("key").alias("url"), F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).drop("col")
    urls = refs.described(each("url"))
    return algebra.union(
        [
            rules, secrets, findings_of(ops, graphs.class_columns(F.col("ops"))), templates, traversal, marks, trailing,
            refs.ssrf_of(each("internal")), refs.local_files(urls), refs.unknown_domains(urls),
        ]
    )


def pickle_marks(found: DataFrame) -> DataFrame:
    """(source, base64, evaluator) flags of files, out of their signals."""
    mark = lambda key: F.bool_or(F.col("key") == key)
    return found.where(F.col("kind") == "mark").groupBy(F.col("path").alias("source")).agg(mark("base64").alias("base64"), mark("evaluator").alias("evaluator"))


def chunks_of(routed: DataFrame, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Chunks of the files, with what detectors need to know of the file, and the aligned text of each."""
    cut = read(plan(routed.select("path", *CARRIED), chunk), chunk, halo, CARRIED)
    return cut.withColumn("aligned", aligned(chunk, halo))


def listings(routed: DataFrame, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Members of archives: zip records out of chunks, tar headers out of pages."""
    zips, tars = routed.where(F.col("archive_kind") == "zip"), routed.where(F.startswith("archive_kind", F.lit("tar")))
    pieces = read(plan(zips.select("path", "length"), chunk), chunk, halo)
    return members.zip_members(pieces).unionByName(members.tar_members(tars.select("path")))


def _whole(path: str, data: Pages) -> list[tuple]:
    if len(data) > members.MEMBER:
        return [(path, None, None, f"file of over {members.MEMBER} bytes was not read whole")]
    return [(path, None, data[:], None)]


def whole_files(files: DataFrame) -> DataFrame:
    """(path, entry, content, error) of files that a parser needs whole, such as requirement lists; never of more than a member's size."""
    return per_file(files.select("path"), _whole, MEMBER_CONTENTS, heavy=2)


