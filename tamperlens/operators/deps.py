"""Dependencies declared beside models, and names that look like traps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamperlens.functions.findings import as_findings
from tamperlens.functions.groups import small_table
from tamperlens.functions.ordered import carry_forward
from tamperlens.functions.paths import base_name
from tamperlens.functions.text import any_contains, first_match
from tamperlens.rules import markers as M

SCANNER = "dependency"
# Similarity that counts, and that of one edit.
THRESHOLD, ONE_SUBSTITUTION, ONE_INSERTION = 0.85, 0.95, 0.92


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("path", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _requirement(line: Column) -> Column:
    """STRUCT<name, raw, dep_type> of one requirement; NULL when it is none."""
    spec = F.trim(F.split_part(line, F.lit(";"), F.lit(1)))
    url = F.rlike(spec, F.lit(r"^(git\+|https?://)"))
    name = F.lower(F.regexp_extract(spec, r"^([a-zA-Z0-9_-]+)", 1))
    struct = lambda n, kind: F.struct(n.alias("name"), spec.alias("raw"), F.lit(kind).alias("dep_type"))
    return F.when(url, struct(F.lit("__url_dependency__"), "url")).when(name != "", struct(name, "package"))


def _deps(rows: DataFrame) -> DataFrame:
    # A generator reads a line once; a filter would read it again for every field that is asked for.
    return rows.select("path", "source", F.inline(F.array_compact(F.array("dep"))))


def requirements(texts: DataFrame) -> DataFrame:
    """(path, source, name, raw, dep_type) of requirement files."""
    line = F.trim("line")
    index = F.contains(line, F.lit("--index-url")) | F.contains(line, F.lit("--extra-index-url"))
    custom = F.struct(
        F.lit("__custom_index__").alias("name"), line.alias("raw"), F.lit("custom_index").alias("dep_type")
    )
    dep = (
        F.when((line == "") | F.startswith(line, F.lit("#")), F.lit(None))
        .when(F.startswith(line, F.lit("-")), F.when(index, custom))
        .otherwise(_requirement(line))
    )
    return _deps(_lines(texts).select("path", "source", dep.alias("dep")))


def quoted_requirements(texts: DataFrame) -> DataFrame:
    """(path, source, quoted): the quoted strings of dependency lists.

    Whether a line lies in a list is the latest opening or closing line above
    it, so files of any length are handled line by line.
    """
    opens = F.contains(F.lower("line"), F.lit("dependencies")) & F.contains("line", F.lit("="))
    closes = F.startswith(F.trim("line"), F.lit("]"))
    turn = F.when(opens, True).when(closes, False)
    lines = carry_forward(_lines(texts), ["path", "source"], "line_no", turn, "inside")
    quoted = F.regexp_extract("line", r'"([^"]+)"', 1)
    return lines.where(F.col("inside") & ~opens & (quoted != "")).select("path", "source", quoted.alias("quoted"))


def pyproject(texts: DataFrame) -> DataFrame:
    """(path, source, name, raw, dep_type) of the dependency lists of project files."""
    rows = quoted_requirements(texts)
    return _deps(rows.select("path", "source", _requirement(F.col("quoted")).alias("dep")))


def setup_py(texts: DataFrame) -> DataFrame:
    """Quoted strings inside ``install_requires=[...]``."""
    block = F.regexp_extract("text", r"(?s)install_requires\s*=\s*\[(.*?)\]", 1)
    quoted = F.regexp_extract_all(block, F.lit(r"""["']([^"']+)["']"""), 1)
    rows = texts.where(F.contains("text", F.lit("install_requires"))).select(
        "path", "source", F.explode(quoted).alias("spec")
    )
    return _deps(rows.select("path", "source", _requirement(F.col("spec")).alias("dep")))


def wheel(texts: DataFrame) -> DataFrame:
    """``Requires-Dist`` lines of wheel metadata."""
    rows = _lines(texts).where(F.startswith("line", F.lit("Requires-Dist:")))
    spec = F.trim(F.substr("line", F.lit(len("Requires-Dist:") + 1)))
    return _deps(rows.select("path", "source", _requirement(spec).alias("dep")))


def file_parser(path: Column, entry: Column) -> Column:
    """Which parser reads a file, or a member ``entry`` of it; NULL when none does."""
    name = base_name(path)
    plain = entry.isNull()
    is_wheel = F.endswith(F.lower(path), F.lit(".whl"))
    return (
        F.when(plain & (name.isin(M.REQUIREMENT_FILES) | F.rlike(name, F.lit(r"^requirements.*\.txt$"))), "requirements")
        .when(plain & (name == "pyproject.toml"), "pyproject")
        .when(plain & (name == "setup.py"), "setup_py")
        .when(is_wheel & (F.endswith(entry, F.lit("METADATA")) | F.endswith(entry, F.lit("metadata.json"))), "wheel")
        .when(~is_wheel & F.endswith(entry, F.lit("requirements.txt")), "requirements")
    )


def dependency_files(paths: DataFrame) -> DataFrame:
    """(path, parser) for the files and members that hold requirements.

    ``paths`` has ``path``, and ``entry`` for members (NULL for plain files).
    """
    parser = file_parser(F.col("path"), F.col("entry"))
    return paths.select("path", "entry", parser.alias("parser")).where(F.col("parser").isNotNull())


def requirement_names(specs: Column) -> Column:
    """Package name of a requirement string: what precedes an extra or a version."""
    return F.trim(F.regexp_extract(specs, r"^([^\[><=!]*)", 1))


def custom_index(deps: DataFrame) -> DataFrame:
    return as_findings(
        deps.where(F.col("dep_type") == "custom_index"), SCANNER, "Dependency Hijacking - Custom Index", "High", 7.5,
        "Packages come from a custom index",
        evidence={"raw": F.col("raw")}, advice="Check that the index is trusted.", cwe="CWE-494",
    )


def url_dependency(deps: DataFrame) -> DataFrame:
    suspicious = any_contains(F.lower("raw"), M.SUSPICIOUS_HOSTS)
    return as_findings(
        deps.where(F.col("dep_type") == "url"), SCANNER, "Dependency Hijacking - URL Dependency",
        F.when(suspicious, "High").otherwise("Medium"), F.when(suspicious, 7.0).otherwise(5.5),
        "A package is fetched from a URL",
        evidence={"raw": F.col("raw")}, advice="Prefer a versioned package of the index.", cwe="CWE-829",
    )


def _normal(name: Column) -> Column:
    return F.translate(F.lower(name), "-_", "")


def _substrings(text: Column) -> Column:
    """All substrings, longest first, those of a length by their start."""
    of_length = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.flatten(F.transform(F.sequence(F.length(text), F.lit(1), F.lit(-1)), of_length))


def sequence_ratio(left: Column, right: Column) -> Column:
    """Matching-blocks similarity of two names: twice the letters in matching blocks, over all letters.

    A fold over a list of open pairs of texts: the longest common block of the
    last pair (earliest on the left, then on the right) is counted, and what lies
    before and behind it on both sides is open again. The number of pairs is
    bounded by the letters of the shorter name.
    """
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    longest = lambda p: F.get(F.filter(_substrings(p["x"]), lambda s: F.contains(p["y"], s)), F.lit(0))
    state = lambda pairs, matched: F.struct(pairs.alias("open"), matched.alias("matched"))

    def split(p: Column, block: Column) -> Column:
        """The pairs before and behind a block, where both sides have letters."""
        i, j = F.instr(p["x"], block), F.instr(p["y"], block)
        before = pair(F.substring(p["x"], F.lit(1), i - 1), F.substring(p["y"], F.lit(1), j - 1))
        size = F.length(block)
        behind = pair(F.substring(p["x"], i + size, F.length(p["x"])), F.substring(p["y"], j + size, F.length(p["y"])))
        return F.filter(F.array(before, behind), lambda q: (q["x"] != "") & (q["y"] != ""))

    def step(now: Column, _: Column) -> Column:
        def counted(found: Column) -> Column:
            rest = F.slice(now["open"], F.lit(1), F.size(now["open"]) - 1)
            none = state(rest, now["matched"])
            some = state(F.concat(rest, split(found["pair"], found["block"])), now["matched"] + F.length(found["block"]))
            return F.when(found["block"].isNull(), none).otherwise(some)

        last = F.element_at(now["open"], -1)
        found = F.transform(F.array(last), lambda p: F.struct(p.alias("pair"), longest(p).alias("block")))
        return F.when(F.size(now["open"]) == 0, now).otherwise(F.get(F.transform(found, counted), F.lit(0)))

    steps = F.sequence(F.lit(1), F.least(F.length(left), F.length(right)) * 2 + 1)
    start = state(F.filter(F.array(pair(left, right)), lambda q: (q["x"] != "") & (q["y"] != "")), F.lit(0))
    matched = F.aggregate(steps, start, step)["matched"]
    return matched * 2.0 / (F.length(left) + F.length(right))


def popular_packages(spark: SparkSession, names: list[str] = M.POPULAR_PACKAGES) -> DataFrame:
    return small_table(spark, [(n,) for n in names], "popular string")


def _candidates(names: DataFrame, popular: DataFrame) -> DataFrame:
    """Pairs of names close enough in length for a similarity of 0.85.

    The shorter of two such names has at least 0.74 times the letters of the
    longer, so each popular name is offered under the few lengths it can meet
    and the join is an equality on length. Exact names are left out first.
    """
    listed = popular.select("popular", _normal(F.col("popular")).alias("target"))
    lengths = F.sequence(
        F.least(F.floor(F.length("target") * 0.73), F.length("target") - 1).cast("int"),
        F.greatest(F.ceil(F.length("target") * 1.37), F.length("target") + 1).cast("int"),
    )
    offered = listed.withColumn("size", F.explode(lengths))
    unknown = (
        names.select("name")
        .distinct()
        .withColumn("plain", _normal(F.col("name")))
        .join(listed.select(F.col("target").alias("plain")).distinct(), "plain", "left_anti")
        .withColumn("size", F.length("plain"))
    )
    return unknown.join(offered, "size").drop("size")


def _one_edit(pairs: DataFrame) -> DataFrame:
    """Add ``edit``: the similarity of one substitution, insertion or deletion."""
    distance = F.levenshtein("plain", "target", 1)
    same = F.length("plain") == F.length("target")
    return pairs.withColumn(
        "edit", F.when(distance == 1, F.when(same, ONE_SUBSTITUTION).otherwise(ONE_INSERTION))
    )


def _best(pairs: DataFrame, score: str) -> DataFrame:
    """Best target per name; equal scores go to the name first in order.

    A name meets each popular name once, so its group is as short as that list.
    """
    best = F.min(F.struct((-F.col(score)).alias("distance"), F.col("popular")))
    return (
        pairs.groupBy("name").agg(best.alias("best"))
        .select("name", F.col("best.popular").alias("target"), (-F.col("best.distance")).alias("similarity"))
    )


def single_edit_lookalikes(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target, similarity) of names one edit away from a popular one."""
    pairs = _one_edit(_candidates(names, popular)).where(F.col("edit").isNotNull())
    return _best(pairs, "edit")


def lookalikes(names: DataFrame, popular: DataFrame) -> DataFrame:
    """(name, target, similarity) of names that imitate a popular one.

    A ratio of 0.85 allows an insert/delete distance of 0.15 times the letters
    of both names, and the edit distance is no larger: pairs beyond that are
    not compared block by block.
    """
    pairs = _candidates(names, popular)
    allowed = F.floor((F.length("plain") + F.length("target")) * 0.15 + 1e-9)
    near = _one_edit(pairs).where(
        F.col("edit").isNotNull() | (F.levenshtein("plain", "target") <= allowed)
    )
    scored = near.withColumn(
        "score", F.greatest(F.coalesce("edit", F.lit(0.0)), sequence_ratio(F.col("plain"), F.col("target")))
    ).where(F.col("score") >= THRESHOLD)
    return _best(scored, "score")


def _packages(deps: DataFrame) -> DataFrame:
    return deps.where(F.col("dep_type") == "package")


def typosquat(deps: DataFrame, similar: DataFrame) -> DataFrame:
    """Findings for dependencies whose name is in ``similar``."""
    rows = _packages(deps).join(similar, "name")
    return as_findings(
        rows, SCANNER, "Dependency Hijacking - Typosquatting", "High", 8.0,
        F.concat(F.col("name"), F.lit(" looks like "), F.col("target")),
        evidence={
            "suspicious_package": F.col("name"), "likely_target": F.col("target"),
            "similarity": F.round("similarity", 6),
        },
        advice="Check that this package is the intended one.", cwe="CWE-494",
    )


def suspicious_pattern(name: Column) -> Column:
    return first_match([(F.rlike(name, F.lit(f"(?i){p}")), d) for p, d in M.SUSPICIOUS_NAMES])


def suspicious_names(deps: DataFrame, similar: DataFrame) -> DataFrame:
    """Names of a suspicious shape that are not lookalikes already."""
    rows = (
        _packages(deps)
        .withColumn("pattern", suspicious_pattern(F.col("name")))
        .where(F.col("pattern").isNotNull())
        .join(similar.select("name"), "name", "left_anti")
    )
    return as_findings(
        rows, SCANNER, "Dependency Hijacking - Suspicious Name", "Medium", 5.0,
        F.concat(F.col("name"), F.lit(": "), F.col("pattern")),
        evidence={"package": F.col("name"), "pattern": F.col("pattern")},
        advice="Check that this package is legitimate.", cwe="CWE-494",
    )


def dependency_findings(deps: DataFrame, popular: DataFrame) -> DataFrame:
    similar = lookalikes(_packages(deps), popular)
    return (
        custom_index(deps)
        .unionByName(url_dependency(deps))
        .unionByName(typosquat(deps, similar))
        .unionByName(suspicious_names(deps, similar))
    )
