"""Pickles, GGUF, weights, metadata and Keras configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamperlens.functions.findings import flat
from tamperlens.functions.groups import fixed
from tamperlens.operators import gguf, jsonwalk, keras, metadata, pickles, weights
from tamperlens.plans import inputs as I
from tamperlens.plans.queries_text import rules_sql
from tamperlens.plans.registry import finding, q, query, table_of
from tamperlens.rules import markers as M
from tamperlens.rules import text_rules as R
from tamperlens.sources import binary, members
from tamperlens.streaming import incremental

# --- pickles --------------------------------------------------------------------

_PUSH = "(" + ", ".join(q(o) for o in pickles.STRING_PUSH) + ")"
_GETS = "(" + ", ".join(q(o) for o in pickles.MEMO_GET) + ")"
_PUTS = "(" + ", ".join(q(o) for o in [*pickles.MEMO_PUT, "MEMOIZE"]) + ")"
_BAD_OPS = "(" + ", ".join(q(o) for o in M.DANGEROUS_OPCODES) + ")"
_IMPORTS = f"""ops AS MATERIALIZED ({I.portable(I.OPCODES)}),
step AS (SELECT *, count(*) FILTER (opcode IN {_PUTS}) OVER w AS puts,
   lag(CASE WHEN opcode IN {_PUSH} THEN arg END) OVER w AS prior FROM ops WINDOW w AS (PARTITION BY source ORDER BY seq)),
slots AS (SELECT source, seq, opcode, CASE WHEN opcode = 'MEMOIZE' THEN puts - 1 ELSE try_cast(arg AS BIGINT) END AS slot,
   CASE WHEN opcode IN {_PUTS} THEN coalesce(prior, chr(1)) END AS stored FROM step WHERE opcode IN {_PUTS} OR opcode IN {_GETS}),
reads AS (SELECT source, seq, opcode, last_value(stored IGNORE NULLS) OVER (PARTITION BY source, slot ORDER BY seq) AS text FROM slots),
pushes AS (SELECT source, seq, arg AS text FROM ops WHERE opcode IN {_PUSH}
   UNION ALL SELECT source, seq, text FROM reads WHERE opcode IN {_GETS} AND text <> chr(1)),
lined AS (SELECT source, seq, text, false AS takes FROM pushes
   UNION ALL SELECT source, seq, NULL, true FROM ops WHERE opcode = 'STACK_GLOBAL'),
tops AS (SELECT *, list(text) FILTER (NOT takes) OVER (PARTITION BY source ORDER BY seq) AS stack FROM lined),
imports AS MATERIALIZED (SELECT source, seq, stack[-2] AS module, stack[-1] AS name FROM tops WHERE takes AND len(stack) >= 2
   UNION ALL SELECT source, seq, split_part(arg, ' ', 1), regexp_replace(arg, '^[^ ]* ', '') FROM ops WHERE opcode = 'GLOBAL' AND contains(arg, ' '))"""
_LISTED = "(module, name) IN (" + ", ".join(f"({q(m)}, {q(n)})" for m, n in M.DANGEROUS_IMPORTS) + ")"
_DANGEROUS = f"({_LISTED} OR (module IN ('builtins', '__builtin__') AND name IN ('eval', 'exec', 'compile')))"
_SUSPICIOUS = f"(module IN ({', '.join(q(m) for m in M.SUSPICIOUS_MODULES)}) AND NOT {_LISTED})"


def _ops(spark, sf_dir):
    return I.derive(spark, sf_dir, I.OPCODES)


@query(
    "pkl_opcodes",
    f"""SELECT source, i AS seq, [0, 2, 2 + strlen(module) + strlen(name) + 3, strlen(module) + strlen(name) + 6, strlen(module) + strlen(name) + 7][i + 1] AS pos,
    ['PROTO', 'GLOBAL', 'POP', 'NONE', 'STOP'][i + 1] AS opcode, CASE i WHEN 0 THEN '2' WHEN 1 THEN module || ' ' || name END AS arg
    FROM ({I.portable(I.PICKLES)}), range(0, 5) AS r(i)""",
)
def pkl_opcodes(spark, sf_dir):
    return binary.opcodes(I.derive(spark, sf_dir, I.PICKLES))


@query("pkl_triage", f"SELECT source, module, name FROM ({I.portable(I.PICKLES)})")
def pkl_triage(spark, sf_dir):
    return pickles.triage_imports(I.derive(spark, sf_dir, I.PICKLES).withColumnRenamed("source", "path"))


@query("pkl_imports", f"WITH {_IMPORTS} SELECT source, seq, module, name FROM imports")
def pkl_imports(spark, sf_dir):
    return pickles.imports(_ops(spark, sf_dir))


@query(
    "pkl_dangerous_ops",
    f"WITH ops AS ({I.portable(I.OPCODES)}) SELECT source, string_agg(DISTINCT opcode, ',' ORDER BY opcode) AS opcodes FROM ops "
    f"WHERE opcode IN {_BAD_OPS} GROUP BY source",
)
def pkl_dangerous_ops(spark, sf_dir):
    return pickles.dangerous_opcodes(_ops(spark, sf_dir)).select("source", F.array_join("opcodes", ",").alias("opcodes"))


@query("pkl_dangerous_imports", f"WITH {_IMPORTS} SELECT source, seq, module, name FROM imports WHERE {_DANGEROUS}")
def pkl_dangerous_imports(spark, sf_dir):
    return pickles.dangerous_imports(pickles.imports(_ops(spark, sf_dir)))


@query("pkl_suspicious_imports", f"WITH {_IMPORTS} SELECT source, seq, module, name FROM imports WHERE {_SUSPICIOUS}")
def pkl_suspicious_imports(spark, sf_dir):
    return pickles.suspicious_imports(pickles.imports(_ops(spark, sf_dir)))


_REASONS = f"""counted AS (SELECT source, count(*) FILTER (opcode = 'REDUCE') AS r, count(*) FILTER (opcode IN ('GLOBAL', 'STACK_GLOBAL')) AS g,
  bool_or(contains(lower(coalesce(arg, '')), 'base64')) AS b, bool_or(contains(coalesce(arg, ''), 'eval(') OR contains(coalesce(arg, ''), 'exec(')) AS e
  FROM ops GROUP BY source),
reasons AS (SELECT source, array_to_string([x FOR x IN [CASE WHEN r > 10 THEN 'REDUCE opcodes: ' || r END, CASE WHEN g > 20 THEN 'GLOBAL imports: ' || g END,
  CASE WHEN b THEN 'base64 mentioned' END, CASE WHEN e THEN 'eval/exec text' END] IF x IS NOT NULL], ',') AS reasons FROM counted)"""


@query("pkl_obfuscation", f"WITH {_IMPORTS}, {_REASONS} SELECT source, reasons FROM reasons WHERE reasons <> ''")
def pkl_obfuscation(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    found = pickles.obfuscation(pickles.opcode_counts(ops), pickles.opcode_text_marks(ops))
    return found.select("source", F.array_join("reasons", ",").alias("reasons"))


def _names(test: str) -> str:
    return f"string_agg(DISTINCT CASE WHEN {test} THEN module || '.' || name END, ',' ORDER BY CASE WHEN {test} THEN module || '.' || name END)"


@query(
    "pkl_verdict",
    f"""WITH {_IMPORTS}, {_REASONS},
    found AS (SELECT source, {_names(_DANGEROUS)} AS d, {_names(_SUSPICIOUS)} AS s FROM imports GROUP BY source),
    bad AS (SELECT source, string_agg(DISTINCT opcode, ',' ORDER BY opcode) AS o FROM ops WHERE opcode IN {_BAD_OPS} GROUP BY source)
    SELECT """
    + finding(
        "source", "pickle",
        "CASE WHEN d IS NOT NULL THEN 'Pickle Exploit Payload - Code Execution Imports (targets pickle.load())' "
        "ELSE 'Pickle Suspicious Payload - Review Required (potential pickle.load() exploit)' END",
        "CASE WHEN d IS NOT NULL THEN 'Critical' ELSE 'High' END", "CASE WHEN d IS NOT NULL THEN 9.8 ELSE 7.5 END", "CWE-502",
        imports="coalesce(d, s)", opcodes="o",
    )
    + " FROM found JOIN bad USING (source) WHERE d IS NOT NULL OR s IS NOT NULL UNION ALL SELECT "
    + finding("source", "pickle", "'Pickle Deserialization - Obfuscation Detected'", "'Medium'", "5.5", "CWE-502",
              imports="NULL", opcodes="reasons")
    + " FROM reasons WHERE reasons <> ''",
)
def pkl_verdict(spark, sf_dir):
    return flat(pickles.verdicts(_ops(spark, sf_dir)), "imports", "opcodes")


_CALLERS = f"module IN ({', '.join(q(m) for m in M.CALL_MODULES)}) OR name IN ({', '.join(q(n) for n in M.CALL_FUNCTIONS)})"


@query(
    "pkl_call_summary",
    f"""WITH {_IMPORTS}, seen AS (SELECT source, seq, module, name, false AS r FROM imports
      UNION ALL SELECT source, seq, NULL, NULL, true FROM ops WHERE opcode = 'REDUCE'),
    called AS (SELECT source, r, last_value(module IGNORE NULLS) OVER w AS module, last_value(name IGNORE NULLS) OVER w AS name
      FROM seen WINDOW w AS (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT source, module || '.' || name AS call, count(*) AS calls FROM called WHERE r AND module IS NOT NULL AND ({_CALLERS}) GROUP BY ALL""",
)
def pkl_call_summary(spark, sf_dir):
    return pickles.call_summary(_ops(spark, sf_dir))


# --- GGUF -----------------------------------------------------------------------

_HEADERS = f"h AS (SELECT path, length, version, CAST(tensors AS HUGEINT) AS nt, CAST(entries AS HUGEINT) AS nk FROM ({I.portable(I.HEADERS)}))"
_MARK = "(" + ", ".join(f"{v}::HUGEINT" for v in M.GGUF_MARKERS) + ")"
_SIGN = "(" + ", ".join(f"{v}::HUGEINT" for v in M.GGUF_SIGN_MARKERS) + ")"


def _headers(spark, sf_dir):
    return gguf.headers(I.derive(spark, sf_dir, I.HEADERS).select("path", "length", "content"))


@query("gguf_header", f"WITH {_HEADERS} SELECT path, length, version, CAST(nt AS VARCHAR) AS n_tensors, CAST(nk AS VARCHAR) AS n_kv FROM h")
def gguf_header(spark, sf_dir):
    return _headers(spark, sf_dir).select(
        "path", "length", "version", F.col("n_tensors").cast("string").alias("n_tensors"), F.col("n_kv").cast("string").alias("n_kv")
    )


@query(
    "gguf_version",
    f"WITH {_HEADERS} SELECT "
    + finding("path", "gguf", f"CASE WHEN version IN {_MARK} THEN 'GGUF - Version Corruption Exploit' ELSE 'GGUF - Invalid Version' END",
              f"CASE WHEN version IN {_MARK} THEN 'Critical' WHEN version > 1000 THEN 'High' ELSE 'Medium' END",
              f"CASE WHEN version IN {_MARK} THEN 9.0 WHEN version > 1000 THEN 7.5 ELSE 5.0 END", "CWE-20",
              value="version", hex="printf('0x%X', version)")
    + f" FROM h WHERE version IN {_MARK} OR version < 1 OR version > 3",
)
def gguf_version(spark, sf_dir):
    return flat(gguf.version_check(_headers(spark, sf_dir)), "value", "hex")


_TENSOR_CASES = [
    (f"nt IN {_MARK}", "GGUF - Tensor Count Integer Overflow Exploit (CVE-2024-21836)", "Critical", "9.8", "CWE-190", "CVE-2024-21836"),
    (f"nt NOT IN {_MARK} AND nt > 104811045873349725", "GGUF - Tensor Count Integer Overflow (CVE-2024-21836)", "Critical", "9.8", "CWE-190", "CVE-2024-21836"),
    (f"nt NOT IN {_MARK} AND nt <= 104811045873349725 AND nt > 100000", "GGUF - Excessive Tensor Count (DoS)", "High", "7.5", "CWE-400", None),
    (f"nt NOT IN {_MARK} AND nt <= 104811045873349725 AND nt * 20 > length * 100", "GGUF - Tensor Count/File Size Mismatch", "High", "7.0", "CWE-20", None),
]


@query(
    "gguf_tensor_count",
    f"WITH {_HEADERS} " + " UNION ALL ".join(
        "SELECT " + finding("path", "gguf", q(kind), q(level), score, cwe, cve, value="nt", file_size="length") + f" FROM h WHERE {test}"
        for test, kind, level, score, cwe, cve in _TENSOR_CASES
    ),
)
def gguf_tensor_count(spark, sf_dir):
    return flat(gguf.tensor_count_check(_headers(spark, sf_dir)), "value", "file_size")


@query(
    "gguf_kv_count",
    f"WITH {_HEADERS} SELECT "
    + finding("path", "gguf",
              f"CASE WHEN nk IN {_MARK} THEN 'GGUF - Metadata Count Integer Overflow (DoS)' ELSE 'GGUF - Excessive Metadata Count (DoS)' END",
              f"CASE WHEN nk IN {_MARK} THEN 'Critical' ELSE 'High' END", f"CASE WHEN nk IN {_MARK} THEN 9.0 ELSE 7.5 END", "CWE-400", value="nk")
    + f" FROM h WHERE nk IN {_MARK} OR nk > 100000",
)
def gguf_kv_count(spark, sf_dir):
    return flat(gguf.kv_count_check(_headers(spark, sf_dir)), "value")


_KV_BYTES = """8 + length('k' || partkey) + 4 + CASE suppkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 8 + length('v' || suppkey)
  WHEN 2 THEN 12 + line ELSE 8 END"""


@query(
    "gguf_kv_dir",
    f"""WITH l AS (SELECT *, {_KV_BYTES} AS n FROM ({I.portable(I.LINES)}))
    SELECT 'g/' || file || '.gguf' AS path, row_number() OVER w - 1 AS idx, 24 + coalesce(sum(n) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset",
      length('k' || partkey) AS key_len, 'k' || partkey AS key, [4, 8, 9, 10][suppkey % 4 + 1] AS value_type,
      CASE WHEN suppkey % 4 = 1 THEN length('v' || suppkey) END AS str_len, CASE WHEN suppkey % 4 = 2 THEN 0 END AS arr_type,
      CASE WHEN suppkey % 4 = 2 THEN line END AS arr_len, false AS truncated
    FROM l WINDOW w AS (PARTITION BY file ORDER BY line)""",
)
def gguf_kv_dir(spark, sf_dir):
    kv = binary.gguf_kv(I.gguf_files(spark, sf_dir))
    return kv.select("path", "idx", "offset", "key_len", "key", "value_type", "str_len", "arr_type", "arr_len", "truncated")


_KV_CASES = [
    (f"key_len IN {_SIGN}", "GGUF - Signed/Unsigned Conversion Exploit", "Critical", 9.5, "CWE-195", "key_len"),
    (f"key_len IN {_MARK}", "GGUF - Metadata String Length Exploit", "Critical", 9.5, "CWE-120", "key_len"),
    ("key_len > 10485760", "GGUF - Excessive Metadata Key Length", "High", 8.0, "CWE-120", "key_len"),
    ("value_type > 12", "GGUF - Invalid Metadata Type", "Medium", 6.0, "CWE-20", "value_type"),
    (f"value_type = 8 AND str_len IN {_SIGN}", "GGUF - Token Length Signed Conversion Exploit", "Critical", 9.5, "CWE-195", "str_len"),
    (f"value_type = 8 AND str_len IN {_MARK}", "GGUF - Metadata String Value Length Exploit", "Critical", 9.0, "CWE-120", "str_len"),
    (f"value_type = 9 AND (arr_len IN {_MARK} OR arr_len IN {_SIGN})", "GGUF - Metadata Array Length Exploit", "Critical", 9.0, "CWE-190", "arr_len"),
    ("value_type = 9 AND arr_len > 10000000", "GGUF - Excessive Array Length", "High", 7.5, "CWE-400", "arr_len"),
    ("truncated", "GGUF - Truncated Metadata", "Medium", 5.5, "CWE-20", "'cut short'"),
]


def _first_case(cases, column: int, quoted: bool) -> str:
    body = " ".join(f"WHEN {c[0]} THEN {q(c[column]) if quoted else c[column]}" for c in cases)
    return f"CASE {body} END"


def _first_sql(rows: str, cases, with_cve: bool = False) -> str:
    """First row per file, in index order, that breaks a rule."""
    value = "CASE " + " ".join(f"WHEN {c[0]} THEN CAST({c[5]} AS VARCHAR)" for c in cases) + " END"
    cve = "CASE " + " ".join(f"WHEN {c[0]} THEN {q(c[6]) if c[6] else 'NULL'}" for c in cases) + " END" if with_cve else "CAST(NULL AS VARCHAR)"
    return f"""WITH r AS ({rows}), v AS (SELECT path, idx, {_first_case(cases, 1, True)} AS kind, {_first_case(cases, 2, True)} AS level,
    {_first_case(cases, 3, False)} AS score, {_first_case(cases, 4, True)} AS cwe, {value} AS val, {cve} AS cve FROM r),
    f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx) AS n FROM v WHERE kind IS NOT NULL) SELECT """ + finding(
        "path", "gguf", "kind", "level", "score", "@cwe", "@cve", value="val", index="idx"
    ) + " FROM f WHERE n = 1"


@query(
    "gguf_kv_checks",
    _first_sql("SELECT * REPLACE (CAST(key_len AS HUGEINT) AS key_len, CAST(str_len AS HUGEINT) AS str_len, CAST(arr_len AS HUGEINT) AS arr_len) "
               f"FROM ({I.portable(I.KV_ROWS)})", _KV_CASES),
)
def gguf_kv_checks(spark, sf_dir):
    return flat(gguf.kv_checks(I.derive(spark, sf_dir, I.KV_ROWS)), "value", "index")


@query(
    "gguf_tensor_dir",
    f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) - 1 AS i, sum({_KV_BYTES}) OVER (PARTITION BY file) AS kv FROM ({I.portable(I.LINES)}))
    SELECT 'g/' || file || '.gguf' AS path, i AS idx, 24 + kv + i * 42 AS "offset", 2 AS name_len, 2 AS n_dims, quantity || ',' || partkey AS dims FROM l""",
)
def gguf_tensor_dir(spark, sf_dir):
    rows = binary.gguf_tensors(I.gguf_files(spark, sf_dir))
    return rows.withColumn("dims", F.array_join(F.transform("dims", lambda d: d.cast("string")), ","))


def _tensor_rows(spark, sf_dir):
    rows = I.derive(spark, sf_dir, I.TENSOR_ROWS)
    return rows.withColumn("dims", F.array("dim0", "dim1")).drop("dim0", "dim1")


_FACTORS = "greatest(dim0, 1::HUGEINT)", "greatest(dim1, 1::HUGEINT)"
_OVER = f"({_FACTORS[0]} > 9223372036854775807 OR {_FACTORS[0]} > 9223372036854775807 // {_FACTORS[1]})"
_TENSOR_CHECKS = [
    (f"name_len IN {_MARK} OR name_len IN {_SIGN}", "GGUF - Tensor Name Length Exploit", "Critical", 9.0, "CWE-120", "name_len", None),
    ("name_len > 10485760", "GGUF - Excessive Tensor Name Length", "High", 7.5, "CWE-120", "name_len", None),
    ("n_dims > 4", "GGUF - Tensor Dimension Overflow (CVE-2024-21802)", "Critical", 9.0, "CWE-122", "n_dims", "CVE-2024-21802"),
    (f"dim0 IN {_MARK}", "GGUF - Tensor Dimension Exploit Value", "Critical", 9.0, "CWE-190", "dim0", None),
    ("dim0 > 9223372036854775807", "GGUF - Integer Overflow in Tensor Size", "Critical", 9.0, "CWE-190", "'size overflow'", "CVE-2025-53630"),
    (f"dim1 IN {_MARK}", "GGUF - Tensor Dimension Exploit Value", "Critical", 9.0, "CWE-190", "dim1", None),
    (_OVER, "GGUF - Integer Overflow in Tensor Size", "Critical", 9.0, "CWE-190", "'size overflow'", "CVE-2025-53630"),
]


@query(
    "gguf_tensor_checks",
    _first_sql("SELECT * REPLACE (CAST(name_len AS HUGEINT) AS name_len, CAST(dim0 AS HUGEINT) AS dim0, CAST(dim1 AS HUGEINT) AS dim1) "
               f"FROM ({I.portable(I.TENSOR_ROWS)})", _TENSOR_CHECKS, with_cve=True),
)
def gguf_tensor_checks(spark, sf_dir):
    return flat(gguf.tensor_checks(_tensor_rows(spark, sf_dir)), "value", "index")


@query(
    "gguf_cumulative",
    f"""WITH r AS (SELECT path, idx, sum(size::HUGEINT) OVER (PARTITION BY path ORDER BY idx) AS total FROM ({I.portable(I.SIZES)})),
    f AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY idx) AS n FROM r WHERE total > 9223372036854775807) SELECT """
    + finding("path", "gguf", "'GGUF - Cumulative Size Integer Overflow'", "'Critical'", "9.0", "CWE-190", index="idx", value="total")
    + " FROM f WHERE n = 1",
)
def gguf_cumulative(spark, sf_dir):
    return flat(gguf.cumulative(I.derive(spark, sf_dir, I.SIZES)), "index", "value")


_TEXTS = I.portable(I.TEXTS)
_TEMPLATES = "CASE " + " ".join(
    f"WHEN regexp_matches(text, {q(gguf._template_pattern(p))}) THEN {q(p)}" for p in R.TEMPLATE_INJECTION
) + " END"
_TEMPLATE_AT = "CASE " + " ".join(
    f"WHEN regexp_matches(text, {q(gguf._template_pattern(p))}) THEN length(regexp_extract(text, {q('^([\\s\\S]*?)' + gguf._template_pattern(p))}, 1))"
    for p in R.TEMPLATE_INJECTION
) + " END"


@query(
    "gguf_template_injection",
    f"WITH hits AS (SELECT source, {_TEMPLATES} AS pattern, {_TEMPLATE_AT} AS at_char FROM ({_TEXTS})) SELECT "
    + finding("source", "gguf", "'GGUF - Jinja2 SSTI Remote Code Execution'", "'Critical'", "10.0", "CWE-94", "CVE-2024-25123",
              pattern="pattern") + ", CAST(at_char AS VARCHAR) AS place FROM hits WHERE pattern IS NOT NULL",
)
def gguf_template_injection(spark, sf_dir):
    return flat(gguf.template_injection(I.derive(spark, sf_dir, I.TEXTS)), "pattern", place="offset")


@query(
    "gguf_path_traversal",
    f"WITH texts AS MATERIALIZED ({_TEXTS}) " + " UNION ALL ".join(
        "SELECT " + finding("source", "gguf", "'GGUF - Path Traversal in Metadata'", "'High'", "8.0", "CWE-22", pattern=q(p))
        + f" FROM texts WHERE regexp_matches(text, {q('(?i)' + p)})" for p in R.PATH_TRAVERSAL
    ),
)
def gguf_path_traversal(spark, sf_dir):
    return flat(gguf.path_traversal(I.derive(spark, sf_dir, I.TEXTS)), "pattern")


_GG = f"WITH g AS MATERIALIZED (SELECT path, min(regexp_replace(hex(content), '(..)', '\\1 ', 'g')) AS sp FROM ({I.portable(I.HEADERS)}) GROUP BY path, content)"


@query(
    "gguf_byte_markers",
    _GG + ", hits AS (" + " UNION ALL ".join(
        f"SELECT path, {q(kind)} AS kind, {q('Critical' if 'CVE' in kind or 'Overflow' in kind else 'High')} AS level, "
        f"{9.5 if 'CVE' in kind or 'Overflow' in kind else 8.0} AS score, {q(raw.hex())} AS pattern_hex, "
        f"(strpos(sp, '{' '.join(f'{b:02X}' for b in raw)} ') - 1) / 3 AS place FROM g" for raw, kind, _ in M.GGUF_BYTE_MARKERS
    ) + ") SELECT " + finding("path", "gguf", "kind", "any_value(level)", "any_value(score)", "CWE-190",
                              pattern_hex="any_value(pattern_hex)", offset="CAST(min(place) AS BIGINT)").replace("AS offset", 'AS "offset"')
    + " FROM hits WHERE place >= 0 GROUP BY path, kind",
)
def gguf_byte_markers(spark, sf_dir):
    found = gguf.byte_markers(I.derive(spark, sf_dir, I.HEADERS).select("path", "content"))
    return flat(found, "pattern_hex", "offset")


# --- weights --------------------------------------------------------------------

_W = f"w AS MATERIALIZED ({I.WEIGHTS_SQL}), st AS (SELECT path, layer, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM w GROUP BY path, layer HAVING count(value) >= 100)"
_OUTLIERS = """o AS (SELECT path, layer, count(*) FILTER (z > 3) AS outlier_count, count(*) FILTER (z > 3) / count(*) AS outlier_ratio, max(z) AS max_zscore
 FROM (SELECT w.path, w.layer, abs((value - mean) / sd) AS z FROM w JOIN st USING (path, layer) WHERE sd >= 1e-10) GROUP BY path, layer
 HAVING count(*) FILTER (z > 3) / count(*) > 0.01)"""
_UNIQUE = """u AS (SELECT path, layer, count(DISTINCT value) AS unique_values, count(*) AS total_values, count(DISTINCT value) / count(*) AS uniqueness_ratio
 FROM w GROUP BY path, layer HAVING count(DISTINCT value) / count(*) < 0.5 AND count(*) > 1000)"""
_STEPS = """c AS (SELECT path, layer, count(step) AS steps, stddev_pop(step) AS diff_std FROM (
 SELECT path, layer, value - lag(value) OVER (PARTITION BY path, layer ORDER BY pos) AS step FROM w) GROUP BY path, layer
 HAVING count(step) > 100 AND stddev_pop(step) < 1e-6)"""
_ENTROPY = """bins AS (SELECT *, least(100, n // 10) AS k FROM st),
 slots AS (SELECT path, layer, n, k, least(CAST(floor((value - lo) * k / (hi - lo)) AS BIGINT), k - 1) AS slot, count(*) AS m
   FROM w JOIN bins USING (path, layer) WHERE hi - lo >= 1e-10 GROUP BY ALL),
 e AS (SELECT path, layer, -sum(m / n * log2(m / n)) / log2(k) AS entropy, 'low_entropy' AS issue FROM slots GROUP BY path, layer, k
   HAVING -sum(m / n * log2(m / n)) / log2(k) < 0.5
   UNION ALL SELECT path, layer, 0.0, 'constant_values' FROM st WHERE hi - lo < 1e-10)"""


def _slices(spark, sf_dir):
    """Numbers of all tables in slices: a layer has several."""
    return weights.sliced(I.weights(spark, sf_dir), 2048)


@query("wt_outliers", f"WITH {_W}, {_OUTLIERS} SELECT path, layer, outlier_count, round(outlier_ratio, 6) AS outlier_ratio, round(max_zscore, 4) AS max_zscore FROM o")
def wt_outliers(spark, sf_dir):
    found = weights.outliers(_slices(spark, sf_dir))
    return found.select("path", "layer", "outlier_count", F.round("outlier_ratio", 6).alias("outlier_ratio"), F.round("max_zscore", 4).alias("max_zscore"))


@query("wt_uniqueness", f"WITH {_W}, {_UNIQUE} SELECT path, layer, unique_values, total_values, round(uniqueness_ratio, 6) AS uniqueness_ratio FROM u")
def wt_uniqueness(spark, sf_dir):
    found = weights.uniqueness(_slices(spark, sf_dir))
    return found.select("path", "layer", "unique_values", "total_values", F.round("uniqueness_ratio", 6).alias("uniqueness_ratio"))


@query("wt_constant_step", f"WITH {_W}, {_STEPS} SELECT path, layer, steps, round(diff_std, 6) AS diff_std FROM c")
def wt_constant_step(spark, sf_dir):
    found = weights.constant_step(_slices(spark, sf_dir))
    return found.select("path", "layer", "steps", F.round("diff_std", 6).alias("diff_std"))


@query("wt_entropy", f"WITH {_W}, {_ENTROPY} SELECT path, layer, round(entropy, 6) AS entropy, issue FROM e")
def wt_entropy(spark, sf_dir):
    return weights.entropy(_slices(spark, sf_dir)).select("path", "layer", F.round("entropy", 6).alias("entropy"), "issue")


@query(
    "wt_verdict",
    f"""WITH {_W}, {_OUTLIERS}, {_UNIQUE}, {_STEPS}, {_ENTROPY},
    a AS (SELECT path, layer, 'outlier_weights' AS t FROM o UNION ALL SELECT path, layer, 'unusual_pattern' FROM u
      UNION ALL SELECT path, layer, 'unusual_pattern' FROM c WHERE (path, layer) NOT IN (SELECT (path, layer) FROM u)
      UNION ALL SELECT path, layer, 'low_entropy' FROM e),
    g AS (SELECT path, count(*) AS n, count(*) FILTER (t = 'outlier_weights') AS o, count(*) FILTER (t = 'unusual_pattern') AS p,
      count(*) FILTER (t = 'low_entropy') AS l, array_to_string(list_sort(list(t || ':' || layer))[:5], ',') AS s FROM a GROUP BY path)
    SELECT """
    + finding("path", "backdoor", "'Neural Backdoor - Weight Anomalies'",
              "CASE WHEN n >= 5 OR (o >= 3 AND p >= 1) THEN 'High' WHEN n >= 2 THEN 'Medium' ELSE 'Low' END",
              "CASE WHEN n >= 5 OR (o >= 3 AND p >= 1) THEN 7.5 WHEN n >= 2 THEN 5.5 ELSE 3.5 END", "CWE-506",
              total_anomalies="n", outlier_layers="o", unusual_patterns="p", low_entropy_regions="l", sample_anomalies="s")
    + " FROM g",
)
def wt_verdict(spark, sf_dir):
    found = weights.verdicts(weights.anomalies(_slices(spark, sf_dir), keep=incremental.kept))
    return flat(found, "total_anomalies", "outlier_layers", "unusual_patterns", "low_entropy_regions", "sample_anomalies")


_LINES = I.portable(I.LINES)


@query("wt_safetensors", f"SELECT 's/' || file || '.safetensors' AS path, 'w' AS layer, row_number() OVER (PARTITION BY file ORDER BY line) - 1 AS pos, value FROM ({_LINES})")
def wt_safetensors(spark, sf_dir):
    files = I.safetensors_files(spark, sf_dir)
    slices = binary.tensor_slices(binary.tensor_table(metadata.safetensors_headers(files)), values=2)
    at, size = (F.col("begin") + 1).cast("int"), F.col("size").cast("int")
    held = slices.join(files.select("path", "content"), "path").withColumn("data", F.substr("content", at, size))
    return binary.exploded(binary.decode_slices(held)).withColumn("value", F.col("value").cast("double"))


@query("wt_pytorch", f"SELECT 'z/' || file || '.zip' AS path, entry AS layer, 0 AS pos, value FROM ({_LINES}) WHERE contains(entry, 'data')")
def wt_pytorch(spark, sf_dir):
    contents = members.member_contents(I.zip_files(spark, sf_dir))
    return binary.exploded(binary.pytorch_slices(contents)).withColumn("value", F.col("value").cast("double"))


# --- metadata -------------------------------------------------------------------

_CONF = I.portable(I.CONFIGS)

def _configs(spark, sf_dir):
    return I.derive(spark, sf_dir, I.CONFIGS).select("path", "source", "text")


# Every string member of a configuration, written out from its parts.
_FIELD_ROWS = f"""k AS MATERIALIZED ({_CONF}), ok AS (SELECT * FROM k WHERE text <> 'not json'), fields AS (
SELECT source, '/class_name' AS json_path, 'Functional' AS value FROM ok
UNION ALL SELECT source, '/note', f FROM ok
UNION ALL SELECT source, '/skip/class_name', 'Lambda' FROM ok
UNION ALL SELECT source, '/config/layers[0]/class_name', c FROM ok
UNION ALL SELECT source, '/config/layers[0]/module', m FROM ok
UNION ALL SELECT source, '/config/layers[0]/config/units', '5000000000' FROM ok WHERE u LIKE '"%'
UNION ALL SELECT source, '/config/layers[0]/config/function', trim(b, '"') FROM ok WHERE b LIKE '"%'
UNION ALL SELECT source, '/config/layers[0]/config/function/function_name', 'f' FROM ok WHERE contains(b, 'function_name')
UNION ALL SELECT source, '/config/layers[0]/config/function/module', 'os' FROM ok WHERE contains(b, 'function_name')
UNION ALL SELECT source, '/config/layers[0]/config/function/code', 'exec(1)' FROM ok WHERE contains(b, '"code"')
UNION ALL SELECT source, '/config/layers[0]/config/function/bytecode', 'AAAA' FROM ok WHERE contains(b, 'bytecode')
UNION ALL SELECT source, '/config/layers[0]/weights_url', l FROM ok
UNION ALL SELECT source, '/config/layers[1][0]/class_name', 'Dense' FROM ok
UNION ALL SELECT source, '/config/layers[1][0]/inner_model/class_name', c FROM ok
UNION ALL SELECT source, '/config/layers[1][0]/inner_model/config/module', 'sys' FROM ok
UNION ALL SELECT source, '/origin', l FROM ok
UNION ALL SELECT source, '/loader', CASE WHEN custkey % 2 = 0 THEN 'get_file' ELSE 'none' END FROM ok
UNION ALL SELECT source, '/callbacks[0]/class_name', 'LambdaCallback' FROM ok
UNION ALL SELECT source, '/callbacks[1]/class_name', 'Other' FROM ok
UNION ALL SELECT source, '/callbacks[2]/class_name', CASE WHEN custkey % 3 = 0 THEN 'LambdaCallback' ELSE 'EarlyStopping' END FROM ok)"""
_NAME = "regexp_extract(json_path, '[^/]*$')"


@query("meta_json_fields", f"WITH {_FIELD_ROWS} SELECT source, json_path, {_NAME} AS name, value FROM fields")
def meta_json_fields(spark, sf_dir):
    return metadata.json_fields(_configs(spark, sf_dir)).select("source", "json_path", "name", "value")


_FORMATS = "CASE " + " ".join(f"WHEN regexp_matches(value, {q(p)}) THEN {q(p)}" for p in R.FORMAT_STRINGS) + " END"
_SCRIPT = "CASE " + " ".join(f"WHEN regexp_matches({{0}}, {q('(?i)' + p)}) THEN {q(d)}" for p, d in R.SCRIPTS) + " END"
_SCRIPT_N = "CASE " + " ".join(
    f"WHEN regexp_matches({{0}}, {q('(?i)' + p)}) THEN len(regexp_extract_all({{0}}, {q('(?i)' + p)}))" for p, d in R.SCRIPTS
) + " END"


@query(
    "meta_format_string",
    f"WITH {_FIELD_ROWS} SELECT "
    + finding("source", "metadata", "'Metadata - Format String'", "'Medium'", "6.0", "CWE-134", field=_NAME, pattern=_FORMATS)
    + f" FROM fields WHERE {_FORMATS} IS NOT NULL",
)
def meta_format_string(spark, sf_dir):
    return flat(metadata.format_string(metadata.json_fields(_configs(spark, sf_dir))), "field", "pattern")


_PAGE_FIELDS = f"""SELECT source, {_NAME} AS field, value FROM fields
 UNION ALL SELECT 'page/' || page_id, 'html', html FROM pages"""


def _page_fields(spark, sf_dir):
    pages = I.table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.lit("html").alias("name"), F.col("html").alias("value")
    )
    fields = metadata.json_fields(_configs(spark, sf_dir)).select("path", "source", "name", "value")
    return fields.unionByName(pages.withColumn("source", F.col("path")))


@query(
    "meta_embedded_script",
    f"WITH {_FIELD_ROWS}, v AS ({_PAGE_FIELDS}) SELECT "
    + finding("source", "metadata", "'Metadata - Embedded Script'", "'High'", "7.0", "CWE-79", field="field", script_type=_SCRIPT.format("value"))
    + f" FROM v WHERE {_SCRIPT.format('value')} IS NOT NULL",
)
def meta_embedded_script(spark, sf_dir):
    return flat(metadata.embedded_script(_page_fields(spark, sf_dir)), "field", "script_type")


_LIMIT = 3000


@query(
    "meta_field_length",
    "WITH v AS (SELECT 'doc/' || doc_id AS source, text AS value FROM documents UNION ALL SELECT 'page/' || page_id, html FROM pages) SELECT "
    + finding("source", "metadata", "'Metadata - Excessive Length'", "'Medium'", "5.5", "CWE-120", field="'text'", length="strlen(value)")
    + f" FROM v WHERE strlen(value) > {_LIMIT}",
)
def meta_field_length(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("value"))
    pages = I.table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("value"))
    fields = docs.unionByName(pages).withColumn("source", F.col("path")).withColumn("name", F.lit("text"))
    return flat(metadata.field_length(fields, _LIMIT), "field", "length")


@query(
    "meta_safetensors",
    f"""WITH l AS (SELECT file, count(*) AS n FROM ({_LINES}) GROUP BY file)
    SELECT 's/' || file || '.safetensors' AS path, strlen(header) AS header_size, header AS text FROM (SELECT file,
      '{{"__metadata__":{{"format":"pt"}},"w":{{"dtype":"F32","shape":[' || n || '],"data_offsets":[0,' || n * 4 || ']}}}}' AS header FROM l)""",
)
def meta_safetensors(spark, sf_dir):
    headers = metadata.safetensors_headers(I.safetensors_files(spark, sf_dir))
    return headers.select("path", F.col("header_size").cast("bigint").alias("header_size"), "text")


@query(
    "meta_header_size",
    f"WITH {_HEADERS} SELECT "
    + finding("path", "metadata", "'Metadata - Excessive Header Size'", "'Medium'", "5.0", "CWE-400", header_size="nt")
    + " FROM h WHERE nt > 104857600",
)
def meta_header_size(spark, sf_dir):
    # Behind the first eight bytes the tensor count stands where a header size would.
    files = fixed(I.derive(spark, sf_dir, I.HEADERS).select("path", "content"), content=F.substr("content", F.lit(9), F.lit(100)))
    return flat(metadata.safetensors_findings(files), "header_size")


@query(
    "meta_long_segment",
    f"""WITH t AS (SELECT 'doc/' || doc_id AS source, text FROM documents UNION ALL SELECT 'page/' || page_id, html FROM pages),
    n AS (SELECT source, strlen(text) AS n, length(regexp_replace(text, '[^ -~]', '', 'g')) AS p FROM t) SELECT """
    + finding("source", "metadata", "'Metadata - Long Text Segment'", "'Low'", "3.5", "CWE-120", length="n")
    + f" FROM n WHERE n > {_LIMIT} AND p / n > 0.7",
)
def meta_long_segment(spark, sf_dir):
    return flat(metadata.long_segment(_contents(spark, sf_dir), None, _LIMIT), "length")


def _contents(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    pages = I.table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return docs.unionByName(pages)


@query(
    "meta_code_pattern",
    "WITH t AS (SELECT 'doc/' || doc_id AS source, text FROM documents UNION ALL SELECT 'page/' || page_id, html FROM pages) SELECT "
    + finding("source", "metadata", "'Metadata - Embedded Code Pattern'", "'Medium'", "5.0", "CWE-94",
              pattern_type=_SCRIPT.format("text"), count=_SCRIPT_N.format("text"))
    + f" FROM t WHERE {_SCRIPT.format('text')} IS NOT NULL",
)
def meta_code_pattern(spark, sf_dir):
    return flat(metadata.code_pattern(_contents(spark, sf_dir), None), "pattern_type", "count")


# --- Keras ----------------------------------------------------------------------

_NODE_ROWS = f"""k AS MATERIALIZED ({_CONF}), ok AS (SELECT * FROM k WHERE text <> 'not json'), nodes AS (
SELECT source, '' AS config_path, 'Functional' AS class_name, '' AS module, l, u, b, c, custkey, 'root' AS role FROM ok
UNION ALL SELECT source, '/config', '', '', l, u, b, c, custkey, 'mid' FROM ok
UNION ALL SELECT source, '/config/layers[0]', c, m, l, u, b, c, custkey, 'layer' FROM ok
UNION ALL SELECT source, '/config/layers[0]/config', '', '', l, u, b, c, custkey, 'mid' FROM ok
UNION ALL SELECT source, '/config/layers[1][0]', 'Dense', '', l, u, b, c, custkey, 'mid' FROM ok
UNION ALL SELECT source, '/config/layers[1][0]/inner_model', c, '', l, u, b, c, custkey, 'inner' FROM ok
UNION ALL SELECT source, '/config/layers[1][0]/inner_model/config', '', 'sys', l, u, b, c, custkey, 'mid' FROM ok)"""


def _nodes(spark, sf_dir):
    return keras.config_nodes(_configs(spark, sf_dir))


def _keras(name: str, rule, kind: str, level: str, score: str, cwe: str, where: str, cve=None, **more):
    @query(
        name,
        f"WITH {_NODE_ROWS} SELECT " + finding("source", "lambda_layer", q(kind), q(level), score, cwe, cve, **more)
        + f", config_path FROM nodes WHERE {where}",
    )
    def run(spark, sf_dir):
        return flat(rule(_nodes(spark, sf_dir)), *more, config_path="config_path")


@query("keras_config_nodes", f"WITH {_NODE_ROWS} SELECT source, config_path, class_name, module FROM nodes")
def keras_config_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select("source", "config_path", "class_name", "module")


_keras("keras_lambda", keras.lambda_layers, "Keras Exploit Payload - Lambda Layer RCE (targets CVE-2024-3660)", "High", "8.0",
       "CWE-94", "class_name = 'Lambda'", "CVE-2024-3660")
_keras("keras_module_import", keras.module_imports, "Keras - Dangerous Module Import", "Critical", "9.8", "CWE-94",
       "module IN ('os', 'subprocess', 'builtins', 'sys', 'socket')", module="module")
_keras("keras_safe_mode", keras.safe_mode, "Keras - Safe Mode Bypass", "Critical", "9.5", "CWE-502",
       "class_name = 'enable_unsafe_deserialization'")
_keras("keras_custom", keras.custom_objects, "Keras - Custom Layer Detected", "High", "7.0", "CWE-94",
       "class_name IN ('Custom', 'CustomObject') OR contains(lower(module), 'custom')", module="module")
_URL_WORD = "CASE " + " ".join(f"WHEN contains(lower(l), {q(w)}) THEN {q(w)}" for w in M.KERAS_SSRF_WORDS) + " END"
_keras("keras_url_ssrf", keras.url_ssrf, "Keras - SSRF in Model Config", "Critical", "9.0", "CWE-918",
       f"(role = 'layer' OR (role = 'root' AND custkey % 2 = 0)) AND {_URL_WORD} IS NOT NULL", url="l", indicator=_URL_WORD)
_keras("keras_dos_units", keras.dos_units, "Keras - DoS via Large Layer", "High", "7.5", "CWE-400",
       "role = 'layer' AND u IN ('1000000001', '99999999999999999999')", units="u")


@query(
    "keras_callbacks",
    f"WITH {_NODE_ROWS}, cb AS (SELECT source, '[0]' AS config_path FROM nodes WHERE role = 'root' "
    "UNION ALL SELECT source, '[2]' FROM nodes WHERE role = 'root' AND custkey % 3 = 0) SELECT "
    + finding("source", "lambda_layer", "'Keras - LambdaCallback RCE'", "'Critical'", "9.0", "CWE-94") + ", config_path FROM cb",
)
def keras_callbacks(spark, sf_dir):
    return flat(keras.callbacks(_nodes(spark, sf_dir)), config_path="config_path")


_BODY = """CASE WHEN b = '"ZXZhbCgieCIp"' THEN 'eval("x")' WHEN b LIKE '"%' THEN trim(b, '"')
 WHEN contains(b, 'function_name') THEN 'Function: os.f' WHEN contains(b, '"code"') THEN 'exec(1)'
 WHEN contains(b, 'bytecode') THEN 'Bytecode: AAAA' ELSE '{"other":1}' END"""


@query(
    "keras_lambda_decode",
    f"""WITH {_NODE_ROWS} SELECT source || ':' || config_path || '/function' AS source, {_BODY} AS text FROM nodes
    WHERE class_name = 'Lambda' AND role = 'layer' AND {_BODY} <> ''""",
)
def keras_lambda_decode(spark, sf_dir):
    return keras.lambda_bodies(_nodes(spark, sf_dir)).select("source", "text")


@query(
    "keras_lambda_code",
    rules_sql(R.ALL_RULES, f"WITH {_NODE_ROWS} SELECT source || ':' || config_path || '/function' AS source, {_BODY} AS text "
                           f"FROM nodes WHERE class_name = 'Lambda' AND role = 'layer' AND {_BODY} <> ''"),
)
def keras_lambda_code(spark, sf_dir):
    return flat(keras.lambda_code(_nodes(spark, sf_dir)), "category", "pattern")


@query(
    "keras_config",
    f"""WITH k AS ({_CONF}) SELECT 'issues' AS what, count(*) FILTER (text = 'not json') AS n FROM k
    UNION ALL SELECT 'parsed', count(*) FILTER (text <> 'not json') FROM k""",
)
def keras_config(spark, sf_dir):
    texts = _configs(spark, sf_dir)
    issues = jsonwalk.parse_issues(texts, "lambda_layer").select(F.lit("issues").alias("what"))
    roots = _nodes(spark, sf_dir).where(F.col("config_path") == "").select(F.lit("parsed").alias("what"))
    return issues.unionByName(roots).groupBy("what").agg(F.count(F.lit(1)).alias("n"))
