"""Rule packs, graph operators, URLs and findings algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamperlens.functions.findings import findings_of, flat
from tamperlens.functions.groups import capped_lists
from tamperlens.operators import algebra, graphs, refs, textscan
from tamperlens.plans import inputs as I
from tamperlens.plans.registry import finding, q, query, table_of
from tamperlens.rules import markers as M
from tamperlens.rules import text_rules as R

TEXTS_SQL = I.portable(I.TEXTS)


def rules_sql(rules, texts=TEXTS_SQL) -> str:
    """One regular expression test per rule and text."""
    parts = []
    for rule in rules:
        level, score = R.RULE_SCORES[rule.level]
        columns = finding(
            "source", "lambda_layer", q(f"Keras Exploit Payload - {rule.category} (targets load_model())"), q(level),
            str(score), R.CATEGORY_CWE[rule.category], category=q(rule.category), pattern=q(rule.description),
        )
        parts.append(f"SELECT DISTINCT {columns} FROM texts WHERE regexp_matches(text, {q('(?i)' + rule.pattern)})")
    return f"WITH texts AS MATERIALIZED ({texts}) " + " UNION ".join(parts)


def _register_pack(key: str, rules) -> None:
    @query(f"rules_{key}", rules_sql(rules))
    def run(spark, sf_dir):
        return flat(textscan.rules_scan(I.derive(spark, sf_dir, I.TEXTS), rules), "category", "pattern")


for _key, _rules in R.KERAS_PACKS.items():
    _register_pack(_key, _rules)


@query(
    "rules_scan",
    f"SELECT vulnerability_type, level, pattern, count(*) AS sources FROM ({rules_sql(R.ALL_RULES)}) GROUP BY ALL",
)
def rules_scan(spark, sf_dir):
    found = flat(textscan.rules_scan(I.derive(spark, sf_dir, I.TEXTS)), "pattern")
    return found.groupBy("vulnerability_type", "level", "pattern").agg(F.count(F.lit(1)).alias("sources"))


_DIMENSION = table_of(
    [(c, R.CATEGORY_CWE[c], R.CATEGORY_ADVICE[c], len(R.CATEGORY_REFERENCES.get(c, []))) for c in R.CATEGORY_CWE],
    "d", "category, cwe, advice, n_references",
)


@query(
    "rules_enrich",
    f"SELECT d.category, d.cwe, d.advice, CAST(d.n_references AS BIGINT) AS n_references, count(*) AS hits "
    f"FROM ({rules_sql(R.ALL_RULES)}) f JOIN {_DIMENSION} ON f.category = d.category GROUP BY ALL",
)
def rules_enrich(spark, sf_dir):
    hits = textscan.enrich(textscan.rule_hits(I.derive(spark, sf_dir, I.TEXTS), R.ALL_RULES))
    return hits.groupBy(
        "category", "cwe", "advice", F.size("reference_urls").cast("bigint").alias("n_references")
    ).agg(F.count(F.lit(1)).alias("hits"))


def secrets_sql(texts=TEXTS_SQL) -> str:
    parts = []
    for rule in R.SECRETS:
        pattern = q("(?i)" + rule.pattern)
        columns = finding(
            "source", "secrets", q(f"Secrets - {rule.description}"), "'Critical'", "9.5", "CWE-798",
            masked=f"left(regexp_extract(text, {pattern}, 0), 4) || '***'",
            matches=f"len(regexp_extract_all(text, {pattern}))",
        )
        parts.append(f"SELECT {columns} FROM texts WHERE regexp_matches(text, {pattern})")
    return f"WITH texts AS MATERIALIZED ({texts}) " + " UNION ALL ".join(parts)


@query("secrets_scan", secrets_sql())
def secrets_scan(spark, sf_dir):
    return flat(textscan.secrets_scan(I.derive(spark, sf_dir, I.TEXTS)), "masked", "matches")


# --- graph operators ----------------------------------------------------------

_OPS = [(f"Graph Injection - {title}", level, score, cwe, op) for title, level, score, cwe, ops in M.GRAPH_CLASSES for op in ops]
_OP_TABLE = table_of(_OPS, "o", "kind, level, score, cwe, op")


@query("graph_ops", f"SELECT source, op FROM ({TEXTS_SQL}) t JOIN {_OP_TABLE} ON contains(t.text, o.op)")
def graph_ops(spark, sf_dir):
    return graphs.graph_ops(I.derive(spark, sf_dir, I.TEXTS)).select("source", "op")


GRAPH_SQL = (
    "SELECT " + finding("source", "graph_injection", "kind", "any_value(o.level)", "any_value(score)", "@any_value(cwe)",
                        ops="string_agg(op, ',' ORDER BY op)", count="count(*)")
    + f" FROM ({TEXTS_SQL}) t JOIN {_OP_TABLE} ON contains(t.text, o.op) GROUP BY source, kind"
)


@query("graph_findings", GRAPH_SQL)
def graph_findings(spark, sf_dir):
    return flat(graphs.graph_findings(I.derive(spark, sf_dir, I.TEXTS)), "ops", "count")


@query(
    "graph_saved_model",
    f"""WITH t AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir FROM ({I.portable(I.TREE)})),
    r AS (SELECT CASE WHEN path LIKE '%/variables/variables.index' THEN regexp_replace(dir, '/[^/]*$', '') ELSE dir END AS directory,
                 CASE WHEN path LIKE '%/saved_model.pb' THEN path END AS graph_file,
                 path LIKE '%/variables/variables.index' AS is_index
          FROM t WHERE path LIKE '%/saved_model.pb' OR path LIKE '%/variables/variables.index')
    SELECT directory, max(graph_file) AS graph_file, bool_or(is_index) AS has_variables FROM r
    GROUP BY directory HAVING max(graph_file) IS NOT NULL""",
)
def graph_saved_model(spark, sf_dir):
    return graphs.saved_models(I.derive(spark, sf_dir, I.TREE))


# --- URLs ---------------------------------------------------------------------

_LINKED = I.portable(I.LINKED)
_URL_ROWS = " UNION ALL ".join(
    f"SELECT path, source, unnest(regexp_extract_all(text, {q('(?i)' + p)})) AS url FROM linked" for p in M.URL_PATTERNS
)
_SSRF = "|".join(M.SSRF_PATTERNS)
_URLS_SQL = f"""linked AS MATERIALIZED ({_LINKED}), found AS ({_URL_ROWS}),
urls AS (SELECT source, url,
    lower(split_part(regexp_replace(regexp_extract(url, '^[A-Za-z0-9+.-]+://([^/?#]*)', 1), '^.*@', ''), ':', 1)) AS host,
    regexp_matches(url, {q('(?i)^(?:' + _SSRF + ')')}) AS is_ssrf, lower(url) LIKE 'file://%' AS is_file FROM found)"""


@query("ref_urls", f"WITH {_URLS_SQL} SELECT source, url, host, is_ssrf, is_file FROM urls")
def ref_urls(spark, sf_dir):
    return refs.urls(I.derive(spark, sf_dir, I.LINKED)).select("source", "url", "host", "is_ssrf", "is_file")


_TEN = "CAST(to_json(list_sort(list_distinct(list(url)))[:10]) AS VARCHAR)"


@query(
    "ref_ssrf",
    f"WITH linked AS MATERIALIZED ({_LINKED}), hits AS ("
    + " UNION ALL ".join(
        f"SELECT source, unnest(regexp_extract_all(text, {q('(?i)' + p)})) AS url FROM linked" for p in M.SSRF_PATTERNS
    )
    + ") SELECT "
    + finding("source", "external_ref", "'External Reference - SSRF Vector'", "'High'", "7.5", "CWE-918",
              ssrf_urls=_TEN, total_found="count(*)")
    + " FROM hits GROUP BY source",
)
def ref_ssrf(spark, sf_dir):
    return flat(refs.ssrf(I.derive(spark, sf_dir, I.LINKED)), "ssrf_urls", "total_found")


@query(
    "ref_local_file",
    f"WITH {_URLS_SQL} SELECT "
    + finding("source", "external_ref", "'External Reference - Local File Access'", "'High'", "7.0", "CWE-22",
              file_urls=_TEN, total_found="count(*)")
    + " FROM urls WHERE is_file GROUP BY source",
)
def ref_local_file(spark, sf_dir):
    return flat(refs.local_files(refs.urls(I.derive(spark, sf_dir, I.LINKED))), "file_urls", "total_found")


_ALLOWED = [*M.SAFE_DOMAINS, "example.net"]
_OUTSIDE = "NOT is_ssrf AND NOT is_file AND host <> '' AND NOT EXISTS (SELECT 1 FROM " + table_of(
    [(d,) for d in _ALLOWED], "a", "domain"
) + " WHERE host = a.domain OR ends_with(host, '.' || a.domain))"


@query("ref_allowed_domain", f"WITH {_URLS_SQL} SELECT source, url, host FROM urls WHERE {_OUTSIDE}")
def ref_allowed_domain(spark, sf_dir):
    return refs.outside_urls(refs.urls(I.derive(spark, sf_dir, I.LINKED)), _ALLOWED).select("source", "url", "host")


@query(
    "ref_unknown_domains",
    f"WITH {_URLS_SQL} SELECT "
    + finding(
        "source", "external_ref", "'External Reference - Unknown Domains'",
        "CASE WHEN count(DISTINCT host) <= 3 THEN 'Medium' ELSE 'High' END",
        "CASE WHEN count(DISTINCT host) <= 3 THEN 5.5 ELSE 7.0 END", "CWE-829",
        domains="CAST(to_json(list_sort(list_distinct(list(host)))[:20]) AS VARCHAR)", sample_urls=_TEN,
        n_domains="count(DISTINCT host)", total_urls="count(*)",
    )
    + f" FROM urls WHERE {_OUTSIDE} GROUP BY source",
)
def ref_unknown_domains(spark, sf_dir):
    # Each text is a source of its own: its URLs are listed and counted in the row.
    arrays = refs.url_arrays(I.derive(spark, sf_dir, I.LINKED))
    found = findings_of(arrays, refs.unknown_domain_columns(F.col("found"), _ALLOWED))
    return flat(found, "domains", "sample_urls", "n_domains", "total_urls")


# --- findings algebra -----------------------------------------------------------

_BASE_RULES = R.ALL_RULES


def base_findings(spark, sf_dir):
    """Findings of three detectors over all texts: one projection reads a text once, its hits leave together."""
    rows = I.derive(spark, sf_dir, I.TEXTS).select("path", "source", "text", F.lower("text").alias("_lower"))
    text, lowered = F.col("text"), F.col("_lower")
    hits = F.concat(textscan.rule_columns(text, lowered, _BASE_RULES), textscan.secret_columns(text, lowered), graphs.graph_columns(text))
    return findings_of(rows, hits)


BASE_SQL = f"""findings AS MATERIALIZED (
SELECT source, regexp_replace(source, '^(conv/[0-9]+)/.*$', '\\1') AS path, scanner, vulnerability_type, level, cvss_score,
       cwe_id, pattern AS detail FROM ({rules_sql(_BASE_RULES)})
UNION ALL SELECT source, regexp_replace(source, '^(conv/[0-9]+)/.*$', '\\1'), scanner, vulnerability_type, level, cvss_score,
       cwe_id, '' FROM ({secrets_sql()})
UNION ALL SELECT source, regexp_replace(source, '^(conv/[0-9]+)/.*$', '\\1'), scanner, vulnerability_type, level, cvss_score,
       cwe_id, ops FROM ({GRAPH_SQL}))"""
_RANK = "CASE level WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END"
_COUNTS = """count(*) AS total_vulnerabilities, count(*) FILTER (level = 'Critical') AS critical,
count(*) FILTER (level = 'High') AS high, count(*) FILTER (level = 'Medium') AS medium, count(*) FILTER (level = 'Low') AS low"""


@query(
    "find_union",
    f"WITH {BASE_SQL} SELECT path, scanner, vulnerability_type, level, count(*) AS n, "
    "count(DISTINCT source || '|' || detail) AS ids FROM findings GROUP BY ALL",
)
def find_union(spark, sf_dir):
    found = base_findings(spark, sf_dir)
    return found.groupBy("path", "scanner", "vulnerability_type", F.col("severity.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("finding_id").alias("ids")
    )


@query("find_summary", f"WITH {BASE_SQL} SELECT path AS target, {_COUNTS} FROM findings GROUP BY ROLLUP (path)")
def find_summary(spark, sf_dir):
    return algebra.summary(base_findings(spark, sf_dir))


@query(
    "find_threshold",
    f"WITH {BASE_SQL} SELECT source, scanner, vulnerability_type, level, cvss_score FROM findings WHERE {_RANK} <= 1",
)
def find_threshold(spark, sf_dir):
    kept = algebra.threshold(base_findings(spark, sf_dir), "high")
    return flat(kept).select("source", "scanner", "vulnerability_type", "level", "cvss_score")


@query(
    "find_gate",
    f"WITH {BASE_SQL} SELECT count(*) FILTER (level = 'Critical') AS critical, count(*) FILTER (level = 'High') AS high, "
    "count(*) FILTER (level IN ('Critical', 'High')) > 0 AS failed FROM findings",
)
def find_gate(spark, sf_dir):
    return algebra.gate(base_findings(spark, sf_dir), fail_on_high=True)


@query(
    "find_listing",
    f"WITH {BASE_SQL} SELECT upper(level) AS level, vulnerability_type, source AS file FROM findings",
)
def find_listing(spark, sf_dir):
    return algebra.listing(base_findings(spark, sf_dir)).select("level", "vulnerability_type", "file")


@query(
    "find_evidence_cap",
    f"WITH {BASE_SQL} SELECT vulnerability_type, to_json(list_sort(list_distinct(list(source)))[:10])::VARCHAR AS items, "
    "count(*) AS total, count(DISTINCT source) AS distinct_total FROM findings GROUP BY vulnerability_type",
)
def find_evidence_cap(spark, sf_dir):
    capped = capped_lists(base_findings(spark, sf_dir), ["vulnerability_type"], F.col("source"), 10)
    return capped.select("vulnerability_type", F.to_json("items").alias("items"), "total", "distinct_total")
