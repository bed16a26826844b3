"""Rule packs over text.

``texts`` has ``path``, ``source`` and ``text``. Each rule costs one substring
test; its regular expression runs only where the anchor occurs. The whole scan
is one narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.findings import findings_of, hit, hits_if
from tamperlens.rules import text_rules as R

# "." excludes only the line feed; letters match in either case.
_FLAGS = "(?id)"


def rule_hits(texts: DataFrame, rules: list[R.Rule], unique_source: bool = True) -> DataFrame:
    """(path, source, category, description, level): once per source and description.

    ``unique_source=False`` when several rows share a source (chunks of one file).
    """
    lowered = texts.select("path", "source", "text", F.lower("text").alias("_lower"))
    tests = [
        F.when(
            F.contains(F.col("_lower"), F.lit(rule.anchor)) & F.rlike(F.col("text"), F.lit(_FLAGS + rule.pattern)),
            F.struct(
                F.lit(rule.category).alias("category"),
                F.lit(rule.description).alias("description"),
                F.lit(rule.level).alias("level"),
            ),
        )
        for rule in rules
    ]
    hits = (
        lowered.select(
            "path", "source", F.explode(F.array_distinct(F.array_compact(F.array(*tests)))).alias("hit")
        )
        .select("path", "source", "hit.*")
    )
    return hits if unique_source else hits.dropDuplicates(["source", "category", "description"])


def _by_category(values: dict, default=None) -> Column:
    result = F.lit(default)
    for category, value in values.items():
        result = F.when(F.col("category") == category, value).otherwise(result)
    return result


def enrich(hits: DataFrame) -> DataFrame:
    """Add advice, references and weakness class of each category."""
    references = {k: F.array(*[F.lit(u) for u in v]) for k, v in R.CATEGORY_REFERENCES.items()}
    nothing = F.array().cast("array<string>")
    column = nothing
    for category, urls in references.items():
        column = F.when(F.col("category") == category, urls).otherwise(column)
    return hits.select(
        "*",
        _by_category(R.CATEGORY_ADVICE, "Review this artifact before loading it.").alias("advice"),
        column.alias("reference_urls"),
        _by_category(R.CATEGORY_CWE, "CWE-94").alias("cwe"),
    )


def rule_numbers(text: Column, lowered: Column, rules: list[R.Rule] = R.ALL_RULES) -> Column:
    """Numbers, from 1, of the (category, description) pairs that a text matches, in order of the rules."""
    # Two rules may share a description: they make one hit.
    merged: dict[tuple[str, str], Column] = {}
    for rule in rules:
        key, test = (rule.category, rule.description), matches_rule(text, lowered, rule)
        merged[key] = merged[key] | test if key in merged else test
    return F.array_compact(F.array(*[F.when(test, F.lit(i)) for i, test in enumerate(merged.values(), 1)]))


def rule_details(rules: list[R.Rule] = R.ALL_RULES) -> Column:
    """Constant table of the hits that the numbers stand for."""
    details: dict[tuple[str, str], Column] = {}
    for rule in rules:
        level, score = R.RULE_SCORES[rule.level]
        details.setdefault(
            (rule.category, rule.description),
            hit(
                "lambda_layer",
                f"Keras Exploit Payload - {rule.category} (targets load_model())",
                level,
                score,
                f"Text matches a signature: {rule.description}",
                evidence={"category": rule.category, "pattern": rule.description},
                advice=R.CATEGORY_ADVICE[rule.category],
                references=R.CATEGORY_REFERENCES.get(rule.category),
                cwe=R.CATEGORY_CWE[rule.category],
            ),
        )
    return F.array(*details.values())


def rule_columns(text: Column, lowered: Column, rules: list[R.Rule] = R.ALL_RULES) -> Column:
    """Hits of the rules in one text: one per (category, description)."""
    table = rule_details(rules)
    return F.transform(rule_numbers(text, lowered, rules), lambda i: F.element_at(table, i))


def matches_rule(text: Column, lowered: Column, rule: R.Rule) -> Column:
    return F.contains(lowered, F.lit(rule.anchor)) & F.rlike(text, F.lit(_FLAGS + rule.pattern))


def rules_scan(texts: DataFrame, rules: list[R.Rule] = R.ALL_RULES, unique_source: bool = True) -> DataFrame:
    """Findings of the given rules, one per (category, description) and source.

    ``unique_source=False`` when several rows share a source (chunks of one file).
    """
    rows = texts.select("path", "source", "text", F.lower("text").alias("_lower"))
    found = findings_of(rows, rule_columns(F.col("text"), F.col("_lower"), rules))
    return found if unique_source else found.dropDuplicates(["finding_id"])


def secret_matches(text: Column, rule: R.Rule) -> tuple[Column, Column]:
    """Four characters of the first match, and how many there are."""
    pattern = _FLAGS + rule.pattern
    masked = F.concat(F.substring(F.regexp_extract(text, pattern, 0), 1, 4), F.lit("***"))
    return masked, F.regexp_count(text, F.lit(pattern))


def secret_hit(rule: R.Rule, masked: Column, matches: Column) -> Column:
    return hit(
        "secrets",
        f"Secrets - {rule.description}",
        "Critical",
        9.5,
        f"Text holds a credential: {rule.description}",
        evidence={"masked": masked, "matches": matches},
        advice="Revoke the credential and remove it from the artifact.",
        cwe="CWE-798",
    )


def secret_columns(text: Column, lowered: Column, rules: list[R.Rule] = R.SECRETS) -> Column:
    """Hits of credentials in one text; the evidence keeps four characters of the first."""
    return hits_if(*[(matches_rule(text, lowered, rule), secret_hit(rule, *secret_matches(text, rule))) for rule in rules])


def secrets_scan(texts: DataFrame, rules: list[R.Rule] = R.SECRETS) -> DataFrame:
    """Findings of credentials in texts."""
    rows = texts.select("path", "source", "text", F.lower("text").alias("_lower"))
    return findings_of(rows, secret_columns(F.col("text"), F.col("_lower"), rules))
