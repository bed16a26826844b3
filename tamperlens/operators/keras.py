"""Keras configurations as tables of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.bytesx import utf8
from tamperlens.functions.findings import as_findings
from tamperlens.functions.groups import fixed
from tamperlens.functions.text import first_match
from tamperlens.operators import jsonwalk
from tamperlens.operators.textscan import rules_scan
from tamperlens.rules import markers as M

SCANNER = "lambda_layer"


def zip_traversal(members: DataFrame) -> DataFrame:
    entry = F.col("entry")
    outside = F.contains(entry, F.lit("..")) | F.startswith(entry, F.lit("/")) | F.startswith(entry, F.lit("\\"))
    rows = members.where((F.col("origin") == "central") & outside).withColumn("source", F.col("path"))
    return as_findings(
        rows, SCANNER, "Keras - ZIP Path Traversal", "High", 8.0,
        F.concat(F.lit("Entry leaves the archive: "), entry),
        location={"entry": entry}, evidence={"malicious_path": entry},
        advice="Do not unpack this archive.", cwe="CWE-22",
    )


def config_texts(member_contents: DataFrame) -> DataFrame:
    """(path, source, text) of the configuration members of model archives."""
    return member_contents.where(F.endswith("entry", F.lit("config.json")) & F.col("content").isNotNull()).select(
        "path",
        F.concat_ws(":", "path", "entry").alias("source"),
        utf8(F.col("content")).alias("text"),
    )


def _text_of(node: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(node, path, "string"), F.lit(""))


def config_nodes(texts: DataFrame, depth: int | None = None) -> DataFrame:
    """Objects of a configuration: (path, source, config_path, class_name, module, node)."""
    nodes = jsonwalk.objects(texts, M.KERAS_CHILD_KEYS, depth).where(~F.col("open"))
    return nodes.select(
        "path",
        "source",
        F.col("json_path").alias("config_path"),
        _text_of(F.col("node"), "$.class_name").alias("class_name"),
        _text_of(F.col("node"), "$.module").alias("module"),
        "node",
    )


def _finding(rows: DataFrame, kind: str, level: str, score: float, text, cwe: str, cve=None, **evidence) -> DataFrame:
    return as_findings(
        rows, SCANNER, kind, level, score, text,
        location={"config_path": F.col("config_path")}, evidence=evidence, cwe=cwe, cve=cve,
        advice="Load only with safe mode on, and only from a source you trust.",
    )


def lambda_layers(nodes: DataFrame) -> DataFrame:
    return _finding(
        nodes.where(F.col("class_name") == "Lambda"),
        "Keras Exploit Payload - Lambda Layer RCE (targets CVE-2024-3660)", "High", 8.0,
        "A Lambda layer carries code", "CWE-94", "CVE-2024-3660",
        layer=F.substring(F.to_json("node"), 1, 500),
    )


def lambda_bodies(nodes: DataFrame) -> DataFrame:
    """(path, source, text): the code of each Lambda layer, decoded."""
    get = lambda key: F.try_variant_get("node", f"$.config.function{key}", "string")
    body = F.try_variant_get("node", "$.config.function", "variant")
    whole = F.when(jsonwalk.is_string(body), get(""))
    decoded = utf8(F.try_to_binary(whole, F.lit("base64")))
    named = F.concat(F.lit("Function: "), F.coalesce(get(".module"), F.lit("")), F.lit("."), get(".function_name"))
    text = F.coalesce(
        decoded,
        whole,
        named,
        get(".code"),
        F.concat(F.lit("Bytecode: "), F.substring(get(".bytecode"), 1, 100)),
        F.to_json(body),
    )
    return (
        nodes.where(F.col("class_name") == "Lambda")
        .select("path", F.concat("source", F.lit(":"), "config_path", F.lit("/function")).alias("source"), text.alias("text"))
        .where(F.coalesce(F.length("text"), F.lit(0)) > 0)
    )


def lambda_code(nodes: DataFrame) -> DataFrame:
    return rules_scan(lambda_bodies(nodes))


def module_imports(nodes: DataFrame) -> DataFrame:
    return _finding(
        nodes.where(F.col("module").isin(M.KERAS_BAD_MODULES)),
        "Keras - Dangerous Module Import", "Critical", 9.8,
        F.concat(F.lit("Configuration imports "), F.col("module")), "CWE-94",
        module=F.col("module"),
    )


def safe_mode(nodes: DataFrame) -> DataFrame:
    return _finding(
        nodes.where(F.col("class_name") == "enable_unsafe_deserialization"),
        "Keras - Safe Mode Bypass", "Critical", 9.5,
        "Configuration switches safe loading off", "CWE-502",
    )


def custom_objects(nodes: DataFrame) -> DataFrame:
    custom = F.col("class_name").isin("Custom", "CustomObject") | F.contains(F.lower("module"), F.lit("custom"))
    return _finding(
        nodes.where(custom), "Keras - Custom Layer Detected", "High", 7.0,
        "A custom layer needs code from elsewhere", "CWE-94", module=F.col("module"),
    )


def url_ssrf(nodes: DataFrame) -> DataFrame:
    """``weights_url``, or ``origin`` beside a ``get_file`` call, that leads inside."""
    weights = F.try_variant_get("node", "$.weights_url", "string")
    origin = F.when(F.contains(F.to_json("node"), F.lit("get_file")), F.try_variant_get("node", "$.origin", "string"))
    rows = fixed(nodes, url=F.coalesce(weights, origin)).where(F.length("url") > 0)
    tests = [(F.contains(F.lower("url"), F.lit(w)), w) for w in M.KERAS_SSRF_WORDS]
    rows = fixed(rows, indicator=first_match(tests)).where(F.col("indicator").isNotNull())
    return _finding(
        rows, "Keras - SSRF in Model Config", "Critical", 9.0,
        F.concat(F.lit("Configuration fetches from "), F.col("url")), "CWE-918",
        url=F.col("url"), indicator=F.col("indicator"),
    )


def dos_units(nodes: DataFrame, limit: int = 1_000_000_000) -> DataFrame:
    rows = nodes.withColumn("units", F.try_variant_get("node", "$.config.units", "decimal(38,0)"))
    whole = F.schema_of_variant(F.try_variant_get("node", "$.config.units", "variant"))
    integer = (whole == "BIGINT") | F.rlike(whole, F.lit(r"^DECIMAL\(\d+,0\)$"))
    return _finding(
        rows.where(integer & (F.col("units") > limit)), "Keras - DoS via Large Layer", "High", 7.5,
        F.concat(F.lit("Layer of "), F.col("units").cast("string"), F.lit(" units")), "CWE-400",
        units=F.col("units"),
    )


def callbacks(nodes: DataFrame) -> DataFrame:
    """One finding per LambdaCallback in a ``callbacks`` list."""
    table = nodes.sparkSession.tvf
    listed = nodes.withColumn("_list", F.try_variant_get("node", "$.callbacks", "variant")).where(
        F.col("_list").isNotNull()
    )
    rows = (
        listed.lateralJoin(table.variant_explode(F.col("_list").outer()))
        .where(F.try_variant_get("value", "$.class_name", "string") == "LambdaCallback")
        .withColumn("config_path", F.concat("config_path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
    )
    return _finding(
        rows, "Keras - LambdaCallback RCE", "Critical", 9.0,
        "A callback runs code while training", "CWE-94", callback=F.substring(F.to_json("value"), 1, 500),
    )


def config_findings(texts: DataFrame) -> DataFrame:
    """Text rules and node rules of configurations."""
    nodes = config_nodes(texts)
    found = rules_scan(texts)
    for rule in (
        lambda_layers, lambda_code, module_imports, safe_mode, custom_objects, url_ssrf, dos_units, callbacks,
    ):
        found = found.unionByName(rule(nodes))
    return found
