"""Graph operators that can run code, touch files or reach the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.findings import findings_of, hit, hits_if
from tamperlens.functions.paths import base_name, parent_dir
from tamperlens.rules import markers as M

_ALL_OPS = [op for *_, ops in M.GRAPH_CLASSES for op in ops]


def graph_ops(texts: DataFrame) -> DataFrame:
    """(path, source, op) for every known operator name in the text."""
    tests = [F.when(F.contains("text", F.lit(op)), F.lit(op)) for op in _ALL_OPS]
    return texts.select("path", "source", F.explode(F.array_compact(F.array(*tests))).alias("op"))


def ops_in(text: Column) -> Column:
    """Sorted array of the known operator names in a text."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(op)), F.lit(op)) for op in sorted(set(_ALL_OPS))]))


def _one_of(names):
    return lambda op: op.isin(list(names))


def class_columns(ops: Column) -> Column:
    """Hits per class of operator, out of the sorted names that occur."""
    tests = []
    for title, level, score, cwe, of_class in M.GRAPH_CLASSES:
        present = F.filter(ops, _one_of(of_class))
        found = hit(
            "graph_injection", f"Graph Injection - {title}", level, score,
            F.concat(F.lit("Graph uses "), F.array_join(present, ", ")),
            evidence={"ops": F.array_join(present, ","), "count": F.size(present)},
            advice="Run only in a sandbox, or remove these operators.", cwe=cwe,
        )
        tests.append((F.size(present) > 0, found))
    return hits_if(*tests)


def graph_columns(text: Column) -> Column:
    """Hits per class of operator in one text."""
    found = F.filter(F.array(ops_in(text)), lambda ops: F.size(ops) > 0)
    return F.flatten(F.transform(found, class_columns))


def graph_findings(texts: DataFrame) -> DataFrame:
    """One finding per class of operator and source."""
    return findings_of(texts, graph_columns(F.col("text")))


def saved_models(paths: DataFrame) -> DataFrame:
    """(directory, graph_file, has_variables) of every SavedModel directory."""
    name = base_name(F.col("path"))
    folder = parent_dir(F.col("path"))
    is_index = (name == "variables.index") & (base_name(folder) == "variables")
    rows = paths.where((name == "saved_model.pb") | is_index).select(
        F.when(is_index, parent_dir(folder)).otherwise(folder).alias("directory"),
        F.when(~is_index, F.col("path")).alias("graph_file"),
        is_index.alias("index"),
    )
    return (
        rows.groupBy("directory")
        .agg(F.max("graph_file").alias("graph_file"), F.bool_or("index").alias("has_variables"))
        .where(F.col("graph_file").isNotNull())
    )


def saved_model_issues(models: DataFrame) -> DataFrame:
    return models.where("has_variables").select(
        F.col("directory").alias("path"),
        F.lit("graph_injection").alias("scanner"),
        F.lit("warning").alias("kind"),
        F.lit("Variables of the SavedModel were not analysed").alias("message"),
    )
