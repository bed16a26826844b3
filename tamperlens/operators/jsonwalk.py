"""Walking JSON documents of any depth as variants.

Each text is parsed once. A level is one generator: every open node is replaced
by its members, a node without members is a leaf, and rows that are done pass
through. So far the walk is one narrow stage, without joins or shuffles. What
lies below ``LEVELS`` is walked inside its row, by a fold over as many steps as it
has brackets: slower for a node, but how deep it is changes nothing in the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 12
_NODE = "struct<json_path: string, name: string, in_list: boolean, node: variant>"
_STATE = f"struct<todo: array<{_NODE}>, done: array<{_NODE}>>"


def is_string(node: Column) -> Column:
    return F.schema_of_variant(node) == "STRING"


def _roots(texts: DataFrame) -> DataFrame:
    # A generator parses a text once, and lets go of what is no JSON.
    return texts.select("path", "source", F.explode(F.array_compact(F.array(F.try_parse_json("text")))).alias("node")).select(
        "path",
        "source",
        F.lit("").alias("json_path"),
        F.lit(None).cast("string").alias("name"),
        F.lit(False).alias("in_list"),
        "node",
        F.lit(True).alias("open"),
    )


def _exploded(nodes: DataFrame) -> DataFrame:
    """Add (pos, key, value) of the members of open nodes; other rows keep NULLs."""
    table = nodes.sparkSession.tvf
    return nodes.lateralJoin(table.variant_explode_outer(F.when(F.col("open"), F.col("node")).outer()))


def _step() -> Column:
    index = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))
    return F.concat("json_path", F.coalesce(F.concat(F.lit("/"), F.col("key")), index))


def _as_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>")


def _members(node: Column) -> Column:
    """Members of an object or list as (step, key, value); NULL for scalars."""
    named = F.transform(F.map_entries(_as_object(node)), lambda e: F.struct(F.concat(F.lit("/"), e["key"]).alias("step"), e["key"].alias("key"), e["value"].alias("value")))
    index = lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))
    listed = F.transform(
        F.try_variant_get(node, "$", "array<variant>"),
        lambda x, i: F.struct(index(i).alias("step"), F.lit(None).cast("string").alias("key"), x.alias("value")),
    )
    return F.coalesce(named, listed)


def _node(path: Column, name: Column, in_list: Column, node: Column) -> Column:
    return F.struct(path.alias("json_path"), name.alias("name"), in_list.alias("in_list"), node.alias("node"))


def _below(enter: Callable[[Column], Column], emit: Callable[[Column, Column], Column]) -> Column:
    """Array of the nodes at and below the row's node that ``emit(node, members)`` picks; ``enter`` picks the members walked into."""
    text = F.to_json("node")
    brackets = F.length(text) - F.length(F.translate(text, "[{", ""))
    root = _node(F.col("json_path"), F.col("name"), F.col("in_list"), F.col("node"))
    start = F.struct(F.array(root).alias("todo"), F.array().cast(f"array<{_NODE}>").alias("done")).cast(_STATE)

    def step(state: Column, _: Column) -> Column:
        """One level: members are looked up once, then sorted into what is done and what is to do."""
        looked = F.transform(state["todo"], lambda n: F.struct(n.alias("n"), _members(n["node"]).alias("members")))

        def sorted_out(found: Column) -> Column:
            below = F.transform(
                F.filter(found, lambda f: F.coalesce(F.size(f["members"]), F.lit(0)) > 0),
                lambda f: F.transform(
                    F.filter(f["members"], enter),
                    lambda m: _node(F.concat(f["n"]["json_path"], m["step"]), m["key"], m["key"].isNull(), m["value"]),
                ),
            )
            out = F.transform(F.filter(found, lambda f: emit(f["n"]["node"], f["members"])), lambda f: f["n"])
            return F.struct(F.flatten(below).alias("todo"), F.concat(state["done"], out).alias("done"))

        return F.when(F.size(state["todo"]) == 0, state).otherwise(F.get(F.transform(F.array(looked), sorted_out), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), brackets + 1), start, step)["done"]


def leaves(texts: DataFrame, depth: int | None = None) -> DataFrame:
    """Scalars of the JSON in ``text``: (path, source, json_path, name, in_list, value, open).

    ``value`` is set for strings only. With a ``depth``, rows still ``open`` lie below
    it. Texts that are not JSON give no rows.
    """
    nodes = _roots(texts).withColumn("value_text", F.lit(None).cast("string"))
    for _ in range((LEVELS if depth is None else depth) + 1):
        member = F.col("pos").isNotNull()
        # Only leaves reach the type test, so it never walks a whole subtree.
        leaf = F.col("open") & ~member
        text = F.when(leaf & is_string(F.col("node")), F.try_variant_get("node", "$", "string"))
        nodes = _exploded(nodes).select(
            "path",
            "source",
            F.when(member, _step()).otherwise(F.col("json_path")).alias("json_path"),
            F.when(member, F.col("key")).otherwise(F.col("name")).alias("name"),
            F.when(member, F.col("key").isNull()).otherwise(F.col("in_list")).alias("in_list"),
            F.col("value").alias("node"),
            member.alias("open"),
            F.when(leaf, text).otherwise(F.col("value_text")).alias("value_text"),
        )
    if depth is None:
        scalar = lambda node, members: F.coalesce(F.size(members), F.lit(0)) <= 0
        leaf = lambda path, name, listed, text: F.struct(path.alias("json_path"), name.alias("name"), listed.alias("in_list"), text.alias("value_text"))
        said = lambda node: F.when(is_string(node), F.try_variant_get(node, "$", "string"))
        deep = F.transform(_below(lambda m: F.lit(True), scalar), lambda n: leaf(n["json_path"], n["name"], n["in_list"], said(n["node"])))
        itself = F.array(leaf(F.col("json_path"), F.col("name"), F.col("in_list"), F.col("value_text")))
        nodes = nodes.select("path", "source", F.inline(F.when(F.col("open"), deep).otherwise(itself))).withColumn("open", F.lit(False))
    return nodes.select("path", "source", "json_path", "name", "in_list", F.col("value_text").alias("value"), "open")


def objects(texts: DataFrame, follow: list[str], depth: int | None = None) -> DataFrame:
    """Objects of the JSON in ``text``: (path, source, json_path, node, open).

    Only members under the ``follow`` keys are entered; lists are entered whole.
    With a ``depth``, rows still ``open`` lie below it.
    """
    nodes = _roots(texts)
    for _ in range((LEVELS if depth is None else depth) + 1):
        member = F.col("pos").isNotNull()
        entered = member & (F.col("key").isNull() | F.col("key").isin(follow))
        # An object is emitted beside its first member; one without members is a leaf.
        first = member & (F.col("pos") == 0) & F.col("key").isNotNull()
        empty = F.col("open") & ~member & (F.schema_of_variant("node") == "OBJECT<>")
        done = ~F.col("open")
        child = F.struct(_step().alias("json_path"), F.col("value").alias("node"), F.lit(True).alias("open"))
        itself = F.struct(F.col("json_path"), F.col("node"), F.lit(False).alias("open"))
        out = (
            F.when(first & entered, F.array(itself, child))
            .when(first | empty | done, F.array(itself))
            .when(entered, F.array(child))
        )
        nodes = _exploded(nodes).select("path", "source", F.explode(out).alias("n")).select(
            "path", "source", F.col("n.json_path").alias("json_path"), F.col("n.node").alias("node"), F.col("n.open").alias("open")
        )
    if depth is None:
        rows = nodes.withColumns({"name": F.lit(None).cast("string"), "in_list": F.lit(False)})
        entered = lambda m: m["key"].isNull() | m["key"].isin(follow)
        found = _below(entered, lambda node, members: _as_object(node).isNotNull())
        deep = F.transform(found, lambda n: F.struct(n["json_path"].alias("json_path"), n["node"].alias("node")))
        itself = F.array(F.struct("json_path", "node"))
        nodes = rows.select("path", "source", F.inline(F.when(F.col("open"), deep).otherwise(itself))).withColumn("open", F.lit(False))
    return nodes


def depth_issues(nodes: DataFrame, scanner: str) -> DataFrame:
    """Issues for nodes below a depth bound that was asked for."""
    return nodes.where("open").select(
        "path",
        F.lit(scanner).alias("scanner"),
        F.lit("warning").alias("kind"),
        F.concat(F.lit("JSON nested deeper than the walk: "), F.col("json_path")).alias("message"),
    )


def parse_issues(texts: DataFrame, scanner: str) -> DataFrame:
    """Issues for texts that should be JSON and are not."""
    return texts.where(F.try_parse_json("text").isNull()).select(
        "path",
        F.lit(scanner).alias("scanner"),
        F.lit("warning").alias("kind"),
        F.concat(F.lit("Not valid JSON: "), F.col("source")).alias("message"),
    )
