"""Statistics of weight tensors.

``slices`` has ``path``, ``layer``, ``first_pos`` and ``values``: a tensor in
pieces of bounded size. A slice is summed up where it is read (count, mean,
squares, extremes, edge values, moments of its steps), summaries of a layer are
combined, and a second reading with the layer's statistics gives a histogram
and a count of far values per slice. No row stands for a single number but in
the count of distinct values, which travel in arrays by hash.

A caller whose slices are only described (where to read them) gives ``load``,
which adds ``values``: then the descriptions are shuffled, never the numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamperlens.functions.findings import as_findings
from tamperlens.functions.groups import capped_lists, join_per_key

KEYS = ["path", "layer"]
MIN_VALUES = 100
# Values of a slice (and those that a Python task holds at a time), and distinct values that one task compares at a time.
SLICE, BUCKET = 1 << 20, 1 << 16
FAR = 3.0
_FLAT = 1e-10

Loader = Callable[[DataFrame], DataFrame]


def sliced(rows: DataFrame, width: int = SLICE) -> DataFrame:
    """Slices out of single numbers (path, layer, pos, value); nulls are left out."""
    numbered = F.array_sort(F.collect_list(F.struct("pos", F.col("value").cast("double").alias("value"))))
    return (
        rows.where(F.col("value").isNotNull())
        .groupBy(*KEYS, F.floor(F.col("pos") / F.lit(width)).alias("_part"))
        .agg(F.min("pos").alias("first_pos"), numbered.alias("_v"))
        .select(*KEYS, "first_pos", F.transform("_v", lambda v: v["value"]).alias("values"))
    )


def _moments(values: np.ndarray) -> tuple[int, float, float]:
    if not len(values):
        return 0, 0.0, 0.0
    mean = float(values.mean())
    return len(values), mean, float(((values - mean) ** 2).sum())


_SUMMARY = pa.schema([
    ("n", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()), ("low", pa.float64()), ("high", pa.float64()),
    ("first", pa.float64()), ("last", pa.float64()), ("step_n", pa.int64()), ("step_mean", pa.float64()), ("step_m2", pa.float64()),
])


def _pieces(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into pieces of about ``most`` values, or of one slice."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("values")).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff((ends - 1) // most)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _per_slice(batches: Iterable[pa.RecordBatch], keep: list[str], make: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``make(values, row)`` beside the columns kept."""
    for batch in batches:
        rows = batch.select([c for c in batch.schema.names if c != "values"]).to_pylist()
        out = [make(batch.column("values")[k].values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), row) for k, row in enumerate(rows)]
        if out:
            made = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *schema.names])


def _summed_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def make(values: np.ndarray, _: dict) -> tuple:
        return *_moments(values), float(values.min()), float(values.max()), float(values[0]), float(values[-1]), *_moments(np.diff(values))

    return _per_slice(batches, [*KEYS, "first_pos"], make, _SUMMARY)


def summaries(slices: DataFrame) -> DataFrame:
    """One row of statistics per slice."""
    kinds = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double'}" for f in _SUMMARY)
    return slices.where(F.size("values") > 0).select(*KEYS, "first_pos", "values").mapInArrow(_summed_up, f"path string, layer string, first_pos long, {kinds}")


def _merged(parts: Column) -> Column:
    """(n, mean, m2) of all of some disjoint parts, by one fold over them."""

    def add(whole: Column, p: Column) -> Column:
        n = whole["n"] + p["n"]
        apart = p["mean"] - whole["mean"]
        more = F.struct(
            n.alias("n"), (whole["mean"] + apart * p["n"] / n).alias("mean"),
            (whole["m2"] + p["m2"] + apart * apart * whole["n"] * p["n"] / n).alias("m2"),
        )
        # The first part with values starts the sums.
        return F.when(p["n"] == 0, whole).when(whole["n"] == 0, p).otherwise(more)

    nothing = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(parts, nothing, add)


def layer_stats(slices: DataFrame) -> DataFrame:
    """(path, layer, n, mean, std, low, high, steps, diff_std) of every layer; steps run across slices."""
    part = lambda n, mean, m2: F.struct(n.cast("bigint").alias("n"), mean.alias("mean"), m2.alias("m2"))
    gathered = summaries(slices).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("first_pos", *_SUMMARY.names))).alias("s"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    values = F.transform("s", lambda p: part(p["n"], p["mean"], p["m2"]))
    inside = F.transform("s", lambda p: part(p["step_n"], p["step_mean"], p["step_m2"]))
    behind = F.slice("s", F.lit(2), F.size("s"))
    between = F.zip_with(F.slice("s", F.lit(1), F.size("s") - 1), behind, lambda a, b: part(F.lit(1), b["first"] - a["last"], F.lit(0.0)))
    told = gathered.select(*KEYS, _merged(values).alias("v"), _merged(F.concat(inside, between)).alias("d"), "low", "high")
    spread = lambda whole: F.when(F.col(whole)["n"] > 0, F.sqrt(F.col(whole)["m2"] / F.col(whole)["n"]))
    return told.select(
        *KEYS, F.col("v")["n"].alias("n"), F.col("v")["mean"].alias("mean"), spread("v").alias("std"),
        "low", "high", F.col("d")["n"].alias("steps"), spread("d").alias("diff_std"),
    )


def bins_of(n: Column) -> Column:
    return F.least(F.lit(100), F.floor(n / 10)).cast("bigint")


_MEASURED = pa.schema([
    ("n", pa.int64()), ("far", pa.int64()), ("max_z", pa.float64()), ("filled", pa.list_(pa.int64())),
    ("distinct", pa.list_(pa.struct([("bucket", pa.int32()), ("held", pa.list_(pa.float64()))]))),
])


class _Distinct:
    """Distinct values of the slices of a task, by layer.

    They leave in one row per layer, by hash. A slice alone has few values for each
    of a large layer's buckets; those of many slices make arrays that are worth a row.
    """

    def __init__(self, most: int):
        self.most, self.count, self.held = most, 0, {}

    def add(self, layer: tuple, values: np.ndarray) -> None:
        # A zero and its negative are one value.
        self.held.setdefault(layer, []).append(values + 0.0)
        self.count += len(values)

    def full(self) -> bool:
        """Whether too many values are held, even when each is held once."""
        if self.count < self.most:
            return False
        self.held = {layer: [np.unique(np.concatenate(parts))] for layer, parts in self.held.items()}
        self.count = sum(len(parts[0]) for parts in self.held.values())
        return self.count >= self.most // 2

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All that is held, which is then left behind."""
        held, self.held, self.count = self.held, {}, 0
        if not held:
            return
        buckets, sizes, values, entries = [], [], [], [0]
        for (_, _, _, among), parts in held.items():
            once = np.unique(np.concatenate(parts))
            bits = once.view(np.uint64)
            bucket = ((bits ^ (bits >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(among)
            found, size = np.unique(bucket, return_counts=True)
            buckets.append(found)
            sizes.append(size)
            values.append(once[np.argsort(bucket, kind="stable")])
            entries.append(entries[-1] + len(found))
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values)))
        pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets).astype(np.int32)), lists], ["bucket", "held"])
        told = [(path, layer, n, 0, None, []) for path, layer, n, _ in held]
        kinds = [pa.string(), pa.string(), *_MEASURED.types]
        columns = [pa.array(c, kind) for c, kind in zip(zip(*told), kinds)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(entries, pa.int32()), pairs)], [*KEYS, *_MEASURED.names])


def _measure(threshold: float, most: int = SLICE):
    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = _Distinct(most)

        def make(values: np.ndarray, row: dict) -> tuple:
            far, largest, filled = 0, None, []
            if row["std"] >= _FLAT:
                z = np.abs((values - row["mean"]) / row["std"])
                far, largest = int((z > threshold).sum()), float(z.max())
            if row["high"] - row["low"] >= _FLAT and row["bins"]:
                slot = np.floor((values - row["low"]) * row["bins"] / (row["high"] - row["low"])).astype(np.int64)
                filled = np.bincount(np.minimum(slot, row["bins"] - 1), minlength=row["bins"])
            if row["buckets"]:
                distinct.add((row["path"], row["layer"], row["n"], row["buckets"]), values)
            return row["n"], far, largest, filled, []

        for told in _per_slice(_pieces(batches, most), KEYS, make, _MEASURED):
            yield told
            if distinct.full():
                yield from distinct.rows()
        yield from distinct.rows()

    return measure


def measured(slices: DataFrame, stats: DataFrame, threshold: float = FAR, unique_above: int = 1000, load: Loader | None = None) -> DataFrame:
    """Per slice: values of its layer, far values, the largest deviation and counts per bin; beside them,
    rows of the distinct values by hash for layers of over ``unique_above`` values."""
    known = stats.select(
        *KEYS, "n", "mean", "std", "low", "high", bins_of(F.col("n")).alias("bins"),
        F.when(F.col("n") > unique_above, F.ceil(F.col("n") / BUCKET)).otherwise(0).cast("bigint").alias("buckets"),
    )
    # The slices of a large layer go to several tasks.
    joined = join_per_key(slices, known, KEYS, F.xxhash64("first_pos"))
    held = joined if load is None else load(joined)
    kinds = "n long, far long, max_z double, filled array<long>, distinct array<struct<bucket: int, held: array<double>>>"
    # With the same columns as ``summaries`` reads, slices that have to be made are made once for both.
    names = [*KEYS, "first_pos", "values", "n", "mean", "std", "low", "high", "bins", "buckets"]
    return held.where(F.size("values") > 0).select(*names).mapInArrow(_measure(threshold), f"path string, layer string, {kinds}")


def _outliers(found: DataFrame, stats: DataFrame, share: float) -> DataFrame:
    per_layer = found.groupBy(*KEYS).agg(F.sum("far").alias("outlier_count"), F.max("max_z").alias("max_zscore"))
    ratio = F.col("outlier_count") / F.col("n")
    large = stats.where((F.col("n") >= MIN_VALUES) & (F.col("std") >= _FLAT)).select(*KEYS, "n")
    return per_layer.join(large, KEYS).select(*KEYS, "outlier_count", ratio.alias("outlier_ratio"), "max_zscore").where(F.col("outlier_ratio") > share)


def _uniqueness(found: DataFrame, share: float, more_than: int) -> DataFrame:
    # The number of a layer's values came along: asking the statistics for it would work them out again.
    listed = found.select(*KEYS, F.col("n").alias("total_values"), F.inline("distinct"))
    per_bucket = listed.groupBy(*KEYS, "total_values", "bucket").agg(F.size(F.array_distinct(F.flatten(F.collect_list("held")))).cast("bigint").alias("u"))
    counts = per_bucket.groupBy(*KEYS, "total_values").agg(F.sum("u").alias("unique_values"))
    ratio = F.col("unique_values") / F.col("total_values")
    large = counts.where(F.col("total_values") > more_than).select(*KEYS, "unique_values", "total_values", ratio.alias("uniqueness_ratio"))
    return large.where(F.col("uniqueness_ratio") < share)


def _stepped(stats: DataFrame, tolerance: float) -> DataFrame:
    return stats.where((F.col("steps") > 100) & (F.col("diff_std") < tolerance)).select(*KEYS, "steps", "diff_std")


def _entropy(found: DataFrame, stats: DataFrame, threshold: float) -> DataFrame:
    large = stats.where(F.col("n") >= MIN_VALUES)
    constant = large.where(F.col("high") - F.col("low") < _FLAT).select(
        *KEYS, F.lit(0.0).alias("entropy"), F.lit(None).cast("bigint").alias("bins"), F.lit("constant_values").alias("issue")
    )
    added = F.aggregate(
        F.slice("all", F.lit(2), F.size("all")), F.element_at("all", 1), lambda total, more: F.zip_with(total, more, lambda a, b: a + b)
    )
    filled = found.where(F.size("filled") > 0).groupBy(*KEYS).agg(F.collect_list("filled").alias("all")).select(*KEYS, added.alias("filled"))
    varied = large.where(F.col("high") - F.col("low") >= _FLAT).select(*KEYS, "n", bins_of(F.col("n")).alias("bins"))
    joined = filled.join(varied, KEYS)
    share = lambda m: m / F.col("n")
    bits = F.aggregate(F.filter("filled", lambda m: m > 0), F.lit(0.0), lambda total, m: total - share(m) * F.log2(share(m)))
    measured = joined.select(*KEYS, (bits / F.log2(F.col("bins"))).alias("entropy"), "bins", F.lit("low_entropy").alias("issue"))
    return constant.unionByName(measured.where(F.col("entropy") < threshold))


def _loaded(slices: DataFrame, load: Loader | None) -> DataFrame:
    return slices if load is None else load(slices)


def outliers(slices: DataFrame, threshold: float = FAR, share: float = 0.01, load: Loader | None = None) -> DataFrame:
    """Layers in which over 1 % of the values lie beyond three deviations."""
    stats = layer_stats(_loaded(slices, load))
    large = stats.where((F.col("n") >= MIN_VALUES) & (F.col("std") >= _FLAT))
    return _outliers(measured(slices, large, threshold, 2**62, load), large, share)


def uniqueness(slices: DataFrame, share: float = 0.5, more_than: int = 1000, load: Loader | None = None) -> DataFrame:
    """Large layers in which fewer than half of the values differ.

    Distinct values of slices go to as many tasks as the layer needs, so none sees a whole layer.
    """
    slices = slices.where(F.col("path").isNotNull() & F.col("layer").isNotNull())
    stats = layer_stats(_loaded(slices, load)).where(F.col("n") > more_than)
    return _uniqueness(measured(slices, stats, FAR, more_than, load), share, more_than)


def constant_step(slices: DataFrame, tolerance: float = 1e-6, load: Loader | None = None) -> DataFrame:
    """Layers whose successive differences hardly vary."""
    return _stepped(layer_stats(_loaded(slices, load)), tolerance)


def entropy(slices: DataFrame, threshold: float = 0.5, load: Loader | None = None) -> DataFrame:
    """Layers whose histogram carries less than half of the possible entropy."""
    stats = layer_stats(_loaded(slices, load))
    return _entropy(measured(slices, stats.where(F.col("n") >= MIN_VALUES), FAR, 2**62, load), stats, threshold)


def anomalies(slices: DataFrame, load: Loader | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(path, layer, type) of every anomaly; a layer has at most one per type.

    The numbers are read twice: for the statistics of layers, and with them.
    ``keep`` stores the two small tables, so that each reading happens once.
    """
    keep = keep or (lambda df, name: df)
    stats = keep(layer_stats(_loaded(slices, load)), "layer_stats")
    found = keep(measured(slices, stats, load=load), "measured")
    repeated = _uniqueness(found, 0.5, 1000)
    # A layer that lacks distinct values is not tested for steps: one anomaly of the kind.
    patterns = repeated.select(*KEYS).unionByName(_stepped(stats.where(F.col("n") >= MIN_VALUES), 1e-6).select(*KEYS)).distinct()
    kinds = {"outlier_weights": _outliers(found, stats, 0.01), "unusual_pattern": patterns, "low_entropy": _entropy(found, stats, 0.5)}
    out = None
    for kind, rows in kinds.items():
        tagged = rows.select(*KEYS, F.lit(kind).alias("type"))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def verdicts(anomalies: DataFrame) -> DataFrame:
    """One finding per model, graded by how many anomalies of which kind it has."""
    counts = anomalies.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(F.col("type") == "outlier_weights").alias("n_outliers"),
        F.count_if(F.col("type") == "unusual_pattern").alias("n_patterns"),
        F.count_if(F.col("type") == "low_entropy").alias("n_entropy"),
    )
    samples = capped_lists(
        anomalies, ["path"], F.concat_ws(":", "type", "layer"), 5, "samples", "_t", "_d"
    ).select("path", "samples")
    rows = counts.join(samples, "path").withColumn("source", F.col("path"))
    many = (F.col("n_all") >= 5) | ((F.col("n_outliers") >= 3) & (F.col("n_patterns") >= 1))
    some = F.col("n_all") >= 2
    return as_findings(
        rows, "backdoor", "Neural Backdoor - Weight Anomalies",
        F.when(many, "High").when(some, "Medium").otherwise("Low"),
        F.when(many, 7.5).when(some, 5.5).otherwise(3.5),
        F.concat(F.col("n_all").cast("string"), F.lit(" unusual layers")),
        evidence={
            "total_anomalies": F.col("n_all"), "outlier_layers": F.col("n_outliers"),
            "unusual_patterns": F.col("n_patterns"), "low_entropy_regions": F.col("n_entropy"),
            "sample_anomalies": F.array_join("samples", ","),
        },
        advice="Search for triggers before using this model.", cwe="CWE-506",
    )
