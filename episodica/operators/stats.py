"""Per-dimension statistics of vector columns, exact and mergeable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.sources.shared import cut, small

#: Values of a group up to which one task may hold them all to find quantiles; the result is the same either way.
GROUP_VALUES = 1 << 20


def dims(df: DataFrame, vector: str | Column, keys: list[str]) -> DataFrame:
    """A row for each component of non-null vectors: keys, dim (0-based), x (double)."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return df.select(*keys, v.alias("_v")).where("_v is not null").select(*keys, F.posexplode("_v").alias("dim", "_x")).select(*keys, F.col("dim").cast("long").alias("dim"), F.col("_x").cast("double").alias("x"))


def exact_stats(components: DataFrame, keys: list[str], bins: int = 4096) -> DataFrame:
    """min, max, mean, population std and interpolated 1 % and 99 % quantiles of x by keys and dim: one aggregation for all
    dims for groups that one task may hold; else quantiles by exact_quantiles, beside the first aggregation."""
    by = [*keys, "dim"]
    plain = [F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")]
    out = cut(components.groupBy(*by).agg(*plain, F.count("x").alias("_n")))
    most = out.agg(F.max("_n")).first()[0] or 0
    if most <= GROUP_VALUES:
        out = components.groupBy(*by).agg(*plain, F.percentile("x", F.array(F.lit(0.01), F.lit(0.99))).alias("_q"))
        return out.withColumns({"q01": F.col("_q")[0], "q99": F.col("_q")[1]}).drop("_q")
    q = exact_quantiles(components, out.select(*by, "min", "max", "_n"), by, {"q01": 0.01, "q99": 0.99}, bins)
    return _matched(out, q, by).drop("_n")


def _matched(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """left joined with right by columns that may be null."""
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in by})
    met = [left[c].eqNullSafe(right[f"_r_{c}"]) for c in by]
    return left.join(right, reduce(lambda a, b: a & b, met), how).drop(*[f"_r_{c}" for c in by])


def exact_quantiles(components: DataFrame, spans: DataFrame, by: list[str], quantiles: dict[str, float], bins: int = 4096) -> DataFrame:
    """by and a column for each quantile of x, interpolated between its two neighbours in order.

    spans: by, min, max and _n (a row for each group).  No group's values meet in one task: they are counted by bins of equal
    width first, and only the values in the bins that hold a sought rank are counted one by one and ordered."""
    spans = small(spans)
    width = (F.col("max") - F.col("min")) / bins
    cell = F.when(F.col("max") > F.col("min"), F.least(F.floor((F.col("x") - F.col("min")) / width), F.lit(bins - 1))).otherwise(0).cast("long")
    binned = _matched(components.select(*by, "x").where("x is not null"), spans.select(*by, "min", "max"), by, "inner").select(*by, "x", cell.alias("_bin"))
    counts = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_before", F.sum("_c").over(Window.partitionBy(*by).orderBy("_bin")) - F.col("_c"))  # bins of a group
    rank = lambda q: F.lit(q) * (F.col("_n") - 1)
    sought = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("side"), (F.floor if k == 0 else F.ceil)(rank(q)).cast("long").alias("rank"), (rank(q) - F.floor(rank(q))).alias("part")) for name, q in quantiles.items() for k in (0, 1)])
    ranks = spans.select(*by, F.explode(sought).alias("s")).select(*by, "s.*")
    at = _matched(ranks, counts, by, "inner").where("rank >= _before and rank < _before + _c")
    at = cut(at.select(*by, "_bin", "name", "side", "part", (F.col("rank") - F.col("_before")).alias("place")))
    inside = _matched(binned, small(at.select(*by, "_bin").distinct()), [*by, "_bin"], "inner")
    ties = inside.groupBy(*by, "_bin", "x").agg(F.count("*").alias("_c"))
    ties = ties.withColumn("_before", F.sum("_c").over(Window.partitionBy(*by, "_bin").orderBy("x")) - F.col("_c"))
    found = _matched(at, ties, [*by, "_bin"], "inner").where("place >= _before and place < _before + _c")
    value = lambda name, k: F.max(F.when((F.col("name") == name) & (F.col("side") == k), F.col("x")))
    part = lambda name: F.max(F.when(F.col("name") == name, F.col("part")))
    return found.groupBy(*by).agg(*[(value(name, 0) + (value(name, 1) - value(name, 0)) * part(name)).alias(name) for name in quantiles])


def histogram_stats(components: DataFrame, keys: list[str], bins: int = 5000, quantiles: tuple[float, ...] = (0.01, 0.99)) -> DataFrame:
    """Mergeable statistics: mean and std from sums, quantiles as left edges of equal-width bins.

    Two passes: the range by key, then counts by bin; only bins x keys rows are ordered, whatever the number of rows."""
    by = [*keys, "dim"]
    span = components.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("_sq"))
    width = (F.col("hi") - F.col("lo")) / bins
    span = cut(span)
    binned = _matched(components, small(span.select(*by, "lo", "hi")), by, "inner")
    bin_of = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    counts = binned.groupBy(*by, bin_of.alias("bin")).agg(F.count("*").alias("c"))
    counts = _matched(counts.withColumn("cum", F.sum("c").over(Window.partitionBy(*by).orderBy("bin"))), span, by, "inner")
    edges = [F.min(F.when(F.col("cum") >= F.lit(q) * F.col("n"), F.col("lo") + F.col("bin") * width)).alias(f"q{round(q * 100):02d}") for q in quantiles]
    std = F.sqrt(F.greatest(F.first("_sq") - F.first("mean") * F.first("mean"), F.lit(0.0)))
    return counts.groupBy(*by).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), std.alias("std"), *edges)


def override(stats: DataFrame, newer: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of stats, replaced one by one where newer has a value."""
    values = [c for c in stats.columns if c not in keys]
    new = newer.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    return _matched(stats, new, keys).select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def histogram_states(components: DataFrame, keys: list[str], bins: int = 5000) -> DataFrame:
    """Mergeable states by keys and dim: n, mean, mean_sq, lo, hi and counts (array of struct(bin, c)) over equal bins of [lo, hi]."""
    by = [*keys, "dim"]
    span = cut(components.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg(F.col("x") * F.col("x")).alias("mean_sq")))
    binned = _matched(components, small(span.select(*by, "lo", "hi")), by, "inner")
    counts = binned.groupBy(*by, _bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.count("*").alias("c"))
    return _matched(span, counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("counts")), by, "inner")


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    return F.when(high > low, F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1))).otherwise(0).cast("long")


def merge_states(states: DataFrame, by: list[str], bins: int = 5000) -> DataFrame:
    """States of the same key as one: means weighted by n, counts moved by their bins' left edges into bins of the common range."""
    weighted = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    whole = states.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), weighted("mean"), weighted("mean_sq"), F.sum("n").alias("n"))
    edges = states.select(*by, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.explode("counts").alias("_s"))
    edges = edges.select(*by, (F.col("_lo") + F.col("_s.bin") * ((F.col("_hi") - F.col("_lo")) / bins)).alias("_edge"), F.col("_s.c").alias("c"))
    moved = _matched(edges, whole.select(*by, "lo", "hi"), by, "inner").groupBy(*by, _bin(F.col("_edge"), F.col("lo"), F.col("hi"), bins).alias("bin")).agg(F.sum("c").alias("c"))
    return _matched(whole, moved.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("bin", "c"))).alias("counts")), by, "inner")


def state_quantiles(states: DataFrame, by: list[str], quantiles: tuple[float, ...] = (0.01, 0.99), bins: int = 5000) -> DataFrame:
    """n, mean, std and quantiles of states: the left edge of the first bin up to which that share has been counted; fewer than two rows raise."""
    start = F.struct(F.lit(0).cast("long").alias("cum"), F.lit(None).cast("long").alias("bin"))
    step = lambda q: lambda s, b: F.struct((s["cum"] + b["c"]).alias("cum"), F.when(s["bin"].isNull() & (s["cum"] + b["c"] >= F.lit(q) * F.col("n")), b["bin"]).otherwise(s["bin"]).alias("bin"))
    edge = lambda q: F.col("lo") + F.aggregate("counts", start, step(q), lambda s: s["bin"]) * ((F.col("hi") - F.col("lo")) / bins)
    few = F.raise_error(F.lit("statistics need two rows at least")).cast("long")
    std = F.sqrt(F.greatest(F.col("mean_sq") - F.col("mean") * F.col("mean"), F.lit(0.0)))
    return states.select(*by, F.when(F.col("n") > 1, F.col("n")).otherwise(few).alias("n"), "mean", std.alias("std"), *[edge(q).alias(f"q{round(q * 100):02d}") for q in quantiles])
