"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import cut, unused

#: White space of the word pattern, as a Java character class.
SPACES = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text, as a long; 0 for null."""
    ends = F.regexp_replace(text, rf"[^{SPACES}]++[{SPACES}]*+", "\u0001")
    lead = F.regexp_replace(F.substring(text, 1, 1), rf"[{SPACES}]", "")
    # white space before the first word is the only text that isn't replaced
    body = F.when(lead == "", F.regexp_replace(ends, rf"^[{SPACES}]++", "")).otherwise(ends)
    return F.coalesce(F.length(body).cast("long"), F.lit(0).cast("long"))


def cyclic_weights(sources: DataFrame, cycle: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """source, weight: the sources in order of code points, null last, get the cycle's weights in turn.

    ``sources`` has a row for each source: a catalogue, so its ranking in one task is bounded by the number of sources."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (rank % len(cycle) + 1).cast("int"))
    return sources.select("source", pick.alias("weight"))


def fill(sizes: DataFrame, max_epochs: float, budget: int | None = None) -> DataFrame:
    """Target of each source: (source, weight, source_size) -> plus target.

    Water-filling: the budget (all sizes by default) is shared by weight; sources above max_epochs times their size are
    clamped there, and what they leave over is shared by weight among the rest, until none is above.  Each round reads two
    sums; at least one more source is clamped in each.  Sources of size 0 and of weight 0 or null get 0."""
    sizes = cut(sizes.select("source", F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight"), "source_size", (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")))
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    budget = total if budget is None else budget
    level = 0.0  # target of an unclamped source per unit of weight; it only rises
    while True:
        free = (F.col("weight") > 0) & (F.col("cap") > F.col("weight") * F.lit(level))
        clamped, weight = sizes.agg(F.sum(F.when((F.col("weight") > 0) & ~free, F.col("cap")).otherwise(0.0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0))).first()
        if not weight:
            break
        rise = max(budget - (clamped or 0.0), 0.0) / weight
        if rise <= level:
            break
        level = rise
    return sizes.select("source", "weight", "source_size", F.when(F.col("weight") > 0, F.least(F.col("cap"), F.col("weight") * F.lit(level))).otherwise(0.0).alias("target"))


def _order(key: str, seed: int) -> Column:
    """A seeded order of rows that doesn't depend on partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def mixing_plan(rows: DataFrame, size: str, source: str = "source", key: str = "doc_id", weights: DataFrame | None = None, max_epochs: float = 3, seed: int = 0, budget: int | None = None, rows_per_bucket: int = 20_000) -> DataFrame:
    """A row for each source: source, source_size, target, whole (repetitions of every row) and last.

    A row of the source is taken once more if its seeded order is less than ``last``.  Rows (narrow: key, source, size) are
    summed by (source, hash bucket) first; only the bucket in which a source's remaining words end is sorted, so a source
    with a third of all rows meets in no task, and buckets hold about rows_per_bucket rows at any scale."""
    rows = cut(rows.select(F.col(key).alias("_key"), F.col(source).alias("source"), F.col(size).alias("_size")).withColumn("_hash", _order("_key", seed)))
    sums = cut(rows.groupBy("source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_rows")))
    if weights is None:
        weights = cyclic_weights(sums)
    weights = weights.select(F.col("source").alias("_source"), "weight")
    filled = fill(sums.join(weights, sums["source"].eqNullSafe(weights["_source"]), "left"), max_epochs, budget)
    whole = F.expr("if(source_size > 0, cast(floor(target + 0.5D) as bigint) div source_size, 0L)")
    plan = cut(filled.select(F.col("source").alias("_source"), "source_size", "target", whole.alias("whole")).withColumn("_extra", F.expr("cast(floor(target + 0.5D) as bigint) - whole * source_size")))
    largest, digits = sums.agg(F.max("_rows")).first()[0] or 0, 1
    while 16**digits * rows_per_bucket < largest:
        digits += 1
    rows = rows.withColumn("_bucket", F.substring("_hash", 1, digits))
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("_size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    edges = buckets.join(plan, buckets["source"].eqNullSafe(plan["_source"])).where("_before < _extra and _before + _sum >= _extra").select("_source", F.col("_bucket").alias("_edge"), "_before", "_extra")
    inside = rows.join(edges, rows["source"].eqNullSafe(edges["_source"]) & (rows["_bucket"] == edges["_edge"]))
    run = F.sum("_size").over(Window.partitionBy("_source", "_edge").orderBy("_hash", "_size").rowsBetween(Window.unboundedPreceding, -1))
    inside = inside.withColumn("_run", F.coalesce(run, F.lit(0)) + F.col("_before"))
    last = inside.groupBy("_source", "_edge").agg(F.max(F.when(F.expr("_run + _size / 2 <= _extra"), F.col("_hash"))).alias("_hash"))
    last = last.select(F.col("_source").alias("source"), F.coalesce(F.concat("_hash", F.lit("~")), "_edge").alias("last"))
    return cut(plan.join(last, plan["_source"].eqNullSafe(last["source"]), "left").select(plan["_source"].alias("source"), "source_size", "target", "whole", F.coalesce("last", F.lit("")).alias("last")))


def apply_plan(docs: DataFrame, plan: DataFrame, source: str = "source", key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Adds source_size, target and copies (times that the mix takes the whole row) to docs; columns of these names are replaced.

    A join with the catalogue of sources: broadcast while that is short, else shuffled."""
    own = {c: unused(f"_{c}", docs.columns) for c in ("source", "source_size", "target", "whole", "last")}
    plan = plan.select(*[F.col(c).alias(name) for c, name in own.items()])
    if plan.count() <= 10_000:
        plan = F.broadcast(plan)
    docs = docs.drop("source_size", "target", "copies")
    out = docs.join(plan, docs[source].eqNullSafe(plan[own["source"]]), "left")
    copies = F.col(own["whole"]) + F.when(_order(key, seed) < F.col(own["last"]), 1).otherwise(0)
    out = out.withColumns({"source_size": F.col(own["source_size"]), "target": F.col(own["target"]), "copies": copies.cast("long")})
    return out.drop(*own.values())


def mix(docs: DataFrame, size: str, source: str = "source", key: str = "doc_id", weights: DataFrame | None = None, max_epochs: float = 3, seed: int = 0, budget: int | None = None) -> DataFrame:
    """Adds source_size, target, copies (times that the mix takes the whole row) and taken (size * copies) to docs.

    The target of a source is max_epochs times its size at most (see fill).  Every row is taken target div source_size
    times; the remaining part of a repetition takes rows in a seeded order until its words are reached, the last one if at
    least half of it fits.  The order is by md5 of seed and key, so reruns agree whatever the partitioning.

    Null sources are a source of their own, as is the empty name; rows with one key (null included) are all taken once
    more, or none.  Rows of size 0 take 0 words.  Without rows the result is empty.  weights: (source, weight); by default
    1, 2, 3 in turn."""
    plan = mixing_plan(docs, size, source, key, weights, max_epochs, seed, budget)
    return apply_plan(docs.drop("taken"), plan, source, key, seed).withColumn("taken", F.col("copies") * F.col(size))


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say, without the columns that mix added."""
    copy = unused("_copy", mixed.columns)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").withColumn(copy, times).drop(copy, "copies", "target", "source_size", "taken")
