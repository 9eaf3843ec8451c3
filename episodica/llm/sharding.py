"""Sharding by sampled splitters: equal bytes, equal texts together, range by range."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from episodica.llm.common import bucket_of, cut
from episodica.sources.shared import small

#: Key ranges per shard at first; rows up to which one task cuts the range in which a shard ends, and that a task numbers.
RANGES, ROWS = 64, 200_000


def shard(rows: DataFrame, key: str, size: str, order: list[str], n_shards: int = 16, seed: int = 0) -> DataFrame:
    """Adds shard (int, 0 to n_shards - 1) and slot (long, gapless from 0 in each shard) to rows, with near-equal sums of size.

    key (long, such as a hash of what must stay together) decides: rows with one key share a shard.  Keys above 1/64 of a
    shard are placed first, largest first on the emptiest shard.  The space of the other keys is cut at quantiles of a
    size-weighted sample of keys into ranges; ranges that turn out overfull are subdivided at quantiles of their own keys.
    They fill the shards in key order up to equal bytes; the range in which a shard ends is subdivided until few rows are left
    in it, and cut between two keys.  A key larger than a whole shard can't stay together: it is subdivided by order into
    pieces below a shard.  Slots are places in order of shard, key and order, counted over range partitions.

    What the driver plans, and tasks are told, are ranges and large keys: their numbers follow n_shards (some 64 of each for a
    shard, and a few for each halving of a range with a shard's end), not the rows.  order: columns that order rows of one
    key (ties share places arbitrarily).  rows should be narrow or cut: they are read several times.  Null keys count as the
    least; sizes must not be null.  Without rows the result is empty."""
    rows = rows.drop("shard", "slot").withColumn("_key", F.coalesce(F.col(key), F.lit(-(2**63))))
    total, count = rows.agg(F.sum(size), F.count("*")).first()
    if not count:
        return rows.drop("_key").withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    spark, ideal = rows.sparkSession, total / n_shards
    # fewer than 64 * n_shards keys
    large = {r["_key"]: r["_bytes"] for r in rows.groupBy("_key").agg(F.sum(size).alias("_bytes")).where(F.col("_bytes") > ideal / 64).collect()}
    pieces = {k: 1 if n <= ideal else -(-64 * n // int(ideal + 1)) for k, n in large.items()}
    told = spark.createDataFrame(list(pieces.items()) or [(None, 1)], "_key long, _pieces long")
    rows = rows.join(F.broadcast(told), "_key", "left")
    piece = F.concat(F.col("_key").cast("string"), F.lit(":"), F.pmod(F.xxhash64(*order, F.lit(seed)), F.col("_pieces")).cast("string"))
    rows = rows.withColumn("_piece", F.when(F.col("_pieces").isNotNull(), piece)).drop("_pieces")
    cold = rows.where("_piece is null")
    placed, ends = _place_large(rows, size, large, ideal, total, n_shards)
    splitters = _splitters(cold, size, order, total, n_shards, seed)
    while True:
        cells = cold.withColumn("_cell", bucket_of(F.col("_key"), splitters))
        loads = {r["_cell"]: r for r in cells.groupBy("_cell").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"), F.min("_key").alias("_low"), F.max("_key").alias("_high")).collect()}
        plan, at = {}, 0  # the first shard of each range, and where in it others begin
        for c in sorted(loads):
            first = next(s for s in range(n_shards) if at < ends[s])
            plan[c] = first, [e - at for e in ends[:-1] if at < e < at + loads[c]["_bytes"]]
            at += loads[c]["_bytes"]
        overfull = [c for c, r in loads.items() if r["_low"] < r["_high"] and (r["_bytes"] > ideal / 16 or plan[c][1] and r["_rows"] > ROWS)]
        if not overfull:
            break
        parts = cells.where(F.col("_cell").isin(overfull)).groupBy("_cell").agg(F.percentile_approx("_key", [k / 16 for k in range(1, 16)]).alias("_cuts"), F.min("_key").alias("_low"), F.max("_key").alias("_high")).collect()
        splitters = sorted({*splitters, *(c for r in parts for c in [*r["_cuts"], r["_high"]] if c > r["_low"])})
    told = [(c, s, []) for c, s in placed.items()] + [(str(c), s, [float(x) for x in cuts]) for c, (s, cuts) in plan.items()]
    told = spark.createDataFrame(told, "_cell string, _first int, _cuts array<double>")
    rows = rows.withColumn("_cell", F.coalesce("_piece", bucket_of(F.col("_key"), splitters).cast("string"))).drop("_piece").join(F.broadcast(told), "_cell")
    whole = rows.where("size(_cuts) = 0").withColumn("shard", F.col("_first"))
    cut_rows = rows.where("size(_cuts) > 0")
    by_key = Window.partitionBy("_cell").orderBy("_key")
    middles = cut_rows.groupBy("_cell", "_key").agg(F.sum(size).alias("_bytes"))
    middles = middles.select(F.col("_cell").alias("_c"), F.col("_key").alias("_k"), (F.sum("_bytes").over(by_key) - F.col("_bytes") / 2).alias("_middle"))
    cut_rows = cut_rows.join(middles, (cut_rows["_cell"] == middles["_c"]) & (cut_rows["_key"] == middles["_k"]))
    cut_rows = cut_rows.withColumn("shard", F.col("_first") + F.size(F.filter("_cuts", lambda x: x <= F.col("_middle")))).drop("_c", "_k", "_middle")
    rows = whole.unionByName(cut_rows).drop("_cell", "_first", "_cuts")
    # slots: ranges of about ROWS rows are sorted, and their shards' rows counted
    by = ["shard", "_key", *[F.col(c).asc_nulls_first() for c in order]]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // ROWS))
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    rows = cut(rows.withColumn("_cell", F.shiftright("_at", 33)))
    counts = rows.groupBy("shard", "_cell").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = small(counts.select("shard", "_cell", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_start")))
    rows = rows.join(starts, ["shard", "_cell"]).withColumns({"slot": F.col("_start") + F.col("_at"), "shard": F.col("shard").cast("int")})
    return rows.drop("_cell", "_at", "_key", "_start")


def _splitters(cold: DataFrame, size: str, order: list[str], total: int, n_shards: int, seed: int) -> list[int]:
    """Quantiles of a sample of keys, in which each row is drawn with a chance in proportion to its size."""
    n = RANGES * n_shards
    chance = F.col(size) * F.lit(16 * n / max(total, 1))
    drawn = cold.where((F.pmod(F.xxhash64("_key", *order, F.lit(seed + 1)), F.lit(1 << 30)) / F.lit(float(1 << 30))) < chance).select("_key")
    return sorted(set(drawn.agg(F.percentile_approx("_key", [k / n for k in range(1, n)], 4 * n)).first()[0] or []))


def _place_large(rows: DataFrame, size: str, large: dict[int, int], ideal: float, total: int, n_shards: int) -> tuple[dict[str, int], list[float]]:
    """The shards of the pieces of large keys, and where in the bytes of all other keys each shard ends."""
    units: dict = {}  # what is placed as one: a key, or a piece of a key larger than a shard
    for r in rows.where("_piece is not null").groupBy("_piece", "_key").agg(F.sum(size).alias("_bytes")).collect():
        units.setdefault(r["_key"] if large[r["_key"]] <= ideal else r["_piece"], []).append(r)
    heap, placed, filled = [(0, s) for s in range(n_shards)], {}, [0] * n_shards
    for _, members in sorted(units.items(), key=lambda u: (-sum(r["_bytes"] for r in u[1]), str(u[0]))):
        load, s = heapq.heappop(heap)
        load += sum(r["_bytes"] for r in members)
        filled[s] = load
        placed.update((r["_piece"], s) for r in members)
        heapq.heappush(heap, (load, s))
    # the rest goes to shards in turn, each up to the level at which all that stay below it are equal
    rest, level, full = total - sum(large.values()), 0.0, sorted(filled)
    for k in range(1, n_shards + 1):
        level = (rest + sum(full[:k])) / k
        if k == n_shards or level <= full[k]:
            break
    ends, at = [], 0.0
    for s in range(n_shards):
        at += max(0.0, level - filled[s])
        ends.append(at)
    ends[-1] = float("inf")
    return placed, ends
