"""Filters, sampling, lookups and unions of row sets."""

from __future__ import annotations

import re
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.sources.shared import cut, small

STRATEGY = re.compile(r"(first|end|random):(\d+)(%?)")
#: Rows of a key up to which a window over the key is one task's work; the rows of keys with more are worked on in blocks.
HOT_ROWS = 1_000_000
BLOCK_ROWS = 100_000
#: Rows up to which the least rows of an order come from a top-n, which ends in one task.
TOP_ROWS = 100_000


def hot_keys(df: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame | None:
    """The values (_key) of key that more than hot_rows (HOT_ROWS) rows of df have; None if there are none."""
    found = cut(df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > (HOT_ROWS if hot_rows is None else hot_rows)).select("_key"))
    return found if found.limit(1).count() else None


def apart(df: DataFrame, key: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df without, and those with, a key of hot (null is a key like others)."""
    hot = small(hot)
    met = df[key].eqNullSafe(hot["_key"])
    return df.join(hot, met, "left_anti"), df.join(hot, met, "left_semi")


def length_filter(df: DataFrame, tokens: str, most: int) -> DataFrame:
    """Rows of at most that many tokens; unknown lengths count as 0."""
    return df.where(F.coalesce(F.col(tokens), F.lit(0)) <= most)


def numbered(df: DataFrame, order: list[Column | str], name: str = "index") -> DataFrame:
    """Adds the 0-based place of each row in order, gapless over all rows.

    Rows are range partitioned and sorted once and numbered from the partitions' counts; no task sees more than its range."""
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def sample(df: DataFrame, strategy: str, order: list[str], seed: int = 42) -> DataFrame:
    """Rows by strategy: all, first:N, end:N or random:N, N a number or a percentage (rounded up) of the rows.

    end:0 keeps all rows, as do strategies of other forms, with a warning.  A number comes from a distributed top-N; a
    percentage, which grows with the table, from the rows' places (see numbered), so neither is one task's work.  Random
    order is by md5 of the seed and the order columns."""
    m = STRATEGY.fullmatch(strategy or "")
    if not m:
        if strategy != "all":
            warnings.warn(f"sampling strategy {strategy!r} is not known: all rows are kept", stacklevel=2)
        return df
    n = int(m[2])
    if m[1] == "end" and n == 0:
        return df
    by = [F.col(c).desc() if m[1] == "end" else F.col(c).asc() for c in order]
    if m[3]:
        n = -(-n * df.count() // 100)
    if m[1] != "random":
        return df.orderBy(*by).limit(n) if n <= TOP_ROWS else numbered(df, by, "_place").where(F.col("_place") < n).drop("_place")
    digest = shuffled(order, seed)[0]
    return least(df, n, F.conv(F.substring(digest, 1, 4), 16, 10).cast("long"), [digest, *by])


def least(df: DataFrame, n: int, score: Column, by: list[Column]) -> DataFrame:
    """The first n rows in the order of by.

    score: a long of at most some 100,000 values that never falls in that order, so that most rows are in or out by it alone.  Rows
    are counted by score; all rows below the score of the n-th are taken as they are, and only those at that score are put in
    order, by range partitions if they are many."""
    if n <= TOP_ROWS:
        return df.orderBy(*by).limit(n)
    rows = df.withColumn("_score", score)
    before, at = 0, None
    for at, count in sorted(tuple(r) for r in rows.groupBy("_score").agg(F.count("*")).collect()):
        if before + count >= n:
            break
        before += count
    else:
        return df
    whole, edge = rows.where(F.col("_score") < at).drop("_score"), rows.where(F.col("_score") == at).drop("_score")
    return whole.unionByName(numbered(edge, by, "_place").where(F.col("_place") < n - before).drop("_place"))


def shuffled(key: list[str], seed: int) -> list[Column]:
    """A seeded order of rows, the same in every run and on every partitioning."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in key]))]


def weighted_subset(df: DataFrame, weight: str, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, likelier with more weight: the smallest -ln(u)/weight, u from md5 of seed and key."""
    rows = df.where(F.col(weight) > 0).withColumn("_r", -F.log(uniform(F.col(key), seed)) / F.col(weight))
    return least(rows, n, F.floor(F.log2("_r") * 256), [F.col("_r"), F.col(key)]).drop("_r")


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) for each key, the same in every run."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") + 1) / F.lit(float(2**32 + 1))


def offsets(df: DataFrame, group: str) -> DataFrame:
    """group, n, start and end (exclusive) of each group when groups follow each other in order; one row for each group."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    end = F.sum("n").over(Window.orderBy(group))  # as many rows as datasets in the catalogue
    return counts.withColumn("end", end).withColumn("start", F.col("end") - F.col("n"))


def in_spans(df: DataFrame, index: str, spans: DataFrame, start: str = "start", end: str = "end", how: str = "inner") -> DataFrame:
    """Rows of df with the columns of the span [start, end) that holds their index; spans must not overlap.

    An equality join: a span of up to 2^k places, but more than half of that, is put into the one or two cells of width 2^k that
    it touches, so a cell meets three spans at most, however unlike the lengths of spans are.  An index is looked up once for
    each k that occurs (64 at most).  Empty spans and null indices meet nothing; how="left" keeps their rows."""
    shift = lambda c, k: F.call_function("shiftright", c.cast("long"), k)
    bits = F.length(F.bin(F.col(end) - F.col(start) - 1))
    cells = spans.where(F.col(end) > F.col(start)).withColumn("_k", F.when(F.col(end) - F.col(start) == 1, 0).otherwise(bits).cast("int"))
    levels = sorted(r[0] for r in cells.select("_k").distinct().collect())
    cells = cells.withColumn("_cell", F.explode(F.array_distinct(F.array(shift(F.col(start), F.col("_k")), shift(F.col(end) - 1, F.col("_k"))))))
    cells = small(cells.withColumnsRenamed({start: "_from", end: "_to"}))
    wanted = df if how == "inner" else df.select(index).distinct()
    every = F.array(*[F.lit(k) for k in levels]).cast("array<int>")
    rows = wanted.withColumn("_level", F.explode(every))
    met = (rows["_level"] == cells["_k"]) & (shift(rows[index], rows["_level"]) == cells["_cell"]) & (rows[index] >= cells["_from"]) & (rows[index] < cells["_to"])
    found = rows.join(cells, met).drop("_cell", "_k", "_level").withColumnsRenamed({"_from": start, "_to": end})
    return found if how == "inner" else df.join(found, index, how)


def locate(df: DataFrame, index: str, starts: DataFrame, group: str) -> DataFrame:
    """Adds the group of a global index and the index inside it."""
    out = in_spans(df, index, starts.select(group, "start", "end"))
    return out.withColumn("local_index", F.col(index) - F.col("start")).drop("start", "end")


def lookup_lengths(df: DataFrame, index: str, dense: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds length: that of the index in dense (idx, len), else that of the closed segment (start, end, len) around it; a miss raises."""
    found = in_spans(df, index, segments.select(F.col("start"), (F.col("end") + 1).alias("end"), F.col("len").alias("_run")), how="left").drop("start", "end")
    found = found.join(dense.select(F.col("idx").alias(index), F.col("len").alias("_dense")), index, "left")
    missing = F.raise_error(F.concat(F.lit("no length for index "), F.coalesce(F.col(index).cast("string"), F.lit("null"))))
    return found.withColumn("length", F.coalesce("_dense", "_run", missing.cast("long"))).drop("_dense", "_run")


def point_lookup(wanted: DataFrame, frames: DataFrame, keys: tuple[str, ...] = ("dataset", "episode_index", "frame_index")) -> DataFrame:
    """The frames that wanted asks for by dataset, episode and frame; asking for one that isn't there raises."""
    found = wanted.join(frames.withColumn("_found", F.lit(True)), list(keys), "left")
    missing = F.raise_error(F.concat_ws("/", F.lit("no frame"), *[F.col(k).cast("string") for k in keys]))
    return found.where(F.coalesce("_found", missing.cast("boolean"))).drop("_found")


#: Indices that one row makes at once when segments are expanded.
RUN = 1 << 16


def expand_segments(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """A row for each index of closed segments; empty ones (end before start, or null) give none.

    A segment is cut into runs of RUN indices first, so a row never holds the indices of a whole segment; the runs of segments with
    very many are dealt out, so that one long segment is many tasks' work."""
    parts = df.where(F.col(start) <= F.col(end)).withColumn("_run", F.explode(F.sequence(F.col(start).cast("long"), F.col(end).cast("long"), F.lit(RUN).cast("long"))))
    long = F.col(end) - F.col(start) >= 16 * RUN
    parts = parts.where(~long).unionByName(parts.where(long).repartition(start, "_run"))
    return parts.withColumn("idx", F.explode(F.sequence("_run", F.least(F.col("_run") + (RUN - 1), F.col(end).cast("long"))))).drop("_run")


def union_all(parts: dict[str, DataFrame], name: str = "dataset") -> DataFrame:
    """All rows of all parts with the part's name; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(name, F.lit(k)) for k, df in parts.items()])


def nearest_in_time(df: DataFrame, other: DataFrame, by: str, ts: str, tolerance: float, value: str, both_sides: bool = False, hot_rows: int | None = None) -> DataFrame:
    """Adds near_value: the value of the last row of other at most tolerance seconds before each row of df (as-of), null without one.

    both_sides: of the nearest row before or after; at equal distance the one before.  Both tables are merged in windows by
    key; no pairs are made.  Keys of more than hot_rows (HOT_ROWS) rows are cut into blocks in time, and what a block has last
    (and first) is carried over to its neighbours."""
    df, other = (x.withColumn(ts, F.col(ts).cast("timestamp")) for x in (df, other))
    both = df.withColumn("_v", F.lit(None).cast("struct<t:timestamp,v:double>")).withColumn("_q", F.lit(1))
    right = other.select(by, ts, F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v")).alias("_v")).withColumn("_q", F.lit(0))
    both = both.unionByName(right, allowMissingColumns=True)
    hot = hot_keys(both.select(by), by, hot_rows)
    rest, crowded = (both, None) if hot is None else apart(both, by, hot)
    window = Window.partitionBy(by).orderBy(ts, "_q")
    none = F.lit(None).cast("struct<t:timestamp,v:double>")
    found = rest.withColumn("_l", F.last("_v", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.withColumn("_r", F.first("_v", ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing)) if both_sides else none)
    if crowded is not None:
        found = found.unionByName(_carried(crowded, by, ts).withColumn("_r", F.col("_r") if both_sides else none))
    gap = lambda c: F.abs(F.unix_micros(ts) - F.unix_micros(f"{c}.t"))
    nearest = F.when(F.col("_l").isNull() | (gap("_r") < gap("_l")), F.col("_r")).otherwise(F.col("_l"))
    found = found.where("_q = 1").withColumn("_n", nearest)
    return found.withColumn("near_value", F.when(gap("_n") <= int(tolerance * 1e6), F.col("_n.v"))).drop("_l", "_r", "_n", "_v", "_q")


def _carried(both: DataFrame, by: str, ts: str) -> DataFrame:
    """Adds _l and _r, the last _v before and the first one after each row of the same key, block by block."""
    placed = numbered(both, [F.col(by).asc_nulls_first(), F.col(ts), F.col("_q")], "_place").withColumn("_block", F.floor(F.col("_place") / F.lit(BLOCK_ROWS)))
    placed = placed.withColumn("_o", F.when(F.col("_v").isNotNull(), F.struct(F.col(by).alias("k"), F.col("_v").alias("v"))))
    edges = placed.groupBy("_block").agg(F.max_by("_o", F.when(F.col("_o").isNotNull(), F.col("_place"))).alias("_last"), F.min_by("_o", F.when(F.col("_o").isNotNull(), F.col("_place"))).alias("_first"))
    order = Window.orderBy("_block")  # one row a block
    edges = edges.select("_block", F.last("_last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_cl"), F.first("_first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_cr"))
    inside = Window.partitionBy("_block").orderBy("_place")
    placed = placed.withColumn("_l", F.last("_o", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.withColumn("_r", F.first("_o", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing)))
    placed = placed.join(small(edges), "_block")
    own = lambda x: F.when(x["k"].eqNullSafe(F.col(by)), x["v"])
    return placed.withColumns({"_l": own(F.coalesce("_l", "_cl")), "_r": own(F.coalesce("_r", "_cr"))}).drop("_place", "_block", "_o", "_cl", "_cr")


def short_rows(df: DataFrame, length: str, below: int) -> DataFrame:
    """Rows shorter than below."""
    return df.where(F.col(length) < below)


def listed_episodes(df: DataFrame, episodes: list[int], episode: str = "episode_index") -> DataFrame:
    """Rows of the listed episodes, with position: their place in the list."""
    places = df.sparkSession.createDataFrame([(e, k) for k, e in enumerate(episodes)], f"`{episode}` long, position long")
    return df.join(small(places), episode)


def based_paths(df: DataFrame, bases: DataFrame, dataset: str, path: str) -> DataFrame:
    """path with its dataset's base before it, unless it is a url or the dataset has no base; bases: dataset, base."""
    out = df.join(small(bases.select(dataset, F.col("base").alias("_base"))), dataset, "left")
    full = F.when(F.col(path).startswith("http") | F.col("_base").isNull(), F.col(path)).otherwise(F.concat_ws("/", "_base", path))
    return out.withColumn(path, full).drop("_base")
