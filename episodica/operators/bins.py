"""Packing rows of known lengths into bins, and what is made of bins."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodica.operators.rows import in_spans, numbered, shuffled
from episodica.sources.shared import cut, small, write_table


def _next_fit(lengths: list[int], capacity: int) -> list[int]:
    out, bin_, load = [], -1, None
    for n in lengths:
        if load is None or load + n > capacity:
            bin_, load = bin_ + 1, 0
        load += n
        out.append(bin_)
    return out


def _worst_fit(lengths: list[int], capacity: int) -> list[int]:
    """Longest first into the emptiest open bin; an oversize row sits alone in a closed bin."""
    out, heap, bins = [0] * len(lengths), [], 0
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if n <= capacity and heap and heap[0][0] + n <= capacity:
            load, b = heapq.heappop(heap)
        else:
            load, b, bins = 0, bins, bins + 1
        out[i] = b
        if n <= capacity:
            heapq.heappush(heap, (load + n, b))
    return out


def pack(df: DataFrame, length: str, group: str, order: list[str], capacity: int, method: str = "next_fit") -> DataFrame:
    """Adds bin (0-based in the group), by next fit in order or worst fit decreasing; groups are packed independently.

    A group is one task's work: give it a bounded number of rows (see megabatches)."""
    place = {"next_fit": _next_fit, "worst_fit": _worst_fit}[method]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        return rows.append_column("bin", pa.array(place(rows[length].to_pylist(), capacity), pa.int64()))

    return df.groupBy(group).applyInArrow(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", bin long")


def megabatches(df: DataFrame, key: str, rows: int = 100_000, seed: int = 42) -> DataFrame:
    """Adds megabatch: rows are dealt by md5 of seed and key to as many batches as hold about so many rows each."""
    n = max(1, -(-df.count() // rows))
    return df.withColumn("megabatch", F.conv(F.substring(shuffled([key], seed)[0], 9, 8), 16, 10).cast("long") % n)


def fixed_batches(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Adds batch: 0-based, of so many rows each in order (the last may have fewer), however many there are."""
    out = numbered(df, [F.col(c).asc_nulls_first() for c in order], "_place")
    return out.withColumn("batch", F.floor(F.col("_place") / F.lit(rows)).cast("long")).drop("_place")


def _jumps(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """For each row the row that begins the next bin, if a bin begins at it."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    n = np.arange(len(lengths))
    return np.maximum(np.searchsorted(ends, ends[:-1] + capacity, "right") - 1, n + 1)


def _first_break(lengths: np.ndarray, load: int, capacity: int) -> int:
    """The row at which a bin that holds load so far is closed (their number, if it isn't)."""
    return int(np.searchsorted(np.cumsum(lengths), capacity - load, "right"))


#: Less than any load: marks the entry of a block's table for a bin that isn't closed in the block.
NEVER = -(1 << 62)


def _block_table(capacity: int, length: str):
    """For a block (rows in order) what next fit does for every load that it may begin with.

    A row for each row at which the open bin may be closed: closed for loads above least, then bins more bins are begun and the
    last is left with load.  Row 0 is closed for loads above the capacity less its length; the entry with least NEVER stands for a bin
    that takes the whole block and adds its sum.  At most as many entries as there are loads."""

    def table(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        n = np.asarray(rows[length]).astype(np.int64)
        jump, bins, load = _jumps(n, capacity), np.zeros(len(n) + 1, np.int64), np.zeros(len(n) + 1, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        for i in range(len(n) - 1, -1, -1):
            j = int(jump[i])
            bins[i], load[i] = 1 + bins[j], load[j] if j < len(n) else ends[-1] - ends[i]
        last = _first_break(n, 0, capacity)  # later rows can't be the first at which a bin is closed, but for an oversize bin
        at = np.arange(min(last, len(n) - 1) + 1)
        least = capacity - ends[at + 1]
        short = Table(np.append(least, NEVER), np.append(bins[at], 0), np.append(load[at], ends[-1])).short()
        out = {"least": short.least, "bins": short.bins, "load": short.load}
        keys = {f"k{i}": pa.array([k.as_py()] * len(short.least), k.type) for i, k in enumerate(key)}
        return pa.table(keys | {c: pa.array(v) for c, v in out.items()})

    return table


#: Blocks whose tables one task composes, or folds, at a time.
FAN = 32


class Table:
    """What a run of rows does to every load that it may begin with: least (falling, NEVER last), bins and load (see _block_table)."""

    def __init__(self, least: np.ndarray, bins: np.ndarray, load: np.ndarray):
        self.least, self.bins, self.load = least, bins, load
        self.rising = least[::-1]

    def after(self, loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bins begun and the last bin's load, for loads to begin with."""
        at = len(self.least) - np.searchsorted(self.rising, loads, "left")  # the first entry that is exceeded
        closed = at < len(self.least) - 1
        return self.bins[at], np.where(closed, self.load[at], loads + self.load[at])

    def then(self, other: Table) -> Table:
        """The table of both runs, one after the other."""
        more, load = other.after(self.load[:-1])
        total = self.load[-1]
        least = other.least[:-1] - total  # a bin that this run leaves open may be closed in the other
        new = least < (self.least[-2] if len(self.least) > 1 else np.inf)
        joined = [np.concatenate(x) for x in ((self.least[:-1], least[new], [NEVER]), (self.bins[:-1] + more, other.bins[:-1][new], [0]), (load, other.load[:-1][new], [total + other.load[-1]]))]
        return Table(*joined).short()

    def short(self) -> Table:
        """Without entries that no load meets first, and with one for each run of equal outcomes."""
        least, bins, load = self.least, self.bins, self.load
        keep = np.append(True, least[1:] != least[:-1])  # rows of length 0 close nothing more
        below = np.flatnonzero(least[:-1] < 0)
        if len(below):  # loads aren't below 0, so the first of these ends the table
            keep[below[1:]] = False
        least, bins, load = least[keep], bins[keep], load[keep]
        last = np.append((bins[1:] != bins[:-1]) | (load[1:] != load[:-1]), True)
        last[-2:] = True
        return Table(least[last], bins[last], load[last])


def _tables(rows: pa.Table, unit: str) -> list[tuple[int, Table]]:
    """The tables of all units in a group, in order."""
    rows = rows.sort_by([(unit, "ascending"), ("least", "descending")])
    block, least, bins, load = (np.asarray(rows[c]).astype(np.int64) for c in (unit, "least", "bins", "load"))
    first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
    return [(int(block[a]), Table(least[a:b], bins[a:b], load[a:b])) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True)]


def _compose(rows: pa.Table) -> pa.Table:
    """One table for the FAN units of a group."""
    found = _tables(rows, "block")
    whole = found[0][1].short()
    for _, table in found[1:]:
        whole = whole.then(table)
    n = len(whole.least)
    return pa.table({"_g": pa.array([rows["_g"][0].as_py()] * n, rows["_g"].type), "block": pa.array(np.full(n, found[0][0] // FAN)), "least": pa.array(whole.least), "bins": pa.array(whole.bins), "load": pa.array(whole.load)})


def _begin(rows: pa.Table) -> pa.Table:
    """The bin and load with which each unit of a group begins, from those with which the group does (_bin, _load)."""
    bin_, have, out = rows["_bin"][0].as_py(), rows["_load"][0].as_py(), []
    for block, table in _tables(rows, "block"):
        out.append((block, bin_, have))
        begun, load = table.after(np.array([have]))
        bin_, have = bin_ + int(begun[0]), int(load[0])
    columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
    return pa.table({"_g": pa.array([rows["_g"][0].as_py()] * len(out), rows["_g"].type), "block": columns[0], "_bin": columns[1], "_load": columns[2]})


def block_beginnings(tables: DataFrame, capacity: int) -> DataFrame:
    """_g, block, _bin and _load: where each block of each group begins.

    tables: _g, block, least, bins and load of all blocks.  Tables of FAN neighbours are composed, level by level, until a
    group has FAN at most; then the beginnings are handed down again.  A task holds FAN tables at a time, of at most capacity + 2
    entries each, and there are as many levels as the number of blocks has digits to that base."""
    kind = dict(tables.dtypes)["_g"]
    levels = [write_table(tables, "next-fit-tables")]
    most = (levels[0].agg(F.max("block")).first()[0] or 0) + 1
    above = F.floor(F.col("block") / FAN).cast("long")
    while most > FAN:
        up = levels[-1].groupBy("_g", above.alias("_up")).applyInArrow(_compose, f"_g {kind}, block long, least long, bins long, load long")
        levels.append(write_table(up, "next-fit-tables"))
        most = -(-most // FAN)
    begins = None
    for level in reversed(levels):
        if begins is None:
            units = level.withColumns({"_up": F.lit(0).cast("long"), "_bin": F.lit(-1).cast("long"), "_load": F.lit(capacity + 1).cast("long")})
        else:
            parents = small(begins.select(F.col("_g").alias("_pg"), F.col("block").alias("_up"), "_bin", "_load"))
            level = level.withColumn("_at", above)
            units = level.join(parents, level["_g"].eqNullSafe(parents["_pg"]) & (level["_at"] == parents["_up"])).drop("_pg", "_at")
        begins = write_table(units.groupBy("_g", "_up").applyInArrow(_begin, f"_g {kind}, block long, _bin long, _load long"), "next-fit-begins")
    return begins


def next_fit(df: DataFrame, length: str, group: str, order: list[str], capacity: int, block_rows: int = 50_000) -> DataFrame:
    """Adds bin (0-based in the group) by exact sequential next fit in order, however large a group is.

    Rows are numbered in order and cut into blocks.  Each block tabulates where every load that it may begin with leads (next
    fit forgets its past at the first bin that it closes); the tables are composed in a tree, which gives every block its true
    beginning, and blocks are then packed side by side.  Null lengths count as 0."""
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    rows = numbered(df.withColumn(length, F.coalesce(F.col(length).cast("long"), F.lit(0))), by, "_place")
    low = rows.groupBy(group).agg(F.min("_place").alias("_low"))
    rows = rows.join(small(low.withColumnRenamed(group, "_g")), F.col(group).eqNullSafe(F.col("_g"))).withColumn("block", F.floor((F.col("_place") - F.col("_low")) / block_rows)).drop("_low")
    rows = cut(rows.drop("_g"))
    kind = dict(rows.dtypes)[group]
    tables = rows.select(F.col(group).alias("_g"), "block", "_place", length).groupBy("_g", "block").applyInArrow(_block_table(capacity, length), f"k0 {kind}, k1 long, least long, bins long, load long")
    begins = block_beginnings(tables.select(F.col("k0").alias("_g"), F.col("k1").alias("block"), "least", "bins", "load"), capacity)

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        n = np.asarray(rows[length]).astype(np.int64)
        bin_, load = rows["_bin"][0].as_py(), rows["_load"][0].as_py()
        i, jump, out = _first_break(n, load, capacity), _jumps(n, capacity), np.empty(len(n), np.int64)
        if load > capacity:
            i = 0
        out[:i] = bin_
        while i < len(n):
            bin_, j = bin_ + 1, int(jump[i])
            out[i:j], i = bin_, j
        return rows.drop_columns(["_bin", "_load"]).append_column("bin", pa.array(out))

    met = rows[group].eqNullSafe(begins["_g"]) & (rows["block"] == begins["block"])
    joined = rows.join(small(begins), met).drop("_g").drop(begins["block"])
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", bin long"
    return joined.select(*rows.columns, "_bin", "_load").groupBy(group, "block").applyInArrow(place, schema).drop("_place", "block")


def _class_plan(capacity: int):
    """Runs of worst fit decreasing over lengths and their numbers of rows: place (of a run's first row, longest rows first), rows,
    bin (that its first row goes to) and each (rows that a bin takes, before the next one does)."""

    def plan(classes: pa.Table) -> pa.Table:
        classes = classes.sort_by([("length", "descending")])
        heap: list[tuple[int, int, int]] = []  # load, first bin, bins: open bins alike, the emptiest first
        runs, place, bins = [], 0, 0
        for length, left in zip(classes["length"].to_pylist(), classes["rows"].to_pylist(), strict=True):
            if length > capacity:  # each alone, in a bin that nothing joins
                runs.append((place, left, bins, 1))
                place, bins, left = place + left, bins + left, 0
            while left:
                if heap and heap[0][0] + length <= capacity:
                    load, first, alike = heapq.heappop(heap)
                    if not length:  # the emptiest bin stays the emptiest
                        runs.append((place, left, first, left))
                        heapq.heappush(heap, (load, first, alike))
                        place, left = place + left, 0
                        continue
                    n = min(left, alike)
                    runs.append((place, n, first, 1))
                    heapq.heappush(heap, (load + length, first, n))
                    if alike > n:
                        heapq.heappush(heap, (load, first + n, alike - n))
                    place, left = place + n, left - n
                else:  # a new bin is the emptiest that has room, until it is full
                    each = capacity // length if length else left
                    runs.append((place, left, bins, each))
                    whole, rest = divmod(left, each)
                    if whole:
                        heapq.heappush(heap, (each * length, bins, whole))
                    if rest:
                        heapq.heappush(heap, (rest * length, bins + whole, 1))
                    place, bins, left = place + left, bins + whole + (rest > 0), 0
        columns = zip(*runs, strict=True) if runs else ((),) * 4
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("start", "rows", "first", "each"), columns, strict=True)})

    return plan


def worst_fit(df: DataFrame, length: str, order: list[str], capacity: int) -> DataFrame:
    """Adds bin by worst fit decreasing over the whole table: longest rows first (of equal ones in order), each into the emptiest
    open bin (of equal ones the first) if it fits, else into a new one; a row over capacity sits alone in a closed bin.

    Rows of one length are alike, so the packing is found for lengths and their counts (at most capacity + 1 of them that
    fit; longer rows are counted as one) in one task, as runs of rows that go to neighbouring bins.  Rows are numbered by
    length and order, and look the run of their number up; no task holds more than the lengths, the runs or its range of rows.
    Null lengths count as 0, negative ones raise."""
    n = F.coalesce(F.col(length).cast("long"), F.lit(0))
    bad = F.raise_error(F.lit("a negative length")).cast("long")
    rows = df.withColumn("_n", F.when(n < 0, bad).otherwise(n))
    classes = rows.groupBy(F.least("_n", F.lit(capacity + 1)).alias("length")).agg(F.count("*").alias("rows"))
    plan = write_table(classes.groupBy(F.lit(0).alias("_all")).applyInArrow(_class_plan(capacity), "start long, rows long, first long, each long"), "packing-plan")
    placed = numbered(rows, [F.col("_n").desc(), *[F.col(c).asc_nulls_first() for c in order]], "_place")
    spans = plan.select(F.col("start").alias("_start"), (F.col("start") + F.col("rows")).alias("_end"), "first", "each")
    found = in_spans(placed, "_place", spans, "_start", "_end")
    bin_ = F.col("first") + F.floor((F.col("_place") - F.col("_start")) / F.col("each"))
    return found.withColumn("bin", bin_.cast("long")).select(*df.columns, "bin")


def shuffled_next_fit(df: DataFrame, length: str, key: str, capacity: int, seed: int = 42, rows: int = 100_000) -> DataFrame:
    """Adds megabatch and bin: next fit in a seeded order of rows, in megabatches of about so many rows that are packed side by side."""
    batched = megabatches(df.withColumn("_order", shuffled([key], seed)[0]), key, rows, seed)
    return pack(batched, length, "megabatch", ["_order", key], capacity).drop("_order")


#: Rows up to which tables are packed in one sequence, and up to which by next fit at all.
NORMAL_ROWS, STREAMING_ROWS = 1_000_000, 10_000_000


def packing_mode(rows: int) -> str:
    """The mode for a table of so many rows: normal, streaming or ultra."""
    return "normal" if rows <= NORMAL_ROWS else "streaming" if rows <= STREAMING_ROWS else "ultra"


def pack_by_size(df: DataFrame, length: str, key: str, capacity: int, mode: str | None = None, seed: int = 42) -> DataFrame:
    """Adds megabatch and bin by mode (None: that of packing_mode): normal (exact next fit in one seeded order), streaming (the same
    order in megabatches, packed side by side), ultra (worst fit decreasing); one megabatch, 0, but for streaming."""
    mode = packing_mode(df.count()) if mode is None else mode
    whole = F.lit(0).cast("long")
    if mode == "normal":
        rows = df.withColumns({"megabatch": whole, "_order": shuffled([key], seed)[0]})
        return next_fit(rows, length, "megabatch", ["_order", key], capacity).drop("_order")
    if mode == "streaming":
        return shuffled_next_fit(df, length, key, capacity, seed)
    if mode != "ultra":
        raise ValueError(f"{mode} is neither normal, streaming nor ultra")
    return worst_fit(df.withColumn("megabatch", whole), length, [key], capacity)


def loads(packed: DataFrame, group: str, length: str) -> DataFrame:
    return packed.groupBy(group, "bin").agg(F.sum(length).alias("load"), F.count("*").alias("items"))


def quality(bin_loads: DataFrame, capacity: int) -> DataFrame:
    """One row on all bins: count, average and population std of loads, utilisation, overflows, labels and rating."""
    use = F.lit(100.0) * F.col("load") / F.lit(capacity)
    out = bin_loads.agg(F.count("*").alias("bins"), F.sum("load").alias("total"), F.avg(use).alias("utilisation"), F.min("load").alias("min_load"), F.max("load").alias("max_load"), F.stddev_pop("load").alias("std_load"), F.sum((F.col("load") > capacity).cast("int")).alias("overflow"), F.sum((use >= 95).cast("int")).alias("excellent"), F.sum(((use >= 85) & (use < 95)).cast("int")).alias("good"))
    return out.withColumn("rating", F.when(F.col("overflow") > 0, "fail").when(F.col("utilisation") >= 90, "excellent").when(F.col("utilisation") >= 80, "good").otherwise("poor"))


def offsets(packed: DataFrame, group: str, order: list[str], length: str) -> DataFrame:
    """Adds offset: the lengths before a row in its bin."""
    before = Window.partitionBy(group, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset", F.coalesce(F.sum(length).over(before), F.lit(0)))


def cumulative_lengths(packed: DataFrame, group: str, order: list[str], length: str) -> DataFrame:
    """group, bin and bounds: 0 and the running sums of the bin's lengths in order."""
    upto = F.sum(F.col(length).cast("long")).over(Window.partitionBy(group, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    items = packed.select(group, "bin", F.struct(*order, upto.alias("_n")).alias("_i"))
    sums = items.groupBy(group, "bin").agg(F.sort_array(F.collect_list("_i")).alias("_i"))
    return sums.select(group, "bin", F.concat(F.array(F.lit(0).cast("long")), F.transform("_i", lambda x: x["_n"])).alias("bounds"))


def pad_batch(df: DataFrame, tokens: str | Column, batch: str, pad: int, left: bool = False) -> DataFrame:
    """Adds padded (tokens filled up to the batch's longest row, on the right or the left) and mask (padded is not pad)."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    longest = F.max(F.size(t)).over(Window.partitionBy(batch))
    df = df.withColumn("_n", longest)
    fill = F.array_repeat(F.lit(pad).cast("long"), F.col("_n") - F.size(t))
    df = df.withColumn("padded", F.concat(fill, t) if left else F.concat(t, fill))
    return df.withColumn("mask", F.transform("padded", lambda x: (x != pad).cast("int"))).drop("_n")
