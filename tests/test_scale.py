"""Operators on hot keys, unlike spans and many blocks, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import bins, chunks, rows


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(rows, "BLOCK_ROWS", 700)
    monkeypatch.setattr(chunks, "BLOCK_ROWS", 700)


def episodes(spark):
    """9000 frames, of which one episode has a third; another has no name."""
    e = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 300 == 1, F.lit(None)).otherwise(F.col("id") % 37)
    return spark.range(9000).select(e.cast("int").alias("episode_index"), F.xxhash64("id").alias("at"), (F.col("id") * 0.5).alias("value"), "id").repartition(5)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    one, two = (sorted(map(str, x.select(*sorted(x.columns)).collect())) for x in (a, b))
    assert one == two


def test_frames_and_chunks_of_a_hot_episode(spark, blocks):
    df = episodes(spark)
    hot = rows.hot_keys(df, "episode_index", 1000)
    assert [r["_key"] for r in hot.collect()] == [7]
    plain = chunks.frames(df, "episode_index", ["at"], None)
    split = chunks.frames(df, "episode_index", ["at"], hot)
    same(plain, split)
    made = chunks.chunk(split, "value", 16, frame=["at"], hot=hot)
    same(chunks.chunk(plain, "value", 16, frame=["at"], hot=None), made)
    same(chunks.chunk(plain, "value", 1500, frame="frame_index", hot=None), chunks.chunk(split, "value", 1500, hot=hot))
    assert rows.hot_keys(df, "episode_index", 10_000) is None


def test_no_task_holds_a_hot_episode(spark, blocks):
    df = episodes(spark).where("episode_index = 7")
    hot = rows.hot_keys(df, "episode_index", 1000)
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chunks.chunk(chunks.frames(df, "episode_index", ["at"], hot), "value", 16, frame=["at"], hot=hot)
        sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    assert sum(sizes) == df.count() and max(sizes) < 0.9 * sum(sizes)


@pytest.mark.parametrize("both_sides", [False, True])
def test_as_of_on_a_hot_key(spark, blocks, both_sides):
    df = episodes(spark).select("episode_index", "id", F.timestamp_seconds(F.pmod("at", F.lit(50_000))).alias("ts"))
    other = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 37).cast("int").alias("episode_index"), F.timestamp_seconds(F.pmod(F.xxhash64(F.col("id") + 5), F.lit(50_000))).alias("ts"), F.pmod(F.xxhash64(F.col("id") + 5), F.lit(50_000)).alias("v"))
    other = other.dropDuplicates(["episode_index", "ts"])
    plain = rows.nearest_in_time(df, other, "episode_index", "ts", 900, "v", both_sides)
    split = rows.nearest_in_time(df, other, "episode_index", "ts", 900, "v", both_sides, hot_rows=1000)
    same(plain, split)
    assert plain.where("near_value is not null").count() > 1000


def test_spans_of_unlike_lengths(spark):
    """100,000 spans of one place beside one of 10^9: each cell meets few of them."""
    unit = spark.range(100_000).select((F.col("id") * 2).alias("start"), (F.col("id") * 2 + 1).alias("end"), F.col("id").alias("name"))
    long = spark.createDataFrame([(300_000, 1_000_300_000, -1), (-50, -3, -2), (5, 5, -3), (250_000, 249_000, -4)], "start long, end long, name long")
    spans = unit.union(long)
    index = spark.range(0, 400_000, 3).select("id").union(spark.createDataFrame([(999_999_999,), (1_000_300_000,), (-4,), (-3,), (-51,), (None,)], "id long"))
    got = {r["id"]: r["name"] for r in rows.in_spans(index, "id", spans).collect()}
    want = {i: i // 2 for i in range(0, 200_000, 6)} | {i: -1 for i in range(300_000, 400_000, 3)} | {999_999_999: -1, -4: -2}
    assert got == want
    left = rows.in_spans(index, "id", spans, how="left")
    assert left.count() == index.count()
    assert {r["id"] for r in left.where("name is null").collect()} == {r["id"] for r in index.collect()} - set(want)
    assert rows.in_spans(index, "id", spans.limit(0)).count() == 0


def test_large_samples(spark, monkeypatch):
    df = spark.range(20_000).select("id", (F.col("id") % 50).alias("w"))
    small = {k: rows.sample(df, k, ["id"]).collect() for k in ("random:9000", "random:45%", "first:9000", "end:9000", "random:30000")}
    few = rows.weighted_subset(df, "w", 9000, "id").collect()
    monkeypatch.setattr(rows, "TOP_ROWS", 10)
    for k, want in small.items():
        assert sorted(rows.sample(df, k, ["id"]).collect()) == sorted(want), k
    got = rows.weighted_subset(df, "w", 9000, "id")
    assert sorted(got.collect()) == sorted(few) and len(few) == 9000
    assert rows.least(df, 500, F.lit(3), [F.col("id")]).agg(F.max("id"), F.count("*")).first()[:] == (499, 500)


def sequential(lengths, capacity):
    out, bin_, load = [], -1, capacity + 1
    for n in lengths:
        if load + n > capacity:
            bin_, load = bin_ + 1, 0
        load += n
        out.append(bin_)
    return out


@pytest.mark.parametrize("most, capacity", [(30, 20), (5, 100), (0, 10), (3, 1000)])
def test_tables_compose(most, capacity):
    rng = np.random.default_rng(most)
    n = rng.integers(0, most + 1, 400) * rng.integers(0, 2, 400)
    start = np.arange(capacity + 2)

    def table(part):
        import pyarrow as pa

        made = bins._block_table(capacity, "n")((pa.scalar(0),), pa.table({"_place": np.arange(len(part)), "n": part}))
        assert len(made) <= capacity + 2
        return bins.Table(*(np.asarray(made[c]) for c in ("least", "bins", "load")))

    for cut in (1, 7, 200, 399):
        whole = table(n[:cut]).then(table(n[cut:]))
        assert len(whole.least) <= capacity + 2
        begun, load = whole.after(start)
        for x in start.tolist():
            bin_, have = 0, x
            for v in n.tolist():
                bin_, have = (bin_ + 1, v) if have + v > capacity else (bin_, have + v)
            assert (int(begun[x]), int(load[x])) == (bin_, have)


def test_next_fit_over_a_thousand_blocks(spark):
    rng = random.Random(4)
    data = [(g, i, rng.choice([0, 0, 0, 1, 2, 3, 9, 25])) for g, n in (("a", 20_000), ("b", 130), (None, 3)) for i in range(n)]
    df = spark.createDataFrame(data, "g string, i long, n long")
    got = {(r["g"], r["i"]): r["bin"] for r in bins.next_fit(df, "n", "g", ["i"], 20, block_rows=17).collect()}
    for g in ("a", "b", None):
        want = sequential([n for k, _, n in data if k == g], 20)
        assert [got[g, i] for i in range(len(want))] == want


@pytest.mark.parametrize("seed", range(6))
def test_worst_fit_by_classes(spark, seed):
    rng = random.Random(seed)
    n = [rng.choice([0, 0, 1, 2, 3, 5, 5, 5, 7, 10, 11, 40]) if seed else rng.randrange(12) for _ in range(rng.choice([1, 30, 400]))]
    capacity = rng.choice([1, 10, 20])
    df = spark.createDataFrame(list(enumerate(n)), "i long, n int").repartition(3)
    got = {r["i"]: r["bin"] for r in bins.worst_fit(df, "n", ["i"], capacity).collect()}
    assert [got[i] for i in range(len(n))] == bins._worst_fit(n, capacity)


def test_worst_fit_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, 0)], "i long, n long")
    assert {r["bin"] for r in bins.worst_fit(df, "n", ["i"], 5).collect()} == {0}
    assert bins.worst_fit(df.limit(0), "n", ["i"], 5).count() == 0
    with pytest.raises(Exception, match="negative"):
        bins.worst_fit(spark.createDataFrame([(1, -1)], "i long, n long"), "n", ["i"], 5).count()


def test_packing_modes(spark):
    assert [bins.packing_mode(n) for n in (0, 1_000_000, 1_000_001, 10_000_000, 10_000_001)] == ["normal", "normal", "streaming", "streaming", "ultra"]
    df = spark.range(300).select("id", (F.col("id") % 9).alias("n"))
    for mode in (None, "normal", "streaming", "ultra"):
        packed = bins.pack_by_size(df, "n", "id", 20, mode)
        found = bins.loads(packed, "megabatch", "n").collect()
        assert sum(r["items"] for r in found) == 300 and max(r["load"] for r in found) <= 20
    order = sorted(range(300), key=lambda i: __import__("hashlib").md5(f"42:{i}".encode()).hexdigest())
    got = {r["id"]: r["bin"] for r in bins.pack_by_size(df, "n", "id", 20).collect()}
    assert [got[i] for i in order] == sequential([i % 9 for i in order], 20)


def test_position_rows_are_the_expression(spark):
    """Tokens' rows by prefix sums are the arrays of the column expressions."""
    from episodica.functions import positions as P

    grid = "array<struct<t:int,h:int,w:int,step:double>>"
    data = [(0, [], []), (1, [1, 1, 1], []), (2, [1, 5, 6, 6, 6, 6, 8, 1], [(1, 4, 4, 1.0)]), (3, [5, 6, 1, 5, 7, 7, 7, 7, 7, 7, 7, 7, 2], [(1, 2, 2, 1.0), (2, 4, 4, 2.5)]), (4, [5, 6], [(1, 1, 1, 1.0)]), (5, [5, 5, 7, 7, 9], [(2, 2, 2, 0.5)])]
    df = spark.createDataFrame(data, f"k int, ids array<int>, grids {grid}")
    arrays = {r["k"]: [tuple(p) for p in r["p"]] for r in df.select("k", P.positions(P.blocks_of(F.col("ids"), F.col("grids"), 6, 7, 5)).alias("p")).collect()}
    got: dict = {k: [] for k in arrays}
    for r in P.position_rows(P.with_blocks(df, F.col("ids"), F.col("grids"), 6, 7, 5), ["k"]).orderBy("k", "n").collect():
        assert r["n"] == len(got[r["k"]])
        got[r["k"]].append((r["t"], r["h"], r["w"]))
    assert got == arrays
    mask = F.transform("ids", lambda x: (x != 1).cast("int"))
    want = {r["k"]: r["p"] for r in df.select("k", P.text_positions(mask).alias("p")).collect() if r["p"]}
    found = P.text_position_rows(df, ["k"], mask).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", "position"))).alias("p")).collect()
    assert {r["k"]: [x["position"] for x in r["p"]] for r in found} == want


def test_alphabet_of_coefficients(spark):
    from episodica.functions import vectors as V

    df = spark.createDataFrame([([3, -7],), ([12],), ([],), (None,)], "q array<int>")
    assert V.coefficient_span(df, "q") == (-7, 12) and V.coefficient_span(df.limit(0), "q") == (0, 0)
    assert V.alphabet_size(-7, 12) == 20 and V.alphabet_size(0, 900) == 901
    with pytest.warns(UserWarning, match="nearly fill"):
        assert V.alphabet_size(0, 1024) == 1025
    with pytest.raises(ValueError, match="too small"):
        V.alphabet_size(0, 1025)
