"""Exact decimals, long segments, keys that are null, and versions of running statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from episodica.functions import tokens
from episodica.operators import rows, stats
from episodica.streaming.running import RunningStatistics


def test_tenths_round_as_binary_fractions_do(spark):
    rng = random.Random(1)
    values = [k / 4 for k in range(-41, 400)] + [k / 20 for k in range(1, 4000)] + [math.nextafter(k / 20, s) for k in range(1, 400, 2) for s in (0, 1e9)]
    values += [rng.uniform(-50, 50) for _ in range(500)] + [rng.uniform(0, 1e12) for _ in range(500)] + [1e-300, 5e-324, -0.04, 86399.95]
    got = [r["t"] for r in spark.createDataFrame([(k, x) for k, x in enumerate(values)], "k int, x double").select("k", tokens.tenths(F.col("x")).alias("t")).orderBy("k").collect()]
    assert [(x, t) for x, t in zip(values, got, strict=True) if t != f"{x:.1f}" and x] == []
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (1e300,)], "x double").select(tokens.tenths(F.col("x")).alias("t")).collect()
    assert [r["t"] for r in odd] == [None] * 4
    plan = spark.range(1).select(tokens.video_text(F.array(F.lit(0.25)), F.lit(1)).alias("v"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_long_segments(spark, monkeypatch):
    monkeypatch.setattr(rows, "RUN", 8)
    segments = [(0, 0, "a"), (5, 12, "b"), (20, 27, "c"), (30, 29, "empty"), (None, 3, "none"), (100, 1007, "long"), (2000, 2128, "long too")]
    got = rows.expand_segments(spark.createDataFrame(segments, "start long, end long, name string"))
    assert got.columns == ["start", "end", "name", "idx"]
    want = [(n, i) for a, b, n in segments if a is not None for i in range(a, b + 1)]
    assert sorted((r["name"], r["idx"]) for r in got.collect()) == sorted(want)


def test_null_keys_keep_their_statistics(spark):
    x = spark.createDataFrame([(k, 0, float(v)) for k in ("a", None) for v in range(101)], "k string, dim long, x double")
    once = stats.histogram_stats(x, ["k"], bins=100)
    assert {(r["k"], r["n"], r["mean"], r["q01"]) for r in once.collect()} == {("a", 101, 50.0, 1.0), (None, 101, 50.0, 1.0)}
    states = stats.histogram_states(x, ["k"], 100)
    merged = stats.merge_states(states.unionByName(states), ["k", "dim"], 100)
    assert {(r["k"], r["n"], sum(c["c"] for c in r["counts"])) for r in merged.collect()} == {("a", 202, 202), (None, 202, 202)}
    new = stats.override(spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, mean double"), spark.createDataFrame([(None, 5.0)], "k string, mean double"), ["k"])
    assert {tuple(r) for r in new.collect()} == {("a", 1.0), (None, 5.0)}


def test_versions_of_running_statistics(spark, tmp_path):
    keeper = RunningStatistics(spark, f"{tmp_path}/s", ["k"], bins=10)
    x = spark.createDataFrame([("a", 0, 1.0), ("a", 0, 2.0)], "k string, dim long, x double")
    with pytest.raises(FileNotFoundError, match="no states"):
        keeper.states()
    with pytest.raises(FileNotFoundError, match="batch 0"):
        keeper.fold(x, 1)
    keeper.fold(x, 0)
    keeper.fold(x, 1)
    assert keeper.states().first()["n"] == 4
    (tmp_path / "s/states/version=2").mkdir()  # a writing that was stopped
    assert keeper.states().first()["n"] == 4
    keeper.fold(x, 2)
    assert keeper.states().first()["n"] == 6
