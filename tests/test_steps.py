"""Steps of long queries are taken once, and as many files are written as the input needs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import text as T
from episodica.operators import chunks, rows, stats, training
from episodica.plans import catalogue
from episodica.plans import training as plans
from episodica.sources import catalog, stats_files
from test_training import make_dataset

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["sequence_extend", "action_spans"])
def test_token_rows_are_made_once(spark, name):
    """A filter on what was found in a token row doesn't make the row anew for each of its places."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(sequence(") == 1


def test_find(spark):
    """The first place of patterns of any length, in rows that are empty, null, hold nulls or end inside a match."""
    data = [None, [], [3], [3, 4], [4, 3, 4, 3, 4], [3, None, 4], [None, 3, 4], [3, 3, 4], [1, 2, 3]]
    df = spark.createDataFrame(list(enumerate(data)), "id int, ids array<bigint>")
    for pattern in ([], [3], [3, 4], [3, 4, 3], [2, 3, 4]):
        want = {i: next((k for k in range(len(x) - len(pattern) + 1) if x[k : k + len(pattern)] == pattern), -1) if x is not None else -1 for i, x in enumerate(data)}
        assert {r["id"]: r["at"] for r in df.select("id", T.find(F.col("ids"), pattern).alias("at")).collect()} == want


def test_find_takes_no_slices(spark):
    """A place is left at its first other token: no part of the row is copied for it."""
    plan = catalogue.QUERIES["subsequence_search"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "array_position(" in plan


def test_files_of_a_dataset(spark, tmp_path):
    """As many files as tasks and chunks of episodes together, not one for each pair of them."""
    frames = spark.range(0, 12000, 1, 8).select(F.col("id").alias("event_id"), (F.pmod(F.xxhash64("id"), F.lit(6000)) * 2).alias("episode_index"), F.col("id").alias("frame_index"), F.lit(2).cast("long").alias("episode_length"), F.rand(1).alias("value"))
    plans._dataset(spark, frames, f"{tmp_path}/d", 0)
    files = list((tmp_path / "d/data").glob("chunk=*/*.parquet"))
    parts = {f.parent.name for f in files}
    assert len(parts) == 12 and len(files) <= 12 + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spark.read.parquet(f"{tmp_path}/d/data").count() == 12000


def test_relative_statistics_of_odd_states(spark):
    """States that are null or shorter than the action leave dims as they are; components that are null don't count, with many values a group or few."""
    data = [(e, k, None if e == 1 else [0.5 * k, None] if e == 2 else [float(k)], [1.0 + k * k, None if k == 2 else -3.0 * k, 7.0 * e]) for e in range(3) for k in range(5)]
    frames = spark.createDataFrame(data, "episode_index long, frame_index long, s array<double>, a array<double>")
    by_frame = {(e, k): (s or [], a) for e, k, s, a in data}
    values = {d: [] for d in range(3)}
    for (e, k), (s, _) in by_frame.items():
        for j in range(k, min(k + 3, 5)):
            for d, x in enumerate(by_frame[e, j][1]):
                if x is not None:
                    values[d].append(x - ((s[d] if d < len(s) else None) or 0.0 if d < 2 else 0.0))
    before = stats.GROUP_VALUES
    try:
        for stats.GROUP_VALUES in (before, 4):
            got = {r["dim"]: r for r in training.relative_stats(frames, ["s"], {"a": 3}, [True, True, False], 3).collect()}
            for d, x in values.items():
                want = [min(x), max(x), np.mean(x), np.std(x), np.quantile(x, 0.01), np.quantile(x, 0.99)]
                assert [got[d][c] for c in stats_files.COLUMNS] == pytest.approx(want)
    finally:
        stats.GROUP_VALUES = before


def test_training_rows_join_before_they_gather(spark, tmp_path):
    """Chunks of actions are gathered last, of vectors that are ready, and what is the same in every row is a constant."""
    make_dataset(spark, tmp_path)
    out = training.trajectory_rows(spark, catalog.TrajectoryDataset("toy", str(tmp_path)), horizon=4, action_dim=5)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan[plan.index("collect_list(") :] and "Join" not in plan[: plan.index("collect_list(")]
    assert "Camera top: <|vision_start|>" in plan


def test_hot_episodes_make_the_same_training_rows(spark, tmp_path, monkeypatch):
    make_dataset(spark, tmp_path)
    dataset = catalog.TrajectoryDataset("toy", str(tmp_path))
    made = lambda: sorted(map(str, training.trajectory_rows(spark, dataset, horizon=4, action_dim=5).collect()))
    want = made()
    monkeypatch.setattr(rows, "HOT_ROWS", 5)
    monkeypatch.setattr(chunks, "BLOCK_ROWS", 4)
    assert made() == want
