"""Delta rounds against plain ones, with exact integers."""

import hashlib
import math

import numpy as np
import pytest

from episodica.llm import delta_lloyd, queries


def plain(rows, k=16, rounds=3, seed=1, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    h = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    centroids = [q for _, q in sorted(kept, key=lambda r: (h(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(rounds + 1):
        owner = [min((gap(q, c), n) for n, c in enumerate(centroids)) for _, q in kept]
        if step == rounds:
            break
        for n in range(len(centroids)):
            members = [q for (_, q), (_, m) in zip(kept, owner, strict=True) if m == n]
            if members:
                centroids[n] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    inertia = {n: sum(d for d, m in owner if m == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, owner, strict=True)]


def data(n=400, spread=0.02, seed=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, 64)) * 0.2
    rows = [(int(i), [float(x) for x in centers[i % 12] + rng.normal(size=64) * spread]) for i in range(n)]
    rows += [(5, rows[0][1]), (5, rows[0][1]), (None, rows[1][1]), (None, rows[2][1])]
    rows += [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [None, *[0.1] * 63]), (905, [float("nan"), *[0.1] * 63]), (906, [float("-inf"), *[0.1] * 63]), (907, [0.0] * 64), (908, [-0.0] * 64), (909, [1000.5] * 64)]
    return rows


@pytest.mark.parametrize("n, spread", [(400, 0.02), (400, 0.4), (0, 0.1)])
def test_op12(spark, tmp_path, n, spread):
    rows = data(n, spread) if n else [(k, [0.25 * (k % 3)] * 64) for k in range(9)]  # fewer vectors than centroids, and ties
    spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, id int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_centroid_clusters(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def test_only_what_changed_is_compared(monkeypatch):
    """Rows whose centroid stands still are compared with moved centroids only."""
    import pyarrow as pa

    calls, nearest = [], delta_lloyd._nearest
    monkeypatch.setattr(delta_lloyd, "_nearest", lambda x, c, among: calls.append((len(x), list(among))) or nearest(x, c, among))
    c = np.array([[0, 0], [10, 0], [0, 10], [50, 50]], np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([[1, 0], [9, 0], [0, 9]], pa.list_(pa.int64())), pa.array([0, 1, 2], pa.int32()), pa.array([1, 1, 1])], names=["id", "q", "cluster", "distance"])
    (out,) = delta_lloyd._assign(c, np.array([1]))(iter([batch]))
    assert calls == [(1, [0, 1, 2, 3]), (2, [1])]
    assert out.column(2).to_pylist() == [0, 1, 2]


def test_rounds_that_move_nothing_stop(spark):
    df = spark.createDataFrame([(k, [float(k % 2)] * 64) for k in range(40)], "vec_id long, embedding array<float>")
    got = delta_lloyd.lloyd(df, k=2, rounds=50)
    assert got.rows.count() == 40


def test_odd_tables(spark):
    assert delta_lloyd.lloyd(spark.createDataFrame([], "vec_id long, embedding array<float>")) is None
    assert delta_lloyd.lloyd(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")) is None
    with pytest.raises(Exception, match="after scaling"):
        delta_lloyd.lloyd(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))
