"""Connected components of long chains, by rounds of joins and by one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.llm import common


def truth(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("bound", [0, 50, 10**6])
def test_random_graph(spark, bound):
    rng = np.random.default_rng(bound)
    edges = [tuple(int(v) for v in rng.integers(-300, 300, 2)) for _ in range(260)]
    df = spark.createDataFrame([*edges, (None, 4), (9, None), (7, 7)], "a long, b long")
    got = common.components(df, bound).collect()
    assert len(got) == len({r["id"] for r in got})
    assert {r["id"]: r["component"] for r in got} == truth([e for e in edges if e[0] != e[1]])


@pytest.mark.parametrize("bound", [1000, None])
def test_chain_of_random_ids(spark, bound, monkeypatch):
    """100,000 nodes in a chain end, and the plans of all rounds keep true sizes."""
    order = np.random.default_rng(3).permutation(100_000)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(order[:-1], order[1:], strict=True)], "a long, b long")
    sizes, write = [], common.write_table

    def written(rows, name):
        table = write(rows, name)
        sizes.append(int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return table

    monkeypatch.setattr(common, "write_table", written)
    got = common.components(df, bound)
    assert got.agg(F.count("*"), F.count_distinct("id"), F.min("component"), F.max("component")).first()[:] == (100_000, 100_000, 0, 0)
    assert max(sizes).bit_length() < 64


def test_no_edges(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert common.components(df).count() == 0
