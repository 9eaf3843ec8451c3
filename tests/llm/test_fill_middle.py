"""Fill-in-the-middle against a direct reading of its definition."""

import hashlib
import random
import re

import numpy as np
import pytest

from episodica.llm import fill_middle, queries


@pytest.mark.parametrize("numbers", [[], [0], [5], [0, 1, 2, 3], [1, 1000000], [3, 3, 3, 9], list(range(0, 50000, 7)), [k * k for k in range(1, 3000)], [10**7]])
def test_elias_fano(numbers):
    ef = fill_middle.EliasFano(np.array(numbers, np.int64))
    assert ef.n == len(numbers)
    assert [ef[k] for k in range(len(numbers))] == numbers


def test_elias_fano_is_small():
    numbers = np.cumsum(np.random.default_rng(1).integers(1, 120, 100_000))
    assert fill_middle.EliasFano(numbers).nbytes * 8 < 100_000 * (2 + 6 + 1)


def by_hand(key, text, rate=100, suffix_first=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < suffix_first:
        return key, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return key, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows():
    rng = random.Random(2)
    texts = [None, "", "\n", "\n\n\n", "one line", "one\ntwo", "one\ntwo\n", "a<P>b\nc", "x <S>\n", "<M>", "<\nP>\n<S\n>", "é\n🙂\r\n中\x85 b\n", "a<\n<b\n<S\n", "line\n" * 5000, "x" * 200_000 + "\ny"]
    texts += ["".join(rng.choice(["a", "é", "🙂", "\n", " ", "<", "P>", "S", "M", ">"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    return [(None if n % 40 == 9 else n, t) for n, t in enumerate(texts * 2)] + [(3, "one\ntwo"), (3, "one\ntwo"), (3, "other\ntext\n")]


@pytest.mark.parametrize("rate, suffix_first", [(100, 50), (30, 100), (0, 0), (70, 0)])
def test_definition(spark, rate, suffix_first):
    data = rows()
    df = spark.createDataFrame([(k, t, 1, "x", 2) for k, t in data], "doc_id long, text string, hash long, output string, row int").repartition(3)
    found = fill_middle.fill_in_middle(df, rate=rate, suffix_first=suffix_first)
    got = found.withColumn("restored", fill_middle.restored()).collect()
    want = [(*by_hand(k, t, rate, suffix_first), t or "") for k, t in data]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query_and_many_copies(spark, tmp_path):
    text = "a hot text\nof three\nlines"
    data = [(k, text) for k in range(3000)] + [(k, f"text {k}\nb") for k in range(3000, 5000)] + [(7, text)] * 500
    spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_fill_in_middle(spark, str(tmp_path)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(*(w := by_hand(k, t))[:5], sha(w[5]), sha(t)) for k, t in data]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    dealt = fill_middle.fill_in_middle(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    parts = [n for n in dealt.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    assert len(parts) == 1 or max(parts) < 3500  # copies spread, unless adaptive execution joins small parts


def test_empty_table(spark):
    got = fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert got.count() == 0
