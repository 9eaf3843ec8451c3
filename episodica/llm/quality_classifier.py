"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import cut
from episodica.llm.textbytes import _SLOT_CODES, Run, mix, runs, sum_by

#: Weights of the model: 2^20 features, the last for the constant.
FEATURE_BITS = 20
#: Bound of the labelled sample that training reads, whatever the table's size.
MAX_TRAIN_ROWS = 20_000
#: Kinds of bytes for word shapes: capitals, small letters, digits, line-end signs, beyond ASCII, others.
_KIND = np.full(256, 5, np.uint64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[0x80:] = 0, 1, 2, 1
_KIND[list(b".,;:")] = 3


def features(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of the run, and the texts' offsets into them.

    Each word gives its own form, its shape (kinds of its first two and last two bytes, whether it is long) and both of
    these joined with the next word's; a word that is repeated at once gives one feature more."""
    run.words()
    hashes, n = run.word_hashes(), len(run.starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(run.n + 1, np.int64)
    first, last = run.buf[run.starts], run.buf[run.ends - 1]
    second, before = run.buf[np.minimum(run.starts + 1, run.ends - 1)], run.buf[np.maximum(run.ends - 2, run.starts)]
    size = np.minimum((run.ends - run.starts) // 8, 3).astype(np.uint64)
    shape = (((_KIND[first] * np.uint64(6) + _KIND[second]) * np.uint64(6) + _KIND[before]) * np.uint64(6) + _KIND[last]) * np.uint64(4) + size
    ends = np.zeros(n, bool)
    ends[run.word_offs[1:][run.n_words > 0] - 1] = True
    after, shape_after = np.roll(hashes, -1), np.roll(shape, -1)
    after[ends], shape_after[ends] = 1, 1 << 40
    again = np.where((hashes == after) & ~ends, np.uint64(77), np.uint64(78))
    kinds = (hashes, shape + np.uint64(1 << 50), hashes * _SLOT_CODES[8] + after * _SLOT_CODES[9], shape * _SLOT_CODES[10] + shape_after * _SLOT_CODES[11], again)
    ids = (mix(np.stack(kinds, 1)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)
    return ids.ravel(), run.word_offs * len(kinds)


def logits(run: Run, weights: np.ndarray) -> np.ndarray:
    """The sparse dot product of each text's counts, divided by the root of their sum, with the weights."""
    ids, offs = features(run)
    n = np.maximum(np.diff(offs), 1)
    return sum_by(weights[ids].astype(np.float64), offs) / np.sqrt(n) + weights[-1]


def _train(alpha: float, beta: float, l1: float, l2: float, epochs: int):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << FEATURE_BITS) + 1
        z, n, rows = np.zeros(size), np.zeros(size), []
        for batch in batches:
            labels = np.asarray(batch.column(1)).astype(np.float64)
            for run in runs(batch.column(0)):
                ids, offs = features(run)
                for i in range(run.n):
                    at, counts = np.unique(ids[offs[i] : offs[i + 1]], return_counts=True)
                    x = counts / np.sqrt(max(offs[i + 1] - offs[i], 1))
                    rows.append((np.append(at, size - 1).astype(np.int32), np.append(x, 1.0).astype(np.float32), labels[run.first + i]))

        def weights(at):
            zi = z[at]
            return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

        for _ in range(epochs):
            for at, x, y in rows:
                w = weights(at)
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        final = weights(np.arange(size)).astype(np.float32)
        at = np.flatnonzero(final)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(final[at], pa.float32())], names=["feature", "weight"])

    return train


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN_ROWS, key: str = "doc_id", text: str = "text", alpha: float = 0.1, beta: float = 1.0, l1: float = 0.0, l2: float = 1.0, epochs: int = 3) -> np.ndarray:
    """Weights of the logistic regression for label 1.

    Trained on a sample of labelled rows of at most max_rows keys, the first in a seeded order of keys (so the task that
    trains, and the broadcast of sampled keys, are bounded).  Keys with several labels count with the least; null keys and
    labels are left out.  Without labelled texts all weights are 0."""
    chosen = labels.select(F.col(key).cast("long").alias("_key"), F.col(label).cast("int").alias("_label")).where("_key is not null and _label in (0, 1)")
    chosen = chosen.groupBy("_key").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64(F.col("_key"), F.lit(11)), "_key").limit(max_rows)
    chosen = cut(chosen)
    rows = docs.join(F.broadcast(chosen), docs[key].cast("long") == chosen["_key"]).select(F.col(text).alias("text"), F.col("_label").alias("label"), "_key")
    ordered = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.col("_key"), F.lit(12)), F.xxhash64("text")).select("text", "label")
    found = ordered.mapInArrow(_train(alpha, beta, l1, l2, epochs), "feature int, weight float").toArrow()
    weights = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
    weights[np.asarray(found["feature"])] = np.asarray(found["weight"])
    return weights


def score(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5) of every whole text; no shuffle.

    Null and empty texts get the constant's score.  Repeated rows and null keys stay; without rows the result is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 MB at every size of input

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(1)):
                s = 1 / (1 + np.exp(-np.clip(logits(run, shared.value), -500, 500)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.n), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """The rows of docs that are predicted 1, all columns as they were."""
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [logits(run, shared.value) >= 0 for run in runs(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *mask])))

    return docs.mapInArrow(select, docs.schema)
