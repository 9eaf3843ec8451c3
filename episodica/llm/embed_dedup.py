"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import components, cut

#: Signs of random projections that make a sort key.
BITS = 62
#: Numbers of one side of a tile (rows by components), so that a task holds few megabytes and large groups are copied seldom.
TILE = 1 << 20
#: Rows of a side that are compared with the other side at once.
BLOCK = 512
#: Chance of having missed a partner just at the threshold up to which a row is done.
OPEN = 0.05
#: Comparisons that cost about as much as one row's part in one pass (projection, shuffle, sort, window).
PASS_COST = 512


def default_passes(n: int, threshold: float, window: int) -> int:
    """Passes of the first round: for vectors spread evenly, a pair just at the threshold meets with a chance of about 0.98."""
    agree = 1 - math.acos(threshold) / math.pi
    meet = agree ** max(0.0, math.log2(max(n, 2) / window))
    return min(512, max(16, math.ceil(4 / meet)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors in double precision, of rows that have one length."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _planes(seed: int, dim: int, k: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, k]).standard_normal((dim, BITS))


def _keys(first: int, passes: int, seed: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for mixed in batches:
            dims = np.asarray(mixed.column(1))
            for dim in np.unique(dims).tolist():
                batch = mixed.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes = {dim: [_planes(seed, dim, k) for k in range(first, first + passes)]}
                x = _matrix(batch.column(2))
                for k in range(passes):
                    keys = (x @ planes[dim][k] > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    columns = [batch.column(1), pa.array(np.full(len(x), first + k, np.int32)), pa.array(keys), batch.column(0), batch.column(2)]
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "pass", "key", "id", "v"])

    return project


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that two keys share."""
    x = a ^ b
    high, low = x >> 31, x & ((1 << 31) - 1)
    return BITS - np.where(high > 0, 31 + np.frexp(high.astype(np.float64))[1], np.frexp(low.astype(np.float64))[1])


def _unmet(x: np.ndarray, planes: np.ndarray, keys: np.ndarray, up: np.ndarray, down: np.ndarray, threshold: float) -> np.ndarray:
    """Log of the chance that a partner just at the threshold is outside a row's window in a pass.

    up, down: key bits shared with the ends of the window.  The row's own projections give the chance that its partner is
    on the same side of each plane; a partner that first differs at a later bit than the window's end stands before it."""
    z = np.abs(x @ planes) * (threshold / math.sqrt(max(1 - threshold * threshold, 1e-12)))
    same = 1 / (1 + np.exp(-np.minimum(1.5976 * z + 0.07056 * z**3, 700)))  # the normal distribution function, to 0.0002
    reach = np.cumprod(same, axis=1)
    differs = np.concatenate([np.ones((len(x), 1)), reach[:, :-1]], axis=1) * (1 - same)
    at = np.arange(BITS)
    ones = (keys[:, None] >> (BITS - 1 - at)) & 1 > 0
    met = (differs * (at > np.where(ones, down[:, None], up[:, None]))).sum(1) + reach[:, -1] * (np.minimum(up, down) < BITS)
    return np.log1p(-np.minimum(met, 1 - 1e-12))


def _neighbours(threshold: float, window: int, seed: int):
    """(a, b, null): verified pairs of rows at most window places apart in one pass, without those already joined by others
    of the task; (id, null, unmet): for each row of a pass the log of the chance that it missed a partner there."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}
        planes: dict[tuple[int, int], np.ndarray] = {}

        def find(i: int) -> int:
            while root.setdefault(i, i) != i:
                root[i] = i = root[root[i]]
            return i

        def ends(passes: np.ndarray, keys: np.ndarray, at: np.ndarray, d: int) -> np.ndarray:
            """Key bits shared with the row d places on: all where the task ends first (nothing is sure), none where the pass does."""
            to = np.clip(at + d, 0, len(keys) - 1)
            inside = (at + d >= 0) & (at + d < len(keys))
            return np.where(passes[to] != passes[at], -1, np.where(inside, _prefix(keys[at], keys[to]), BITS))

        def rated(passes, keys, ids, x, a: int, b: int):
            at, out = np.arange(a, b), np.zeros(b - a)
            up, down = ends(passes, keys, at, window), ends(passes, keys, at, -window)
            for k in np.unique(passes[a:b]).tolist():
                if (x.shape[1], k) not in planes:
                    planes.clear()
                    planes[x.shape[1], k] = _planes(seed, x.shape[1], k)
                of = passes[a:b] == k
                out[of] = _unmet(x[a:b][of], planes[x.shape[1], k], keys[a:b][of], up[of], down[of], threshold)
            none = pa.nulls(b - a, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids[a:b]), none, pa.array(out)], names=["a", "b", "unmet"])

        held, due = None, 0  # the last rows so far, and the first of them that isn't rated yet
        for mixed in batches:
            dims = np.asarray(mixed.column(0))
            starts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for start, stop in zip(starts[:-1], starts[1:], strict=True):
                batch = mixed.slice(start, stop - start)
                if not len(batch):
                    continue
                passes, keys, ids, x = *(np.asarray(batch.column(c)) for c in (1, 2, 3)), _matrix(batch.column(4))
                if held is not None and held[3].shape[1] != x.shape[1]:
                    yield rated(*held, due, len(held[2]))
                    held, due = None, 0
                old = 0
                if held is not None:
                    old = len(held[2])
                    passes, keys, ids, x = (np.concatenate([h, y]) for h, y in zip(held, (passes, keys, ids, x), strict=True))
                a, b = [], []
                for d in range(1, min(window, len(ids) - 1) + 1):
                    low = max(0, old - d)
                    near = (np.einsum("ij,ij->i", x[low:-d], x[low + d :]) >= threshold) & (passes[low:-d] == passes[low + d :])
                    for i in (np.flatnonzero(near) + low).tolist():
                        p, q = find(int(ids[i])), find(int(ids[i + d]))
                        if p != q:
                            root[max(p, q)] = min(p, q)
                            a.append(int(ids[i]))
                            b.append(int(ids[i + d]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.float64())], names=["a", "b", "unmet"])
                done = max(due, len(ids) - window)
                if done > due:
                    yield rated(passes, keys, ids, x, due, done)
                keep = max(0, done - window)
                held, due = (passes[keep:], keys[keep:], ids[keep:], x[keep:]), done - keep
        if held is not None and due < len(held[2]):
            yield rated(*held, due, len(held[2]))

    return compare


def _links(threshold: float):
    """Links between components over the rows of two blocks (or inside one): one pair of rows for each two that they join."""

    def link(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        ids, side, of = (np.asarray(tile[c]) for c in ("id", "side", "component"))
        left = side == 0
        right = left if tile["same"][0].as_py() else side == 1
        a, b = [], []
        if left.any() and right.any() and len(np.unique(of)) > 1:
            x = _matrix(tile["v"].chunk(0) if isinstance(tile["v"], pa.ChunkedArray) else tile["v"])
            y, y_of, y_ids = x[right], of[right], ids[right]
            at, seen = np.flatnonzero(left), set()
            for k in range(0, len(at), BLOCK):
                rows = at[k : k + BLOCK]
                i, j = np.nonzero((x[rows] @ y.T >= threshold) & (of[rows][:, None] != y_of))
                pairs, where = np.unique(np.stack([of[rows][i], y_of[j]]), axis=1, return_index=True)
                for p, q, w in zip(*pairs.tolist(), where.tolist(), strict=True):
                    if (p, q) not in seen and (q, p) not in seen:
                        seen.add((p, q))
                        a.append(int(ids[rows[i[w]]]))
                        b.append(int(y_ids[j[w]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return link


def _in_blocks(rows: DataFrame, n: Column) -> DataFrame:
    """rows (with dim) with their block and the number of _blocks, for groups of n rows: blocks of TILE numbers."""
    blocks = F.greatest(F.lit(1), F.ceil(n * F.col("dim") / TILE)).cast("int")
    return rows.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))


def _tiles(rows: DataFrame, *columns: str) -> DataFrame:
    """rows (with block and _blocks) dealt to all pairs t0, t1 of blocks; side tells the two apart, same an equal pair."""
    tiles = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return tiles.select(*columns, F.least("block", "other").alias("t0"), F.greatest("block", "other").alias("t1"), (F.col("block") > F.col("other")).cast("int").alias("side"), (F.col("block") == F.col("other")).alias("same"))


def _edges(groups: DataFrame, n: int, threshold: float, window: int, passes: int | None, seed: int) -> DataFrame:
    """Pairs (a, b) of linked rows that span the components of groups (id, dim, v)."""
    kind = dict(groups.dtypes)["v"]
    open_, done, edges, total = groups.select("id", "dim", "v"), 0, None, None
    width = passes or default_passes(n, threshold, window)
    while True:
        keyed = open_.mapInArrow(_keys(done, width, seed), f"dim int, pass int, key long, id long, v {kind}")
        ordered = keyed.repartitionByRange("dim", "pass", "key", "id").sortWithinPartitions("dim", "pass", "key", "id")
        met = cut(ordered.mapInArrow(_neighbours(threshold, window, seed), "a long, b long, unmet double"))
        found = met.where("b is not null").select("a", "b")
        edges, done = found if edges is None else edges.union(found), done + width
        if passes:
            return edges
        rated = met.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("unmet").alias("unmet"))
        rated = rated if total is None else rated.unionByName(total).groupBy("id").agg(F.sum("unmet").alias("unmet"))
        total = cut(rated.where(F.col("unmet") > math.log(OPEN)))
        more = F.least(F.lit(1e6), done * (math.log(OPEN) / F.least("unmet", F.lit(-1e-9)) - 1))
        left, more = total.agg(F.count("*"), F.avg(more)).first()
        if left < 2:
            return edges
        open_ = open_.join(total.select("id"), "id")
        if left < 2 * PASS_COST * more:
            break
        open_ = cut(open_)
        width = max(4, min(done, math.ceil(more)))
    # rows that passes would take longer to settle are compared with each other, unless their components are one already
    rest = cut(open_.join(components(edges), "id", "left").select("id", "dim", "v", F.coalesce("component", "id").alias("component")))
    if rest.select("component").distinct().limit(2).count() < 2:
        return edges
    tiles = _tiles(_in_blocks(rest, F.lit(left)), "dim", "component", "id", "v")
    return edges.union(cut(tiles.groupBy("dim", "t0", "t1").applyInArrow(_links(threshold), "a long, b long")))


def _count(threshold: float):
    """Links between the rows of two blocks of a component (or inside one), weighted by copies; no pairs are made."""

    def count(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        ids, side, copies = (np.asarray(tile[c]) for c in ("id", "side", "copies"))
        x, same = _matrix(tile["v"].chunk(0) if isinstance(tile["v"], pa.ChunkedArray) else tile["v"]), bool(tile["same"][0].as_py())
        left = side == 0
        right = left if same else side == 1
        a, b, weight, out_ids = x[left], x[right], copies[right], ids[left]
        links, back = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        for k in range(0, len(a), BLOCK):
            near = a[k : k + BLOCK] @ b.T >= threshold
            if same:
                near[np.arange(len(near)), k + np.arange(len(near))] = False
            links[k : k + BLOCK] = near @ weight
            if not same:
                back += copies[left][k : k + BLOCK] @ near
        if not same:
            out_ids, links = np.concatenate([out_ids, ids[right]]), np.concatenate([links, back])
        return pa.table({"id": pa.array(out_ids, pa.int64()), "links": pa.array(links, pa.int64())})

    return count


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, window: int = 32, passes: int | None = None, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors.

    Equal vectors are grouped first, and only vectors of one length are compared.  In each pass the distinct ones are ordered
    by a key of 62 random projection signs, and each is compared with its window next neighbours; pairs with a cosine of at
    least threshold (in double precision) join components over all passes.  After a round of passes each row has the chance
    that a partner just at the threshold never stood in its window, from its own projections and the width of its windows;
    rows where it is above OPEN go on, so crowded rows get more passes.  A pair needs further passes only if both its rows
    do.  Once comparing the rows left with each other is cheaper than further passes, that is done instead and is exact.
    passes sets a fixed number of passes over all rows.
    n_links then counts all links inside each component, tile by tile, so large groups cost no pair rows and lose no link.

    Null and zero vectors, and vectors with null or non-finite components, link with nothing.  Rows that
    repeat a key are vectors of their own with equal results: links between them count.  Null keys keep their row and never lead a component.  Without rows the result is empty."""
    v = F.col(vector)
    usable = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))), F.lit(False))
    usable = usable & F.coalesce(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) > 0, F.lit(False))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.when(usable, v).alias("v"))
    # equal vectors: the least key stands for them; an internal id keeps groups apart when keys are null or repeat
    groups = rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    groups = cut(groups.withColumns({"id": F.monotonically_increasing_id(), "dim": F.size("v")}))
    n = groups.count()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    joined = components(_edges(groups, n, threshold, window, passes, seed))
    # count links inside each component: members are dealt to blocks, pairs of blocks are tiles
    members = groups.join(joined, "id")
    sizes = joined.groupBy("component").agg(F.count("*").alias("_n"))
    members = _in_blocks(members.join(sizes, "component"), F.col("_n")).drop("_n")
    tiles = _tiles(members, "component", "id", "v", "copies")
    links = tiles.groupBy("component", "t0", "t1").applyInArrow(_count(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    lows = members.groupBy("component").agg(F.min("low").alias("component_id"))
    found = groups.join(joined, "id", "left").join(lows, "component", "left").join(links, "id", "left")
    found = cut(found.select("id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low").alias("component_id")))
    by_vector = groups.join(found, "id").select(F.col("v").alias("_v"), "n_links", "component_id")
    out = rows.join(by_vector, rows["v"].eqNullSafe(F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
