"""Exact Jaccard self-join on word shingles.

Every text becomes a set of 64-bit shingle hashes.  Texts with equal sets form a class and are compared as one.  Classes
that reach the threshold share a hash among the first n - ceil(t n) + 1 of their sets in any common order, so those
prefixes are dealt into tiles by (hash, size band).  The order puts the most frequent hashes last, which keeps tiles
small where many unlike texts share a passage.  Inside tiles, parity bitmaps bound the overlap of two sets from above by
bit counts, and the pairs that pass are decided by intersecting the sorted arrays.

Tiles of many alike texts don't make all their pairs: two rounds first compare each member with one pivot of its tiles and
join components; then members are compared only across different components, block by block, and no pair leaves a block
before it is verified.  Bitmaps, first folded to a quarter and then whole, tell which members of a block have a partner that
may reach the threshold; only their arrays are fetched, once for each such block, and a block gives the verified links that span its components, fewer
than its members.  Two members that share several tiles are compared in the first of them.  No link between components is
lost, as every pair that shares a tile is either in one component already or compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodica.llm.common import BROADCAST_ROWS, components, cut
from episodica.llm.textbytes import _SLOT_CODES, LOWER, Run, give_back, mix, runs, spread, sum_by, windows

#: Texts that share a hash from which it counts as frequent, and frequent hashes that are told to tasks at most (8 MB).
#: Both only shape the order of prefixes; results are the same for any values.
FREQUENT, MOST_FREQUENT = 64, 1 << 20
#: Postings that a task gathers, and members of a tile, and all their shingles, that one block holds.
TASK_POSTINGS, BLOCK, BLOCK_SHINGLES = 1 << 20, 1024, 1 << 21
#: Members that are compared with a pivot in one group.
GROUP = 512
#: Candidates of a member whose arrays are intersected at once.
CHUNK = 32
#: Parts by low bits of the hash in which a task works through its postings, and bytes of text whose postings are
#: gathered at once: a worker's temporary arrays are bounded by these.
PARTS, GATHER_BYTES = 8, 1 << 23


class Sets:
    """Shingle sets of a run: hashes of text i, ascending and distinct, at [offs[i], offs[i+1])."""

    def __init__(self, run: Run, shingle: int):
        run.buf = LOWER[run.buf]
        run.words()
        hashes = run.word_hashes()
        found, found_offs = windows(hashes, run.word_offs, shingle)
        counts = np.diff(found_offs)
        short = (run.n_words > 0) & (run.n_words < shingle)  # the whole sequence is the only shingle
        if short.any():
            counts = counts + short
            offs = np.concatenate([[0], np.cumsum(counts)])
            flat = np.zeros(int(offs[-1]), np.uint64)
            flat[spread(offs[:-1][~short], counts[~short])] = found
            for n in range(1, shingle):
                at = np.flatnonzero(run.n_words == n)
                total = np.full(len(at), n, np.uint64) * _SLOT_CODES[40]
                for k in range(n):
                    total += hashes[run.word_offs[at] + k] * _SLOT_CODES[41 + k]
                flat[offs[at]] = mix(total)
            found, found_offs = flat, offs
        for a, b in zip(found_offs[:-1].tolist(), found_offs[1:].tolist(), strict=True):
            if b - a > 1:
                found[a:b].sort()
        doc = np.repeat(np.arange(run.n), np.diff(found_offs))
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
        self.hashes, self.doc = found[new], doc[new]
        self.offs = np.searchsorted(self.doc, np.arange(run.n + 1))
        self.n = np.diff(self.offs)
        #: The same for equal sets, whatever the text.
        self.keys = mix(sum_by(mix(self.hashes).view(np.int64), self.offs).view(np.uint64) + self.n.astype(np.uint64)).view(np.int64)

    def prefixes(self, t100: int, tasks: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings of all prefixes, their texts, and whether each is frequent."""
        hashes, doc, often = posting(self.hashes, tasks), self.doc, np.zeros(len(self.hashes), bool)
        if len(frequent) and len(hashes):
            often = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
            if often.any():
                order = np.argsort(doc * 2 + often, kind="stable")
                hashes, often = hashes[order], often[order]
        lengths = np.where(self.n > 0, self.n - (t100 * self.n + 99) // 100 + 1, 0)
        at = spread(self.offs[:-1], lengths)
        return hashes[at], doc[at], often[at]


def bands(n: np.ndarray, t100: int) -> np.ndarray:
    """Sizes that reach the threshold lie in one band or in two adjacent ones."""
    edges = [1]
    while edges[-1] <= n.max(initial=1):
        edges.append(max(edges[-1] + 1, 100 * edges[-1] // t100 + 1))
    return np.searchsorted(edges, n, "right")


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the set's hashes in four to eight bits for each: |A ^ B| is at least the number of bits that differ."""
    bits = max(64, 1 << (4 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _fold(maps: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to size bytes."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, size), axis=1)


def _coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps (key, data) folded to a quarter, which tells unlike sets apart nearly as well."""
    for batch in batches:
        data = [_fold(np.frombuffer(x, np.uint8).reshape(1, -1), max(8, len(x) // 4)).tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["key", "data"])


def _overlap_bound(a: int, b: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The most that sets of sizes a and b can share when their bitmaps differ in so many bits."""
    return (a + b - differ) // 2


def _reaches(shared, a, b, t100: int):
    return (100 + t100) * shared >= t100 * (a + b)


def _documents(shingle: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(1)):
                s = Sets(run, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.n), pa.array(s.n, pa.int64()), pa.array(s.keys)], names=["doc_id", "n_shingles", "key"])

    return measure


def posting(hashes: np.ndarray, tasks: int) -> np.ndarray:
    """What stands for a hash in postings: the task that gathers it and its low 40 bits, which tell the hashes of one task apart.

    Two hashes that fall together (about one pair in a task of 2^20) only make a tile larger."""
    task = (hashes >> np.uint64(32)) * np.uint64(tasks) >> np.uint64(32)
    return task << np.uint64(40) | hashes & np.uint64((1 << 40) - 1)


def _short(postings: np.ndarray) -> bytes:
    return np.ascontiguousarray(postings).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _of_part(hashes: np.ndarray, part: int) -> np.ndarray:
    return np.flatnonzero(hashes % np.uint64(PARTS) == np.uint64(part))


def _rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k else pa.int32()) for k in range(len(names))], names=names)


def _slices(values: np.ndarray) -> zip:
    """Start and end of each run of equal values."""
    first = np.flatnonzero(np.diff(values, prepend=values[:1] - 1)) if len(values) else np.zeros(0, np.int64)
    return zip(first.tolist(), [*first[1:].tolist(), len(values)], strict=True) if len(first) else zip((), (), strict=True)


def _counts(shingle: int, t100: int, tasks: int):
    """Distinct prefix postings of each batch with their texts' counts, a row for each task that gathers them."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Sets(run, shingle).prefixes(t100, tasks, np.zeros(0, np.uint64))[0] for run in runs(batch.column(0))]
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            task, counts = (values >> np.uint64(40)).astype(np.int64), counts.astype(np.uint32)
            yield _rows([(int(task[a]), _short(values[a:b]), counts[a:b].tobytes()) for a, b in _slices(task)], ["task", "hashes", "counts"])

    return gather


def _frequent(least: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        for part in range(PARTS if rows else 0):
            values, counts = [], []
            for task, h, n in rows:
                value = _long(h) | np.uint64(task << 40)
                at = _of_part(value, part)
                values.append(value[at])
                counts.append(np.frombuffer(n, np.uint32)[at])
            found, back = np.unique(np.concatenate(values), return_inverse=True)
            total = np.bincount(back, np.concatenate(counts), len(found))
            at = np.flatnonzero(total >= least)
            yield pa.RecordBatch.from_arrays([pa.array(found[at].view(np.int64)), pa.array(total[at].astype(np.int64))], names=["hash", "n"])
        rows = None
        give_back()

    return find


def _postings(shingle: int, t100: int, tasks: int, frequent):
    """Prefix postings of each batch, a row for each task that gathers them; those of frequent ones, dealt by text, go to tasks of their own.

    A row holds the postings of a text side by side: for each such text its key, size and number of postings."""

    def deal(parts: list[tuple]) -> pa.RecordBatch:
        hashes, keys, sizes, is_often, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        task = np.where(is_often, tasks + (mix(keys.view(np.uint64)) % np.uint64(tasks)).astype(np.int64), (hashes >> np.uint64(40)).astype(np.int64))
        order = np.argsort(task, kind="stable")
        task, hashes, keys, sizes, doc = task[order], hashes[order], keys[order], sizes[order], doc[order]
        rows = []
        for a, b in _slices(task):
            first = np.flatnonzero(np.diff(doc[a:b], prepend=-1)) + a
            counts = np.diff(np.append(first, b)).astype(np.uint32)
            code = hashes[a:b].tobytes() if task[a] >= tasks else _short(hashes[a:b])
            rows.append((int(task[a]), code, keys[first].tobytes(), sizes[first].tobytes(), counts.tobytes()))
        return _rows(rows, ["task", "hashes", "keys", "sizes", "counts"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for batch in batches:
            parts, texts, size = [], 0, 0
            for run in runs(batch.column(0)):
                size += len(run.buf)
                s = Sets(run, shingle)
                _, one = np.unique(s.keys, return_index=True)  # one text of each class
                first = np.zeros(run.n, bool)
                first[one] = True
                hashes, doc, is_often = s.prefixes(t100, tasks, often)
                at = np.flatnonzero(first[doc])
                doc = doc[at]
                parts.append((hashes[at], s.keys[doc], s.n[doc].astype(np.int32), is_often[at], doc + texts))
                texts += run.n
                if size >= GATHER_BYTES:
                    yield deal(parts)
                    parts, size = [], 0
            if parts:
                yield deal(parts)

    return gather


def _tiles(t100: int, tasks: int):
    """Members of tiles: each class in the tile of its own size band and in that of the next.

    Tiles that can't hold a pair are left out.  A tile is named by its members, so that the many tiles that alike texts
    share become one; those of frequent postings, which several tasks hold parts of, are named by posting and band."""

    def tiles(rows: list[tuple], whole: bool, part: int, seen: np.ndarray) -> tuple[tuple, np.ndarray]:
        """tile, key, size and own of the members."""
        chosen = []
        for task, h, k, n, c in rows:
            code = _long(h) | np.uint64(task << 40) if whole else np.frombuffer(h, np.uint64)
            at, counts = _of_part(code, part), np.frombuffer(c, np.uint32)
            text = np.repeat(np.arange(len(counts)), counts)[at]
            chosen.append((code[at], np.frombuffer(k, np.int64)[text], np.frombuffer(n, np.int32)[text]))
        hashes, keys, sizes = (np.concatenate(x) for x in zip(*chosen, strict=True))
        if whole:
            order = np.argsort(hashes)
            same = hashes[order][1:] == hashes[order][:-1]
            at = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
            hashes, keys, sizes = hashes[at], keys[at], sizes[at]
        band = bands(sizes, t100).astype(np.uint64)
        both = np.concatenate([band, band + np.uint64(1)])
        tile = mix(np.concatenate([hashes, hashes]) ^ mix(both + np.uint64(0x51ED27)))
        keys, sizes, own = np.concatenate([keys, keys]), np.concatenate([sizes, sizes]), np.arange(2 * len(hashes)) < len(hashes)
        order = np.lexsort((~own, keys, tile))
        tile, keys, sizes, own = tile[order], keys[order], sizes[order], own[order]
        new = np.ones(len(tile), bool)
        new[1:] = (tile[1:] != tile[:-1]) | (keys[1:] != keys[:-1])
        tile, keys, sizes, own = tile[new], keys[new], sizes[new], own[new]
        if whole and len(tile):
            first = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            count = np.diff(np.append(first, len(tile)))
            owners = np.add.reduceat(own.astype(np.int64), first)
            name = mix(np.add.reduceat(mix(keys.view(np.uint64) * np.uint64(2) + own), first) + count.astype(np.uint64))
            _, once = np.unique(name, return_index=True)
            kept = np.zeros(len(first), bool)
            kept[once] = True
            kept &= (count > 1) & (owners > 0) & ~np.isin(name, seen)
            seen = np.concatenate([seen, name[kept]])
            at = np.repeat(kept, count)
            tile, keys, sizes, own = np.repeat(name, count)[at], keys[at], sizes[at], own[at]
        return (tile, keys, sizes, own), seen

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, often, seen = [], [], np.zeros(0, np.uint64)
        for batch in batches:
            for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                (often if row[0] >= tasks else parts).append(row)
        for rows, whole in ((parts, True), (often, False)):
            for part in range(PARTS if rows else 0):
                (tile, keys, sizes, own), seen = tiles(rows, whole, part, seen)
                yield pa.RecordBatch.from_arrays([pa.array(tile.view(np.int64)), pa.array(keys), pa.array(sizes.astype(np.int32)), pa.array(own)], names=["tile", "key", "n", "own"])
        parts = often = rows = None
        give_back()

    return deal


def _fetched(shingle: int, form):
    """The rows of texts that are of the expected class (column key), without the text but with form(sorted array) as data."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected, rest = np.asarray(batch.column("key")), batch.drop_columns(["text"])
            for run in runs(batch.column("text")):
                s = Sets(run, shingle)
                at = np.flatnonzero(s.keys == expected[run.first : run.first + run.n])
                data = [form(s.hashes[s.offs[i] : s.offs[i + 1]]) for i in at.tolist()]
                rows = rest.take(pa.array(run.first + at))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(data, pa.binary())], names=[*rows.schema.names, "data"])

    return fetch


def _with_pivot(reaches):
    """Pairs of pivot and member for which reaches(pivot's n and data, member's n and data); rows come ordered by pivot, part and role."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, n, held = None, 0, b""
        for batch in batches:
            a, b = [], []
            for group, role, key, size, data in zip(*(batch.column(c).to_pylist() for c in ("pivot", "role", "key", "n", "data")), strict=True):
                if role == 0:
                    pivot, n, held = group, size, data
                elif pivot == group and reaches(n, held, size, data):
                    a.append(group)
                    b.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    return check


def _may_reach(t100: int):
    """Whether the bitmaps of two sets allow the threshold."""

    def reaches(n: int, one: bytes, m: int, two: bytes) -> bool:
        if n > m:
            n, one, m, two = m, two, n, one
        if m * t100 > n * 100:
            return False
        small, large = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
        differ = int(np.bitwise_count(small ^ np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0)).sum())
        return bool(_reaches(_overlap_bound(n, m, differ), n, m, t100))

    return reaches


def _do_reach(t100: int):
    """Whether two sorted arrays reach the threshold."""

    def reaches(n: int, one: bytes, m: int, two: bytes) -> bool:
        both = np.concatenate([np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)])
        both.sort(kind="stable")  # two ascending runs
        return bool(_reaches(int((both[1:] == both[:-1]).sum()), n, m, t100))

    return reaches


class Block:
    """Members of two blocks of a tile, or of one, by size; candidates(i) are the later ones that i is to be compared with."""

    def __init__(self, rows: pa.Table, t100: int, whole: bool):
        """whole: data holds sorted arrays, else bitmaps."""
        sizes = np.asarray(rows["n"])
        self.order = np.argsort(sizes, kind="stable")
        self.t100, self.n = t100, sizes[self.order].astype(np.int64)
        self.key, self.comp, self.own, self.side = (np.asarray(rows[c])[self.order] for c in ("key", "comp", "own", "side"))
        self.same, tile = bool(rows["same"][0].as_py()), rows["tile"][0].as_py()
        raw = rows["data"].to_pylist()
        raw = [raw[i] for i in self.order.tolist()]
        if whole:
            self.arrays = [np.frombuffer(x, np.uint64) for x in raw]
            raw = [bitmap(x) for x in self.arrays]
        self.sizes = np.array([len(x) for x in raw])  # ascending, as they follow n
        self.to = np.searchsorted(self.n, 100 * self.n // t100, "right")
        self.folded = {}  # bitmaps of all that are at least so large, folded to that size
        for size in np.unique(self.sizes).tolist():
            first = int(np.searchsorted(self.sizes, size))
            to = int(self.to[np.searchsorted(self.sizes, size, "right") - 1])
            parts = [_fold(np.frombuffer(b"".join(raw[i:j]), np.uint8).reshape(j - i, -1), size) for i, j in _slices(self.sizes) if i >= first and i < to]
            self.folded[size] = first, np.concatenate(parts).view(np.uint64)
        self._earlier(rows["codes"].combine_chunks(), tile)

    def _earlier(self, codes: pa.ListArray, tile: int) -> None:
        """For each member the tiles before this one that others of the block are in too, as bits: all, and those it owns."""
        codes = codes.take(pa.array(self.order))
        flat, counts = np.asarray(codes.flatten()), np.diff(np.asarray(codes.offsets))
        of = np.repeat(np.arange(len(counts)), counts)
        own, flat = (flat & 1).astype(bool), flat >> 1
        before = flat < np.array([tile], np.int64)[0] << np.int64(1) >> np.int64(1)
        flat, of, own = flat[before], of[before], own[before]
        values, back, met = np.unique(flat, return_inverse=True, return_counts=True)
        place = np.cumsum(met > 1) - 1
        shared = met[back] > 1
        at, of, own = place[back[shared]], of[shared], own[shared]
        width = max(1, -(-int((met > 1).sum()) // 64))
        self.all, self.owned = np.zeros((len(counts), width), np.uint64), np.zeros((len(counts), width), np.uint64)
        bit = np.uint64(1) << (at & 63).astype(np.uint64)
        np.bitwise_or.at(self.all, (of, at >> 6), bit)
        np.bitwise_or.at(self.owned, (of[own], at[own] >> 6), bit[own])

    def candidates(self, i: int) -> np.ndarray:
        """Later members of other components whose sizes and bitmaps allow the threshold and that no earlier tile compares with i."""
        j = np.arange(i + 1, self.to[i])
        j = j[(self.comp[j] != self.comp[i]) & (self.own[j] | self.own[i])]
        if not self.same:
            j = j[self.side[j] != self.side[i]]
        if len(j):
            first, maps = self.folded[int(self.sizes[i])]
            differ = np.bitwise_count(maps[j - first] ^ maps[i - first]).sum(1)
            j = j[_reaches(_overlap_bound(int(self.n[i]), self.n[j], differ), self.n[i], self.n[j], self.t100)]
        if len(j):
            j = j[~((self.owned[i] & self.all[j]) | (self.all[i] & self.owned[j])).any(1)]
        return j

    def links(self) -> tuple[list[int], list[int]]:
        """Verified links that span the components of the block."""
        comps, of = np.unique(self.comp, return_inverse=True)
        label, a, b = np.arange(len(comps)), [], []  # components that are one by now have one label
        for i in range(len(self.n)):
            todo, mine = self.candidates(i), self.arrays[i]
            while len(todo := todo[label[of[todo]] != label[of[i]]]):
                now, todo = todo[:CHUNK], todo[CHUNK:]
                flat = np.concatenate([self.arrays[j] for j in now.tolist()])
                hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
                starts = np.concatenate([[0], np.cumsum(self.n[now])[:-1]])
                shared = np.add.reduceat(hit, starts, dtype=np.int64)
                for j in now[_reaches(shared, self.n[i], self.n[now], self.t100)].tolist():
                    if label[of[j]] != label[of[i]]:
                        label[label == label[of[j]]] = label[of[i]]
                        a.append(int(self.key[i]))
                        b.append(int(self.key[j]))
        return a, b


def _by_block(work, schema: pa.Schema):
    """work(rows) for the rows of each (tile, t0, t1), by which they come ordered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool) -> pa.RecordBatch:
            """Whole blocks of the table; unless it is the last, its last block waits."""
            ids = np.stack([np.asarray(table[c]).astype(np.int64) for c in ("tile", "t0", "t1")], 1)
            first = np.flatnonzero(np.append(True, np.any(ids[1:] != ids[:-1], axis=1)))
            ends = np.append(first[1:], len(ids))
            found = [work(table.slice(a, b - a)) for a, b in list(zip(first.tolist(), ends.tolist(), strict=True))[: None if last else -1]]
            held[:] = [] if last else table.slice(int(first[-1])).combine_chunks().to_batches()
            return pa.concat_tables([schema.empty_table(), *(x.select(schema.names).cast(schema) for x in found)]).combine_chunks()

        for batch in batches:
            if batch.num_rows:
                yield from groups(pa.Table.from_batches([*held, batch]).combine_chunks(), False).to_batches()
        if held:
            yield from groups(pa.Table.from_batches(held).combine_chunks(), True).to_batches()
        give_back()

    return run


_MEMBER = pa.schema([("tile", pa.int64()), ("t0", pa.int32()), ("t1", pa.int32()), ("key", pa.int64()), ("comp", pa.int64()), ("n", pa.int32()), ("own", pa.bool_()), ("side", pa.int32()), ("same", pa.bool_()), ("codes", pa.list_(pa.int64()))])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _hopeful(t100: int):
    """The members of each block that have a candidate in it."""

    def select(rows: pa.Table) -> pa.Table:
        block, hit = Block(rows, t100, False), np.zeros(len(rows), bool)
        for i in range(len(rows)):
            j = block.candidates(i)
            hit[j] = True
            hit[i] |= len(j) > 0
        return rows.filter(pa.array(hit[np.argsort(block.order)]))

    return _by_block(select, _MEMBER)


def _spanning(t100: int):
    """The links of each block."""

    def link(rows: pa.Table) -> pa.Table:
        a, b = Block(rows, t100, True).links()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK)

    return _by_block(link, _LINK)


def _of_classes(docs: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """The text of one document of each wanted class (a row each), with its size and wanted's columns: (text, n, key, ...)."""
    ids = cut(wanted.join(classes.select("key", "n", F.col("any_id").alias("_id")), "key"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids.hint("merge")
    return docs.join(ids, "_id").select("text", "n", *wanted.columns)


def _roles(pairs: DataFrame) -> DataFrame:
    """key, pivot, part and own: a row for each text of pairs (a, b).  Each b has one pair, a being its pivot, and is in one part of the
    pivot's members; own is the number of parts that a pivot itself has, so that none holds more than about GROUP members."""
    pivots = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("own")))
    many = pivots.where("own > 1")  # at most one for each GROUP pairs
    many = F.broadcast(many) if many.count() <= BROADCAST_ROWS else many
    dealt = pairs.join(many, "a", "left").select(F.col("b").alias("key"), F.col("a").alias("pivot"), F.pmod(F.xxhash64("b"), F.coalesce("own", F.lit(1))).cast("int").alias("part"))
    return dealt.join(pivots.withColumnRenamed("a", "key"), "key", "full").select("key", "pivot", "part", "own")


def _met(rows: DataFrame, reaches) -> DataFrame:
    """The pairs (a, b) for which reaches holds; rows: those of _roles with n and data.  The data of a member move once, those of a
    pivot once for each of its parts."""
    role = lambda pivot, part, k: F.struct(pivot.alias("pivot"), part.cast("int").alias("part"), F.lit(k).alias("role"))
    none = F.array().cast("array<struct<pivot:long,part:int,role:int>>")
    member = F.when(F.col("pivot").isNotNull(), F.array(role(F.col("pivot"), F.col("part"), 1))).otherwise(none)
    leads = F.when(F.col("own").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("own") - 1), lambda i: role(F.col("key"), i, 0))).otherwise(none)
    rows = rows.select("key", "n", "data", F.explode(F.concat(member, leads)).alias("r")).select("r.pivot", "r.part", "r.role", "key", "n", "data")
    return rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role").mapInArrow(_with_pivot(reaches), "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, maps: DataFrame, classes: DataFrame, t100: int, shingle: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: first by bitmaps; of those that may, texts are read once more and arrays decide."""
    hopeful = cut(_met(_roles(pairs).join(maps, "key"), _may_reach(t100)))
    arrays = _of_classes(docs, _roles(hopeful), classes).mapInArrow(_fetched(shingle, np.ndarray.tobytes), "n int, key long, pivot long, part int, own int, data binary")
    return _met(arrays, _do_reach(t100))


def _by_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tile", "t0", "t1").sortWithinPartitions("tile", "t0", "t1")


def _hopeful_members(members: DataFrame, maps: DataFrame, t100: int) -> DataFrame:
    """The members of blocks that have a candidate in their block, by their bitmaps and (if they have any) their codes."""
    rows = members.join(maps, "key").select(*_MEMBER.names, "data")
    return cut(_by_blocks(rows).mapInArrow(_hopeful(t100), "tile long, t0 int, t1 int, key long, comp long, n int, own boolean, side int, same boolean, codes array<long>"))


def jaccard_components(docs: DataFrame, threshold: int = 75, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every text: links join texts whose shingle sets reach the threshold (in per cent).

    Words are [^\\x20\\x09-\\x0D]+ of the whole text with A-Z in lower case; a set holds the distinct shingles, or the whole
    sequence if it is shorter.  component_id is the least doc_id that links reach.  Null texts and texts without words have
    empty sets and are linked with nothing; repeated rows are linked with each other; null ids keep their row and never
    lead a component that has others.  Without rows the result is empty.  Sets are told apart by 64-bit hashes."""
    spark = docs.sparkSession
    t100 = threshold
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("_id"), F.col(text).alias("text"))
    texts = docs.select("text")
    each = cut(docs.mapInArrow(_documents(shingle), "doc_id long, n_shingles long, key long"))
    null_id = F.when(F.col("doc_id") != -(2**63), F.col("doc_id"))
    filled = each.where("n_shingles > 0")
    classes = cut(filled.groupBy("key").agg(F.min("doc_id").alias("any_id"), F.min(null_id).alias("low"), F.max("n_shingles").cast("int").alias("n")))
    total = filled.agg(F.sum("n_shingles")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(total * (100 - t100) / 100) // TASK_POSTINGS)
    counted = texts.mapInArrow(_counts(shingle, t100, tasks), "task int, hashes binary, counts binary").repartitionById(tasks, "task")
    often = counted.mapInArrow(_frequent(FREQUENT), "hash long, n long").orderBy(F.desc("n"), "hash").limit(MOST_FREQUENT).select("hash").toArrow()
    frequent = spark.sparkContext.broadcast(np.sort(np.asarray(often["hash"]).astype(np.int64).view(np.uint64)))
    posted = texts.mapInArrow(_postings(shingle, t100, tasks, frequent), "task int, hashes binary, keys binary, sizes binary, counts binary")
    members = cut(posted.repartitionById(2 * tasks, "task").mapInArrow(_tiles(t100, tasks), "tile long, key long, n int, own boolean").distinct())

    # a text that others were made from has no rare hashes of its own, so its prefix lies in the most tiles: a good pivot
    members = cut(members.join(members.groupBy("key").agg(F.count("*").alias("tiles")), "key"))
    maps = cut(_of_classes(docs, members.select("key").distinct(), classes).mapInArrow(_fetched(shingle, bitmap), "n int, key long, data binary").dropDuplicates(["key"]))
    best = lambda rows: rows.groupBy("tile").agg(F.max(F.struct("tiles", "key", "comp")).alias("p"))
    links, tested, labels = None, None, None
    for again in (False, True):  # each member against one pivot of its tiles
        labelled = members.withColumn("comp", F.col("key")) if labels is None else members.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        if again:  # among those that are still apart from their tile's first pivot
            labelled = labelled.join(best(labelled), "tile").where("comp <> p.comp").drop("p")
        met = labelled.join(best(labelled), "tile").where("comp <> p.comp").select(F.col("key").alias("b"), F.col("p.key").alias("a"), F.col("p.tiles").alias("weight"))
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        pairs = cut(met.groupBy("b").agg(F.max(F.struct("weight", "a")).alias("p")).select("p.a", "b"))
        found = cut(_verified(docs, pairs, maps, classes, t100, shingle))
        links = found if links is None else links.union(found)
        tested = pairs if tested is None else tested.union(pairs)
        labels = components(links).select(F.col("id").alias("key"), F.col("component").alias("comp"))
    labelled = cut(members.join(labels, "key", "left").withColumn("comp", F.coalesce("comp", "key")))
    mixed = labelled.groupBy("tile").agg(F.count("*").alias("_count"), F.sum("n").alias("_size"), F.max("own").alias("_own"), F.min("comp").alias("_low"), F.max("comp").alias("_high")).where("_own and _low < _high")
    mixed = mixed.select("tile", F.ceil(F.greatest(F.col("_count") / BLOCK, F.col("_size") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    rows = cut(labelled.join(mixed, "tile"))
    maps = maps.drop("n")
    wide = rows.withColumn("_block", F.pmod(F.xxhash64("key"), F.col("_blocks")).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    member = ["tile", F.least("_block", "_other").alias("t0"), F.greatest("_block", "_other").alias("t1"), "key", "comp", "n", "own", (F.col("_block") > F.col("_other")).cast("int").alias("side"), (F.col("_block") == F.col("_other")).alias("same")]
    coarse = maps.select("key", "data").mapInArrow(_coarse, "key long, data binary")
    hopeful = _hopeful_members(wide.select(*member, F.array().cast("array<long>").alias("codes")), coarse, t100)
    # those that an earlier tile compares as well are left out: a hopeful member's tiles are as many as its own prefix has
    code = F.shiftleft("tile", 1).bitwiseOR(F.col("own").cast("long"))
    tiles = rows.join(hopeful.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.sort_array(F.collect_list(code)).alias("codes"))
    hopeful = _hopeful_members(hopeful.drop("codes").join(tiles, "key"), maps, t100)
    arrays = _of_classes(docs, hopeful.select("key").distinct(), classes).mapInArrow(_fetched(shingle, np.ndarray.tobytes), "n int, key long, data binary").drop("n").dropDuplicates(["key"])
    links = links.union(_by_blocks(hopeful.join(arrays, "key")).mapInArrow(_spanning(t100), "a long, b long"))
    joined = components(links)
    lows = joined.join(classes, joined["id"] == classes["key"]).groupBy("component").agg(F.min("low").alias("component_id"))
    of_class = classes.join(joined.withColumnRenamed("id", "key"), "key", "left").join(lows, "component", "left").select("key", F.coalesce("component_id", "low").alias("component_id"))
    out = each.join(of_class, (each["key"] == of_class["key"]) & (each["n_shingles"] > 0), "left")
    return out.select(null_id.alias("doc_id"), "n_shingles", F.coalesce("component_id", null_id).alias("component_id"))
