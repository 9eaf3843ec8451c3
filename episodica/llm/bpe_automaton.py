"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton reads token sequences and accepts exactly those that the merges give.  It starts with one state that has a
loop for every byte.  Each merge (u, v) -> w, in order, adds a gadget: arcs labelled u now lead to a copy of their state
without the arc v, and wherever u and then v could be read there is an arc w, which leads where v led.  All arcs of one
label lead to one state, and many labels leave the same states, so the automaton is a table of bits: a row for each state,
a column for each class of labels.

A word is encoded from left to right.  The bytes read so far have one accepted tokenization, so each position of the word
is reached by one arc only: the longest known prefix is extended by every token of the vocabulary that continues it, and the
table says which of these arcs exists.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from episodica.llm.common import bound_batches
from episodica.llm.encoding import BYTE_SIGNS, MOST_PIECES, Encoder
from episodica.llm.textbytes import spread

_PLAIN = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


class Automaton:
    """The automaton of some merges (pairs of byte strings, in order) over the 256 bytes.

    allowed: bits by state and class of labels; state: by label, the state its arcs lead to; label_class: by label, its
    column; labels: the bytes of each label, the single bytes first, then the results of the merges.  State 0 is the start."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.labels = [bytes([b]) for b in range(256)]
        place = {x: n for n, x in enumerate(self.labels)}
        pairs = []
        for left, right in merges:
            whole = left + right
            if left not in place or right not in place or whole in place:
                raise ValueError(f"merge {left!r} {right!r} doesn't follow from the merges before it, or repeats one's result")
            pairs.append((place[left], place[right]))
            place[whole] = len(self.labels)
            self.labels.append(whole)
        n = len(self.labels)
        self.state, self.label_class = np.zeros(n, np.int32), np.zeros(n, np.int32)
        rows, columns = self._sizes(pairs)
        self.allowed = np.zeros((rows, columns + 7 >> 3), np.uint8)
        self._compile(pairs)

    @staticmethod
    def _sizes(pairs: list[tuple[int, int]]) -> tuple[int, int]:
        """Upper bounds of the numbers of states and of label classes."""
        return 1 + len(pairs), 2 + len(pairs)

    def _compile(self, pairs: list[tuple[int, int]]) -> None:
        bits, state, label_class = self.allowed, self.state, self.label_class
        in_state, in_class = np.zeros(bits.shape[0], np.int64), np.zeros(bits.shape[1] * 8, np.int64)
        in_state[0] = in_class[0] = 256
        bits[0, 0] = 1
        states, classes, none = 1, 1, None
        for w, (u, v) in enumerate(pairs, 256):
            p = int(state[u])
            c = int(label_class[v])
            if not bits[p, c >> 3] >> (c & 7) & 1:  # u and v never stand side by side: w has no arc
                if none is None:
                    none, classes = classes, classes + 1
                label_class[w], state[w] = none, 0
                in_class[none] += 1
                in_state[0] += 1
                continue
            state[w] = state[v]
            in_state[state[w]] += 1
            if in_state[p] > 1:  # a copy of u's state, for u alone
                in_state[p] -= 1
                bits[states] = bits[p]
                state[u], p, states = states, states, states + 1
                in_state[p] = 1
            if in_class[c] > 1:  # a copy of v's class, for v alone
                in_class[c] -= 1
                bits[:states, classes >> 3] |= (bits[:states, c >> 3] >> (c & 7) & 1) << (classes & 7)
                label_class[v], c, classes = classes, classes, classes + 1
                in_class[c] = 1
            bits[p, c >> 3] &= ~np.uint8(1 << (c & 7))
            label_class[w] = label_class[u]
            in_class[label_class[w]] += 1
        self.allowed = np.ascontiguousarray(bits[:states, : (classes + 7) >> 3])

    def next_state(self, state: int, label: int) -> int | None:
        """Where the arc leads, None if there is none."""
        c = int(self.label_class[label])
        return int(self.state[label]) if self.allowed[state, c >> 3] >> (c & 7) & 1 else None


class Transducer:
    """An automaton with the trie of its labels: encodes words, many at once."""

    def __init__(self, automaton: Automaton):
        self.allowed, self.state, self.classes = automaton.allowed, automaton.state, automaton.label_class
        self.length = np.array([len(x) for x in automaton.labels], np.int64)
        self.trie, at = {}, [-1]
        for label, text in enumerate(automaton.labels):
            node = 0
            for b in text:
                key = node << 8 | b
                if key not in self.trie:
                    self.trie[key] = len(at)
                    at.append(-1)
                node = self.trie[key]
            at[node] = label
        self.at = np.array(at, np.int32)
        # the trie's arcs once more, as a hash table that arrays can be looked up in
        self.shift = 64 - max(4, (4 * len(self.trie)).bit_length())
        self.keys, self.nodes = np.full(1 << 64 - self.shift, -1, np.int64), np.zeros(1 << 64 - self.shift, np.int32)
        left, values = np.fromiter(self.trie.keys(), np.int64, len(self.trie)), np.fromiter(self.trie.values(), np.int32, len(self.trie))
        slots, self.probes = self._slots(left), 0
        while len(left):
            free = self.keys[slots] < 0
            self.keys[slots[free]], self.nodes[slots[free]] = left[free], values[free]  # of several in one slot the last stays
            out = self.keys[slots] != left
            left, values, slots = left[out], values[out], slots[out] + 1 & len(self.keys) - 1
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _children(self, nodes: np.ndarray, signs: np.ndarray) -> np.ndarray:
        """Where the trie's arcs lead, -1 where there is none."""
        keys = nodes.astype(np.int64) << 8 | signs
        slots = self._slots(keys)
        out = np.where(self.keys[slots] == keys, self.nodes[slots], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[slots] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slots[open_] = slots[open_] + 1 & len(self.keys) - 1
            met = self.keys[slots[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self.nodes[slots[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return out

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The labels of the paths that spell the words, one after the other, and each word's number of labels."""
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        buf = np.frombuffer(b"".join(words), np.uint8)
        starts = np.concatenate([[0], ends[:-1]]) if len(words) else ends
        until = np.repeat(ends, ends - starts)
        # all arcs that the vocabulary has: (from, to, label)
        position, nodes, arcs = np.arange(len(buf)), np.zeros(len(buf), np.int32), []
        size = 0
        while len(position):
            nodes = self._children(nodes, buf[position + size])
            size += 1
            on = nodes >= 0
            position, nodes = position[on], nodes[on]
            labels = self.at[nodes]
            some = labels >= 0
            arcs.append((position[some], np.full(int(some.sum()), size), labels[some]))
            on = position + size < until[position]
            position, nodes = position[on], nodes[on]
        arrived, states = np.full(len(buf) + 1, -1, np.int32), np.zeros(len(buf) + 1, np.int32)
        # arrived[i]: label of the arc into the place before byte i; a word's first place counts as the start
        if arcs:
            self._follow(*(np.concatenate(x) for x in zip(*arcs, strict=True)), starts, ends, arrived, states)
        return self._back(starts, ends, arrived)

    def _follow(self, source, size, label, starts, ends, arrived, states) -> None:
        """Takes the arcs that exist, in the order of their distance from their words' starts."""
        first = np.repeat(starts, ends - starts)[source]
        step = source - first
        order = np.argsort(step, kind="stable")
        source, target, label, step = source[order], (source + size)[order], label[order], step[order]
        classes = self.classes[label]
        bounds = np.searchsorted(step, np.arange(int(step[-1]) + 2))
        at_start = step == 0
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if a == b:
                continue
            state = np.where(at_start[a:b], 0, states[source[a:b]])
            c = classes[a:b]
            there = (self.allowed[state, c >> 3] >> (c & 7).astype(np.uint8) & 1).astype(bool)
            to, by = target[a:b][there], label[a:b][there]
            arrived[to], states[to] = by, self.state[by]

    def _back(self, starts, ends, arrived) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of all paths, from the ends of the words."""
        word, place = np.flatnonzero(ends > starts), ends[ends > starts]
        found_words, found = [], []
        while len(word):
            label = arrived[place]
            found_words.append(word)
            found.append(label)
            place = place - self.length[label]
            on = place > starts[word]
            word, place = word[on], place[on]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
        words, labels = np.concatenate(found_words)[::-1], np.concatenate(found)[::-1]
        return labels[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(starts))


def _merges(model: dict) -> list[tuple[bytes, bytes]]:
    """The merges of a byte-level tokenizer file as bytes."""
    byte = {sign: b for b, sign in BYTE_SIGNS.items()}
    raw = lambda s: bytes(byte[c] for c in s)
    return [(raw(a), raw(b)) for a, b in (x.split(" ") if isinstance(x, str) else x for x in model["merges"])]


class WordEncoder(Encoder):
    """ids(texts) as Encoder gives them, with every word's ids from the automaton."""

    def __init__(self, path: str):
        super().__init__(path, -1)
        spec = json.loads(self.tok.to_str())
        model = spec["model"]
        odd = {k: model.get(k) for k, v in _PLAIN.items() if model.get(k, v) != v}
        if self.kind != "led" or odd or (spec.get("decoder") or {}).get("type") != "ByteLevel" or spec.get("post_processor"):
            raise ValueError(f"{path}: only plain byte-level BPE is compiled, found {self.kind} {odd}")
        added = spec.get("added_tokens", [])
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added):
            raise ValueError(f"{path}: added tokens that take white space or whole words only")
        automaton = Automaton(_merges(model))
        self.transducer = Transducer(automaton)
        self.token = np.array([model["vocab"]["".join(BYTE_SIGNS[b] for b in x)] for x in automaton.labels], np.int64)
        self.known_words: dict[bytes, list[int]] = {}
        self.specials = {x["content"]: x["id"] for x in added}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.words = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.byte = {ord(sign): chr(b) for b, sign in BYTE_SIGNS.items()}

    def _encode_spans(self, data: bytes, starts: list[int], ends: list[int], odds: list[bool]) -> tuple[list[int], list[int]]:
        words, spans = [], []
        for k, (a, b, odd) in enumerate(zip(starts, ends, odds, strict=True)):
            if odd:
                split = self._words(data[a:b].decode("utf-8", "replace"))
                words += split
                spans += [k] * len(split)
            else:
                words.append(data[a:b])
                spans.append(k)
        labels, lengths = self.transducer.encode(words)
        return self.token[labels].tolist(), np.bincount(np.array(spans, np.int64), lengths, len(starts)).astype(np.int64).tolist()

    def _words(self, text: str) -> list[bytes]:
        """The words into which the library splits a text, as bytes."""
        return [w.translate(self.byte).encode("latin-1") for w, _ in self.words.pre_tokenize_str(text)]

    def _whole(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts.split(text) if self.parts else [text]:
            if part in self.specials:
                out.append(self.specials[part])
            else:
                words = self._words(part)
                self._learn(words)
                for word in words:
                    out += self.known_words[word]
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Puts the ids of all words into known_words."""
        if len(self.known_words) > MOST_PIECES:
            self.known_words.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known_words]
        labels, lengths = self.transducer.encode(fresh)
        ids, ends = self.token[labels].tolist(), np.cumsum(lengths).tolist()
        for word, start, end in zip(fresh, [0, *ends], ends, strict=False):
            self.known_words[word] = ids[start:end]


class Labels:
    """The bytes of every token id of a tokenizer file, in one pool."""

    def __init__(self, path: str):
        spec = json.loads(Tokenizer.from_file(path).to_str())
        byte = {sign: b for b, sign in BYTE_SIGNS.items()}
        known = spec["model"]["vocab"] | {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        texts = [b""] * (max(known.values(), default=-1) + 1)
        for s, n in known.items():
            texts[n] = bytes(byte[c] for c in s) if all(c in byte for c in s) else s.encode()
        self.pool = np.frombuffer(b"".join(texts), np.uint8)
        self.length = np.array([len(x) for x in texts], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def emit(self, ids: np.ndarray) -> np.ndarray:
        return self.pool[spread(self.start[ids], self.length[ids])]


_encoders: dict[str, WordEncoder] = {}
_labels: dict[str, Labels] = {}


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encoder = _encoders[path]
        for batch in batches:
            out: list[bytes] = []
            for _, ids, offs in encoder.ids(batch.column(1)):
                raw, ends = ids.astype("<u4").tobytes(), (offs * 4).tolist()
                out += [raw[a : b - 4] for a, b in zip(ends[:-1], ends[1:], strict=True)]  # without the mark of a text's end
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["key", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _labels:
            _labels[path] = Labels(path)
        labels = _labels[path]
        for batch in batches:
            texts = [None if x is None else labels.emit(np.frombuffer(x, "<u4")).tobytes().decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["key", "ids", "text"])

    return run


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (binary: little-endian unsigned 32-bit token ids) of every row of docs, by the automaton of the file's merges.

    path: a byte-level BPE file of the tokenizers library, which every worker can read; other kinds of files raise.  The ids are
    the library's, without the special tokens that it would add around a text; an added token's string inside a text is
    that token.  Truncation and padding are not used.  Null and empty texts have no ids.  Null and repeated keys, and other
    columns of any name, are no matter: each row gives one row.  Nothing is shuffled; a worker compiles the automaton
    once (its size depends on the vocabulary alone)."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_encode(path), f"key {dict(rows.dtypes)['key']}, ids binary").withColumnRenamed("key", key)


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids and text of rows (as encode gives them): the labels of all ids in order, special ones included.

    Bytes that are no UTF-8 become replacement characters, as the library has it; null ids give null."""
    rows = rows.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(_decode(path), f"key {dict(rows.dtypes)['key']}, ids binary, text string").withColumnsRenamed({"key": key, "ids": ids})


def token_count(ids: str = "ids") -> Column:
    """How many ids a binary column of encode holds."""
    return (F.octet_length(ids) / 4).cast("long")
