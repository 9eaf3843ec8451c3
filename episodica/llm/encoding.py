"""Token ids of whole texts by the ``tokenizers`` library, at corpus speed.

Texts are first cut where the tokenizer itself always cuts (white space and
changes between letters, digits and other signs).  Each distinct piece is
encoded once per worker by the library's model and remembered, so the ids are
those of encoding the whole text while most of the work is array lookups.
Pieces with apostrophes or unusual characters are kept whole and given to the
library as they are; texts with white space outside ASCII or with the string
of an added token, and tokenizers of other kinds, go to the library whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from episodica.llm.textbytes import END, LOWER, Run, runs, span_hashes, spread

SPACE, LETTER, DIGIT, OTHER, ODD, STOP = range(6)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = SPACE
_CLASS[48:58] = DIGIT
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[39] = ODD
_CLASS[0x80:] = ODD
_CLASS[END] = STOP
#: White space outside ASCII, as UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SLOTS = 20
#: Distinct pieces remembered by a worker before it starts afresh.
MOST_PIECES = 400_000


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: The printable sign of each byte.
BYTE_SIGNS = _SIGNS = _byte_signs()


class Encoder:
    """ids(texts) for one tokenizer file, with its cache of pieces."""

    def __init__(self, path: str, end_id: int):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.end_id = end_id
        spec = json.loads(self.tok.to_str())
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [x.get("type") for x in pre.get("pretokenizers", [])]
        norms = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        self.kind = "whole"
        if spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.kind = "led"  # a space belongs to the piece after it
        elif spec["model"]["type"] == "BPE" and steps == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"] and pre["pretokenizers"][0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            self.kind = "bare"  # white space is dropped, case is folded, digits stand alone
        self.model = self.tok.model
        #: Strings that stand for one id wherever they occur, in small letters; texts that hold one go to the library whole.
        self.added = [x["content"].lower().encode() for x in spec.get("added_tokens", [])]
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _SLOTS, np.uint64)
        self.vals = np.zeros(1 << _SLOTS, np.int32)
        self.known = np.zeros(0, np.uint64)  # hashes of all pieces, ascending, and which piece each is of
        self.piece = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 16, np.int64)  # piece k has ids pool[at[k]:at[k+1]]
        self.n = 0

    def _extend(self, flat: list[int], lengths: list[int]) -> None:
        """Adds pieces, given all their ids and each one's number of ids."""
        end, n = int(self.at[self.n]) + len(flat), self.n + len(lengths)
        while end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + 1 > len(self.at) - 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.pool[end - len(flat) : end] = flat
        np.cumsum(lengths, out=self.at[self.n + 1 : n + 1])
        self.at[self.n + 1 : n + 1] += self.at[self.n]
        self.n = n

    def _encode_piece(self, raw: bytes, odd: bool) -> list[int]:
        if odd:
            return self.tok.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids
        if raw.isascii():
            text = raw.decode("ascii")
            text = text.replace(" ", _SIGNS[0x20]) if text.isprintable() else text.translate(_SIGNS)
        else:
            if self.kind == "bare":
                raw = raw.decode("utf-8").lower().encode("utf-8")
            text = raw.decode("latin-1").translate(_SIGNS)
        return [x.id for x in self.model.tokenize(text)]

    def _encode_spans(self, data: bytes, starts: list[int], ends: list[int], odds: list[bool]) -> tuple[list[int], list[int]]:
        """All ids of some pieces, and each one's number of ids."""
        found = [self._encode_piece(data[a:b], odd) for a, b, odd in zip(starts, ends, odds, strict=True)]
        return [x for ids in found for x in ids], [len(ids) for ids in found]

    def _lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: np.ndarray | None) -> np.ndarray:
        """The index of each span's ids."""
        hashes = span_hashes(buf, starts, ends)
        if odd is not None:
            hashes ^= odd.astype(np.uint64)
        slots = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        found = self.vals[slots]
        missed = np.flatnonzero(self.keys[slots] != hashes)
        if len(missed):
            values, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            if self.n + len(values) > MOST_PIECES and self.n:
                self._clear()
                return self._lookup(buf, starts, ends, odd)
            self._fill(buf, starts, ends, odd, hashes, found, missed, values, first, back)
        return found

    def _fill(self, buf, starts, ends, odd, hashes, found, missed, values, first, back) -> None:
        """Sets found for the missed spans, encoding those never met before."""
        at = np.searchsorted(self.known, values)
        met = np.zeros(len(values), bool)
        if len(self.known):
            met = self.known[np.minimum(at, len(self.known) - 1)] == values
        new = np.empty(len(values), np.int32)
        new[met] = self.piece[at[met]]
        fresh = np.flatnonzero(~met)
        if len(fresh):
            spans = missed[first[fresh]]
            flat, lengths = self._encode_spans(buf.tobytes(), starts[spans].tolist(), ends[spans].tolist(), odd[spans].tolist() if odd is not None else [False] * len(spans))
            new[fresh] = np.arange(self.n, self.n + len(fresh))
            self.known = np.insert(self.known, at[fresh], values[fresh])
            self.piece = np.insert(self.piece, at[fresh], new[fresh])
            self._extend(flat, lengths)
        slots = (values >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.keys[slots], self.vals[slots] = values, new
        found[missed] = new[back]

    def run(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        """ids of the run's texts, each with the end id, and the texts' offsets into them."""
        wide = np.zeros(run.n, bool)
        if self.kind == "whole":
            wide[:] = True
        elif self.added:
            data = LOWER[run.buf].tobytes()
            for token in self.added:
                at = data.find(token)
                while at >= 0:
                    wide[np.searchsorted(run.offs, at, "right") - 1] = True
                    at = data.find(token, at + len(token))
        if self.kind != "whole" and _WIDE_LEAD[run.buf].any():
            for m in _WIDE_SPACE.finditer(run.buf.tobytes()):
                wide[np.searchsorted(run.offs, m.start(), "right") - 1] = True
        if wide.any():
            return self._with_whole(run, wide)
        return self._pieces(run.buf, run.n)

    def _with_whole(self, run: Run, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for i in range(run.n):
            buf = run.buf[run.offs[i] : run.offs[i + 1]]
            if wide[i]:
                ids = self._whole(buf[:-1].tobytes().decode("utf-8", "replace"))
                parts.append(np.array([*ids, self.end_id], np.int32))
            else:
                parts.append(self._pieces(buf, 1)[0])
        offs = np.zeros(run.n + 1, np.int64)
        np.cumsum([len(x) for x in parts], out=offs[1:])
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), offs

    def _whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _pieces(self, buf: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "bare":
            buf = LOWER[buf]
        kind = _CLASS[buf]
        lead = (buf >= 0xC3) & (buf <= 0xC9)  # two-byte letters, but for three signs
        if lead.any():
            at = np.flatnonzero(lead[:-1])
            pair = buf[at].astype(np.int32) << 8 | buf[at + 1]
            at = at[(pair != 0xC397) & (pair != 0xC3B7) & (pair != 0xC4B0)]
            kind[at] = kind[at + 1] = LETTER
        before = np.empty_like(kind)
        before[:1] = STOP
        before[1:] = kind[:-1]
        solid, solid_before = (kind >= LETTER) & (kind <= ODD), (before >= LETTER) & (before <= ODD)
        change = solid & solid_before & (kind != before)
        odd_bytes = np.flatnonzero(kind == ODD)
        piece_starts = None
        if len(odd_bytes):  # no cut inside a piece with an odd byte
            piece_starts = np.flatnonzero(solid & ~solid_before)
            is_odd = np.zeros(len(piece_starts), bool)
            is_odd[np.searchsorted(piece_starts, odd_bytes, "right") - 1] = True
            cuts = np.flatnonzero(change)
            change[cuts[is_odd[np.searchsorted(piece_starts, cuts, "right") - 1]]] = False
        stop = kind == STOP
        if self.kind == "led":
            space, space_before = kind == SPACE, before == SPACE
            follows = np.zeros_like(space)
            follows[:-1] = solid[1:]
            blank_before = np.empty_like(space)
            blank_before[:1] = False
            blank_before[1:] = buf[:-1] == 0x20
            start = stop | change | (space & ~space_before) | (space & space_before & follows) | (solid & ~solid_before & ~blank_before)
            starts = np.flatnonzero(start)
            ends = np.append(starts[1:], len(buf))
        else:
            digits = change | (kind == DIGIT)
            if piece_starts is not None:
                at = np.flatnonzero(kind == DIGIT)
                digits[at[is_odd[np.searchsorted(piece_starts, at, "right") - 1]]] = False
                digits |= change
            start = stop | digits | (solid & ~solid_before)
            starts = np.flatnonzero(start)
            last = np.flatnonzero((start[1:] | ~solid[1:]) & (solid[:-1] | stop[:-1])) + 1  # where a piece ends
            ends = np.append(last, len(buf))
        odd = None
        if piece_starts is not None:
            at = starts.copy()
            if self.kind == "led":  # a leading space stands before its piece
                at += (buf[starts] == 0x20) & (np.append(starts[1:], len(buf)) > starts + 1) & (kind[starts] == SPACE)
            where = np.searchsorted(piece_starts, at, "right") - 1
            inside = (where >= 0) & (kind[np.minimum(at, len(kind) - 1)] >= LETTER) & (kind[np.minimum(at, len(kind) - 1)] <= ODD)
            odd = np.zeros(len(starts), bool)
            odd[inside] = is_odd[where[inside]]
        stops = stop[starts]
        real = np.flatnonzero(~stops)
        index = self._lookup(buf, starts[real], ends[real], None if odd is None else odd[real])
        counts = np.ones(len(starts), np.int64)
        counts[real] = self.at[index + 1] - self.at[index]
        out_ends = np.cumsum(counts)
        ids = np.full(int(out_ends[-1]), self.end_id, np.int32)
        ids[spread(out_ends[real] - counts[real], counts[real])] = self.pool[spread(self.at[index], counts[real])]
        offs = np.zeros(n_texts + 1, np.int64)
        offs[1:] = out_ends[stops]
        return ids, offs

    def ids(self, texts: pa.Array):
        """(first text, ids, offsets) of each run of the batch."""
        for run in runs(texts):
            ids, offs = self.run(run)
            yield run.first, ids, offs


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """The worker's encoder for this file, kept from task to task with its cache."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
