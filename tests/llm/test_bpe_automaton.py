"""The tokenization automaton against its definition and against the untouched library."""

import hashlib
import itertools
import random
import struct

import pytest
from tokenizers import Tokenizer

from episodica.llm import bpe_automaton, queries

PATH = queries.tokenizer_path("byte_bpe_50k.json")


def by_hand(word, merges):
    """Every merge in order, from left to right."""
    parts = [bytes([b]) for b in word]
    for left, right in merges:
        out = []
        for part in parts:
            if out and out[-1] == left and part == right:
                out[-1] = left + right
            else:
                out.append(part)
        parts = out
    return parts


def spell(*merges):
    return [tuple(x.encode() for x in m.split()) for m in merges]


@pytest.mark.parametrize("merges", [spell("a a", "aa a", "aa aa"), spell("a b", "b a", "ab a", "ba b", "aba b", "b bab"), spell("b c", "a b", "ab c", "bc b"), spell("a a", "a b", "aa b", "b b", "aab bb", "bb a"), []])
def test_automaton_accepts_exactly_the_tokenizations(merges):
    automaton = bpe_automaton.Automaton(merges)
    transducer = bpe_automaton.Transducer(automaton)
    words = [bytes(x) for n in range(1, 8) for x in itertools.product(b"abc", repeat=n)]
    labels, lengths = transducer.encode(words)
    at = 0
    for word, n in zip(words, lengths.tolist(), strict=True):
        want = by_hand(word, merges)
        assert [automaton.labels[x] for x in labels[at : at + n]] == want
        at += n
    # no other token sequence is accepted
    merged = [n for n, x in enumerate(automaton.labels) if n >= 256 or x in (b"a", b"b", b"c")]
    for path in itertools.product(merged, repeat=3):
        state = 0
        for label in path:
            state = None if state is None else automaton.next_state(state, label)
        parts = [automaton.labels[x] for x in path]
        assert (state is not None) == (by_hand(b"".join(parts), merges) == parts)


def test_merges_out_of_order_raise():
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(spell("ab c", "a b"))
    with pytest.raises(ValueError):
        bpe_automaton.Automaton(spell("a b", "ab c", "b c", "a bc"))
    with pytest.raises(ValueError):
        bpe_automaton.WordEncoder(queries.tokenizer_path("word_bpe_49k.json"))


def odd_texts():
    rng = random.Random(1)
    signs = ["a", "b", "e", "t", "h", " ", "  ", "'", "'s", "'re", "0", "é", "ß", "٠", "中", "\n", "\t", "　", "\x1c", "\x00", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "‍", "_", "-", ".", "\xa0", "\x85"]
    out = ["", None, " ", "<|endoftext|>", "a<|endoftext|>b", "it's we'll I'M ’s", "x" * 3000, "aaaa" * 500, " " * 200, "日本語テキスト", "1234567 89", "Ġt", "word " * 3000]
    out += ["".join(rng.choice(signs) if rng.random() < 0.8 else chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x1FFFF)])) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return out


def test_op11(spark, tmp_path):
    texts = odd_texts()
    rows = [(None if n % 50 == 7 else n // 2, t, "x", n) for n, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string, key long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_bpe(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(PATH)
    want = []
    for key, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_op11_documents(spark):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"]) for r in queries.op11_bpe(spark, "/root/testdata/sf0.001").collect()}
    tok = Tokenizer.from_file(PATH)
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").collect()
    want = {}
    for r in docs:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert got == want


def test_empty_table_and_bad_bytes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    encoded = bpe_automaton.encode(empty, PATH)
    assert bpe_automaton.decode(encoded, PATH).columns == ["doc_id", "ids", "text"]
    assert bpe_automaton.decode(encoded, PATH).count() == 0
    tok = Tokenizer.from_file(PATH)
    ids = tok.encode("é🙂", add_special_tokens=False).ids[:-1]
    rows = spark.createDataFrame([(1, bytearray(struct.pack(f"<{len(ids)}I", *ids))), (2, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["text"] for r in bpe_automaton.decode(rows, PATH).collect()}
    assert got == {1: tok.decode(ids, skip_special_tokens=False), 2: None}
