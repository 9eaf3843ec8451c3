"""The numbered operators and the pipeline: brute force on small tables, round trips, odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from episodica.llm import common, embed_dedup, html_extract, mixing, ngram_join, packing, quality_classifier, quality_rules, queries, sharding, token_counts, token_file  # noqa: E402
from episodica.llm.encoding import Encoder  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, target double, copies long"
BASE = "The quick brown fox jumps over the lazy dog while seven wise owls read old books near a calm river"


def rows():
    """Nulls in any column, empty and long texts, ties, copies, near copies, clashing extra columns."""
    texts = [BASE, BASE, BASE.upper(), BASE + " today", "a b c", "A B  c", "", None, "  \n\t", "word " * 3000, BASE.replace("fox", "cat"), "x", "émigré ＷＩＤＥ space “quoted” don't 12ab", BASE + "\n" + BASE]
    return [(i if i != 5 else None, t, None if i % 3 else "en", [None, "s1", "s2", "", "s1"][i % 5], None, 7, 3, 1.0, 2) for i, t in enumerate(texts)] + [(1, BASE, "en", "s1", 3, 7, 3, 1.0, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return common.cut(spark.createDataFrame(rows(), SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(items):
    """[(id, set)] -> least id reachable by Jaccard links, in order."""
    root = list(range(len(items)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(items)), 2):
        a, b = items[i][1], items[j][1]
        if a and b and 100 * len(a & b) >= 75 * len(a | b):
            root[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(items):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return [low.get(find(i), key) for i, (key, _) in enumerate(items)]


def test_join_odd_rows(docs, empty):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()), key=str)
    items = [(r[0], shingles(r[1])) for r in rows()]
    want = sorted(((k, len(s), c) for (k, s), c in zip(items, brute_components(items), strict=True)), key=str)
    assert got == want
    assert ngram_join.jaccard_components(empty).count() == 0


def test_join_random_near_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    data, shared = [], " ".join(rng.choice(words, 60))
    for g in range(12):
        base = list(rng.choice(words, rng.integers(8, 120)))
        for _ in range(rng.integers(1, 12)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(len(copy))] = str(rng.choice(words))
            data.append(" ".join(copy) + (" " + shared if g % 3 == 0 else ""))
    items = [(i, shingles(t)) for i, t in enumerate(data)]
    want = dict(zip(range(len(data)), brute_components(items), strict=True))
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    frequent, ngram_join.FREQUENT = ngram_join.FREQUENT, 4
    block, ngram_join.BLOCK = ngram_join.BLOCK, 8
    try:
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()} == want
    finally:
        ngram_join.FREQUENT, ngram_join.BLOCK = frequent, block


def test_join_one_large_group(spark):
    """2000 near copies, many of them too far from any pivot, among unlike texts that share a passage."""
    rng = np.random.default_rng(6)
    words = np.array([f"w{i}" for i in range(3000)])
    base, shared = rng.choice(words, 60), list(rng.choice(words, 12))
    data = []
    for i in range(2000):
        copy = base.copy()
        at = rng.choice(60, rng.integers(0, 5), replace=False)
        copy[at] = rng.choice(words, len(at))
        data.append(list(copy))
    data += [list(rng.choice(words, 45)) + shared for _ in range(300)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in data]
    place = {x: k for k, x in enumerate(sorted(set().union(*sets)))}
    m = np.zeros((len(data), len(place)), np.float32)
    for i, s in enumerate(sets):
        m[i, [place[x] for x in s]] = 1
    shared_n, n = m @ m.T, m.sum(1)
    near = 100 * shared_n >= 75 * (n[:, None] + n[None] - shared_n)
    label = np.arange(len(data))
    while True:
        low = np.where(near, label[None], len(data)).min(1)
        if (low == label).all():
            break
        label = low
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(data)], "doc_id long, text string")
    block, ngram_join.BLOCK = ngram_join.BLOCK, 256
    try:
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(df).collect()}
    finally:
        ngram_join.BLOCK = block
    assert [got[i] for i in range(len(data))] == label.tolist()
    assert 50 < len(set(label[:2000].tolist())) < 2000


def test_mixing(docs, empty):
    data = docs.withColumn("size", mixing.word_count(F.col("text")))
    assert {(r["text"], r["size"]) for r in data.collect()} == {(r[1], len(WORD.findall(r[1] or ""))) for r in rows()}
    got = mixing.mix(data, "size").collect()
    total = sum(r["size"] for r in got)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(total)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert mine[0]["target"] <= 3 * mine[0]["source_size"] and all(r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(data, "size").collect()))
    assert mixing.mix(empty.withColumn("size", F.lit(0).cast("long")), "size").count() == 0
    assert mixing.repeat_rows(mixing.mix(data, "size")).count() == sum(r["copies"] for r in got)


def test_mixing_clashing_names(spark, docs):
    odd = ["last", "whole", "_source", "_LAST", "_copy", "source", "_target", "_size", "_key", "_hash"]
    df = docs.select("doc_id", "text", *[F.col("source").alias(c) for c in odd], F.lit(5).alias("taken"), F.lit(9).alias("target")).withColumn("size", mixing.word_count(F.col("text")))
    plain = mixing.mix(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size")), "size")
    got = mixing.mix(df, "size")
    assert set(odd) <= set(got.columns)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["target"], r["taken"])
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))
    assert all(r["_source"] == r["source"] and r["last"] == r["source"] for r in got.collect())
    assert set(odd) <= set(mixing.repeat_rows(got).columns)


def test_fill_clamps(spark):
    sizes = spark.createDataFrame([("a", 1.0, 10), ("b", 8.0, 10), ("c", 1.0, 100)], "source string, weight double, source_size long")
    got = {r["source"]: r["target"] for r in mixing.fill(sizes, 3).collect()}
    assert got == {"a": 30.0, "b": 30.0, "c": 60.0}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    rng = np.random.default_rng(1)
    signs = list("abZ éÉß×'9 \t\n\r.,!?$  ") + ["'s", "'ll", " 's", " ", " ", "“", "日本", "\x1c", "<|endoftext|>", "é", "１", "_", "İ"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 30))) for _ in range(1500)] + [None, "", "a" * 5000]
    every = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + ["한", "😀", "Ａ", "ﬁ", "\U0001d7d9"]
    texts += ["".join(rng.choice(every, rng.integers(0, 12))) + " a1 'll " + "".join(rng.choice(every, 2)) for _ in range(3000)]
    texts += ["hello <|endoftext|> world", " <|endoftext|>", "<|startoftext|>a<|endoftext|>b"]
    enc = Encoder(public_tokenizers.path(name), 0)
    for first, ids, offs in enc.ids(pa.array(texts)):
        for i in range(len(offs) - 1):
            assert ids[offs[i] : offs[i + 1]].tolist() == [*tok.encode(texts[first + i] or "", add_special_tokens=False).ids, 0]


def test_token_file(spark, docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    crc = lambda t: zlib.crc32(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())
    got = sorted(token_file.token_documents(docs, path).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda k: -1 if k is None else k)
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    assert sorted(((r["doc_id"], r["ids_crc32"]) for r in got), key=str) == sorted(((r[0], crc(r[1])) for r in rows()), key=str)
    assert token_file.token_documents(empty, path).count() == 0


def test_token_codes():
    ids = np.random.default_rng(2).choice([3, 4095, 4096, 65535, 65536, 2**24, 2**32 - 1], 3001).astype(np.uint32)
    chunks, bitmaps, ranks = token_file.encode_levels(ids)
    segment = {"ends": [len(ids)], "chunks": chunks, "bitmaps": bitmaps, "ranks": ranks}
    for a, b in ((0, 3001), (17, 18), (511, 1025), (3000, 3001), (5, 5)):
        assert token_file.read_range(segment, a, b).tolist() == ids[a:b].tolist()


def test_shards(spark, docs, empty):
    def make(df):
        return sharding.shard(common.cut(df.select("doc_id", "text", F.coalesce(F.octet_length("text") + 1, F.lit(1)).cast("long").alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"))), "k", "size", ["doc_id"])

    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.repeat(F.md5(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))), F.lit(2))).alias("text"))
    for df in (docs, big):
        got = make(df).collect()
        assert len(got) == df.count()
        for s in {r["shard"] for r in got}:
            assert 0 <= s < 16 and sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    sums = [sum(r["size"] for r in got if r["shard"] == s) for s in range(16)]
    assert max(sums) - min(sums) < 0.1 * sum(sums) / 16
    cold = {}
    for r in got:
        if r["doc_id"] % 3:
            cold.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in cold.values())
    assert make(empty).count() == 0


def test_op4_against_the_texts(spark):
    """Every row of op4_shard: size and checksum from the text, equal texts together, near-equal bytes, gapless slots."""
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    got = queries.op4_shard(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    of, loads, slots = {}, [0] * 16, [[] for _ in range(16)]
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert of.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(loads) - min(loads) < 0.05 * sum(loads) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots)


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = packing.pack(packing.pieces(docs, path, capacity=512), 512).collect()
    want = []  # every piece by the plain library: cuts at multiples of the capacity
    for r in rows():
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want += [(r[0], at, len(ids[at : at + 512]), zlib.crc32(np.array(ids[at : at + 512], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 512)]
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=str) == sorted(want, key=str)
    assert sum(r["length"] for r in got) == sum(len(Tokenizer.from_file(path).encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows())
    for seq in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 512
    assert packing.pack(packing.pieces(empty, path)).count() == 0


def test_differencing():
    sizes = np.random.default_rng(3).integers(1, 2000, 400)
    windows = packing.pack_sizes(sizes)
    loads = np.bincount(windows, sizes)
    assert loads.max() <= 4096 and len(loads) <= 1.03 * sizes.sum() / 4096 + 1
    assert np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4]).max() <= 16


def test_token_counts(docs, empty):
    heads, inner = ["a", "ab", "abc", "b"], ["c", "bc", "d", "cd", "bcde"]

    def greedy(word):
        at, n = 0, 0
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (inner if at else heads)), 0)
            if not size:
                return 0
            at, n = at + size, n + 1
        return n

    auto = token_counts.Automaton(heads, inner)
    for n in range(1, 7):
        for word in map("".join, itertools.product("abcde", repeat=n)):
            assert auto.count(word) == greedy(word)
    marked = token_counts.Automaton(heads, inner, bare_mark=True)

    def marked_greedy(word):
        at, n = (0, 0) if any(word.startswith(h) for h in heads) else (0, 1)
        first = True
        while at < len(word):
            pool = heads if first and n == 0 else inner
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pool), 0)
            if not size:
                return 0
            at, n, first = at + size, n + 1, False
        return n

    for n in range(1, 7):
        for word in map("".join, itertools.product("abcde", repeat=n)):
            assert marked.count(word) == marked_greedy(word)
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = token_counts.token_counts(docs, model).collect()
    assert len(got) == len(rows()) and all(r["n_tokens"] >= r["n_words"] for r in got)
    assert token_counts.token_counts(empty, model).count() == 0


def test_token_counts_real_vocabulary(spark):
    """Every distinct word of a table against a greedy loop over the model's pieces."""
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    longest = max(map(len, pieces))

    def greedy(word):
        word, at, n = "▁" + word, 0, 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in pieces), 0)
            if not size:
                return 0
            at, n = at + size, n + 1
        return n

    texts = [r["text"] for r in queries.table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    automaton = token_counts._worker(model)[0]
    for word in {w for t in texts for w in WORD.findall(t or "")} | {"çréoi", "ñandú", "日本", "1", "▁", "a▁b", "\u0600x"}:
        assert automaton.count(word) == greedy(word), word


def test_long_texts_hash_alike(monkeypatch):
    from episodica.llm import textbytes

    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abc"), rng.integers(1, 90))) for _ in range(300)] + ["z" * 1000]
    data = np.frombuffer(" ".join(words).encode() + b"\xff", np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    want = textbytes.span_hashes(data, starts, ends)
    monkeypatch.setattr(textbytes, "HASH_BYTES", 64)
    assert (textbytes.span_hashes(data, starts, ends) == want).all()


def test_shard_many_small_rows(spark, monkeypatch):
    """A key of few bytes but many rows is numbered in pieces, not in one window."""
    seen = []
    monkeypatch.setattr(sharding, "ROWS", 100)
    monkeypatch.setattr(sharding, "cut", lambda df: seen.append(common.cut(df)) or seen[-1])
    df = spark.createDataFrame([(7, i, 1) for i in range(1500)] + [(1000 * i, i, 10_000) for i in range(1, 201)], "k long, doc_id long, size long")
    got = sharding.shard(df, "k", "size", ["doc_id"]).collect()
    assert max(r["count"] for r in seen[-1].groupBy("_cell").count().collect()) <= 200
    assert len({r["shard"] for r in got if r["k"] == 7}) == 1
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_components_of_chains(spark, monkeypatch):
    """Chains in order of ids, stars and loops; a chain of 12 takes four rounds."""
    cuts, plain = [], common.cut
    monkeypatch.setattr(common, "cut", lambda df: cuts.append(1) or plain(df))
    edges = [(i, i + 1) for i in range(12)] + [(50, i) for i in range(40, 46)] + [(90, 90), (91, 93), (93, 92), (93, None)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(13), 0), **dict.fromkeys([*range(40, 46), 50], 40), **dict.fromkeys((91, 92, 93), 91)}
    assert len(cuts) < 25


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    vectors = [(base[i % 30] + 0.05 * rng.standard_normal(16)).tolist() for i in range(300)]
    vectors += [vectors[0], vectors[0], [0.0] * 16, None, [float("nan")] * 16, [None] * 16, [1.0] * 3, []]
    df = spark.createDataFrame([(i if i != 301 else 0, v, 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {}
    for r in embed_dedup.near_duplicates(df).collect():
        got.setdefault(r["vec_id"], r)
    x = np.array([np.array(v, np.float32).astype(float) for v in vectors[:302]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    for i in range(1, 300):
        assert got[i]["n_links"] == near[i].sum() - 1
        assert got[i]["component_id"] == next(k for k in range(300) if near[i, k])
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(302, 308))
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def crowded(rng, n, dim, median, pairs):
    """n unit vectors with a median cosine between unlike ones, and as many pairs of them again at a cosine of exactly 0.9."""
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(np.sqrt(median) * unit(rng.standard_normal((1, dim))) + np.sqrt(1 - median) * unit(rng.standard_normal((n, dim))))
    y = rng.standard_normal((pairs, dim))
    y = unit(y - (y * x[:pairs]).sum(1)[:, None] * x[:pairs])
    return np.concatenate([x, (0.9 + 1e-6) * x[:pairs] + np.sqrt(1 - (0.9 + 1e-6) ** 2) * y])


def test_crowded_vectors(spark):
    x = crowded(np.random.default_rng(5), 6000, 64, 0.8, 300)
    vectors = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], *x.tolist()]  # the first rows have a length of their own
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in embed_dedup.near_duplicates(df).collect()}
    a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    share = np.mean([got[i + 2] == got[j + 2] for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    assert len(a) >= 300 and share >= 0.95
    assert got[0] == got[1] == 0


PAGE = """<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class="share-box">Follow {0}</div><article><h1>Head &amp; {1}</h1>
<div><i>Our daily letter</i></div><p><b>One<br>two {1}.<p>Three <i>fo</i>ur&nbsp;five<script>var t="</p>";</script></p><div class="comments"><p>nice</p></div></article><aside>side</aside><footer>&copy;</footer></body></html>"""


def test_html(spark):
    data = [(i, f"http://h.example/{i}", PAGE.format(i, f"n{i}")) for i in range(6)]
    data += [(6, None, None), (7, "x", ""), (8, "http://o.example/", "<p>a < b</p><p>c"), (8, "http://o.example/", "<p>a < b</p><p>c"), (9, "http://o.example/9", "<div class='ad'>no</div><article class=comment>no</article><article>yes &am &#233;</article>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got[2] == "Head & n2 One two n2. Three four five"  # the recurring letter is the site's template
    assert got[6] == got[7] == "" and got[8] == "a < b c" and got[9] == "yes &am é"
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_rare_template(spark):
    """A box and a notice on a tenth of a large host are template; a heading that is all of a page isn't."""
    box = "<div class=xy>Read our weekly letter</div><p>Prices are in euro</p>"
    data = [(i, f"http://h.example/{i}", f"<body><p>Body text of page number {i} is here</p>{box if i % 10 == 0 else ''}</body>") for i in range(600)]
    data += [(600 + i, f"http://g.example/{i}", f"<body><h1>Moved for good</h1><p>{i}</p></body>") for i in range(8)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for limit in (100, 0):
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df, broadcast_subtrees=limit).collect()}
        assert all(got[i] == f"Body text of page number {i} is here" for i in range(600))
        assert got[603] == "Moved for good 3"


def test_html_structure_removes(spark):
    """Without any name list or article selection, structure alone removes menus, adverts and footers whose words differ by page."""
    rng = np.random.default_rng(11)
    say = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))

    def page(i):
        menu = "".join(f"<li><a href='/{say(1)}'>{say(1)}</a></li>" for _ in range(rng.integers(3, 7)))
        body = "".join(f"<p class=lead>{say(rng.integers(20, 60))}</p>" for _ in range(rng.integers(2, 6)))
        want.append(" ".join(re.findall("<p class=lead>([^<]*)", body)))
        return f"<body><div class='xa'><ul>{menu}</ul></div><div id='box-{i}'>{say(4)}</div><div class=xc>{body}</div><div class=xf>{say(3)} &copy;</div></body>"

    want: list[str] = []
    df = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(40)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df, names=False).collect()}
    assert [got[i] for i in range(40)] == want
    # two pages are no template: everything stays
    few = {r["page_id"]: r["text"] for r in html_extract.extract(df.where("page_id < 2"), names=False).collect()}
    assert all(few[i] != want[i] and want[i] in few[i] for i in range(2))


def test_html_given_pages(spark):
    pages = queries.table(spark, "/root/testdata/sf0.01", "pages")
    got, alone = ({r["page_id"]: r["text"] for r in html_extract.extract(pages, names=x).collect()} for x in (True, False))
    article = {r["page_id"]: html_extract.main_text(html_extract.parse(re.search("(?s)<article>.*</article>", r["html"])[0])) for r in pages.collect()}
    assert got == article
    hosts = {r["page_id"]: r["h"] for r in pages.select("page_id", html_extract.host_of("url").alias("h")).collect()}
    large = [k for k, h in hosts.items() if list(hosts.values()).count(h) >= 10]
    assert np.mean([alone[k] == article[k] for k in large]) > 0.9


def test_html_deep():
    import time

    began = time.time()
    root = html_extract.parse("<div>" * 30_000 + "a" + "</span></p>" * 30_000)
    assert html_extract.main_text(root).split() == ["a"] and time.time() - began < 20


@pytest.mark.parametrize(
    "page, want",
    [
        ("<div class='content has-sidebar'><article>a b</article></div>", "a b"),
        ("<div id=page class='no-comments'><p>a b</p></div>", "a b"),
        ("<div class=sidebar><article>a b</article></div><p>c", "a b"),
        ("<article class='post no-comments'>a b</article>", "a b"),
        ("<form><article>a b</article><div class='cookie-banner'>no</div></form>", "a b"),
        ("<main>body <article>a</article></main><main>c<div class=related><article>no</article></div></main>", "body a c"),
        ("<article>a b</article><form>no</form><div role=dialog>no</div>", "a b"),
        ("<article><p>foo<img>bar <math><mi>x</mi></math></p></article>", "foobar x"),
    ],
)
def test_html_guard(page, want):
    assert html_extract.main_text(html_extract.parse(page)) == want


def test_rules(spark, docs, empty):
    def brute(text):
        words = WORD.findall(text or "")
        seen = {}
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)

    table = queries.table(spark, DATA, "documents").select("doc_id", "text")
    for df in (docs.select("doc_id", "text"), table):
        got = sorted(tuple(r[c] for c in quality_rules.SIGNALS) for r in quality_rules.score(df).collect())
        assert got == sorted(brute(r["text"]) for r in df.collect())
    scored = quality_rules.score(table).collect()
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in scored)
    assert quality_rules.keep(table).count() == sum(r["kept"] for r in scored)
    assert quality_rules.score(empty).count() == 0


def test_votes_recover_planted_accuracies():
    """EM finds what the rules do, and the posterior overrules a lone bad vote of a weak rule but not those of strong ones."""
    rng = np.random.default_rng(9)
    bad_if_good, bad_if_bad = np.array([0.01, 0.01, 0.02, 0.15, 0.01]), np.array([0.9, 0.8, 0.7, 0.3, 0.6])
    good_if_good, good_if_bad = np.array([0.9, 0.8, 0.9, 0.7, 0.8]), np.array([0.05, 0.1, 0.2, 0.5, 0.3])
    is_good = rng.random(40_000) < 0.8
    u = rng.random((len(is_good), 5))
    bad, good = np.where(is_good[:, None], bad_if_good, bad_if_bad), np.where(is_good[:, None], good_if_good, good_if_bad)
    v = np.where(u < bad, -1, np.where(u < bad + good, 1, 0))
    patterns, back, counts = np.unique(v, axis=0, return_inverse=True, return_counts=True)
    model = quality_rules.fit_votes(patterns, counts.astype(float))
    odds = np.array(model.odds)
    want = np.log(np.stack([bad_if_good / bad_if_bad, (1 - bad_if_good - good_if_good) / (1 - bad_if_bad - good_if_bad), good_if_good / good_if_bad], 1))
    assert np.abs(odds - want).max() < 0.5 and abs(model.prior - np.log(4)) < 0.2
    verdict = model.posterior(v) >= 0.5
    assert (verdict == is_good).mean() > 0.97 > (~(v == -1).any(1) == is_good).mean()
    lone = model.posterior(np.array([[1, 1, 1, -1, 1], [-1, -1, 1, 1, 1], [0, 0, 0, 0, 0]]))
    assert lone[0] > 0.5 > lone[1]
    # the same, step by step, for each text instead of each pattern
    p = np.where((v[:3000] == -1).any(1), 0.1, 0.9)
    for _ in range(500):
        w, belief = np.stack([p, 1 - p]), quality_rules.BELIEF_WEIGHT * 3000
        prior = (w.sum(1) + belief * np.array([0.9, 0.1])) / (3000 + belief)
        chance = np.array([[[w[k] @ (v[:3000, r] == x - 1) + belief * prior[k] * quality_rules.BELIEF[k, x] for x in range(3)] for r in range(5)] for k in (0, 1)])
        chance /= chance.sum(2, keepdims=True)
        logs = np.log(prior)[:, None] + sum(np.log(chance[:, r])[:, v[:3000, r] + 1] for r in range(5))
        p = 1 / (1 + np.exp(logs[1] - logs[0]))
    few, n = np.unique(v[:3000], axis=0, return_counts=True)
    assert np.abs(quality_rules.fit_votes(few, n.astype(float)).posterior(v[:3000]) - p).max() < 1e-5


def test_verdict_is_not_all_must_pass(spark):
    scored = quality_rules.score(queries.table(spark, "/root/testdata/sf0.01", "documents"))
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels").withColumnRenamed("quality", "label")
    got = scored.join(labels, "doc_id").collect()
    assert np.mean([r["kept"] == (r["label"] == 1) for r in got]) > 0.97

    def bad_votes(text):
        m = quality_rules.measure(next(iter(quality_rules.runs(pa.array([text], pa.string())))))
        return int((quality_rules.votes(m) == -1).sum())

    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, "/root/testdata/sf0.01", "documents").collect()}
    assert any(r["kept"] and bad_votes(texts[r["doc_id"]]) for r in scored.collect())


def test_classifier(spark, docs, empty):
    got = queries.op10_quality_classifier(spark, "/root/testdata/sf0.01").join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.95
    weights = quality_classifier.fit(docs, spark.createDataFrame([(0, 1), (0, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int"))
    scores = quality_classifier.score(docs, weights).collect()
    assert len(scores) == len(rows()) and all(0 <= r["score"] <= 1 for r in scores)
    assert quality_classifier.score(empty, weights).count() == 0


def test_classifier_by_hand(spark, docs):
    """Training and scores against the update rule, row by row, in plain Python."""
    labels = spark.createDataFrame([(0, 1), (3, 0), (4, 1), (9, 0), (11, 1)], "doc_id long, quality int")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    order = spark.createDataFrame([(r[0], r[1]) for r in rows() if r[0] in known], "k long, text string").orderBy(F.xxhash64("k", F.lit(12)), F.xxhash64("text")).collect()
    alpha, beta, l2 = 0.1, 1.0, 1.0
    z, n = {}, {}

    def weight(i):
        return -z.get(i, 0.0) / ((beta + n.get(i, 0.0) ** 0.5) / alpha + l2)

    def vector(text):
        run = next(iter(quality_rules.runs(pa.array([text], pa.string()))))
        ids, _ = quality_classifier.features(run)
        x = {}
        for i in ids.tolist():
            x[i] = x.get(i, 0) + 1 / max(len(ids), 1) ** 0.5
        return x | {1 << quality_classifier.FEATURE_BITS: 1.0}

    train = [(vector(r["text"]), known[r["k"]]) for r in order]
    for _ in range(3):
        for x, y in train:
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (p - y) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    weights = quality_classifier.fit(docs, labels)
    got = sorted(((str(r["doc_id"]), r["score"]) for r in quality_classifier.score(docs, weights).collect()))
    want = sorted((str(r[0]), float(1 / (1 + np.exp(-sum(weight(i) * v for i, v in vector(r[1]).items()))))) for r in rows())
    assert [k for k, _ in got] == [k for k, _ in want]
    assert np.abs(np.array([s for _, s in got]) - np.array([s for _, s in want])).max() < 1e-5


def test_pipeline_copies_by_row(spark):
    """Copies that share an id or have none go, and a unique text that shares an id with a copy stays."""
    import corpus_pipeline

    other = "Seven wise owls watch a calm river at dusk while nobody reads any of the old books there"
    data = [(5, BASE), (5, BASE), (2, BASE + " now"), (2, other), (None, BASE), (None, BASE.replace("fox", "cat") + " for a while longer than before"), (None, other), (9, "x"), (9, "x"), (None, None)]
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in data], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, df, DATA)
    sets = [(i, shingles(t)) for i, (_, t) in enumerate(data)]
    groups = {}
    for i, g in zip(range(len(data)), brute_components(sets), strict=True):
        groups.setdefault(g, []).append(i)
    want = sorted((data[i] for i in (min(g, key=lambda i: (data[i][0] is None, data[i][0] or 0, i)) for g in groups.values())), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == want


def test_pipeline(spark, docs, empty):
    import corpus_pipeline

    before = table = queries.table(spark, DATA, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = common.cut(stage(spark, before, DATA))
        if k < 4:
            assert after.columns == table.columns
        if k == 2:  # against brute force on the stage's own input
            items = [(r["doc_id"], shingles(r["text"])) for r in before.collect()]
            assert sorted(r["doc_id"] for r in after.collect()) == sorted({k for (k, _), c in zip(items, brute_components(items), strict=True) if k == c})
        assert 0 < after.count() <= before.count() * 3
        before = after
    for df in (docs.select(*corpus_pipeline.COLUMNS), empty.select(*corpus_pipeline.COLUMNS)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, DATA).count() >= 0


def test_order_is_portable(spark):
    assert spark.range(1).select(mixing._order("id", 0).alias("h")).first()["h"] == hashlib.md5(b"0:0").hexdigest()
