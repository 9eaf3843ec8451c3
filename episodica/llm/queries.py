"""The numbered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm import bpe_automaton, delta_lloyd, embed_dedup, fill_middle, html_extract, mixing, ngram_join, packing, quality_classifier, quality_rules, sharding, token_counts, token_file


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(mixing.cut(docs), "size").select("doc_id", "source", "size", "source_size", "target", "taken")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)


def op4_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    rows = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))
    out = sharding.shard(sharding.cut(rows), "text_key", "size", ["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"))


def held_out(key: str = "doc_id"):
    """Rows that no training reads: crc32 of the id as text is 1 modulo 3; null ids are not among them."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality_classifier.fit(docs, labels.where(~held_out()))
    return quality_classifier.score(docs, weights).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    rows = bpe_automaton.decode(bpe_automaton.encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", bpe_automaton.token_count().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = delta_lloyd.lloyd(table(spark, sf_dir, "embeddings"))
    if found is None:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return delta_lloyd.report(found)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_ngram_jaccard, op3_token_file, op4_shard, op5_pack, op6_token_counts, op7_embedding_near_dedup, op8_html_extract, op9_quality_rules, op10_quality_classifier, op11_bpe, op12_centroid_clusters, op13_fill_in_middle, pipeline)}


def _lloyd_sql(rounds: int = 3, k: int = 16, dim: int = 64) -> str:
    """Plain Lloyd's rounds: a step compares all vectors with all centroids."""
    distance = "list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    mean = lambda d: f"((SUM(v.q[{d}])::BIGINT - ((SUM(v.q[{d}])::BIGINT % COUNT(*)) + COUNT(*)) % COUNT(*)) // COUNT(*))::BIGINT"  # noqa: E731  floor, also below zero
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT v.row, MIN(({distance}, c.cluster)) AS best FROM v CROSS JOIN c{r} c GROUP BY v.row)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT a.best[2] AS cluster, [{', '.join(mean(d) for d in range(1, dim + 1))}] AS q FROM v JOIN a{r} a ON v.row = a.row GROUP BY a.best[2])")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, COALESCE(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m ON c.cluster = m.cluster)")
    chain = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
      WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h NULLS LAST, q) - 1)::INT AS cluster, q FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h NULLS LAST, q LIMIT {k})),
{chain},
s AS (SELECT best[2] AS cluster, SUM(best[1])::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY best[2])
SELECT v.vec_id, a.best[2] AS cluster, a.best[1] AS distance, s.cluster_inertia, (SELECT SUM(cluster_inertia)::BIGINT FROM s) AS inertia,
  sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a ON v.row = a.row JOIN s ON s.cluster = a.best[2] JOIN c{rounds} c ON c.cluster = a.best[2]"""


ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
k AS (SELECT *, SUM(source_size) OVER ()::DOUBLE AS total,
        COALESCE(SUM(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS clamped,
        SUM(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
l AS (SELECT (total - clamped) / free AS level FROM k WHERE cap > weight * ((total - clamped) / free) ORDER BY cap / weight, source LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN cap > weight * level THEN weight * level ELSE cap END AS target FROM k, l),
p AS (SELECT *, floor(target + 0.5)::BIGINT AS words FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM p),
o AS (SELECT d.*, q.source_size, q.target, q.whole, q.words - q.whole * q.source_size AS extra,
        COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || COALESCE(CAST(doc_id AS VARCHAR), '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, source, size, source_size, target, (size * (whole + CASE WHEN extra > 0 AND run + size / 2.0 <= extra THEN 1 ELSE 0 END))::BIGINT AS taken FROM o""",
    "op2_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, shingle FROM (
        SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
        UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id HAVING 175 * COUNT(*) >= 75 * ((SELECT n FROM n WHERE n.doc_id = a.doc_id) + (SELECT n FROM n WHERE n.doc_id = b.doc_id))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, MIN(b) AS low FROM r GROUP BY a)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, LEAST(d.doc_id, COALESCE(c.low, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.a""",
    "op7_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v WHERE list_sum(list_transform(e, lambda y: y * y)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) >= 0.9),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, MIN(b) AS low FROM r GROUP BY a), n AS (SELECT a, COUNT(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, LEAST(v.vec_id, COALESCE(c.low, v.vec_id)) AS component_id, v.vec_id <= COALESCE(c.low, v.vec_id) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN c ON v.vec_id = c.a""",
    "op12_centroid_clusters": _lloyd_sql(),
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, COALESCE(text, '') AS text, sha256('7:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
        ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(lines) AS n, LEAST(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, GREATEST(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n::BIGINT AS n, form, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p""",
}
