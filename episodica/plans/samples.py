"""Queries over token rows, chat turns, positions, vectors of samples, batches and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import positions as P
from episodica.functions import text as T
from episodica.functions import tokens as K
from episodica.functions import vectors as V
from episodica.operators import batches, bins, chunks, metrics, packs
from episodica.plans.packed import PACKED, _packs
from episodica.plans.registry import FRAMES, ORDER, event_chunks, long, query
from episodica.sources.tables import table

PART = "t AS (SELECT p_partkey, p_size, list_transform(range(0, p_size + 1), lambda i: (i * p_partkey + i) % 13) AS ids FROM part)"


def _part(spark, d):
    """Token rows: ids is a column of its own, which filters and lambdas of later steps read but don't compute anew."""
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.col("p_size").cast("long")), lambda i: (i * F.col("p_partkey") + i) % 13)
    return P.fixed(table(spark, d, "part").select("p_partkey", "p_size"), ids=ids)


def _text(ids):
    return F.array_join(ids.cast("array<string>"), ",")


@query("WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS t FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, i AS pair, t[2 * i + 1] AS q, t[2 * i + 2] AS a FROM (SELECT conv_id, t, unnest(range(len(t) // 2)) AS i FROM c)) SELECT conv_id, pair, '<|im_start|>' || q.r || chr(10) || q.t || '<|im_end|>' || chr(10) || '<|im_start|>' || a.r || chr(10) AS prompt, CASE WHEN a.t = '' THEN '' ELSE a.t || '<|im_end|>' || chr(10) END AS answer FROM p")
def chat_framing(spark, d):
    """Chat pairs; conversations are bounded by their turns."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("role"), s["text"].alias("content")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return c.select("conv_id", F.posexplode(K.chat_pairs(F.col("turns"), "drop")).alias("pair", "s")).select("conv_id", *long("pair"), "s.prompt", "s.answer")


@query("WITH " + PART + " SELECT p_partkey, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= len(ids) // 2 THEN -100 ELSE x END), ',') AS labels FROM t")
def label_mask(spark, d):
    half = F.floor(F.size("ids") / 2).cast("int")
    x = _part(spark, d).select("p_partkey", F.slice("ids", F.lit(1), half).alias("prompt"), F.slice("ids", half + 1, F.size("ids")).alias("answer"))
    return x.select("p_partkey", _text(K.labels(F.col("prompt"), F.col("answer"))).alias("labels"))


@query("SELECT p_partkey, 'a' || repeat('<|image_pad|>', p_size % 3) || 'b' || repeat('<|image_pad|>', p_size % 4) || 'c<|image_pad|>' AS text FROM part")
def placeholder_expand(spark, d):
    text = F.lit("a<|image_pad|>b<|image_pad|>c<|image_pad|>")
    return table(spark, d, "part").select("p_partkey", K.expand_placeholders(text, "<|image_pad|>", F.array(F.col("p_size") % 3, F.col("p_size") % 4)).alias("text"))


TIMES = "x AS (SELECT p_partkey, p_size % 5 + 1 AS n, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 3 * 2)::DOUBLE ELSE 24.0 END AS fps FROM part), g AS (SELECT p_partkey, n, fps, unnest(range((n + 1) // 2)) AS g FROM x), m AS (SELECT p_partkey, g, (2 * g * p_partkey / fps + least(2 * g + 1, n - 1) * p_partkey / fps) / 2 AS seconds FROM g)"


def _times(spark, d):
    frames = F.transform(F.sequence(F.lit(0), F.col("p_size") % 5), lambda i: i * F.col("p_partkey"))
    fps = F.when(F.col("p_partkey") % 3 > 0, (F.col("p_partkey") % 3 * 2).cast("double"))
    return table(spark, d, "part").select("p_partkey", K.merged_times(frames, fps).alias("times"))


@query("WITH " + TIMES + " SELECT p_partkey, g, seconds FROM m")
def merged_times(spark, d):
    return _times(spark, d).select("p_partkey", F.posexplode("times").alias("g", "seconds")).select("p_partkey", *long("g"), "seconds")


@query("WITH " + TIMES + " SELECT p_partkey, string_agg('<' || printf('%.1f', seconds) || ' seconds><|vision_start|><|video_pad|><|video_pad|><|vision_end|>', '' ORDER BY g) AS text FROM m GROUP BY p_partkey")
def video_text(spark, d):
    return _times(spark, d).select("p_partkey", K.video_text(F.col("times"), F.lit(2)).alias("text"))


@query("WITH " + PART + " SELECT p_partkey, array_to_string(list_transform(ids, lambda x: '<|action_token_' || x || '|>'), '') AS text, array_to_string(ids, ',') AS codec FROM t")
def action_text(spark, d):
    ids = K.split_ids(K.join_ids(F.col("ids")))
    return _part(spark, d).select("p_partkey", K.action_text(F.col("ids")).alias("text"), K.join_ids(ids).alias("codec"))


@query("WITH " + PART + ", x AS (SELECT p_partkey, ids, unnest(range(1, len(ids) + 1)) AS i FROM t) SELECT p_partkey, sum((i > 1 AND ids[i - 1] = 5 AND ids[i] = 10)::INT)::BIGINT AS images, sum((i > 1 AND ids[i - 1] = 5 AND ids[i] = 7)::INT)::BIGINT AS videos FROM x GROUP BY p_partkey")
def media_counts(spark, d):
    return _part(spark, d).select("p_partkey", K.media_count(F.col("ids"), 5, 10).cast("long").alias("images"), K.media_count(F.col("ids"), 5, 7).cast("long").alias("videos"))


SPANS = PART + ", m AS (SELECT *, coalesce((SELECT min(i) FROM (SELECT unnest(range(1, len(ids))) AS i) WHERE ids[i] = 3 AND ids[i + 1] = 4), 0)::BIGINT - 1 AS marker, coalesce(list_position(ids, 7), 0) - 1 AS goal, coalesce(list_position(ids, 5), 0) - 1 AS a, coalesce(list_position(ids, 9), 0) - 1 AS b FROM t), s AS (SELECT *, marker >= 0 AND goal > marker AND a >= 0 AND b >= 0 AS ok FROM m)"


def _spans(spark, d):
    marked = P.fixed(_part(spark, d), marker=T.find(F.col("ids"), [3, 4]))
    return P.fixed(marked, span=K.spans(F.col("ids"), F.col("marker"), 7, 5, 9))


@query("WITH " + SPANS + " SELECT p_partkey, marker AS instruction_start, goal + 1 AS instruction_end, goal AS goal_pos, a AS action_start, b AS action_end_pos FROM s WHERE ok")
def action_spans(spark, d):
    return _spans(spark, d).where("span is not null").select("p_partkey", "span.*").select("p_partkey", *long("instruction_start", "instruction_end", "goal_pos", "action_start", "action_end_pos"))


@query("WITH " + SPANS + ", e AS (SELECT p_partkey, CASE WHEN ok THEN list_concat(list_concat(ids, CASE WHEN b >= a THEN ids[a + 1:b + 1] ELSE [] END), [11, 12]) ELSE ids END AS ids, CASE WHEN ok THEN list_concat(list_concat(range(len(ids)), CASE WHEN b >= a THEN range(a, b + 1) ELSE [] END), [0, 1]) ELSE range(len(ids)) END AS pos, len(ids) AS n FROM s WHERE b >= a OR NOT ok) SELECT p_partkey, array_to_string(ids, ',') AS ids, array_to_string(pos, ',') AS positions, (len(ids) - n)::BIGINT AS ignored FROM e")
def sequence_extend(spark, d):
    x = _spans(spark, d).where("span is null or span.action_end_pos >= span.action_start")
    x = P.fixed(x, positions=F.transform("ids", lambda v, i: i.cast("long")))
    goal = F.array(F.lit(11).cast("long"), F.lit(12).cast("long"))
    out = P.fixed(x, s=K.extended(F.col("ids"), F.col("ids"), F.col("positions"), F.col("span"), goal))
    return out.select("p_partkey", _text(F.col("s.ids")).alias("ids"), _text(F.col("s.positions")).alias("positions"), F.size(F.filter("s.labels", lambda v: v == K.IGNORE)).cast("long").alias("ignored"))


def _placed(df, *more):
    return P.position_rows(df, ["p_partkey", *more]).select(*more, "p_partkey", *long("n", "t", "h", "w"))


@query("WITH x AS (SELECT p_partkey, (p_size % 5 + 2)::BIGINT AS a, (p_partkey % 3 + 1)::BIGINT AS m FROM part), y AS (SELECT *, a + greatest(2, m) AS b FROM x), z AS (SELECT p_partkey, unnest(range(a)) AS n, n AS t, n AS h, n AS w FROM y UNION ALL SELECT p_partkey, a + j, a, a + j // m, a + j % m FROM (SELECT *, unnest(range(2 * m)) AS j FROM y) UNION ALL SELECT p_partkey, a + 2 * m + j, b + j, b + j, b + j FROM (SELECT *, unnest(range(2)) AS j FROM y) UNION ALL SELECT p_partkey, a + 2 * m + 2 + j, b + 2, b + 2 + j // 2, b + 2 + j % 2 FROM (SELECT *, unnest(range(4)) AS j FROM y) UNION ALL SELECT p_partkey, a + 2 * m + 6, b + 4, b + 4, b + 4 FROM y UNION ALL SELECT p_partkey, a + 2 * m + 7 + j, b + 5, b + 5 + j // 2, b + 5 + j % 2 FROM (SELECT *, unnest(range(4)) AS j FROM y) UNION ALL SELECT p_partkey, a + 2 * m + 11 + j, b + 7 + j, b + 7 + j, b + 7 + j FROM (SELECT *, unnest(range(3)) AS j FROM y)) SELECT p_partkey, n, t, h, w FROM z")
def position_index(spark, d):
    """A text, an image, and a video of two frames with its times between them."""
    a, m = F.col("p_size") % 5 + 2, (F.col("p_partkey") % 3 + 1).cast("int")
    rep = lambda x, n: F.array_repeat(F.lit(x), n.cast("int") if hasattr(n, "cast") else n)
    ids = F.concat(rep(1, a - 1), rep(5, 1), rep(6, 2 * m), rep(8, 1), rep(5, 1), rep(9, 4), rep(5, 1), rep(9, 4), rep(8, 3))
    image = F.struct(F.lit(1).alias("t"), F.lit(4).alias("h"), (2 * m).cast("int").alias("w"), F.lit(1.0).alias("step"))
    grids = F.concat(F.array(image), P.frames_of_video(F.struct(F.lit(2).alias("t"), F.lit(4).alias("h"), F.lit(4).alias("w"))))
    return _placed(P.with_blocks(table(spark, d, "part"), ids, grids, 6, 9, 5))


def _time(version: str, step: str) -> str:
    return f"SELECT '{version}' AS version, p_partkey, n, t, h, w FROM (SELECT p_partkey, unnest(range(a)) AS n, n AS t, n AS h, n AS w FROM x UNION ALL SELECT p_partkey, a + j, a + floor((j // 4) * {step})::BIGINT, a + (j % 4) // 2, a + j % 2 FROM (SELECT *, unnest(range(12)) AS j FROM x) UNION ALL SELECT p_partkey, a + 12 + j, a + greatest(floor(2 * {step})::BIGINT + 1, 2) + j, a + greatest(floor(2 * {step})::BIGINT + 1, 2) + j, a + greatest(floor(2 * {step})::BIGINT + 1, 2) + j FROM (SELECT *, unnest(range(2)) AS j FROM x))"


@query("WITH x AS (SELECT p_partkey, (p_size % 5 + 1)::BIGINT AS a, 0.25 * (p_partkey % 4 + 1) * 2 AS step FROM part) " + _time("timed", "step::DOUBLE") + " UNION ALL " + _time("plain", "1"))
def position_index_time(spark, d):
    """Videos whose time axis follows seconds, or counts grid times."""
    part, a = table(spark, d, "part"), F.col("p_size") % 5 + 1
    seconds = F.lit(0.25) * (F.col("p_partkey") % 4 + 1)
    parts = []
    for version, step in (("timed", seconds * 2), ("plain", F.lit(1.0))):
        blocks = F.array(P.block(a, F.lit(3), F.lit(4), F.lit(4), step), P.block(F.lit(2), F.lit(0), F.lit(0), F.lit(0)))
        parts.append(part.select("p_partkey", F.lit(version).alias("version"), blocks.alias("_blocks")))
    return _placed(parts[0].union(parts[1]), "version")


@query("WITH " + PART + ", x AS (SELECT p_partkey, unnest(range(len(ids))) AS i, ids FROM t), m AS (SELECT p_partkey, i, (ids[i + 1] % 4 > 0)::INT AS mask FROM x) SELECT p_partkey, i, CASE WHEN mask = 0 THEN 1 ELSE sum(mask) OVER (PARTITION BY p_partkey ORDER BY i) - 1 END::BIGINT AS position FROM m")
def text_positions(spark, d):
    mask = F.transform("ids", lambda x: (x % 4 > 0).cast("int"))
    return P.text_position_rows(_part(spark, d), ["p_partkey"], mask).select("p_partkey", *long("i", "position"))


SAMPLES = "n AS (SELECT doc_id, (doc_id % 7 + 1)::BIGINT AS n, doc_id % 2 = 0 AS has FROM documents)"


def _samples(spark, d):
    """A sample of doc_id % 7 + 1 tokens for each document; even ones have spans."""
    n = (F.col("doc_id") % 7 + 1).cast("long")
    ids = F.sequence(F.lit(1).cast("long"), n)
    span = F.struct(F.lit(0).cast("long").alias("instruction_start"), F.lit(1).cast("long").alias("instruction_end"), F.lit(0).cast("long").alias("goal_pos"), F.lit(0).cast("long").alias("action_start"), (n - 1).alias("action_end_pos"))
    x = table(spark, d, "documents").select("doc_id", ids.alias("ids"), F.when(F.col("doc_id") % 2 == 0, span).alias("span"))
    first = F.transform("ids", lambda v, i: F.when(i == 0, F.lit(K.IGNORE).cast("long")).otherwise(v))
    return x.withColumns({"labels": first, "positions": F.transform("ids", lambda v, i: i.cast("long"))})


@query(PACKED + ", " + SAMPLES + ", r AS (SELECT package_id, doc_id, n, has, sum(n) OVER (PARTITION BY package_id ORDER BY doc_id) - n AS base FROM k JOIN p USING (source, bin) JOIN n USING (doc_id)) SELECT package_id::BIGINT AS package_id, sum(n * (n + 1) // 2)::BIGINT AS total, string_agg(n::VARCHAR, ',' ORDER BY doc_id) AS seq_lens, coalesce(string_agg((base + n - 1)::BIGINT::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE has), '') AS ends, sum(n * (n + 1) // 2 - 1 - 100)::BIGINT AS labels FROM r GROUP BY package_id")
def pack_materialise(spark, d):
    out = packs.materialise(_packs(spark, d), _samples(spark, d).withColumnRenamed("doc_id", "idx"))
    add = lambda s, x: s + x
    zero = F.lit(0).cast("long")
    return out.select("package_id", F.aggregate("ids", zero, add).alias("total"), _text(F.col("seq_lens")).alias("seq_lens"), _text(F.transform("spans", lambda s: s["action_end_pos"])).alias("ends"), F.aggregate("labels", zero, add).alias("labels"))


@query("WITH " + SAMPLES + ", r AS (SELECT *, doc_id // 8 AS batch, sum(n) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) AS upto FROM n) SELECT batch, '0,' || string_agg(upto::BIGINT::VARCHAR, ',' ORDER BY doc_id) AS bounds, max(n)::BIGINT AS max_seqlen, coalesce(string_agg((upto - 1)::BIGINT::VARCHAR, ',' ORDER BY doc_id) FILTER (WHERE has), '') AS ends, sum(n * (n - 1) // 2)::BIGINT AS positions FROM r GROUP BY batch")
def flat_batch(spark, d):
    x = _samples(spark, d).withColumns({"batch": F.floor(F.col("doc_id") / 8), "seq_lens": F.array(F.size("ids").cast("long")), "spans": F.when(F.col("span").isNull(), F.array().cast("array<struct<instruction_start:bigint,instruction_end:bigint,goal_pos:bigint,action_start:bigint,action_end_pos:bigint>>")).otherwise(F.array("span"))})
    out = batches.flat_batch(x, "batch", "doc_id")
    return out.select("batch", _text(F.col("bounds")).alias("bounds"), "max_seqlen", _text(F.transform("spans", lambda s: s["action_end_pos"])).alias("ends"), F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x).alias("positions"))


@query("WITH " + SAMPLES + ", r AS (SELECT *, max(n) OVER (PARTITION BY doc_id // 8) AS m FROM n) SELECT doc_id, m AS size, (n * (n + 1) // 2 - 1 - 100 - 100 * (m - n))::BIGINT AS labels, (n * (n - 1) // 2 + m - n)::BIGINT AS positions, (n - (n >= 3)::INT)::BIGINT AS real FROM r")
def padded_samples(spark, d):
    """Padded batches; the pad id 3 also occurs as a token, which the mask leaves out too."""
    out = batches.padded_batch(_samples(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 8)), "batch", 3)
    add, zero = lambda s, x: s + x, F.lit(0).cast("long")
    return out.select("doc_id", F.size("ids").cast("long").alias("size"), F.aggregate("labels", zero, add).alias("labels"), F.aggregate("positions", zero, add).alias("positions"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("real"))


@query("WITH " + SAMPLES + ", r AS (SELECT *, max(n) OVER (PARTITION BY doc_id // 8) AS m FROM n) SELECT doc_id, repeat('0,', (m - n)::INT) || array_to_string(range(1, n + 1), ',') AS padded FROM r")
def pad_left(spark, d):
    x = _samples(spark, d).withColumn("batch", F.floor(F.col("doc_id") / 8))
    return bins.pad_batch(x, "ids", "batch", 0, left=True).select("doc_id", _text(F.col("padded")).alias("padded"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN greatest(p_size * 2, (p_partkey % 9) * 4) ELSE (p_partkey % 9) * 4 END::BIGINT AS most FROM part")
def frame_tokens(spark, d):
    """The most tokens of a frame over two grids, one of which has no time in a fifth of the rows."""
    grid = lambda t, h, w: F.struct(t.cast("long").alias("t"), h.cast("long").alias("h"), w.cast("long").alias("w"))
    grids = F.array(grid(F.col("p_partkey") % 5, F.col("p_size"), F.lit(2)), grid(F.lit(1), F.col("p_partkey") % 9, F.lit(4)))
    return table(spark, d, "part").select("p_partkey", batches.max_frame_tokens(grids).alias("most"))


@query(FRAMES + ", s AS (SELECT b.value AS v FROM f a CROSS JOIN (SELECT unnest(range(4)) AS delta) d JOIN f b ON a.episode_index = b.episode_index AND b.frame_index = a.frame_index + d.delta) SELECT round(sum((v - 1) * (v - 1) + (2 * v - 1) * (2 * v - 1)) / (count(*) * 2), 4) AS loss, count(*) AS steps FROM s")
def flow_loss(spark, d):
    """Loss over chunks of three dims of which the mask counts two."""
    df = event_chunks(spark, d, "value", 4)
    three = lambda f: F.transform("chunk", f)
    df = df.select(F.col("event_id").alias("_order"), three(lambda v: F.array(v, v * 2, v * 3)).alias("p"), three(lambda v: F.array(F.lit(1.0), F.lit(1.0), F.lit(9.0))).alias("t"), "chunk_is_pad", three(lambda v: F.array(F.lit(1), F.lit(1), F.lit(0))).alias("m"))
    return metrics.flow_loss(df, "p", "t", "chunk_is_pad", "m").select(F.round("loss", 4).alias("loss"), "steps")


@query("WITH " + PART + ", x AS (SELECT ids, unnest(range(2, len(ids) + 1)) AS i FROM t), y AS (SELECT CASE WHEN ids[i] % 4 = 0 THEN -100 ELSE ids[i] END AS y, ids[i - 1] / 10.0 AS loss, ids[i - 1] + 1 AS guess FROM x) SELECT round(coalesce(avg(CASE WHEN y <> -100 THEN loss END), 0), 6) AS loss, round(avg(CASE WHEN y >= 9 THEN (guess = y)::INT END), 6) AS action_accuracy FROM y")
def token_losses(spark, d):
    ids = F.col("ids")
    x = _part(spark, d).select(F.transform(ids, lambda v: F.when(v % 4 == 0, F.lit(-100).cast("long")).otherwise(v)).alias("labels"), F.transform(ids, lambda v: v / F.lit(10.0)).alias("losses"), F.transform(ids, lambda v: v + 1).alias("guesses"))
    return metrics.token_losses(x, "labels", "losses", "guesses", 9).select(F.round("loss", 6).alias("loss"), F.round("action_accuracy", 6).alias("action_accuracy"))


@query("SELECT doc_id, coalesce(quality * 1000, length(text), 0)::BIGINT AS length FROM documents LEFT JOIN labels USING (doc_id)")
def filled_lengths(spark, d):
    known = table(spark, d, "labels").select("doc_id", (F.col("quality") * 1000).alias("known"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    return metrics.filled_lengths(docs.join(known, "doc_id", "left"), "known", F.col("n")).select("doc_id", "length")


@query("WITH r AS (SELECT event_type AS name, user_id % 8 AS rank, sum(value) / 4 AS s FROM events GROUP BY ALL) SELECT name, round(avg(s) / 10, 4) AS loss FROM r GROUP BY name")
def meta_loss(spark, d):
    return metrics.meta_loss(table(spark, d, "events").withColumn("rank", F.col("user_id") % 8).withColumnRenamed("event_type", "name"), "name", "rank", "value", 4, 10)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - l_tax AS arm, l_discount AS hand, l_extendedprice AS rest, l_quantity + l_discount + l_extendedprice + l_tax AS total FROM lineitem")
def relative_keys(spark, d):
    """Three action keys against two states joined: the mask covers the first two, of which the second is absolute; and vectors joined over keys."""
    one = lambda c: F.array(F.col(c))
    actions = {"arm": (one("l_quantity"), 1), "hand": (one("l_discount"), 1), "rest": (one("l_extendedprice"), 1)}
    rel = V.relative_keys(actions, [one("l_tax"), one("l_quantity")], [True, False])
    total = F.aggregate(V.concat_vectors(one("l_quantity"), F.array("l_discount", "l_extendedprice"), one("l_tax")), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[v[0].alias(k) for k, v in rel.items()], total.alias("total"))


@query(FRAMES + " SELECT event_id, 8::BIGINT AS actions, sum(value) OVER (PARTITION BY episode_index ORDER BY frame_index ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) > 0 AS positive FROM f")
def length_agreement(spark, d):
    """As many actions as pad flags and masks in every chunk, else it raises."""
    df = event_chunks(spark, d, "value", 8)
    same = (F.size("chunk") == F.size("chunk_is_pad")) & (F.size("chunk") == F.size(V.pad_mask(F.col("chunk"), 8)))
    checked = F.when(same, F.size("chunk")).otherwise(F.raise_error(F.lit("actions, pad flags and masks differ in number")).cast("int"))
    real = F.filter(F.arrays_zip("chunk", "chunk_is_pad"), lambda s: ~s["chunk_is_pad"])
    return df.select("event_id", checked.cast("long").alias("actions"), (F.aggregate(real, F.lit(0.0), lambda s, x: s + x["chunk"]) > 0).alias("positive"))


DCT = FRAMES + ", g AS (SELECT a.event_id, list(b.value ORDER BY d.delta) AS c FROM f a CROSS JOIN (SELECT unnest(range(8)) AS delta) d JOIN f b ON a.episode_index = b.episode_index AND b.frame_index = least(a.frame_index + d.delta, a.n - 1) GROUP BY a.event_id), k AS (SELECT event_id, c, unnest(range(8)) AS k FROM g), q AS (SELECT event_id, k, round_even((CASE WHEN k = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) END) * list_sum(list_transform(range(8), lambda n: c[n + 1] * cos(pi() * (2 * n + 1) * k / 16))) * 10, 0)::BIGINT AS q FROM k), l AS (SELECT min(q) - 32 AS least, max(q) AS most FROM q)"


def _coefficients(spark, d):
    return event_chunks(spark, d, "value", 8).select("event_id", "chunk", V.dct(F.col("chunk"), 8).alias("q"))


@query(DCT + " SELECT event_id, string_agg(chr((q - least)::INT), '' ORDER BY k) AS text, string_agg(q::VARCHAR, ',' ORDER BY k) AS back, '0,0,0' AS bad, any_value(most - least)::BIGINT AS alphabet FROM q, l GROUP BY event_id")
def dct_text(spark, d):
    """Coefficients as characters and back; a text of another length gives zeros."""
    x = _coefficients(spark, d)
    least, most = V.coefficient_span(x, "q")
    least -= 32  # no control signs
    out = x.withColumn("text", V.coefficient_text(F.col("q"), least))
    return out.select("event_id", "text", _text(V.text_coefficients(F.col("text"), 8, least)).alias("back"), _text(V.text_coefficients(F.col("text"), 3, least)).alias("bad"), F.lit(V.alphabet_size(least, most, 1 << 16) - 1).cast("long").alias("alphabet"))


@query("SELECT p_partkey, i::BIGINT AS i, round(CASE WHEN i < 4 THEN sin(x * 2 * pi() / (0.004 * pow(1000.0, i / 3.0))) ELSE cos(x * 2 * pi() / (0.004 * pow(1000.0, (i - 4) / 3.0))) END, 6) + 0.0 AS low, round(CASE WHEN i < 4 THEN sin(p_size * pow(10000.0, -i / 4.0)) ELSE cos(p_size * pow(10000.0, -(i - 4) / 4.0)) END, 6) + 0.0 AS high FROM (SELECT p_partkey, p_size, p_size / 64.0::DOUBLE AS x, unnest(range(8)) AS i FROM part)")
def sinusoids(spark, d):
    both = F.arrays_zip(V.sinusoid(F.col("p_size") / F.lit(64.0), 8).alias("low"), V.wave(F.col("p_size"), 8).alias("high"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(both).alias("i", "s")).select("p_partkey", *long("i"), (F.round("s.low", 6) + 0.0).alias("low"), (F.round("s.high", 6) + 0.0).alias("high"))


@query("SELECT event_id, round((0.999 - least((event_id % 1000) / 999.0::DOUBLE, 0.999)) / 0.999, 6) AS t, round(value + (0 + 0.25 + 0.5 + 0.75) / 4.0::DOUBLE, 6) AS moved FROM events")
def flow_steps(spark, d):
    """Flow times from samples, and an Euler integration whose speed is the time."""
    e = table(spark, d, "events")
    return e.select("event_id", F.round(V.flow_time((F.col("event_id") % 1000) / F.lit(999.0)), 6).alias("t"), F.round(V.euler(F.col("value"), lambda x, t: F.lit(t), 4), 6).alias("moved"))
