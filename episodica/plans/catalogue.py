"""All queries with their SQL: those over frames, vectors, sampling, packing and metrics here, the others in the modules below."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.functions import text as T
from episodica.functions import vectors as V
from episodica.operators import bins, chunks, metrics, rows, stats, subtasks
from episodica.plans.registry import CAPACITY, EMB, FRAMES, HORIZON, LINES, ORACLE_SQL, ORDER, QUERIES, event_chunks, events_as_frames, line_vector, lines, long, query, rounded, vectors
from episodica.sources.shared import small
from episodica.sources.tables import table


@query(FRAMES + " SELECT a.episode_index, a.frame_index, a.n - 1 - a.frame_index AS steps_to_go, d.delta, b.value, a.frame_index + d.delta >= a.n AS is_pad FROM f a CROSS JOIN (SELECT unnest(range(16)) AS delta) d JOIN f b ON a.episode_index = b.episode_index AND b.frame_index = least(a.frame_index + d.delta, a.n - 1)")
def action_chunk_pad(spark, d):
    df = event_chunks(spark, d, "value", HORIZON)
    return chunks.chunk_rows(df.select("episode_index", "frame_index", "steps_to_go", "chunk", "chunk_is_pad")).withColumn("delta", F.col("delta").cast("long"))


@query(FRAMES + " SELECT event_id, episode_index, frame_index, n - 1 - frame_index AS steps_to_go, min(event_id) OVER (PARTITION BY episode_index) + frame_index AS start_index FROM f")
def episode_frames(spark, d):
    from pyspark.sql import Window

    return events_as_frames(spark, d).select("event_id", "episode_index", "frame_index", "steps_to_go", (F.min("event_id").over(Window.partitionBy("episode_index")) + F.col("frame_index")).alias("start_index"))


@query("SELECT r_regionkey, i AS delta, i / (10.0 + r_regionkey)::DOUBLE AS seconds FROM region, (SELECT unnest(range(16)) AS i)")
def chunk_timestamps(spark, d):
    return table(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HORIZON - 1).cast("long"))).alias("delta")).withColumn("seconds", F.col("delta") / (F.lit(10.0) + F.col("r_regionkey")))


@query(FRAMES + " SELECT event_id, round(pow(0.99, n - 1 - frame_index), 9) AS weight FROM f")
def discount_weight(spark, d):
    return events_as_frames(spark, d).select("event_id", F.round(T.discount(F.col("steps_to_go")), 9).alias("weight"))


STATS_SQL = "min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99"


@query(EMB + f" SELECT label, dim, {STATS_SQL} FROM x GROUP BY label, dim")
def vector_stats(spark, d):
    return stats.exact_stats(vectors(spark, d), ["label"]).select("label", "dim", "min", "max", *rounded("mean", "std", "q01", "q99"))


@query(LINES + f" SELECT dataset, dim, {STATS_SQL.replace('round(avg(x), 6)', 'round(avg(x), 4)').replace('round(stddev_pop(x), 6)', 'round(stddev_pop(x), 4)')} FROM x GROUP BY dataset, dim")
def dataset_stats(spark, d):
    return stats.exact_stats(lines(spark, d), ["dataset"]).select("dataset", "dim", "min", "max", *rounded("mean", "std", places=4), *rounded("q01", "q99"))


@query(LINES + ", s AS (SELECT dataset, dim, min(x) AS lo, max(x) AS hi, count(*) AS n, avg(x) AS mean, avg(x * x) AS sq FROM x GROUP BY dataset, dim), b AS (SELECT dataset, dim, CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 5000)), 4999) ELSE 0 END AS bin, count(*) AS c FROM x JOIN s USING (dataset, dim) GROUP BY ALL), c AS (SELECT *, sum(c) OVER (PARTITION BY dataset, dim ORDER BY bin) AS cum FROM b) SELECT dataset, dim, any_value(n) AS n, round(any_value(mean), 4) AS mean, round(sqrt(greatest(any_value(sq) - any_value(mean) * any_value(mean), 0)), 3) AS std, round(min(CASE WHEN cum >= 0.01 * n THEN lo + bin * ((hi - lo) / 5000) END), 6) AS q01, round(min(CASE WHEN cum >= 0.99 * n THEN lo + bin * ((hi - lo) / 5000) END), 6) AS q99 FROM c JOIN s USING (dataset, dim) GROUP BY dataset, dim")
def running_stats_hist(spark, d):
    return stats.histogram_stats(lines(spark, d), ["dataset"]).select("dataset", "dim", "n", *rounded("mean", places=4), *rounded("std", places=3), *rounded("q01", "q99"))


@query(LINES + ", s AS (SELECT dataset, dim, avg(x) AS mean, max(x) AS max FROM x GROUP BY dataset, dim) SELECT dataset, dim, CASE WHEN dim = 0 THEN 25.0 ELSE round(mean, 4) END AS mean, max FROM s")
def stats_override(spark, d):
    old = lines(spark, d).groupBy("dataset", "dim").agg(F.round(F.avg("x"), 4).alias("mean"), F.max("x").alias("max"))
    newer = old.where("dim = 0").select("dataset", "dim", F.lit(25.0).alias("mean"), F.lit(None).cast("double").alias("max"))
    return stats.override(old, newer, ["dataset", "dim"])


def _normalised(mode: str, places: int = 5):
    def run(spark, d):
        x = vectors(spark, d)
        f, _, a, b = V.MODES[mode]
        s = stats.exact_stats(x, ["label"]).select("label", "dim", a, b)
        return x.join(small(s), ["label", "dim"]).select("vec_id", "dim", F.round(f(F.col("x"), F.col(a), F.col(b)), places).alias("y"))

    return run


NORM = EMB + ", s AS (SELECT label, dim, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.01) AS q01, quantile_cont(x, 0.99) AS q99 FROM x GROUP BY label, dim)"
for _name, _mode, _sql in (("normalize_meanstd", "MEAN_STD", "(x - mean) / (std + 1e-8)"), ("normalize_minmax", "MIN_MAX", "2.0 * (x - lo) / (hi - lo + 1e-8) - 1.0"), ("normalize_quantile", "QUANTILE", "2.0 * (x - q01) / (q99 - q01 + 1e-8) - 1.0")):
    _f = _normalised(_mode)
    _f.__name__ = _name
    query(NORM + f" SELECT vec_id, dim, round({_sql}, 5) AS y FROM x JOIN s USING (label, dim)")(_f)


@query("WITH s AS (SELECT event_type, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events GROUP BY event_type) SELECT event_id, round(greatest(-50, least(50, 2.0 * (value - lo) / (hi - lo + 1e-6) - 1.0)), 6) AS y FROM events JOIN s USING (event_type)")
def quantile_clipped(spark, d):
    e = table(spark, d, "events")
    s = stats.exact_stats(e.select("event_type", F.lit(0).cast("long").alias("dim"), F.col("value").alias("x")), ["event_type"]).select("event_type", "q01", "q99")
    return e.join(small(s), "event_type").select("event_id", F.round(V.quantile_clipped(F.col("value"), F.col("q01"), F.col("q99")), 6).alias("y"))


@query(NORM + " SELECT label, count(*) AS n, max(abs(x - (((2.0 * (x - lo) / (hi - lo + 1e-8) - 1.0) + 1.0) / 2.0 * (hi - lo) + lo))) < 1e-6 AS close FROM x JOIN s USING (label, dim) GROUP BY label")
def normalize_roundtrip(spark, d):
    x = vectors(spark, d)
    s = stats.exact_stats(x, ["label"]).select("label", "dim", "min", "max")
    there = V.min_max(F.col("x"), F.col("min"), F.col("max"))
    back = V.undo_min_max(there, F.col("min"), F.col("max"))
    return x.join(small(s), ["label", "dim"]).groupBy("label").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("x") - back)) < 1e-6).alias("close"))


@query("SELECT event_id, greatest(-1, least(1000, trunc((value / 250.0 - 1.0 + 1.0) / 2.0 * 1000.0)::BIGINT)) AS bin FROM events")
def state_bins(spark, d):
    return table(spark, d, "events").select("event_id", V.state_bin(F.col("value") / 250.0 - 1.0).cast("long").alias("bin"))


@query("SELECT l_orderkey, l_linenumber, unnest(range(8)) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax, 0, 0, 0, 0]) AS x, unnest([1, 1, 1, 1, 0, 0, 0, 0])::BIGINT AS mask FROM lineitem")
def pad_dims_mask(spark, d):
    padded = F.arrays_zip(V.pad(line_vector(), 8).alias("x"), V.pad_mask(line_vector(), 8).alias("mask"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode(padded).alias("dim", "s")).select("l_orderkey", "l_linenumber", F.col("dim").cast("long").alias("dim"), "s.x", F.col("s.mask").cast("long").alias("mask"))


MASK = [True, False]


@query(FRAMES + " SELECT a.event_id, d.delta, round(b.value - a.value, 6) AS rel, b.value * 2 AS absolute FROM f a CROSS JOIN (SELECT unnest(range(8)) AS delta) d JOIN f b ON a.episode_index = b.episode_index AND b.frame_index = least(a.frame_index + d.delta, a.n - 1)")
def state_relative_chunk(spark, d):
    both = F.array(F.col("value"), F.col("value") * 2)
    df = event_chunks(spark, d, both, 8).select("event_id", "value", F.posexplode("chunk").alias("delta", "a"))
    rel = V.relative(F.col("a"), F.array(F.col("value"), F.col("value") * 2), MASK)
    return df.withColumn("r", rel).select("event_id", F.col("delta").cast("long").alias("delta"), F.round(F.col("r")[0], 6).alias("rel"), F.col("r")[1].alias("absolute"))


@query("WITH x AS (SELECT vec_id, unnest(range(64)) AS d, unnest(embedding)::DOUBLE AS a, unnest(list_reverse(embedding))::DOUBLE AS s FROM embeddings) SELECT vec_id, count(*) AS n, round(sum(CASE WHEN d < 32 THEN a - s ELSE a END), 5) AS relative, round(sum(a), 5) AS back, round(max(a), 5) AS largest FROM x GROUP BY vec_id")
def state_relative_inverse(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("a"))
    state, mask = F.reverse("a"), [True] * 32 + [False] * 32
    there = V.relative(F.col("a"), state, mask)
    add = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 5)
    x = e.withColumn("r", there).withColumn("b", V.relative(F.col("r"), state, mask, sign=1))
    return x.select("vec_id", F.size("a").cast("long").alias("n"), add("r").alias("relative"), add("b").alias("back"), F.round(F.array_max("b"), 5).alias("largest"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END, ''), nullif(c_mktsegment, ''), 'Do the task.') AS task FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def task_text_fallback(spark, d):
    tasks = table(spark, d, "nation").select(F.col("n_nationkey").alias("task_index"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("task"))
    return subtasks.task_text(table(spark, d, "customer"), small(tasks), "c_nationkey", "c_mktsegment").select("c_custkey", "task")


@query(r"SELECT s_suppkey, upper(substr(b, 1, 1)) || substr(b, 2) || '.' AS text FROM (SELECT s_suppkey, regexp_replace(trim(lower('  Pick UP ' || s_name || '.. ')), '\.+$', '') AS b FROM supplier)")
def canonical_text(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.canonical(F.concat(F.lit("  Pick UP "), F.col("s_name"), F.lit(".. "))).alias("text"))


def third_ends():
    return F.array(F.floor(F.col("episode_length") / 3), F.floor(F.col("episode_length") / 2), F.col("episode_length") - 2)


@query(FRAMES + ", e AS (SELECT *, [n // 3, n // 2, n - 2] AS ends FROM f), s AS (SELECT *, least(len(list_filter(ends, lambda x: x <= frame_index)), 2) AS seg FROM e) SELECT event_id, seg::BIGINT AS segment, greatest(0, ends[seg + 1] - frame_index)::BIGINT AS steps FROM s")
def subtask_segment(spark, d):
    return events_as_frames(spark, d).withColumn("ends", third_ends()).select("event_id", subtasks.segment_index(F.col("frame_index"), F.col("ends")).cast("long").alias("segment"), subtasks.segment_steps(F.col("frame_index"), F.col("ends")).cast("long").alias("steps"))


@query("SELECT n_nationkey, n_name || ' ' || lower(n_name) || ' done' AS text FROM nation")
def subtask_cumulate(spark, d):
    return table(spark, d, "nation").select("n_nationkey", subtasks.cumulate(F.array("n_name", F.lower("n_name"), F.lit("done"))).alias("text"))


U01 = "(('0x' || substr(md5('42:' || {}), 1, 8))::BIGINT + 1)::DOUBLE / 4294967297.0"


@query(f"SELECT event_id, CASE WHEN {U01.format('event_id::VARCHAR')} < 0.3 THEN event_type ELSE 'global' END AS text FROM events")
def subtask_mixture(spark, d):
    return table(spark, d, "events").select("event_id", subtasks.mixture(F.col("event_id"), F.col("event_type"), F.lit("global"), 0.3).alias("text"))


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, n, (sum(n) OVER (ORDER BY source) - n)::BIGINT AS start, (sum(n) OVER (ORDER BY source))::BIGINT AS \"end\" FROM c")
def dataset_offsets(spark, d):
    return rows.offsets(table(spark, d, "documents"), "source").select("source", "n", "start", "end")


@query("WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), o AS (SELECT source, sum(n) OVER (ORDER BY source) - n AS s, sum(n) OVER (ORDER BY source) AS e FROM c) SELECT doc_id, o.source, (doc_id - s)::BIGINT AS local_index FROM documents JOIN o ON doc_id >= s AND doc_id < e")
def global_index_lookup(spark, d):
    docs = table(spark, d, "documents")
    return rows.locate(docs.select("doc_id"), "doc_id", rows.offsets(docs, "source"), "source").select("doc_id", "source", "local_index")


@query("SELECT p_partkey, unnest(range(p_partkey * 10, p_partkey * 10 + p_size % 4 + 1)) AS idx FROM part")
def rle_expand(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + F.col("p_size") % 4).alias("end"))
    return rows.expand_segments(p).select("p_partkey", "idx")


@query("SELECT doc_id, n_chars FROM documents WHERE coalesce(n_chars, 0) <= 2000")
def length_filter(spark, d):
    return rows.length_filter(table(spark, d, "documents"), "n_chars", 2000).select("doc_id", "n_chars")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def sample_first(spark, d):
    return rows.sample(table(spark, d, "documents").select("doc_id"), "first:50", ["doc_id"])


@query("SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 50")
def sample_end(spark, d):
    return rows.sample(table(spark, d, "documents").select("doc_id"), "end:50", ["doc_id"])


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR), doc_id LIMIT 70")
def sample_random(spark, d):
    return rows.sample(table(spark, d, "documents").select("doc_id"), "random:70", ["doc_id"])


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents WHERE n_chars <= 3000) WHERE r <= ceil(25 * n / 100.0)")
def sample_percent(spark, d):
    return rows.sample(rows.length_filter(table(spark, d, "documents"), "n_chars", 3000).select("doc_id"), "first:25%", ["doc_id"])


@query(f"SELECT p_partkey FROM part WHERE p_size > 0 ORDER BY -ln({U01.format('p_partkey::VARCHAR')}) / p_size, p_partkey LIMIT 40")
def weighted_subset(spark, d):
    return rows.weighted_subset(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", 40, "p_partkey").select("p_partkey")


@query("SELECT 'trajectory' AS dataset, event_id AS id, NULL AS role, value FROM events UNION ALL SELECT 'instruction', conv_id * 1000 + turn, role, NULL FROM conversations")
def union_sources(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "value")
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return rows.union_all({"instruction": c, "trajectory": e}).select("dataset", "id", "role", "value")


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'user' WHEN turn % 3 = 1 THEN 'assistant' ELSE role END AS role FROM conversations")
def role_map(spark, d):
    name = F.when(F.col("turn") % 3 == 0, "human").when(F.col("turn") % 3 == 1, "gpt").otherwise(F.col("role"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.role(name).alias("role"))


@query("SELECT conv_id, turn, regexp_replace('look  <image>' || chr(10) || chr(10) || 'here <image>' || text, '\\s*<image>\\n?', '<|vision_start|><|image_pad|><|vision_end|>', 'g') AS text FROM conversations")
def tag_rewrite(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.rewrite_tag(F.concat(F.lit("look  <image>\n\nhere <image>"), F.col("text"))).alias("text"))


@query("WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, i AS pair, t[2 * i + 1] AS question, coalesce(t[2 * i + 2], '') AS answer FROM (SELECT conv_id, t, unnest(range((len(t) + 1) // 2)) AS i FROM c)")
def turn_pairs(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    pairs = turns.select("conv_id", "t", F.explode(F.sequence(F.lit(0), F.floor((F.size("t") - 1) / 2).cast("int"))).alias("pair"))
    at = lambda k: F.get("t", F.col("pair") * 2 + k)["text"]
    return pairs.select("conv_id", *long("pair"), at(0).alias("question"), F.coalesce(at(1), F.lit("")).alias("answer"))




#: Names of cameras made from a document's source and language.
CAMERA_SQL = "CASE doc_id % 5 WHEN 0 THEN 'observation.images.image_' || (doc_id // 5) % 4 WHEN 1 THEN lang || '.wrist_image' WHEN 2 THEN 'observation.cam_' || source WHEN 3 THEN 'High_' || lang ELSE 'images.' || source || '_camera' END"


@query(f"WITH n AS (SELECT doc_id, list_extract(string_split({CAMERA_SQL}, '.'), -1) AS s FROM documents), w AS (SELECT doc_id, lower(replace(CASE WHEN s = 'image_0' THEN 'camera_top' WHEN s = 'image_1' THEN 'camera_left_wrist' WHEN s = 'image_2' THEN 'camera_right_wrist' WHEN contains(s, 'image') THEN replace(s, 'image', 'camera') WHEN contains(s, 'cam') THEN replace(s, 'cam', 'camera') ELSE 'camera_' || s END, '_', ' ')) AS w FROM n) SELECT doc_id, upper(w[1:1]) || w[2:] AS caption FROM w")
def camera_caption(spark, d):
    return table(spark, d, "documents").select("doc_id", T.camera_caption(F.expr(CAMERA_SQL.replace("//", "div"))).alias("caption"))


@query("SELECT event_id, 'Camera top: <|vision_start|><|image_pad|><|vision_end|>' || chr(10) || 'State: ' || greatest(-1, least(1000, trunc((value / 250.0 - 1.0 + 1.0) / 2.0 * 1000.0)::BIGINT)) || chr(10) || 'Instruction: ' || upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) || '.' || chr(10) || 'Predict the next actions.' AS prompt FROM events")
def prompt_text(spark, d):
    return table(spark, d, "events").select("event_id", T.prompt(F.array(F.lit("image_0")), F.array(V.state_bin(F.col("value") / 250.0 - 1.0)), T.canonical(F.col("event_type"))).alias("prompt"))


@query("WITH h AS (SELECT c_custkey, md5(lower(trim(c_name))) AS m FROM customer), u AS (SELECT c_custkey, ('0x' || substr(m, 15, 2) || substr(m, 13, 2) || substr(m, 11, 2) || substr(m, 9, 2) || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2))::UBIGINT::HUGEINT AS v FROM h) SELECT c_custkey, (CASE WHEN v >= 9223372036854775808 THEN v - 18446744073709551616 ELSE v END)::BIGINT AS task_id FROM u")
def task_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.task_hash(F.col("c_name")).alias("task_id"))


@query("WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), p AS (SELECT source, doc_id, n_chars, r, 0 AS bin, n_chars AS load FROM o WHERE r = 1 UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.r, CASE WHEN p.load + o.n_chars > 8192 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.load + o.n_chars > 8192 THEN o.n_chars ELSE p.load + o.n_chars END FROM p JOIN o ON o.source = p.source AND o.r = p.r + 1) SELECT source, doc_id, bin::BIGINT AS bin, (load - n_chars)::BIGINT AS \"offset\" FROM p")
def pack_next_fit(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return bins.offsets(bins.next_fit(docs, "n_chars", "source", ["doc_id"], CAPACITY), "source", ["doc_id"], "n_chars").select("source", "doc_id", "bin", "offset")


WFD = "WITH RECURSIVE o AS (SELECT doc_id, coalesce(n_chars, 0)::BIGINT AS n, row_number() OVER (ORDER BY coalesce(n_chars, 0) DESC, doc_id NULLS FIRST) AS r FROM documents), p(r, doc_id, n, loads, bin) AS (SELECT 0::BIGINT, NULL::BIGINT, 0::BIGINT, []::BIGINT[], 0::BIGINT UNION ALL SELECT o.r, o.doc_id, o.n, CASE WHEN list_min(p.loads) + o.n <= 8192 THEN p.loads[1:list_position(p.loads, list_min(p.loads)) - 1] || [list_min(p.loads) + o.n] || p.loads[list_position(p.loads, list_min(p.loads)) + 1:] ELSE p.loads || [o.n] END, CASE WHEN list_min(p.loads) + o.n <= 8192 THEN list_position(p.loads, list_min(p.loads)) ELSE len(p.loads) + 1 END FROM p JOIN o ON o.r = p.r + 1)"


@query(WFD + " SELECT (bin - 1)::BIGINT AS bin, sum(n)::BIGINT AS load, count(*) AS items FROM p WHERE r > 0 GROUP BY bin")
def pack_wfd_loads(spark, d):
    packed = bins.pack_by_size(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", CAPACITY, "ultra")
    return bins.loads(packed, "megabatch", "n_chars").select("bin", *long("load", "items"))


@query(WFD + " SELECT doc_id, (bin - 1)::BIGINT AS bin FROM p WHERE r > 0")
def pack_wfd(spark, d):
    """The bin of every row."""
    return bins.worst_fit(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], CAPACITY).select("doc_id", "bin")


PACKED = ORACLE_SQL["pack_next_fit"].split(" SELECT source, doc_id, bin::BIGINT")[0]


@query(PACKED + ", l AS (SELECT source, bin, sum(n_chars) AS load FROM p GROUP BY source, bin), q AS (SELECT count(*) AS bins, sum(load)::BIGINT AS total, avg(100.0 * load / 8192) AS u, min(load)::BIGINT AS min_load, max(load)::BIGINT AS max_load, round(stddev_pop(load), 4) AS std_load, sum((load > 8192)::INT)::BIGINT AS overflow, sum((100.0 * load / 8192 >= 95)::INT)::BIGINT AS excellent, sum((100.0 * load / 8192 >= 85 AND 100.0 * load / 8192 < 95)::INT)::BIGINT AS good FROM l) SELECT bins, total, round(u, 4) AS utilisation, min_load, max_load, std_load, overflow, excellent, good, CASE WHEN overflow > 0 THEN 'fail' WHEN u >= 90 THEN 'excellent' WHEN u >= 80 THEN 'good' ELSE 'poor' END AS rating FROM q")
def pack_quality(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    out = bins.quality(bins.loads(bins.next_fit(docs, "n_chars", "source", ["doc_id"], CAPACITY), "source", "n_chars"), CAPACITY)
    return out.withColumns({"utilisation": F.round("utilisation", 4), "std_load": F.round("std_load", 4)})


@query(PACKED + ", b AS (SELECT source, bin, n_chars, doc_id, sum(n_chars) OVER (PARTITION BY source, bin ORDER BY doc_id) AS c FROM p) SELECT source, bin::BIGINT AS bin, '0,' || string_agg(c::BIGINT::VARCHAR, ',' ORDER BY doc_id) AS bounds FROM b GROUP BY source, bin")
def cu_seqlens(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    out = bins.cumulative_lengths(bins.next_fit(docs, "n_chars", "source", ["doc_id"], CAPACITY), "source", ["doc_id"], "n_chars")
    return out.select("source", "bin", F.array_join(F.transform("bounds", lambda x: x.cast("string")), ",").alias("bounds"))


@query("SELECT conv_id, turn, (max(length(text)) OVER (PARTITION BY conv_id))::BIGINT AS padded_size, (length(text)::BIGINT * (length(text) + 1) // 2)::BIGINT AS total, length(text)::BIGINT AS real FROM conversations")
def padded_batch(spark, d):
    """Whole texts, the turns of each conversation padded to its longest."""
    return _padded(table(spark, d, "conversations").select("conv_id", "turn", "text", F.col("conv_id").alias("batch")))


def _padded(rows_):
    """Texts as the numbers of their characters, padded in their batches: size, sum and real tokens."""
    n, none, add = F.char_length("text"), F.array().cast("array<long>"), lambda s, x: s + x
    ids = F.when(n > 0, F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1)).cast("long"))).when(n == 0, none)
    out = bins.pad_batch(rows_.select("conv_id", "turn", "batch", ids.alias("ids")), "ids", "batch", 0)
    return out.select("conv_id", "turn", F.size("padded").cast("long").alias("padded_size"), F.aggregate("padded", F.lit(0).cast("long"), add).alias("total"), F.aggregate("mask", F.lit(0), add).cast("long").alias("real"))


@query("WITH t AS (SELECT conv_id, turn, (row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, text NULLS FIRST) - 1) // 64 AS batch, length(text) AS real FROM conversations) SELECT conv_id, turn, (max(real) OVER (PARTITION BY batch))::BIGINT AS padded_size, (real::BIGINT * (real + 1) // 2)::BIGINT AS total, real::BIGINT AS real FROM t")
def padded_batch_whole(spark, d):
    """Whole texts in batches of 64 rows."""
    return _padded(bins.fixed_batches(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn", "text"], 64))


@query("SELECT l_linestatus AS dataset, round(sum(l_discount) / sum(l_linenumber), 4) AS loss, sum(l_linenumber)::BIGINT AS loss_count FROM lineitem GROUP BY l_linestatus")
def channel_loss(spark, d):
    return metrics.channel_loss(table(spark, d, "lineitem").withColumnRenamed("l_linestatus", "dataset"), "dataset", "l_discount", "l_linenumber")


@query(FRAMES + " SELECT a.episode_index, round(coalesce(avg(CASE WHEN a.frame_index + d.delta < a.n THEN (b.value - 1) * (b.value - 1) END), 0), 4) AS loss FROM f a CROSS JOIN (SELECT unnest(range(8)) AS delta) d JOIN f b ON a.episode_index = b.episode_index AND b.frame_index = least(a.frame_index + d.delta, a.n - 1) GROUP BY a.episode_index")
def masked_loss(spark, d):
    x = chunks.chunk_rows(event_chunks(spark, d, "value", 8).select("episode_index", "chunk", "chunk_is_pad"))
    return x.groupBy("episode_index").agg(F.round(metrics.masked_mean((F.col("value") - 1) * (F.col("value") - 1), ~F.col("is_pad")), 4).alias("loss"))


@query("SELECT lang, count(*) AS n, round(coalesce(avg(CASE WHEN quality >= 0 THEN (quality = toxic)::INT END), 0), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def token_accuracy(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return x.groupBy("lang").agg(F.count("*").alias("n"), F.round(metrics.masked_mean((F.col("quality") == F.col("toxic")).cast("int"), F.col("quality") >= 0), 6).alias("accuracy"))


@query("SELECT lang, count(*) AS episodes, round(avg(quality), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)")
def success_rate(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    return metrics.success_rate(x, "lang", F.col("quality") == 1).select("lang", "episodes", *rounded("rate"))


@query("WITH r AS (SELECT event_type AS name, user_id % 8 AS rank, avg(value) AS m FROM events GROUP BY ALL) SELECT name, round(avg(m), 4) AS avg_s, round(max(m), 4) AS max_s, round(min(m), 4) AS min_s FROM r GROUP BY name")
def timing_summary(spark, d):
    return metrics.timing(table(spark, d, "events").withColumn("rank", F.col("user_id") % 8).withColumnRenamed("event_type", "name"), "rank", "value", "name")


@query("SELECT source, floor((arg_min(n_chars, doc_id) + arg_max(n_chars, doc_id)) / 2)::BIGINT AS estimate FROM documents GROUP BY source")
def length_estimate(spark, d):
    return metrics.length_estimate(table(spark, d, "documents"), "source", "doc_id", "n_chars")


@query(FRAMES + ", g AS (SELECT a.event_id, list(b.value ORDER BY d.delta) AS c FROM f a CROSS JOIN (SELECT unnest(range(8)) AS delta) d JOIN f b ON a.episode_index = b.episode_index AND b.frame_index = least(a.frame_index + d.delta, a.n - 1) GROUP BY a.event_id), k AS (SELECT event_id, c, unnest(range(8)) AS k FROM g) SELECT event_id, k, round_even((CASE WHEN k = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) END) * list_sum(list_transform(range(8), lambda n: c[n + 1] * cos(pi() * (2 * n + 1) * k / 16))) * 10, 0)::BIGINT AS q FROM k")
def dct_quantize(spark, d):
    df = event_chunks(spark, d, "value", 8)
    return df.select("event_id", F.posexplode(V.dct(F.col("chunk"), 8)).alias("k", "q")).select("event_id", *long("k", "q"))


@query(ORACLE_SQL["dct_quantize"].replace(" SELECT event_id, k, round_even", ", q AS (SELECT event_id, c, k, round_even") + ") SELECT event_id, round(sum((CASE WHEN k = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) END) * q * cos(pi() * k / 16)) / 10, 4) AS first, abs(sum((CASE WHEN k = 0 THEN sqrt(1.0 / 8) ELSE sqrt(2.0 / 8) END) * q * cos(pi() * k / 16)) / 10 - any_value(c[1])) < 0.15 AS close FROM q GROUP BY event_id")
def dct_roundtrip(spark, d):
    """The first value of each chunk back from its coefficients, off by their rounding at most."""
    df = event_chunks(spark, d, "value", 8)
    back = V.inverse_dct(V.dct(F.col("chunk"), 8), 8)[0]
    return df.select("event_id", F.round(back, 4).alias("first"), (F.abs(back - F.col("chunk")[0]) < 0.15).alias("close"))


def part_tokens():
    return F.transform(F.sequence(F.lit(0).cast("long"), F.col("p_size").cast("long")), lambda i: (i * F.col("p_partkey") + i) % 13)


@query("WITH t AS (SELECT p_partkey, list_transform(range(0, p_size + 1), lambda i: (i * p_partkey + i) % 13) AS ids FROM part), s AS (SELECT *, list_position(ids, 5) AS st FROM t), g AS (SELECT *, CASE WHEN st > 0 THEN list_position(ids[st:], 7) END AS gp FROM s) SELECT p_partkey, CASE WHEN st > 0 THEN st - 1 END::BIGINT AS start, CASE WHEN st > 0 THEN CASE WHEN gp > 0 THEN st + gp - 1 ELSE st END END::BIGINT AS \"end\" FROM g")
def span_extract(spark, d):
    s = T.span(F.col("ids"), 5, 7)
    return table(spark, d, "part").select("p_partkey", part_tokens().alias("ids")).select("p_partkey", s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"))


@query("WITH t AS (SELECT p_partkey, list_transform(range(0, p_size + 1), lambda i: (i * p_partkey + i) % 13) AS ids FROM part) SELECT p_partkey, coalesce((SELECT min(i) FROM (SELECT unnest(range(1, len(ids))) AS i) WHERE ids[i] = 3 AND ids[i + 1] = 4), 0)::BIGINT - 1 AS place FROM t")
def subsequence_search(spark, d):
    return table(spark, d, "part").select("p_partkey", part_tokens().alias("ids")).select("p_partkey", T.find(F.col("ids"), [3, 4]).cast("long").alias("place"))


@query(FRAMES + " SELECT a.event_id, d.delta AS step, b.value FROM f a CROSS JOIN (SELECT unnest(range(10)) AS delta) d JOIN f b ON a.episode_index = b.episode_index AND b.frame_index = least(a.frame_index + d.delta, a.n - 1) WHERE a.frame_index % 10 = 0")
def replan_replay(spark, d):
    df = event_chunks(spark, d, "value", HORIZON).where("frame_index % 10 = 0")
    return df.select("event_id", F.posexplode(F.slice("chunk", 1, 10)).alias("step", "value")).select("event_id", *long("step"), "value")


@query("SELECT p_partkey, (2 * p_size * (p_size + 4) // 4)::BIGINT AS tokens FROM part")
def media_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", T.media_tokens(F.lit(2), F.col("p_size"), F.col("p_size") + 4).alias("tokens"))


@query("SELECT vec_id, d AS dim, round(x, 6) AS x FROM (SELECT vec_id, unnest(range(64)) AS d, unnest(list_transform(e, lambda v: v / sqrt(list_sum(list_transform(e, lambda y: y * y))))) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalise(F.col("embedding"))).alias("dim", "x")).select("vec_id", *long("dim"), *rounded("x"))


@query("SELECT event_id, round(CASE WHEN sqrt(1 - w * w) = 0 THEN 0 ELSE 0.6 * 2 * acos(w) / sqrt(1 - w * w) END, 6) AS ax FROM (SELECT event_id, greatest(-1, least(1, cos(value))) AS w FROM events)")
def quaternion_axis_angle(spark, d):
    return table(spark, d, "events").select("event_id", F.round(V.axis_angle(F.lit(0.6), F.lit(0.0), F.lit(0.8), F.cos("value"))[0], 6).alias("ax"))


@query("SELECT e.event_id, round((SELECT arg_max(v.value, (v.ts, v.event_id)) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.ts <= e.ts AND v.ts >= e.ts - INTERVAL 6 HOUR), 6) AS near_value FROM events e WHERE e.event_type <> 'view'")
def nearest_timestamp(spark, d):
    e = table(spark, d, "events")
    return rows.nearest_in_time(e.where("event_type <> 'view'"), e.where("event_type = 'view'"), "user_id", "ts", 6 * 3600, "value").select("event_id", F.round("near_value", 6).alias("near_value"))


@query("SELECT event_id, round((1 - t) * 0.5 + t * value, 6) AS x_t, round(value - 0.5, 6) AS v FROM (SELECT event_id, value, (event_id % 10) / 10.0::DOUBLE AS t FROM events)")
def flow_matching(spark, d):
    t = (F.col("event_id") % 10) / F.lit(10.0)
    return table(spark, d, "events").select("event_id", F.round((F.lit(1.0) - t) * 0.5 + t * F.col("value"), 6).alias("x_t"), F.round(F.col("value") - 0.5, 6).alias("v"))


# the modules below register their queries as they are imported
from episodica.plans import files, packed, samples, training  # noqa: E402, F401
