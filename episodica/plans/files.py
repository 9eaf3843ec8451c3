"""Queries that write a dataset, a statistics file, a log or a report to the shared folder and read it back."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from episodica.functions import vectors as V
from episodica.operators import metrics, rows, stats, subtasks
from episodica.plans.registry import LINES, lines, long, query, rounded
from episodica.sources import catalog, episodes, instructions, stats_files
from episodica.sources.shared import new_path, small, write_text
from episodica.sources.tables import table


@query("SELECT c_nationkey::BIGINT AS dataset, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer GROUP BY c_nationkey")
def glob_scan(spark, d):
    root = new_path(spark, "frames")
    table(spark, d, "customer").withColumn("dataset", F.col("c_nationkey").cast("long")).repartition("dataset").write.partitionBy("dataset").parquet(f"{root}/data")
    return episodes.read_frames(spark, root).groupBy(F.col("dataset").cast("long").alias("dataset")).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("keys"))


LISTED = [7, 3, 11, 20]


@query("SELECT c_custkey, c_nationkey::BIGINT AS episode_index, list_position([7, 3, 11, 20], c_nationkey)::BIGINT - 1 AS position FROM customer WHERE c_nationkey IN (7, 3, 11, 20)")
def episode_subset(spark, d):
    """Only the listed episodes' files are read."""
    root = new_path(spark, "episodes")
    table(spark, d, "customer").withColumn("episode_index", F.col("c_nationkey").cast("long")).repartition("episode_index").write.partitionBy("episode_index").parquet(f"{root}/data/chunk-000")
    found = episodes.read_episodes(spark, root, LISTED, "data/chunk-{chunk:03d}/episode_index={episode}")
    return rows.listed_episodes(found, LISTED).select("c_custkey", F.col("episode_index").cast("long").alias("episode_index"), "position")


@query("SELECT n_nationkey::BIGINT AS episode_index, n_name AS task, n_regionkey::BIGINT AS task_index, r_name AS region, 10.0::DOUBLE AS fps FROM nation JOIN region ON n_regionkey = r_regionkey")
def metadata_scan(spark, d):
    root = new_path(spark, "meta")
    write_text(spark, json.dumps({"fps": 10.0, "features": {"action": {"dtype": "float32", "shape": [7], "names": None}}}), f"{root}/{episodes.INFO}")
    nation = table(spark, d, "nation")
    nation.select(F.col("n_nationkey").alias("episode_index"), F.array("n_name", F.col("n_regionkey").cast("string")).alias("tasks")).write.json(f"{root}/{episodes.EPISODES}")
    table(spark, d, "region").select(F.col("r_regionkey").alias("task_index"), F.col("r_name").alias("task")).write.json(f"{root}/{episodes.TASKS}")
    meta = episodes.read_metadata(spark, root)
    made = meta["episodes"].select("episode_index", F.col("tasks")[0].alias("task"), F.col("tasks")[1].cast("long").alias("task_index"))
    out = made.join(small(meta["tasks"].withColumnRenamed("task", "region")), "task_index")
    return out.crossJoin(F.broadcast(meta["info"].select("fps"))).select("episode_index", "task", "task_index", "region", "fps")  # one row on the right


NAMES = "CASE n_nationkey % 6 WHEN 0 THEN 'observation.images.top' WHEN 1 THEN 'observation.environment_state' WHEN 2 THEN 'observation.state' WHEN 3 THEN 'action.arm' WHEN 4 THEN 'action' ELSE 'timestamp' END"


def _features(spark, d):
    name = F.element_at(F.array(*[F.lit(x) for x in ("observation.images.top", "observation.environment_state", "observation.state", "action.arm", "action", "timestamp")]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    is_image = F.col("n_nationkey") % 6 == 0
    shape = F.when(is_image, F.array(F.lit(224), F.col("n_nationkey").cast("int"), F.lit(3))).otherwise(F.array(F.col("n_nationkey").cast("int")))
    names = F.when(is_image, F.array(F.lit("height"), F.lit("width"), F.lit("channel")))
    return table(spark, d, "nation").select("n_nationkey", name.alias("feature"), F.when(is_image, "video").otherwise("float32").alias("dtype"), shape.alias("shape"), names.alias("names"))


@query(f"SELECT n_nationkey, {NAMES} AS feature, CASE n_nationkey % 6 WHEN 0 THEN 'VISUAL' WHEN 1 THEN 'ENV' WHEN 2 THEN 'STATE' ELSE 'ACTION' END AS role, CASE WHEN n_nationkey % 6 = 0 THEN '3,224,' || n_nationkey ELSE n_nationkey::VARCHAR END AS shape FROM nation WHERE n_nationkey % 6 < 5")
def feature_roles(spark, d):
    return episodes.with_roles(_features(spark, d)).select("n_nationkey", "feature", "role", F.array_join(F.transform("shape", lambda x: x.cast("string")), ",").alias("shape"))


@query("SELECT sum(n_nationkey)::BIGINT AS action_dims FROM nation WHERE n_nationkey % 6 IN (3, 4)")
def action_dims(spark, d):
    return episodes.action_dims(episodes.with_roles(_features(spark, d)))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def prefix_columns(spark, d):
    """Columns by prefix from a wider table."""
    wide = table(spark, d, "customer").withColumns({"other": F.lit(1), "x.c_odd": F.lit(2)})
    return wide.select(*episodes.columns_of(wide, "c_"))


@query("SELECT c_custkey AS \"observation.images.top\", c_acctbal AS \"observation.state\", -c_acctbal AS action, c_name AS task, c_acctbal < 0 AS action_is_pad, 'top' AS cam_names, c_nationkey AS steps_to_go FROM customer")
def ordered_columns(spark, d):
    df = table(spark, d, "customer").select(F.col("c_nationkey").alias("steps_to_go"), F.lit("top").alias("cam_names"), F.col("c_name").alias("task"), (F.col("c_acctbal") < 0).alias("action_is_pad"), (-F.col("c_acctbal")).alias("action"), F.col("c_acctbal").alias("observation.state"), F.col("c_custkey").alias("observation.images.top"))
    pick = lambda p: episodes.columns_of(df, p)
    return episodes.ordered(df, pick("observation.images"), pick("observation.state"), ["action"])


def _line_stats(spark, d):
    s = stats.exact_stats(lines(spark, d), ["dataset"]).withColumnRenamed("dataset", "feature")
    return s.select("feature", "dim", "min", "max", *rounded("mean", "std", places=4), *rounded("q01", "q99"))


STATS = "min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99"


@query(LINES + f" SELECT dataset AS feature, dim, {STATS} FROM x GROUP BY dataset, dim")
def stats_file(spark, d):
    """Statistics written to a file once and read back; a second write changes nothing."""
    path = f"{new_path(spark, 'stats')}/{stats_files.STATS}"
    found = _line_stats(spark, d)
    stats_files.write_stats(found, path)
    stats_files.write_stats(found.withColumn("mean", F.lit(0.0)), path)
    return stats_files.read_stats(spark, path)


@query(LINES + f", s AS (SELECT dataset AS feature, dim, {STATS} FROM x GROUP BY dataset, dim) SELECT feature, dim, CASE WHEN feature = 'A' THEN mean ELSE max END AS max, mean, CASE WHEN feature = 'A' THEN mean END AS relative FROM s WHERE feature <> 'R'")
def stats_relative(spark, d):
    """Statistics of state-relative actions replace those of feature A alone; a sub-map of features."""
    root = new_path(spark, "relative")
    found = _line_stats(spark, d)
    newer = stats_files.of_features(found, ["A"]).withColumn("max", F.col("mean")).withColumn("mean", F.lit(None).cast("double"))
    stats_files.write_stats(newer, f"{root}/{stats_files.RELATIVE.format(horizon=16)}")
    out = stats_files.of_features(stats_files.with_relative_actions(spark, root, 16, found), ["A", "N"])
    return out.select("feature", "dim", "max", "mean", F.when(F.col("feature") == "A", F.col("max")).alias("relative"))


@query(LINES + f", s AS (SELECT dataset, dim, {STATS} FROM x GROUP BY dataset, dim) SELECT dataset AS repo, 'action' AS feature, dim, mean, q99, 'QUANTILE' AS mode FROM s UNION ALL SELECT 'other', 'action', dim, mean, q99, 'QUANTILE' FROM s WHERE dataset = 'A'")
def model_stats(spark, d):
    """Statistics of several datasets in one file; an unknown dataset gets those of the first."""
    path = f"{new_path(spark, 'model')}/{stats_files.MODEL}"
    found = _line_stats(spark, d).cache()
    names = ["A", "N", "R"]
    stats_files.write_model_stats(spark, path, {n: ({"action": "ACTION"}, found.where(F.col("feature") == n).withColumn("feature", F.lit("action"))) for n in names}, "QUANTILE")
    parts = {}
    for n in [*names, "other"]:
        s, _, mode = stats_files.read_model_stats(spark, path, n)
        parts[n] = s.select("feature", "dim", "mean", "q99", F.lit(mode).alias("mode"))
    found.unpersist()
    return rows.union_all(parts, "repo").select("repo", "feature", "dim", "mean", "q99", "mode")


@query("SELECT lang || ': ' || count(*) || ' episodes, ' || round(avg(quality) * 100, 1) || ' %' AS value FROM documents JOIN labels USING (doc_id) GROUP BY lang UNION ALL SELECT 'total: ' || count(*) || ' episodes, ' || round(avg(quality) * 100, 1) || ' %' FROM documents JOIN labels USING (doc_id)")
def eval_report(spark, d):
    """Success rates as lines of a text file, read back."""
    x = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    path = new_path(spark, "report")
    metrics.report(metrics.success_rate(x, "lang", F.col("quality") == 1), "lang").coalesce(1).orderBy("is_total", "value").select("value").write.text(path)
    return spark.read.text(path)


@query("SELECT event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def metric_log(spark, d):
    """Two appends to one log."""
    path = new_path(spark, "log")
    e = table(spark, d, "events").select(F.col("event_type").alias("name"), "value", "event_id")
    metrics.append_log(e.where("event_id % 2 = 0"), path)
    log = metrics.append_log(e.where("event_id % 2 <> 0"), path)
    return log.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place FROM documents WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 96)")
def replay_batches(spark, d):
    """The first 96 rows recorded (a report of fixed size), then replayed in a seeded order."""
    path = new_path(spark, "recorded")
    rows.sample(table(spark, d, "documents").select("doc_id"), "first:96", ["doc_id"]).write.parquet(path)
    return rows.numbered(spark.read.parquet(path), [*rows.shuffled(["doc_id"], 7), "doc_id"], "place").select("doc_id", *long("place"))


MASKS = "VALUES ('libero_panda', [true, true, true, true, true, true, false]), ('flexiv', [true, true, true, true, true, true, true, false])"


@query(f"SELECT c_custkey, tag, d::BIGINT AS dim, mask[d + 1] AS relative FROM customer JOIN (SELECT * FROM ({MASKS}) t(tag, mask)) ON tag = CASE WHEN c_nationkey % 2 = 0 THEN 'libero_panda' ELSE 'flexiv' END, (SELECT unnest(range(7)) AS d)")
def embodiment_masks(spark, d):
    tags = catalog.masks(spark)
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "libero_panda").otherwise("flexiv").alias("tag"))
    return catalog.with_mask(c, tags, 7).select("c_custkey", "tag", F.posexplode("mask").alias("dim", "relative")).select("c_custkey", "tag", *long("dim"), "relative")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'http://h/' || doc_id ELSE '/base/' || source || '/' || doc_id || '.png' END AS path FROM documents")
def media_base_path(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    base = docs.select("source").distinct().withColumn("base", F.concat(F.lit("/base/"), "source"))
    path = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".png")))
    return rows.based_paths(docs.withColumn("path", path), base, "source", "path").select("doc_id", "path")


@query("SELECT n_nationkey, 10 * n_nationkey + 3 AS end_frame, n_name AS text, 0::BIGINT AS segment FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT n_nationkey, 100 * n_nationkey + 12, lower(n_name), 1 FROM nation WHERE n_nationkey % 3 < 2")
def subtask_boundaries(spark, d):
    """action_config in both shapes; a third of the rows has neither."""
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    low, high = (F.col("n_nationkey") * 10 + 3).cast("string"), F.concat(F.lit("frame "), key, F.lit("-1b2"))
    listed = F.concat(F.lit('[{"end_frame": '), low, F.lit(', "action_text": "'), name, F.lit('"}, {"end_frame": "'), high, F.lit('", "action_text": "'), F.lower(name), F.lit('"}, {"end_frame": "x", "action_text": "gone"}]'))
    steps = F.concat(F.lit('{"steps": [{"end_frame": "at '), low, F.lit('", "step_description": "'), name, F.lit('"}, {"end_frame": "'), high, F.lit('", "step_description": "'), F.lower(name), F.lit('"}]}'))
    config = F.when(F.col("n_nationkey") % 3 == 0, listed).when(F.col("n_nationkey") % 3 == 1, steps).otherwise(F.lit("none"))
    found = table(spark, d, "nation").select("n_nationkey", F.posexplode(subtasks.boundaries(config)).alias("segment", "s"))
    return found.select("n_nationkey", "s.end_frame", "s.text", *long("segment"))


@query("WITH s AS (SELECT event_type, min(value) AS lo, max(value) AS hi, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM events GROUP BY event_type), y AS (SELECT event_id, value, (value - mean) / (std + 1e-8) * std + mean AS a, (2.0 * (value - lo) / (hi - lo + 1e-8) - 1 + 1) / 2.0 * (hi - lo) + lo AS b, (2.0 * (value - q01) / (q99 - q01 + 1e-8) - 1 + 1) / 2.0 * (q99 - q01) + q01 AS c FROM events JOIN s USING (event_type)) SELECT event_id, round(a, 5) AS mean_std, round(b, 5) AS min_max, round(c, 5) AS quantile, value AS same FROM y")
def unnormalize_modes(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    s = stats.exact_stats(e.select("event_type", F.lit(0).cast("long").alias("dim"), F.col("value").alias("x")), ["event_type"])
    x, cols = F.col("value"), {c: F.col(f"s_{c}") for c in ("min", "max", "mean", "std", "q01", "q99")}
    both = lambda mode: V.normalise(mode, V.normalise(mode, x, cols), cols, undo=True)
    joined = e.join(small(s.select("event_type", *[F.col(c).alias(f"s_{c}") for c in cols])), "event_type")
    return joined.select("event_id", F.round(both("MEAN_STD"), 5).alias("mean_std"), F.round(both("MIN_MAX"), 5).alias("min_max"), F.round(both("QUANTILE"), 5).alias("quantile"), both("IDENTITY").alias("same"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'user' WHEN turn % 3 = 1 THEN 'assistant' ELSE role END AS role, 'see' || CASE WHEN conv_id % 3 = 1 THEN '  <image>' || chr(10) || 'or<|vision_start|><|image_pad|><|vision_end|> ' ELSE '<|vision_start|><|image_pad|><|vision_end|>or  <video>' || chr(10) || ' ' END || 'then<|action_pad|>' || text AS content, CASE conv_id % 3 WHEN 0 THEN '/base/' || conv_id || '.png' WHEN 1 THEN 'http://v/' || conv_id || '.mp4' END AS media FROM conversations")
def instruction_records(spark, d):
    """JSON-lines records with images, videos or neither: roles, tags and media paths."""
    path = f"{new_path(spark, 'records')}.jsonl"
    c = table(spark, d, "conversations")
    name = F.when(F.col("turn") % 3 == 0, "human").when(F.col("turn") % 3 == 1, "gpt").otherwise(F.col("role"))
    value = F.concat(F.lit("see  <image>\nor  <video>\n then <action>\n"), "text")
    kind, key = F.col("conv_id") % 3, F.col("conv_id").cast("string")
    record = F.struct(F.array(F.struct(name.alias("from"), value.alias("value"))).alias("conversations"), F.when(kind == 0, F.concat(key, F.lit(".png"))).alias("image"), F.when(kind == 1, F.array(F.concat(F.lit("http://v/"), key, F.lit(".mp4")))).alias("video"), (F.col("conv_id") * 1000 + F.col("turn")).cast("int").alias("num_tokens"))
    c.select(F.to_json(record)).write.text(path)
    out = instructions.media_paths(instructions.turns(instructions.read_instructions(spark, path)), "/base")
    out = out.select(F.floor(F.col("num_tokens") / 1000).alias("conv_id"), (F.col("num_tokens") % 1000).cast("long").alias("turn"), F.explode("turns").alias("t"), F.get("media", F.lit(0)).alias("media"))
    return out.select("conv_id", "turn", "t.role", "t.content", "media")
