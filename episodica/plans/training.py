"""Queries that go from a catalogue of datasets to training rows, over recorded batches, and over streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from episodica.operators import stats, training
from episodica.plans.registry import FRAMES, ORACLE_SQL, events_as_frames, line_vector, long, query, rounded
from episodica.sources import catalog, episodes, recorded, stats_files
from episodica.sources.shared import exists, new_path, read_text, write_table, write_text
from episodica.sources.tables import table
from episodica.streaming.running import RunningStatistics

INFO = {"fps": 10.0, "features": {"observation.images.top": {"dtype": "video", "shape": [224, 224, 3], "names": ["height", "width", "channels"]}, "observation.state": {"dtype": "float32", "shape": [2], "names": None}, "action": {"dtype": "float32", "shape": [2], "names": None}}}
TASKS = [(0, " Pick UP the cup.. "), (1, ""), (2, "open the drawer")]


def _dataset(spark, frames, root: str, odd: int) -> None:
    """The events of users with even or odd ids as a dataset on disk: frames by chunk of episodes, metadata."""
    frames = frames.where(F.col("episode_index") % 2 == odd)
    value = F.col("value")
    made = frames.select("episode_index", "frame_index", (F.col("event_id") % 3).alias("task_index"), F.array(value, value / 2).alias("observation.state"), F.array(value * 2, -value).alias("action"), F.floor(F.col("episode_index") / 1000).alias("chunk"))
    # by range, so that a task writes into few chunks: no more files than tasks and chunks together
    made.repartitionByRange("episode_index", "frame_index").write.partitionBy("chunk").parquet(f"{root}/data")
    write_text(spark, json.dumps(INFO), f"{root}/{episodes.INFO}")
    name = F.concat(F.lit("episode "), F.col("episode_index").cast("string"))
    half = F.floor(F.col("episode_length") / 2).cast("string")
    config = F.concat(F.lit('[{"end_frame": '), half, F.lit(', "action_text": "begin"}, {"end_frame": '), F.col("episode_length").cast("string"), F.lit(', "action_text": "finish"}]'))
    frames.select("episode_index", "episode_length").distinct().select("episode_index", F.array(name).alias("tasks"), F.when(F.lit(odd == 1), config).alias("action_config")).write.json(f"{root}/{episodes.EPISODES}")
    spark.createDataFrame(TASKS, episodes.TASK_SCHEMA).write.json(f"{root}/{episodes.TASKS}")


def _catalogue(spark, d, odd_options: str = "train_subtask: true", strategy: str = "first:10") -> str:
    root = new_path(spark, "catalogue")
    frames = write_table(events_as_frames(spark, d).select("event_id", "episode_index", "frame_index", "episode_length", "value"), "frames")
    for name, odd in (("even", 0), ("odd", 1)):
        _dataset(spark, frames, f"{root}/{name}", odd)
    lines = ["lerobot_datasets:", f"- {{repo_id: even, root: '{root}/even', state_mode: MIN_MAX}}", f"- {{repo_id: gone, root: '{root}/gone'}}", f"- {{repo_id: odd, root: '{root}/odd', {odd_options}}}", f"mm_datasets:\n- {{name: talks, json_path: '{root}/talks.jsonl', sampling_strategy: '{strategy}', vision_base_path: '/media'}}"]
    write_text(spark, "\n".join(lines), f"{root}/all.yaml")
    return f"{root}/all.yaml"


ROWS = FRAMES + ", g AS (SELECT *, CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM f), s AS (SELECT dataset, min(2 * value) AS lo, max(2 * value) AS hi, avg(2 * value) AS mean, stddev_pop(2 * value) AS std, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.99) AS q99 FROM g GROUP BY dataset), c AS (SELECT a.dataset, a.episode_index, a.frame_index, sum(CASE WHEN a.dataset = 'even' THEN 2 * (2 * b.value - lo) / (hi - lo + 1e-8) - 1 ELSE (2 * b.value - mean) / (std + 1e-8) END) AS total, sum((a.frame_index + d.delta >= a.n)::INT)::BIGINT AS pads FROM g a CROSS JOIN (SELECT unnest(range(16)) AS delta) d JOIN g b ON a.episode_index = b.episode_index AND b.frame_index = least(a.frame_index + d.delta, a.n - 1) JOIN s ON s.dataset = a.dataset GROUP BY ALL), t AS (SELECT g.*, CASE WHEN dataset = 'odd' THEN CASE WHEN frame_index < n // 2 THEN 'Begin.' ELSE 'Finish.' END WHEN event_id % 3 = 0 THEN 'Pick up the cup.' WHEN event_id % 3 = 1 THEN 'Episode ' || episode_index || '.' ELSE 'Open the drawer.' END AS task, CASE WHEN dataset = 'odd' THEN CASE WHEN frame_index < n // 2 THEN n // 2 - frame_index ELSE n - frame_index END ELSE n - 1 - frame_index END AS steps FROM g), b AS (SELECT t.*, greatest(-1, least(1000, trunc((2 * (value - q01) / (q99 - q01 + 1e-8) - 1 + 1.0) / 2.0 * 1000.0)::BIGINT)) AS bin1 FROM t JOIN s USING (dataset))"


@query(ROWS + " SELECT b.dataset, b.episode_index::BIGINT AS episode_index, b.frame_index::BIGINT AS frame_index, task, round(total, 3) AS total, pads, steps::BIGINT AS steps_to_go, round(pow(0.99, steps), 6) AS weight, 2::BIGINT AS dims, 48::BIGINT AS width, 'Top' AS camera, bin1 AS bin FROM b JOIN c USING (dataset, episode_index, frame_index)")
def training_rows(spark, d):
    """A catalogue of two datasets (and one that isn't there) read to training rows."""
    found, skipped = training.training_rows(spark, _catalogue(spark, d))
    if [x.repo_id for x, _ in skipped] != ["gone"]:
        raise ValueError(f"skipped {skipped}")
    total = F.aggregate("actions", F.lit(0.0), lambda s, a: s + F.get(a, F.lit(0)))
    pads = F.size(F.filter("action_is_pad", lambda x: x))
    width = F.array_max(F.transform("actions", F.size))
    camera = F.regexp_extract("prompt", r"^Camera ([a-z]+): <\|vision_start\|>", 1)
    out = found.select("dataset", *long("episode_index", "frame_index"), "task", F.round(total, 3).alias("total"), pads.cast("long").alias("pads"), *long("steps_to_go"), F.round("weight", 6).alias("weight"), F.aggregate("action_dof_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("dims"), width.cast("long").alias("width"), F.initcap(camera).alias("camera"), F.element_at("state_bins", 1).cast("long").alias("bin"))
    return out


TALKS = ", z AS (SELECT conv_id, list(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE role END ORDER BY turn) AS r, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id), y AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS record FROM z), w AS (SELECT *, row_number() OVER (ORDER BY record) AS k, count(*) OVER () AS n FROM y WHERE conv_id % 7 * 1000 <= 5120), v AS (SELECT *, unnest(range(len(t) // 2)) AS i FROM w WHERE k <= (60 * n + 99) // 100)"


@query(ROWS + TALKS + " SELECT 'trajectory' AS kind, dataset, episode_index::BIGINT AS a, frame_index::BIGINT AS b, task AS text, NULL AS media FROM t UNION ALL SELECT 'instruction', 'talks', record, i, CASE WHEN i = 0 THEN '<|im_start|>system' || chr(10) || 'Be brief.<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>' || r[2 * i + 1] || chr(10) || t[2 * i + 1] || '<|im_end|>' || chr(10) || '<|im_start|>' || r[2 * i + 2] || chr(10) || CASE WHEN t[2 * i + 2] = '' THEN '' ELSE t[2 * i + 2] || '<|im_end|>' || chr(10) END, CASE WHEN conv_id % 2 = 0 THEN '/media/' || conv_id || '.png' END FROM v")
def catalog_samples(spark, d):
    """Instruction and trajectory rows of one catalogue; a row for each chat pair and for each frame."""
    path = _catalogue(spark, d, strategy="first:60%")
    turn = F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))
    talks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    record = F.struct(F.transform("t", lambda x: x.dropFields("turn")).alias("conversations"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.col("conv_id").cast("string"), F.lit(".png"))).alias("image"), (F.col("conv_id") % 7 * 1000).alias("num_tokens"))
    talks.orderBy("conv_id").select(F.to_json(record)).write.text(f"{path.removesuffix('all.yaml')}talks.jsonl")
    found, skipped = training.sample_rows(spark, path, system="Be brief.", odd="drop")
    if [x.repo_id for x, _ in skipped] != ["gone"]:
        raise ValueError(f"skipped {skipped}")
    out = found.select("kind", "dataset", "record", "episode_index", "frame_index", "task", F.get("media", F.lit(0)).alias("media"), F.posexplode_outer("pairs").alias("i", "p"))
    out = out.where("kind = 'trajectory' or i is not null")
    return out.select("kind", "dataset", F.coalesce("record", "episode_index").alias("a"), F.coalesce(F.col("i").cast("long"), "frame_index").alias("b"), F.coalesce(F.concat("p.prompt", "p.answer"), "task").alias("text"), "media")


STEPS = FRAMES + ", g AS (SELECT *, CASE WHEN episode_index % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset FROM f), x AS (SELECT dataset, 'absolute' AS kind, unnest(['observation.state', 'observation.state', 'action', 'action']) AS feature, unnest([0, 1, 0, 1]) AS dim, unnest([value, value / 2, value * 2, -value]) AS x FROM g UNION ALL SELECT 'odd', 'relative', unnest(['action', 'action']), unnest([0, 1]), unnest([b.value * 2 - a.value, -b.value - a.value / 2]) FROM g a CROSS JOIN (SELECT unnest(range(16)) AS delta) d JOIN g b ON b.episode_index = a.episode_index AND b.frame_index = a.frame_index + d.delta WHERE a.dataset = 'odd')"


@query(STEPS + " SELECT dataset, kind, feature, dim::BIGINT AS dim, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, round(quantile_cont(x, 0.01), 6) AS q01, round(quantile_cont(x, 0.99), 6) AS q99 FROM x GROUP BY ALL")
def catalog_statistics(spark, d):
    """Statistics files of a catalogue's datasets, one of them with actions relative to the state, made and read back."""
    found, skipped = training.compute_statistics(spark, _catalogue(spark, d, "state_relative_action: true, embodiment_tag: libero_panda"))
    if [x.repo_id for x, _ in skipped] != ["gone"]:
        raise ValueError(f"skipped {skipped}")
    return found.select("dataset", "kind", "feature", "dim", *rounded("mean", "std", places=4), *rounded("min", "max", "q01", "q99"))


@query("SELECT * FROM (VALUES ('even', 'trajectory', 'MIN_MAX', false), ('gone', 'trajectory', 'MEAN_STD', false), ('odd', 'trajectory', 'MEAN_STD', true), ('talks', 'instruction', 'first:10', false)) t(name, kind, mode, subtask) CROSS JOIN (SELECT count(DISTINCT user_id % 2) AS parts FROM events)")
def catalog_datasets(spark, d):
    """The datasets of a catalogue, with how many of its folders hold frames."""
    path = _catalogue(spark, d)
    found = catalog.read_catalog(path, spark=spark)
    rows = [(x.repo_id, "trajectory", x.state_mode, bool(x.train_subtask)) for x in found.lerobot_datasets] + [(x.name, "instruction", x.sampling_strategy, False) for x in found.mm_datasets]
    alone = catalog.read_catalog(path, trajectory_only=True, instruction_only=True, spark=spark)
    if alone.mm_datasets or len(alone.lerobot_datasets) != 3 or catalog.read_catalog("one").lerobot_datasets[0].repo_id != "one":
        raise ValueError("flags and single datasets of a catalogue")
    parts = sum(exists(spark, f"{x.root}/data") for x in found.lerobot_datasets)
    return spark.createDataFrame(rows, "name string, kind string, mode string, subtask boolean").withColumn("parts", F.lit(parts).cast("long"))


@query("SELECT 'even' AS dataset, count(*) FILTER (WHERE user_id % 2 = 0) AS frames, true AS copied FROM events UNION ALL SELECT 'odd', count(*) FILTER (WHERE user_id % 2 = 1), true FROM events UNION ALL SELECT 'gone', NULL, true FROM events HAVING count(*) > 0")
def skipped_datasets(spark, d):
    """Frames of each dataset of a catalogue, null for those that can't be read; the catalogue is copied beside the result."""
    path = _catalogue(spark, d)
    datasets = catalog.read_catalog(path, spark=spark).lerobot_datasets
    found, skipped = episodes.load_all(datasets, lambda x: episodes.read_frames(spark, x.root).select(F.lit(x.repo_id).alias("dataset")))
    whole = found[0].union(found[1]).groupBy("dataset").agg(F.count("*").alias("frames"))
    lost = spark.createDataFrame([(x.repo_id, None) for x, _ in skipped], "dataset string, frames long")
    target = f"{new_path(spark, 'beside')}/catalogue.yaml"
    copied = episodes.copy_beside(spark, path, target) and read_text(spark, target) == read_text(spark, path)
    return whole.union(lost).withColumn("copied", F.lit(copied))


@query("SELECT 'events/' || event_type || '/mean' AS key, 'events.' || event_type || '.mean' AS name, 'events_' || replace(event_type, '.', '_') AS buffer, round(avg(value), 6) AS value FROM events GROUP BY event_type")
def flat_stats(spark, d):
    """Statistics by type as a nested tree, flattened, rebuilt and named; a row for each type."""
    found = table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")).collect()
    tree = {"events": {r["event_type"]: {"mean": r["mean"]} for r in found}}
    flat = stats_files.flatten(tree)
    if stats_files.unflatten(flat) != tree:
        raise ValueError("the tree changed")
    rows = [(k, stats_files.feature_name(k), stats_files.buffer_name(stats_files.feature_name(k).removesuffix(".mean")), v) for k, v in flat.items()]
    return spark.createDataFrame(rows, "key string, name string, buffer string, value double")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents), b AS (SELECT doc_id, (p // 16 % 4)::BIGINT AS rank, p // 16 // 4 AS step, (p % 16)::BIGINT AS place FROM r), t AS (SELECT rank, step, row_number() OVER (PARTITION BY rank ORDER BY md5('7:0:' || step), step) - 1 AS turn FROM (SELECT DISTINCT rank, step FROM b)) SELECT doc_id, b.rank, turn, place FROM b JOIN t ON b.rank = t.rank AND b.step = t.step")
def replay_ranks(spark, d):
    """All documents recorded as batches of four ranks, and replayed by each from its own files: half of the turns, then the rest."""
    path = new_path(spark, "recorded")
    recorded.record(table(spark, d, "documents").select("doc_id"), path, ["doc_id"], 16, 4)
    parts = []
    for rank in range(4):
        whole = recorded.replay(spark, path, rank, seed=7)
        if whole is None:
            continue
        half = (whole.agg(F.max("turn")).first()[0] + 1) // 2
        rest = recorded.replay(spark, path, rank, seed=7, done=half)
        parts += [x.select("doc_id", F.lit(rank).cast("long").alias("rank"), *long("turn", "place")) for x in (whole.where(F.col("turn") < half), rest)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query(ORACLE_SQL["running_stats_merge"])
def running_stats_stream(spark, d):
    """Order lines streamed in two halves, the second after a restart; the states of the stream are merged histograms."""
    path = new_path(spark, "stream")
    vector = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_linenumber") % 2).alias("half"), line_vector().alias("v"))
    for half in (0, 1):
        vector.where(F.col("half") == half).drop("half").write.mode("append").parquet(f"{path}/in")
        rows = spark.readStream.schema("dataset string, v array<double>").parquet(f"{path}/in")
        RunningStatistics(spark, path, ["dataset"]).run(stats.dims(rows, "v", ["dataset"]))
    out = RunningStatistics(spark, path, ["dataset"]).statistics()
    return out.select("dataset", "dim", "n", *rounded("mean", places=4), *rounded("q01", "q99"))
