"""Queries over packs, lengths and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from episodica.operators import bins, packs, rows, stats, subtasks
from episodica.plans.registry import CAPACITY, FRAMES, LINES, ORACLE_SQL, events_as_frames, lines, long, query, rounded
from episodica.sources.shared import new_path
from episodica.sources.tables import table

PACKED = "WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), p AS (SELECT source, doc_id, n_chars, r, 0 AS bin, n_chars AS load FROM o WHERE r = 1 UNION ALL SELECT o.source, o.doc_id, o.n_chars, o.r, CASE WHEN p.load + o.n_chars > 8192 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.load + o.n_chars > 8192 THEN o.n_chars ELSE p.load + o.n_chars END FROM p JOIN o ON o.source = p.source AND o.r = p.r + 1), k AS (SELECT source, bin, sum(n_chars) AS size, count(*) AS items, row_number() OVER (ORDER BY source, bin) - 1 AS package_id FROM p GROUP BY source, bin)"


def _packs(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return packs.pack_table(bins.next_fit(docs, "n_chars", "source", ["doc_id"], CAPACITY), ["source", "bin"], ["doc_id"], "doc_id", "n_chars")


@query(PACKED + " SELECT k.package_id::BIGINT AS package_id, k.size::BIGINT AS package_size, k.items::BIGINT AS indices_count, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS indices FROM k JOIN p USING (source, bin) GROUP BY ALL")
def pack_table(spark, d):
    """Packs written with their sidecar and read back."""
    path = new_path(spark, "packs")
    packs.write_packs(_packs(spark, d), path, capacity=CAPACITY, seed=42)
    found, about = packs.read_packs(spark, path)
    if about["packs"] != found.count() or about["capacity"] != CAPACITY:
        raise ValueError("the sidecar doesn't belong to the table")
    return found.select("package_id", *long("package_size", "indices_count"), F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"))


@query(PACKED + " SELECT count(*) AS packs, sum(items)::BIGINT AS items, sum(size)::BIGINT AS total, round(avg(size), 4) AS average, max(size)::BIGINT AS largest, min(size)::BIGINT AS least, round(stddev_pop(size), 4) AS std, true AS sound FROM k")
def pack_info(spark, d):
    made = _packs(spark, d)
    both = packs.info(made).crossJoin(packs.check(made).select("sound"))  # one row on either side
    return both.select("packs", "items", "total", F.round("average", 4).alias("average"), "largest", "least", F.round("std", 4).alias("std"), "sound")


@query(PACKED + ", m AS (SELECT package_id, size FROM k UNION ALL SELECT package_id + (SELECT count(*) FROM k), size FROM k WHERE package_id < 5) SELECT package_id::BIGINT AS package_id, size::BIGINT AS package_size FROM m")
def pack_merge(spark, d):
    made = _packs(spark, d)
    return packs.merge(made, packs.of_packs(made, list(range(5)))).select("package_id", *long("package_size"))


U01 = "(('0x' || substr(md5('42:' || {}), 1, 8))::BIGINT + 1)::DOUBLE / 4294967297.0"


@query(PACKED + f", s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents WHERE n_chars < 200), m AS (SELECT count(*) AS m FROM s), x AS (SELECT k.package_id, min(doc_id) AS low, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM k JOIN p USING (source, bin) GROUP BY k.package_id) SELECT package_id::BIGINT AS package_id, CASE WHEN low >= 300 THEN ids || ',' || s.doc_id ELSE ids END AS indices FROM x, m LEFT JOIN s ON s.k = floor({U01.format('package_id::VARCHAR')} * m)")
def pack_complete(spark, d):
    """Packs without a row of id below 300 get a short one more."""
    short = rows.short_rows(table(spark, d, "documents"), "n_chars", 200)
    out = packs.complete(_packs(spark, d), short, "doc_id", 300)
    return out.select("package_id", F.array_join(F.transform("indices", lambda x: x.cast("string")), ",").alias("indices"))


@query("SELECT doc_id FROM documents WHERE n_chars < 200")
def short_rows(spark, d):
    return rows.short_rows(table(spark, d, "documents"), "n_chars", 200).select("doc_id")


@query("WITH s AS (SELECT p_partkey, p_partkey * 10 AS lo, p_partkey * 10 + p_size % 4 AS hi, p_size AS len FROM part), w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_partkey * 10 + l_linenumber % 2 AS idx FROM lineitem WHERE l_partkey > 3) SELECT l_orderkey, l_linenumber, l_partkey, idx::BIGINT AS idx, CASE WHEN idx % 2 = 1 THEN 7 ELSE len END::BIGINT AS length FROM w JOIN s ON idx BETWEEN lo AND hi")
def rle_lookup(spark, d):
    """Lengths by index: odd ones from the dense table, the others from run-length segments."""
    part = table(spark, d, "part")
    segments = part.select((F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + F.col("p_size") % 4).alias("end"), F.col("p_size").cast("long").alias("len"))
    inside = rows.expand_segments(segments).select("idx")
    dense = inside.where("idx % 2 = 1").select("idx", F.lit(7).cast("long").alias("len"))
    wanted = table(spark, d, "lineitem").where("l_partkey > 3").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") * 10 + F.col("l_linenumber") % 2).cast("long").alias("idx"))
    wanted = wanted.join(inside, "idx", "left_semi")
    return rows.lookup_lengths(wanted, "idx", dense, segments).select("l_orderkey", "l_linenumber", "l_partkey", "idx", "length")


@query(FRAMES + " SELECT o_orderkey, f.event_id, f.value FROM orders JOIN f ON f.episode_index = o_custkey % 50 + 1 AND f.frame_index = o_orderkey % 20 WHERE EXISTS (SELECT 1 FROM f g WHERE g.episode_index = o_custkey % 50 + 1 AND g.n > 20)")
def point_lookup(spark, d):
    """Frames by dataset, episode and frame."""
    frames = events_as_frames(spark, d).withColumn("dataset", F.lit("events"))
    wanted = table(spark, d, "orders").select("o_orderkey", F.lit("events").alias("dataset"), (F.col("o_custkey") % 50 + 1).alias("episode_index"), (F.col("o_orderkey") % 20).alias("frame_index"))
    wanted = wanted.join(frames.where("episode_length > 20").select("episode_index").distinct(), "episode_index", "left_semi")
    return rows.point_lookup(wanted, frames).select("o_orderkey", "event_id", "value")


@query(FRAMES + " SELECT conv_id, turn, event_id FROM conversations JOIN f ON f.episode_index = conv_id % 40 + 1 AND f.frame_index = turn")
def interleaved_frames(spark, d):
    """Instruction rows that name a frame of a trajectory."""
    c = table(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") % 40 + 1).alias("episode_index"), F.col("turn").alias("frame_index"))
    return c.join(events_as_frames(spark, d).select("episode_index", "frame_index", "event_id"), ["episode_index", "frame_index"]).select("conv_id", "turn", "event_id")


@query("WITH x AS (SELECT e.event_id, v.value, v.ts, v.event_id AS vid, abs(epoch_us(v.ts) - epoch_us(e.ts)) AS gap, v.ts > e.ts AS later FROM events e JOIN events v ON v.user_id = e.user_id AND v.event_type = 'view' WHERE e.event_type <> 'view'), n AS (SELECT event_id, value, row_number() OVER (PARTITION BY event_id ORDER BY gap, later) AS r FROM x WHERE gap <= 21600000000) SELECT e.event_id, round(n.value, 6) AS near_value FROM events e LEFT JOIN n ON n.event_id = e.event_id AND n.r = 1 WHERE e.event_type <> 'view'")
def nearest_frame(spark, d):
    e = table(spark, d, "events")
    out = rows.nearest_in_time(e.where("event_type <> 'view'"), e.where("event_type = 'view'"), "user_id", "ts", 6 * 3600, "value", both_sides=True)
    return out.select("event_id", F.round("near_value", 6).alias("near_value"))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS place FROM documents")
def global_shuffle(spark, d):
    return rows.numbered(table(spark, d, "documents").select("doc_id"), [*rows.shuffled(["doc_id"], 42), "doc_id"], "place").select("doc_id", *long("place"))


@query("SELECT DISTINCT source AS dataset FROM documents UNION SELECT 'events'")
def dataset_names(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("dataset"))
    return docs.union(table(spark, d, "events").select(F.lit("events"))).distinct()


@query("WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents) SELECT count(*) AS items, sum(n_chars)::BIGINT AS total, true AS sound FROM o")
def pack_shuffled(spark, d):
    """Shuffled next fit in megabatches keeps every row, and no pack of several rows exceeds the capacity."""
    packed = bins.pack_by_size(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", CAPACITY, "streaming")
    loads = bins.loads(packed, "megabatch", "n_chars")
    return loads.agg(F.sum("items").cast("long").alias("items"), F.sum("load").cast("long").alias("total"), F.bool_and((F.col("load") <= CAPACITY) | (F.col("items") == 1)).alias("sound"))


STREAMED = "WITH RECURSIVE n AS (SELECT greatest(1, (count(*) + 299) // 300) AS n FROM documents), g AS (SELECT doc_id, n_chars, md5('42:' || doc_id) AS h, ('0x' || substr(md5('42:' || doc_id), 9, 8))::BIGINT % n AS g FROM documents, n), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY h, doc_id) AS r FROM g), p AS (SELECT g, doc_id, n_chars, r, 0 AS bin, n_chars AS load FROM o WHERE r = 1 UNION ALL SELECT o.g, o.doc_id, o.n_chars, o.r, CASE WHEN p.load + o.n_chars > 8192 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.load + o.n_chars > 8192 THEN o.n_chars ELSE p.load + o.n_chars END FROM p JOIN o ON o.g = p.g AND o.r = p.r + 1)"


@query(STREAMED + " SELECT g AS megabatch, doc_id, bin::BIGINT AS bin FROM p")
def pack_streaming(spark, d):
    """Next fit in a seeded order, in megabatches of about 300 rows that are packed side by side."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return bins.shuffled_next_fit(docs, "n_chars", "doc_id", CAPACITY, rows=300).select("megabatch", "doc_id", "bin")


@query("WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents), p AS (SELECT doc_id, n_chars, r, 0 AS bin, n_chars AS load FROM o WHERE r = 1 UNION ALL SELECT o.doc_id, o.n_chars, o.r, CASE WHEN p.load + o.n_chars > 8192 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.load + o.n_chars > 8192 THEN o.n_chars ELSE p.load + o.n_chars END FROM p JOIN o ON o.r = p.r + 1) SELECT doc_id, bin::BIGINT AS bin FROM p")
def pack_shuffled_whole(spark, d):
    """Exact next fit over all rows in a seeded order: one sequence of packs, block by block."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", F.lit(0).alias("all"), rows.shuffled(["doc_id"], 42)[0].alias("order"))
    return bins.next_fit(docs, "n_chars", "all", ["order", "doc_id"], CAPACITY, block_rows=500).select("doc_id", "bin")


HALF = "SELECT l_returnflag AS dataset, l_linenumber % 2 AS half, unnest([0, 1, 2, 3]) AS dim, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem"


@query(f"WITH x AS ({HALF}), s AS (SELECT dataset, dim, half, min(x) AS lo, max(x) AS hi FROM x GROUP BY ALL), t AS (SELECT dataset, dim, min(lo) AS lo, max(hi) AS hi FROM s GROUP BY ALL), b AS (SELECT x.dataset, x.dim, half, CASE WHEN s.hi > s.lo THEN least(floor((x - s.lo) / ((s.hi - s.lo) / 5000)), 4999) ELSE 0 END AS bin, count(*) AS c FROM x JOIN s USING (dataset, dim, half) GROUP BY ALL), r AS (SELECT b.dataset, b.dim, CASE WHEN t.hi > t.lo THEN least(floor((s.lo + b.bin * ((s.hi - s.lo) / 5000) - t.lo) / ((t.hi - t.lo) / 5000)), 4999) ELSE 0 END AS bin, sum(c) AS c FROM b JOIN s USING (dataset, dim, half) JOIN t ON t.dataset = b.dataset AND t.dim = b.dim GROUP BY ALL), u AS (SELECT *, sum(c) OVER (PARTITION BY dataset, dim ORDER BY bin) AS cum, sum(c) OVER (PARTITION BY dataset, dim) AS n FROM r), m AS (SELECT dataset, dim, avg(x) AS mean FROM x GROUP BY ALL) SELECT u.dataset, u.dim, any_value(n)::BIGINT AS n, round(any_value(mean), 4) AS mean, round(min(CASE WHEN cum >= 0.01 * n THEN t.lo + bin * ((t.hi - t.lo) / 5000) END), 6) AS q01, round(min(CASE WHEN cum >= 0.99 * n THEN t.lo + bin * ((t.hi - t.lo) / 5000) END), 6) AS q99 FROM u JOIN t ON t.dataset = u.dataset AND t.dim = u.dim JOIN m ON m.dataset = u.dataset AND m.dim = u.dim GROUP BY u.dataset, u.dim")
def running_stats_merge(spark, d):
    """Histogram states of two halves, binned anew to their common range and merged."""
    x = stats.dims(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_linenumber") % 2).alias("half"), F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("v")), "v", ["dataset", "half"])
    states = stats.histogram_states(x, ["dataset", "half"])
    out = stats.state_quantiles(stats.merge_states(states, ["dataset", "dim"]), ["dataset", "dim"])
    return out.select("dataset", "dim", "n", *rounded("mean", places=4), *rounded("q01", "q99"))


@query(f"SELECT event_id, CASE WHEN {U01.format('event_id::VARCHAR')} < 0.3 OR event_type = 'view' THEN event_type ELSE 'view' END AS text, CASE WHEN {U01.format('event_id::VARCHAR')} < 0.3 AND event_type <> 'view' THEN 1 ELSE 2 END::BIGINT AS steps FROM events")
def mixture_steps(spark, d):
    """A mixture of subtask and task with their steps; the weight comes from the mode's text."""
    s = subtasks.mixture_steps(F.col("event_id"), F.col("event_type"), F.lit(1), F.lit("view"), F.lit(2), subtasks.mixture_weight("mixture:0.3"))
    return table(spark, d, "events").select("event_id", s.alias("s")).select("event_id", "s.text", F.col("s.steps").cast("long").alias("steps"))


@query(PACKED + ", l AS (SELECT 100.0 * size / 8192 AS u, size FROM k ORDER BY md5('42:' || source || ':' || bin), source, bin LIMIT 10) SELECT count(*) AS bins, round(avg(u), 4) AS utilisation, sum((size > 8192)::INT)::BIGINT AS overflow FROM l")
def pack_quality_sample(spark, d):
    """The quality report of ten packs drawn at random (a report of fixed size)."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    loads = bins.loads(bins.next_fit(docs, "n_chars", "source", ["doc_id"], CAPACITY), "source", "n_chars")
    return bins.quality(rows.sample(loads, "random:10", ["source", "bin"]), CAPACITY).select("bins", F.round("utilisation", 4).alias("utilisation"), "overflow")
