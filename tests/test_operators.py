"""Golden cases of single operators."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.functions import positions as P
from episodica.functions import text as T
from episodica.functions import tokens as K
from episodica.functions import vectors as V
from episodica.operators import bins, packs, rows, stats, subtasks
from episodica.sources import catalog, episodes, instructions, stats_files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_next_fit():
    assert bins._next_fit([1, 3, 2, 2, 6, 4, 2, 6, 5], 10) == [0, 0, 0, 0, 1, 1, 2, 2, 3]
    assert bins._next_fit([4, 12, 3], 10) == [0, 1, 2]
    assert bins._next_fit([], 10) == []


def test_worst_fit():
    lengths = [6, 5, 4, 3, 2, 12]
    found = bins._worst_fit(lengths, 10)
    loads = sorted(sum(n for n, b in zip(lengths, found) if b == k) for k in set(found))
    assert loads == [2, 9, 9, 12]


def test_position_index(spark):
    """The golden row: two text tokens and a start, an image of 4 x 4 merged by 2, an end and a text token."""
    grids = F.array(F.struct(F.lit(1).alias("t"), F.lit(4).alias("h"), F.lit(4).alias("w"), F.lit(1.0).alias("step")))
    found = P.positions(P.blocks_of(F.array(*[F.lit(x) for x in (1, 1, 5, 6, 6, 6, 6, 8, 1)]), grids, 6, 7, 5))
    got = one(spark, found)
    assert [p["t"] for p in got] == [0, 1, 2, 3, 3, 3, 3, 5, 6]
    assert [p["h"] for p in got] == [0, 1, 2, 3, 3, 4, 4, 5, 6]
    assert [p["w"] for p in got] == [0, 1, 2, 3, 4, 3, 4, 5, 6]
    assert one(spark, P.delta(found, F.lit(9))) == -2
    plain = P.positions(F.array(P.block(F.lit(0), F.lit(3), F.lit(4), F.lit(4)), P.block(F.lit(5), F.lit(0), F.lit(0), F.lit(0))))
    assert [p["t"] for p in one(spark, plain)] == [0] * 4 + [1] * 4 + [2] * 4 + [3, 4, 5, 6, 7]
    assert one(spark, P.positions(P.blocks_of(F.array().cast("array<int>"), grids, 6, 7, 5))) == []


def test_next_fit_in_blocks(spark):
    rng = random.Random(3)
    data = [(g, i, rng.choice([0, 1, 3, 7, 9, 10, 12, 40, None])) for g in ("a", "b", None) for i in range(157)]
    df = spark.createDataFrame(data, "g string, i long, n long")
    for rows_ in (1, 4, 25, 1000):
        got = {(r["g"], r["i"]): r["bin"] for r in bins.next_fit(df, "n", "g", ["i"], 10, rows_).collect()}
        for g in ("a", "b", None):
            assert [got[g, i] for i in range(157)] == bins._next_fit([n or 0 for x, _, n in data if x == g], 10)
    assert bins.next_fit(df.limit(0), "n", "g", ["i"], 10).count() == 0


def test_quantiles_without_groups_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = {0: rng.normal(size=501), 1: np.repeat([1.0, 2.0, 5.0], 40), 2: np.array([3.5]), 3: rng.integers(0, 9, 1000).astype(float)}
    df = spark.createDataFrame([("d" if k else None, k, float(v)) for k, vs in x.items() for v in vs], "g string, dim long, x double")
    for limit in (1 << 20, 0):
        monkeypatch.setattr(stats, "GROUP_VALUES", limit)
        for r in stats.exact_stats(df, ["g"], bins=7).collect():
            v = x[r["dim"]]
            assert [r["q01"], r["q99"]] == pytest.approx(np.quantile(v, [0.01, 0.99]).tolist())
            assert r["std"] == pytest.approx(v.std()) and r["min"] == v.min()


def test_spans_and_lengths(spark):
    spans = spark.createDataFrame([(0, 10, "a"), (10, 11, "b"), (500, 900, "c")], "start long, end long, name string")
    df = spark.createDataFrame([(0,), (9,), (10,), (11,), (500,), (899,), (900,), (None,)], "i long")
    assert sorted((r["i"], r["name"]) for r in rows.in_spans(df, "i", spans).collect()) == [(0, "a"), (9, "a"), (10, "b"), (500, "c"), (899, "c")]
    segments, dense = spark.createDataFrame([(0, 4, 7)], "start long, end long, len long"), spark.createDataFrame([(2, 5)], "idx long, len long")
    assert sorted((r["i"], r["length"]) for r in rows.lookup_lengths(df.where("i in (0, 2)").union(spark.range(2, 5)), "i", dense, segments).collect()) == [(0, 7), (2, 5), (3, 7), (4, 7)]
    with pytest.raises(Exception, match="no length"):
        rows.lookup_lengths(df, "i", dense, segments).collect()
    frames = spark.createDataFrame([("d", 1, 0)], "dataset string, episode_index long, frame_index long")
    with pytest.raises(Exception, match="no frame"):
        rows.point_lookup(frames.withColumn("frame_index", F.lit(5).cast("long")), frames).collect()


def test_files(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("mm_datasets:\n- {name: m, json_path: j}\nlerobot_datasets:\n- {repo_id: a, root: /x}\n")
    assert not catalog.read_catalog(str(path), trajectory_only=True, instruction_only=True).mm_datasets
    assert not catalog.read_catalog(str(path), instruction_only=True).lerobot_datasets
    assert episodes.copy_beside(spark, str(path), f"{tmp_path}/copy") and not episodes.copy_beside(spark, f"{tmp_path}/none", f"{tmp_path}/c2")
    found, skipped = episodes.load_all(["a", f"{tmp_path}/none"], lambda p: spark.range(3) if p == "a" else spark.read.parquet(p))
    assert len(found) == 1 and skipped[0][0].endswith("none")
    assert stats_files.read_stats(spark, f"{tmp_path}/none.json") is None
    with pytest.raises(FileNotFoundError):
        stats_files.with_file(spark, stats_files.table_of(spark, {}), f"{tmp_path}/none.json")
    tree = {"a": {"b": 1, "c": {"d": 2}}, "e": 3}
    assert stats_files.flatten(tree) == {"a/b": 1, "a/c/d": 2, "e": 3} and stats_files.unflatten(stats_files.flatten(tree)) == tree
    assert stats_files.buffer_name("observation.state") == "observation_state" and stats_files.feature_name("a/b") == "a.b"
    assert stats_files.write_stats(stats_files.table_of(spark, {"s": {"mean": [1.0], "std": None}}), f"{tmp_path}/n.json", stats_files.NORM)
    assert stats_files.nested(stats_files.read_stats(spark, f"{tmp_path}/n.json")) == {"s": {"mean": [1.0]}}
    with pytest.raises(KeyError):
        episodes.ordered(spark.range(1), ["v"], [], [])
    with pytest.raises(Exception, match="three dimensions"):
        episodes.with_roles(spark.createDataFrame([("i", "image", [1], None)], "feature string, dtype string, shape array<int>, names array<string>")).collect()


def test_tokens(spark):
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "a"), ("assistant", ""), ("user", "b"))])
    assert [p["answer"] for p in one(spark, K.chat_pairs(turns, "drop"))] == [""]
    with pytest.raises(Exception, match="no reply"):
        one(spark, K.chat_pairs(turns))
    assert K.system_turn("") == "" and K.system_turn("x") == "<|im_start|>system\nx<|im_end|>\n"
    assert one(spark, K.merged_times(F.array(F.lit(0), F.lit(1), F.lit(2)), F.lit(2.0))) == [0.25, 1.0]
    text = one(spark, K.video_text(F.array(F.lit(0.25), F.lit(0.35), F.lit(0.75)), F.lit(0)))
    assert re.findall("<([0-9.]+) seconds>", text) == ["0.2", "0.3", "0.8"]
    assert one(spark, K.split_ids(K.join_ids(F.array().cast("array<bigint>")))) == []
    assert one(spark, K.next_labels(F.array(F.lit(1), F.lit(2)))) == [2]
    q = F.array(*[F.lit(x) for x in (-30, 0, 900)])
    assert one(spark, V.text_coefficients(V.coefficient_text(q, -60), 3, -60)) == [-30, 0, 900]
    assert one(spark, V.text_coefficients(F.lit("ab"), 3, 0)) == [0, 0, 0]
    with pytest.raises(Exception, match="no statistics"):
        one(spark, V.normalise("MEAN_STD", F.lit(1.0), {"mean": F.lit(None).cast("double"), "std": F.lit(1.0)}))
    assert V.mode_of("STATE", "MIN_MAX") == "QUANTILE" and V.mode_of("ENV") == "IDENTITY"
    assert subtasks.mixture_weight("mixture:0.25") == 0.25 and subtasks.mixture_weight(True) is None
    with pytest.raises(ValueError):
        subtasks.mixture_weight("mix:0.5")


def test_packs(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 4), (0, 1, 5), (1, 2, 12)], "bin long, i long, n long")
    made = packs.pack_table(df, ["bin"], ["i"], "i", "n")
    packs.write_packs(made, f"{tmp_path}/p", seed=7)
    found, about = packs.read_packs(spark, f"{tmp_path}/p")
    assert about["seed"] == 7 and about["packs"] == 2 and about["largest"] == 12
    assert [r["indices"] for r in found.orderBy("package_id").collect()] == [[0, 1], [2]]
    assert [r["package_id"] for r in packs.merge(found, found).orderBy("package_id").collect()] == [0, 1, 2, 3]
    assert packs.check(found).first()["sound"] and not packs.check(packs.merge(found, found).where("package_id <> 1")).first()["sound"]
    assert not packs.check(found.limit(0)).first()["sound"]
    assert packs.complete(found, df.limit(0).select("i"), "i", 0).count() == 2
    with pytest.raises(ValueError):
        bins.pack_by_size(df, "n", "i", 10, "other")


def test_stream_of_statistics(spark, tmp_path):
    """The windowed statistics give the same on a stream of files as on a table."""
    from episodica.streaming import running

    df = spark.createDataFrame([(i, ["a", "b"][i % 2], float(i)) for i in range(50)], "s long, k string, v double").select(F.timestamp_seconds(F.col("s") * 600).alias("ts"), "k", "v")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = running.windowed_stats(stream, "ts", "k", "v").writeStream.outputMode("complete").format("memory").queryName("stats").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(str, spark.table("stats").collect())) == sorted(map(str, running.windowed_stats(df, "ts", "k", "v").collect()))


def test_text(spark):
    assert one(spark, T.canonical(F.lit("  Pick UP the cup.. "))) == "Pick up the cup."
    assert one(spark, T.canonical(F.lit("a. ."))) == "A. ."
    assert one(spark, T.task_hash(F.lit("put the bowl on the plate."))) == 2849453207902188681
    assert one(spark, T.rewrite_tag(F.lit("look  <image>\n\nhere"))) == f"look{T.VISION}\nhere"
    assert one(spark, T.digits(F.lit("a1-b2"))) == 12 and one(spark, T.digits(F.lit("x"))) is None


def test_vectors(spark):
    for s, b in ((-1.0, 0), (0.0, 500), (1.0, 1000), (-1.0005, 0), (-1.01, -1), (1.5, 1000)):
        assert one(spark, V.state_bin(F.lit(s))) == b if s != -1.01 else one(spark, V.state_bin(F.lit(s))) <= 0
    assert one(spark, V.pad(F.array(F.lit(1.0), F.lit(2.0)), 5)) == [1, 2, 0, 0, 0]
    with pytest.raises(Exception, match="wider"):
        one(spark, V.pad(F.array(F.lit(1.0), F.lit(2.0)), 1))
    assert one(spark, V.quantile_clipped(F.lit(1.0), F.lit(0.0), F.lit(0.0))) == 50
    assert one(spark, V.relative(F.array(F.lit(5.0), F.lit(5.0)), F.array(F.lit(2.0), F.lit(3.0)), [True, False])) == [3, 5]
    assert one(spark, V.dct(F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4)]), 4, 1000.0)) == [5000, -2230, 0, -159]


def test_sampling(spark):
    df = spark.range(10)
    for strategy, n in (("first:3", 3), ("end:3", 3), ("end:0", 10), ("first:25%", 3), ("foo:3", 10), ("all", 10)):
        assert rows.sample(df, strategy, ["id"]).count() == n


def test_sources(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("mm_datasets: null\nlerobot_datasets:\n- {repo_id: a, root: /x}\n")
    found = catalog.read_catalog(str(path))
    assert found.mm_datasets == [] and found.lerobot_datasets[0].root == "/x"
    path.write_text("other: []\n")
    with pytest.raises(ValueError):
        catalog.read_catalog(str(path))
    lines = [{"conversations": [{"from": "human", "value": "hi <image>"}, {"from": "gpt", "value": "yo"}], "num_tokens": 3}, {"conversations": [], "video": ["a", "b"]}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "a.json").write_text(json.dumps(lines))
    for name in ("a.jsonl", "a.json"):
        got = instructions.turns(instructions.read_instructions(spark, str(tmp_path / name))).collect()
        assert [r["turns"] and r["turns"][0]["role"] for r in got if r["turns"]] == ["user"]
    stats = {"a": {"mean": [1.0, 2.0], "std": [0.5, 0.5]}}
    (tmp_path / "s.json").write_text(json.dumps(stats))
    table = stats_files.read_stats(spark, str(tmp_path / "s.json"))
    assert table.count() == 2 and stats_files.nested(table) == stats


def test_fixed_batches(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(200)] + [(None, None)], "a long, b long").repartition(5)
    got = sorted((r["batch"], -1 if r["a"] is None else r["a"], -1 if r["b"] is None else r["b"]) for r in bins.fixed_batches(df, ["a", "b"], 16).collect())
    rows_ = sorted([(i % 7, i) for i in range(200)] + [(-1, -1)])
    assert got == [(k // 16, *r) for k, r in enumerate(rows_)]


def test_padded_batch_whole(spark, tmp_path):
    from episodica.plans import catalogue

    data = [(1, 0, "x" * 100), (1, 1, ""), (2, 0, "y" * 41)]
    spark.createDataFrame(data, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["padded_batch_whole"](spark, str(tmp_path)).collect())
    assert got == [(1, 0, 100, 5050, 100), (1, 1, 100, 0, 0), (2, 0, 100, 861, 41)]
