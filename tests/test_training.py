"""Catalogue to training rows, recorded batches, running statistics of streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import rows, stats, training
from episodica.sources import catalog, recorded, stats_files
from episodica.streaming.running import RunningStatistics


def make_dataset(spark, root, episodes=(0, 1, 2), frames=7, config=None):
    """Frame files by episode with a state of three dims and actions of two columns."""
    rng = np.random.default_rng(1)
    data = [(e, k, e % 2, rng.normal(size=3).tolist(), rng.normal(size=2).tolist(), rng.normal(size=1).tolist()) for e in episodes for k in range(frames)]
    df = spark.createDataFrame(data, "episode_index long, frame_index long, task_index long, `observation.state` array<double>, `action.arm` array<double>, `action.hand` array<double>")
    for e in episodes:
        df.where(F.col("episode_index") == e).coalesce(1).write.parquet(f"{root}/data/chunk-000/episode_{e:06d}.parquet")
    features = {"observation.images.image_0": {"dtype": "video", "shape": [8, 8, 3], "names": ["h", "w", "channels"]}, "observation.state": {"dtype": "float32", "shape": [3], "names": None}}
    (root / "meta").mkdir()
    (root / "meta/info.json").write_text(json.dumps({"fps": 10, "features": features}))
    (root / "meta/tasks.jsonl").write_text("\n".join(json.dumps(x) for x in ({"task_index": 0, "task": "Pick it"}, {"task_index": 1, "task": ""})))
    (root / "meta/episodes.jsonl").write_text("\n".join(json.dumps({"episode_index": e, "tasks": [f"task {e}"], "action_config": config}) for e in episodes))
    return {(r[0], r[1]): r for r in data}


def test_trajectory_rows(spark, tmp_path):
    data = make_dataset(spark, tmp_path)
    dataset = catalog.TrajectoryDataset("toy", str(tmp_path), state_mode="MEAN_STD", select_action_keys=["action.arm", "action.hand"])
    got = training.trajectory_rows(spark, dataset, horizon=4, action_dim=5).collect()
    assert len(got) == 21
    a = np.array([r[4] + r[5] for r in data.values()])
    s = np.array([r[3] for r in data.values()])
    low, high = np.quantile(s, 0.01, axis=0), np.quantile(s, 0.99, axis=0)
    for r in got:
        e, k = r["episode_index"], r["frame_index"]
        steps = [data[e, min(k + j, 6)] for j in range(4)]
        want = (np.array([x[4] + x[5] for x in steps]) - a.mean(0)) / (a.std(0) + 1e-8)
        assert np.allclose(np.array(r["actions"])[:, :3], want) and not np.array(r["actions"])[:, 3:].any()
        assert r["action_is_pad"] == [k + j > 6 for j in range(4)] and r["action_dof_mask"] == [1, 1, 1, 0, 0]
        bins = ((2 * (np.array(data[e, k][3]) - low) / (high - low + 1e-8) - 1 + 1) / 2 * 1000).astype(int).clip(-1, 1000)
        assert np.abs(np.array(r["state_bins"]) - bins).max() <= 1
        assert r["task"] == ("Pick it." if e % 2 == 0 else f"Task {e}.") and r["steps_to_go"] == 6 - k
        assert r["cameras"] == ["observation.images.image_0"] and r["prompt"].startswith("Camera top: ") and r["task"] in r["prompt"]
    # a second reading takes the statistics from the file
    path = f"{tmp_path}/{stats_files.STATS}"
    assert stats_files.nested(stats_files.read_stats(spark, path))["observation.state"]["min"] == pytest.approx(s.min(0).tolist())


def test_only_listed_episodes_are_read(spark, tmp_path):
    make_dataset(spark, tmp_path, episodes=(0, 1, 2, 5))
    dataset = catalog.TrajectoryDataset("toy", str(tmp_path), episodes=[1, 5])
    out = training.trajectory_rows(spark, dataset, horizon=2)
    assert {r["episode_index"] for r in out.select("episode_index").distinct().collect()} == {1, 5}
    assert {f.split("episode_")[1][:6] for f in out.inputFiles() if "episode_" in f} == {"000001", "000005"}
    scan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in scan


def test_read_dataset(spark, tmp_path):
    from episodica.sources import episodes

    make_dataset(spark, tmp_path, episodes=(0, 1, 2))
    found = catalog.Catalog([], [catalog.TrajectoryDataset("toy", str(tmp_path), episodes=[2], select_action_keys=["action.hand"])])
    df = episodes.read_dataset(spark, found, "toy").where("frame_index > 3")
    assert df.columns == ["episode_index", "frame_index", "task_index", "observation.state", "action.hand"] and df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "action.arm" not in plan and "PushedFilters: [IsNotNull(frame_index), GreaterThan(frame_index,3)]" in plan
    assert {f.split("episode_")[1][:6] for f in df.inputFiles()} == {"000002"}
    with pytest.raises(KeyError, match="other"):
        episodes.read_dataset(spark, found, "other")


def test_relative_actions_and_subtasks(spark, tmp_path):
    config = json.dumps([{"end_frame": 3, "action_text": "begin"}, {"end_frame": 7, "action_text": "end it"}])
    data = make_dataset(spark, tmp_path, config=config)
    relative = {"action.arm": {"mean": [0.0, 0.0], "std": [1.0, 1.0]}, "action.hand": {"mean": [0.0], "std": [1.0]}}
    dataset = catalog.TrajectoryDataset("toy", str(tmp_path), state_relative_action=True, embodiment_tag="libero_panda", train_subtask=True, select_action_keys=["action.arm", "action.hand"])
    with pytest.raises(FileNotFoundError):
        training.trajectory_rows(spark, dataset, horizon=4)
    (tmp_path / stats_files.RELATIVE.format(horizon=4)).write_text(json.dumps(relative))
    for r in training.trajectory_rows(spark, dataset, horizon=4, action_dim=3).collect():
        e, k = r["episode_index"], r["frame_index"]
        steps = np.array([data[e, min(k + j, 6)][4] + data[e, min(k + j, 6)][5] for j in range(4)]) - np.array(data[e, k][3])
        assert np.allclose(np.array(r["actions"]), steps, atol=1e-6)
        assert (r["task"], r["steps_to_go"]) == (("Begin.", 3 - k) if k < 3 else ("End it.", 7 - k))
    dataset.train_subtask = "cumulate"
    assert {r["task"] for r in training.trajectory_rows(spark, dataset, horizon=4).select("task").collect()} == {"Begin end it."}
    dataset.train_subtask = "mixture:0.5"
    assert {r["task"] for r in training.trajectory_rows(spark, dataset, horizon=4).select("task").collect()} >= {"Begin.", "Pick it."}


def test_relative_statistics(spark, tmp_path):
    """Over every frame and every real step of its chunk; the file that they make is what training rows ask for."""
    (tmp_path / "a").mkdir()
    data = make_dataset(spark, tmp_path / "a")
    (tmp_path / "c.yaml").write_text(f"lerobot_datasets:\n- {{repo_id: gone, root: {tmp_path}/gone}}\n- {{repo_id: a, root: {tmp_path}/a, state_relative_action: true, embodiment_tag: libero_panda, select_action_keys: [action.arm, action.hand]}}\n")
    found, skipped = training.compute_statistics(spark, f"{tmp_path}/c.yaml", horizon=4)
    assert [x.repo_id for x, _ in skipped] == ["gone"]
    steps = np.array([np.array(data[e, k + j][4] + data[e, k + j][5]) - np.array(r[3]) for (e, k), r in data.items() for j in range(4) if k + j < 7])
    got = {(r["kind"], r["feature"], r["dim"]): r for r in found.collect()}
    assert len(got) == 6 + 3 and {r["dataset"] for r in got.values()} == {"a"}
    for d, place in enumerate([("action.arm", 0), ("action.arm", 1), ("action.hand", 0)]):
        r, x = got["relative", *place], steps[:, d]
        assert [r[c] for c in stats_files.COLUMNS] == pytest.approx([x.min(), x.max(), x.mean(), x.std(), np.quantile(x, 0.01), np.quantile(x, 0.99)])
        assert got["absolute", *place]["mean"] == pytest.approx(np.mean([(r[4] + r[5])[d] for r in data.values()]))
    train, _ = training.training_rows(spark, f"{tmp_path}/c.yaml", horizon=4, action_dim=3)
    r = train.where("episode_index = 1 and frame_index = 2").first()
    moved = np.array([np.array(data[1, 2 + j][4] + data[1, 2 + j][5]) - np.array(data[1, 2][3]) for j in range(4)])
    assert np.allclose(np.array(r["actions"]), (moved - steps.mean(0)) / (steps.std(0) + 1e-8))
    # files are made once
    path = tmp_path / "a" / stats_files.RELATIVE.format(horizon=4)
    given = {"action.arm": {"mean": [9.0, 9.0], "std": [1.0, 1.0]}}
    spark.createDataFrame([(json.dumps(given),)], "value string").coalesce(1).write.mode("overwrite").text(str(path))
    again, _ = training.compute_statistics(spark, f"{tmp_path}/c.yaml", horizon=4)
    assert [r["mean"] for r in again.where("kind = 'relative'").collect()] == [9.0, 9.0]


def test_catalogue_with_a_missing_dataset(spark, tmp_path):
    (tmp_path / "a").mkdir()
    make_dataset(spark, tmp_path / "a")
    (tmp_path / "c.yaml").write_text(f"lerobot_datasets:\n- {{repo_id: gone, root: {tmp_path}/gone}}\n- {{repo_id: a, root: {tmp_path}/a}}\n")
    found, skipped = training.training_rows(spark, f"{tmp_path}/c.yaml", horizon=3)
    assert found.count() == 21 and [x.repo_id for x, _ in skipped] == ["gone"]
    none, skipped = training.training_rows(spark, f"{tmp_path}/gone")
    assert none is None and len(skipped) == 1


def talk(n, tokens=None, **media):
    turns = [{"from": "human", "value": f"q{n} <image>\nsee"}, {"from": "gpt", "value": f"a{n}"}]
    return json.dumps({"conversations": turns, "num_tokens": tokens, **media})


def test_instruction_rows_keep_the_order_of_files(spark, tmp_path):
    (tmp_path / "t.jsonl").mkdir()
    sizes = {"part-00000": 3, "part-00001": 400, "part-00002": 40}  # tasks read large files first
    records, n = [], 0
    for name, size in sizes.items():
        part = [talk(n + k, 9000 if (n + k) % 10 == 0 else None if (n + k) % 10 == 1 else 50, image=f"{n + k}.png") for k in range(size)]
        (tmp_path / "t.jsonl" / f"{name}.jsonl").write_text("\n".join(part))
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for split in ("10000", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            for strategy in ("all", "first:5", "end:5", "random:25%"):
                dataset = catalog.InstructionDataset("t", f"{tmp_path}/t.jsonl", strategy, "/base")
                records = sorted(training.instruction_rows(spark, dataset, most_tokens=100, system="S").collect(), key=lambda r: r["record"])
                assert all(r["pairs"][0]["prompt"].startswith(f"<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nq{r['record']}<|vision_start|>") for r in records)
                assert all(r["media"] == [f"/base/{r['record']}.png"] for r in records)
                seen.append([r["record"] for r in records])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [k for k in range(443) if k % 10]
    assert seen[0] == kept and seen[1] == kept[:5] and seen[2] == kept[-5:] and len(seen[3]) == -(-len(kept) // 4)
    assert seen[:4] == seen[4:]


def test_rows_of_both_kinds(spark, tmp_path):
    (tmp_path / "a").mkdir()
    make_dataset(spark, tmp_path / "a")
    (tmp_path / "t.json").write_text("[" + ",".join([talk(0), talk(1, video="v.mp4")]) + "]")
    (tmp_path / "c.yaml").write_text(f"lerobot_datasets:\n- {{repo_id: a, root: {tmp_path}/a}}\nmm_datasets:\n- {{name: t, json_path: {tmp_path}/t.json}}\n- {{name: bad, json_path: {tmp_path}/t.txt}}\n- {{name: lost, json_path: {tmp_path}/lost.json}}\n")
    found, skipped = training.sample_rows(spark, f"{tmp_path}/c.yaml", horizon=2)
    assert [x.name for x, _ in skipped] == ["bad", "lost"]
    assert {(r["kind"], r["n"]) for r in found.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {("instruction", 2), ("trajectory", 21)}
    assert found.where("kind = 'instruction' and actions is null and record = 1").first()["media"] == ["v.mp4"]
    assert found.where("kind = 'trajectory' and pairs is null and size(actions) = 2").count() == 21


def test_replay(spark, tmp_path):
    path = f"{tmp_path}/r"
    recorded.record(spark.range(103), path, ["id"], 5, 3)
    ranks = [recorded.replay(spark, path, r, seed=3) for r in range(3)]
    seen = [{x["id"] for x in df.collect()} for df in ranks]
    assert sum(map(len, seen)) == 103 and set().union(*seen) == set(range(103))
    for df in ranks:
        turns = {}
        for x in df.collect():
            turns.setdefault(x["turn"], []).append((x["place"], x["id"]))
        assert sorted(turns) == list(range(len(turns)))
        assert all([p for p, _ in sorted(v)] == list(range(len(v))) for v in turns.values())
    again = recorded.replay(spark, path, 1, seed=3, done=2)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, ranks[1].where("turn >= 2").collect()))
    order = lambda epoch: [x["step"] for x in recorded.replay(spark, path, 0, seed=3, epoch=epoch).select("step", "turn").distinct().orderBy("turn").collect()]
    assert order(0) == order(0) and order(0) != order(1)
    with pytest.warns(UserWarning, match="no recorded"):
        assert recorded.replay(spark, path, 7) is None
    recorded.record(spark.range(103), path, ["id"], 5, 3, steps=2)
    assert recorded.replay(spark, path, 0).count() == 10


def plain(states):
    return sorted((r["k"], r["dim"], r["n"], round(r["mean"], 9), round(r["mean_sq"], 9), r["lo"], r["hi"], str(r["counts"])) for r in states.collect())


def test_stream_of_three_batches(spark, tmp_path):
    """The states after three batches, with restarts between them, are those of merging the batches' states one by one."""
    rng = np.random.default_rng(2)
    values = [(("a", "b")[i % 2], 0, float(v)) for i, v in enumerate(rng.normal(size=300))]
    schema, keeper = "k string, dim long, x double", lambda: RunningStatistics(spark, f"{tmp_path}/s", ["k"], bins=50)
    merged = None
    for part in range(3):
        df = spark.createDataFrame(values[part * 100 : part * 100 + 100], schema)
        df.write.mode("append").parquet(f"{tmp_path}/in")
        keeper().run(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        states = stats.histogram_states(df, ["k"], 50)
        merged = states if merged is None else stats.merge_states(merged.unionByName(states), ["k", "dim"], 50)
    assert plain(keeper().states()) == plain(merged)
    whole = {r["k"]: r for r in stats.histogram_states(spark.createDataFrame(values, schema), ["k"], 50).collect()}
    for r in keeper().states().collect():
        one = whole[r["k"]]
        assert (r["n"], r["lo"], r["hi"]) == (one["n"], one["lo"], one["hi"]) and r["mean"] == pytest.approx(one["mean"])
        assert sum(c["c"] for c in r["counts"]) == r["n"]
    # a batch that is run again replaces its version
    keeper().fold(spark.createDataFrame(values[200:], schema), 2)
    assert plain(keeper().states()) == plain(merged)


def test_equal_ranges_give_the_one_shot_states(spark, tmp_path):
    """Batches that all span the common range are binned alike, so their merged states are those of all rows at once."""
    rng = np.random.default_rng(3)
    keeper, data = RunningStatistics(spark, f"{tmp_path}/s", ["k"], bins=64), []
    for part in range(3):
        batch = [("a", 0, v) for v in [0.0, 64.0, *rng.integers(0, 65, 80).astype(float).tolist()]]
        data += batch
        keeper.fold(spark.createDataFrame(batch, "k string, dim long, x double"), part)
    assert plain(keeper.states()) == plain(stats.histogram_states(spark.createDataFrame(data, "k string, dim long, x double"), ["k"], 64))
    assert rows.HOT_ROWS > 1
