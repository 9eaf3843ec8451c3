"""From a catalogue to training rows: frames, statistics, chunks of actions, instructions and prompts of all its datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.functions import text as T
from episodica.functions import tokens as K
from episodica.functions import vectors as V
from episodica.operators import chunks, rows, stats, subtasks
from episodica.sources import catalog, episodes, instructions, stats_files
from episodica.sources.catalog import Catalog, InstructionDataset, TrajectoryDataset
from episodica.sources.shared import small

KEYS = ["episode_index", "frame_index"]


def _joined(names: list[str]) -> Column:
    """The vectors of several columns one after the other, as doubles."""
    return V.concat_vectors(*[F.transform(F.col(f"`{c}`"), lambda x: x.cast("double")) for c in names])


def ensured_stats(spark: SparkSession, root: str, frames: DataFrame, names: list[str]) -> DataFrame:
    """The dataset's statistics file; made from all its frames and written where there is none."""
    path = f"{root}/{stats_files.STATS}"
    found = stats_files.read_stats(spark, path)
    if found is None:
        vectors = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("array<double>").alias("v")) for c in names])
        stats_files.write_stats(stats.exact_stats(stats.dims(frames.select(F.inline(vectors)), "v", ["feature"]), ["feature"]), path)
        found = stats_files.read_stats(spark, path)
    return found


def _numbered(frames: DataFrame, state: list[str], action: list[str], *more: str) -> tuple[DataFrame, DataFrame | None]:
    """Frames numbered in their episodes, with _state and _action; and the hot episodes."""
    df = frames.select(*KEYS, *more, _joined(state).alias("_state"), _joined(action).alias("_action"))
    hot = rows.hot_keys(df.select("episode_index"), "episode_index")
    return chunks.frames(df, "episode_index", ["frame_index"], hot), hot


def relative_stats(frames: DataFrame, state: list[str], action: dict[str, int], moved: list[bool], horizon: int) -> DataFrame:
    """feature, dim and exact statistics of actions relative to the state: over every frame and every step of its chunk that is real.

    Steps past an episode's end are left out, as they repeat its last action; dims that moved doesn't name count as they
    are.  action: columns with their numbers of dims, in order.  Steps are rows only on their way into partial aggregates, and
    their dims are told apart from the state's by place, as V.relative does, but without a lambda for each step."""
    df, hot = _numbered(frames, state, list(action))
    steps = chunks.ahead(df, "_action", horizon, name="_steps", hot=hot).select("_state", F.inline("_steps"))
    beside = F.slice(F.coalesce("_state", F.array().cast("array<double>")), F.lit(1), F.size("v"))
    met = steps.select(F.posexplode(F.arrays_zip("v", beside.alias("s"))).alias("dim", "_x"))
    less = F.when(F.coalesce(F.get(F.array(*[F.lit(x) for x in moved]).cast("array<boolean>"), F.col("dim")), F.lit(False)), F.coalesce("_x.s", F.lit(0.0)) * F.lit(-1.0)).otherwise(F.lit(0.0))
    components = met.select(F.col("dim").cast("long").alias("dim"), (F.col("_x.v") + less).alias("x"))
    places = F.array(*[F.struct(F.lit(name).alias("feature"), F.lit(k).cast("long").alias("dim")) for name, n in action.items() for k in range(n)])
    found = stats.exact_stats(components, []).withColumn("_f", F.get(places, F.col("dim").cast("int")))
    return found.select("_f.feature", "_f.dim", *stats_files.COLUMNS)


def _normalised(v: Column, mode: str, tree: dict, names: list[str]) -> Column:
    """A vector of the joined columns names, normalised by their statistics (one value a dim, as literals)."""
    if mode == "IDENTITY":
        return v
    column = lambda c: F.array(*[F.lit(x) for name in names for x in tree[name][c]]).cast("array<double>")
    used = {c: column(c) for c in V.MODES[mode][2:]}
    return F.transform(v, lambda x, i: V.normalise(mode, x, {c: F.get(a, i) for c, a in used.items()}))


def _instruction(df: DataFrame, meta: dict[str, DataFrame], dataset: TrajectoryDataset, seed: int) -> DataFrame:
    """Adds task and, where a subtask is the instruction, its steps_to_go."""
    about = meta["episodes"].select("episode_index", F.get("tasks", F.lit(0)).alias("_first"), subtasks.boundaries(F.col("action_config")).alias("_parts"))
    df = df.join(small(about), "episode_index", "left")
    df = subtasks.task_text(df, small(meta["tasks"]), "task_index", "_first")
    if dataset.train_subtask:
        some = F.coalesce(F.size("_parts"), F.lit(0)) > 0
        texts, ends = F.transform("_parts", lambda p: p["text"]), F.transform("_parts", lambda p: p["end_frame"])
        if dataset.train_subtask == "cumulate":
            text, steps = subtasks.cumulate(texts), F.col("steps_to_go")
        else:
            text, steps = F.get(texts, subtasks.segment_index(F.col("frame_index"), ends)), subtasks.segment_steps(F.col("frame_index"), ends).cast("long")
            weight = subtasks.mixture_weight(dataset.train_subtask)
            if weight is not None:
                key = F.concat_ws(":", *KEYS)
                text = subtasks.mixture(key, text, F.col("task"), weight, seed)
                steps = F.when(text == F.col("task"), F.col("steps_to_go")).otherwise(steps)
        df = df.withColumns({"_text": F.when(some, F.nullif(text, F.lit(""))), "_steps": F.when(some, steps)})
        df = df.withColumns({"task": F.coalesce("_text", "task"), "steps_to_go": F.coalesce("_steps", "steps_to_go")}).drop("_text", "_steps")
    return df.withColumn("task", T.canonical(F.col("task"))).drop("_first", "_parts")


def trajectory_rows(spark: SparkSession, dataset: TrajectoryDataset, horizon: int = 16, action_dim: int = 48, bins: int = 1000, gamma: float = 0.99, seed: int = 42) -> DataFrame:
    """A training row for each frame of a dataset: dataset, episode_index, frame_index, task, cameras, prompt, state_bins, actions (horizon
    vectors of action_dim), action_is_pad, action_dof_mask, steps_to_go and weight.

    Only the listed episodes' files are read, and of all files only the columns chosen, or found by prefix.  Actions are made
    relative to the state where the dataset says so (by its embodiment's mask, with statistics of their own), normalised by the
    dataset's mode, and filled up with zeros; states are normalised by quantiles and binned."""
    root = dataset.root or dataset.repo_id
    meta = episodes.read_metadata(spark, root)
    frames = episodes.read_dataset(spark, Catalog([], [dataset]), dataset.repo_id)
    state = episodes.columns_of(frames, "observation.state", dataset.select_state_keys)
    action = episodes.columns_of(frames, "action", dataset.select_action_keys)
    visual = [r["feature"] for r in episodes.with_roles(episodes.features(meta["info"])).where("role = 'VISUAL'").orderBy("feature").collect()]  # a row for each feature
    cameras = dataset.select_video_keys or visual
    found = ensured_stats(spark, root, frames, [*state, *action])
    states_tree = actions_tree = stats_files.nested(found)
    if dataset.state_relative_action:
        actions_tree = stats_files.nested(stats_files.with_relative_actions(spark, root, horizon, found))
    # joined before actions are gathered, so no join moves whole chunks
    df, hot = _numbered(frames, state, action, "task_index")
    df = _instruction(df, meta, dataset, seed)
    mode = V.mode_of("ACTION", dataset.state_mode)
    if dataset.state_relative_action:
        df = chunks.chunk(df, "_action", horizon, name="actions", hot=hot)
        dims = sum(len(actions_tree[c]["mean"]) for c in action)
        moved = catalog.mask(dataset.embodiment_tag, dims)
        df = df.withColumn("actions", F.transform("actions", lambda a: V.relative(a, F.col("_state"), moved)))
        # in two steps: pad reads its vector several times, and a lambda would compute it anew for each
        actions = F.transform(F.transform("actions", lambda a: _normalised(a, mode, actions_tree, action)), lambda a: V.pad(a, action_dim))
        df = df.withColumn("actions", actions)
    else:
        # a frame's action is the same in every chunk, so it is normalised and padded once
        df = df.withColumn("_value", _normalised(F.col("_action"), mode, actions_tree, action)).withColumn("_value", V.pad(F.col("_value"), action_dim))
        df = chunks.chunk(df, "_value", horizon, name="actions", hot=hot)
    binned = F.transform(_normalised(F.col("_state"), V.mode_of("STATE"), states_tree, state), lambda s: V.state_bin(s, bins))
    names = F.array(*[F.lit(c) for c in cameras]).cast("array<string>")
    df = df.withColumns({"dataset": F.lit(dataset.repo_id), "cameras": names, "state_bins": binned, "action_dof_mask": V.pad_mask(F.col("_action"), action_dim), "weight": T.discount(F.col("steps_to_go"), gamma)})
    df = df.withColumn("prompt", T.prompt(list(cameras), F.col("state_bins"), F.col("task")))
    return df.select("dataset", *KEYS, "task", "cameras", "prompt", "state_bins", "actions", "actions_is_pad", "action_dof_mask", "steps_to_go", "weight").withColumnRenamed("actions_is_pad", "action_is_pad")


def training_rows(spark: SparkSession, path: str, **options) -> tuple[DataFrame | None, list[tuple[object, str]]]:
    """The training rows of all trajectory datasets of a catalogue file (or of the one dataset at path), and the datasets that could not
    be read with their errors; None if none could.  options: those of trajectory_rows."""
    datasets = catalog.read_catalog(path, spark=spark).lerobot_datasets
    found, skipped = episodes.load_all(datasets, lambda dataset: trajectory_rows(spark, dataset, **options))
    whole = None
    for part in found:
        whole = part if whole is None else whole.unionByName(part)
    return whole, skipped


def instruction_rows(spark: SparkSession, dataset: InstructionDataset, most_tokens: int = 5120, system: str = "", odd: str = "error", seed: int = 42) -> DataFrame:
    """A training row for each chosen record of an instruction dataset: dataset, record (its 0-based place in the file), media (paths),
    num_tokens, turns and pairs (prompt and answer; the system message stands before the first prompt).

    Records of more than most_tokens go first, then the dataset's sampling strategy chooses among the others in the file's order,
    or in a seeded one.  Numbers follow the records, not the tasks that read them.  odd: as in tokens.chat_pairs."""
    df = rows.numbered(instructions.read_instructions(spark, dataset.json_path, place=True), ["place"], "record").drop("place")
    df = rows.sample(rows.length_filter(df, "num_tokens", most_tokens), dataset.sampling_strategy, ["record"], seed)
    df = instructions.media_paths(instructions.turns(df), dataset.vision_base_path)
    df = df.withColumn("pairs", K.chat_pairs(F.col("turns"), odd))
    if head := K.system_turn(system):
        first = lambda p, i: F.struct(F.when(i == 0, F.concat(F.lit(head), p["prompt"])).otherwise(p["prompt"]).alias("prompt"), p["answer"].alias("answer"))
        df = df.withColumn("pairs", F.transform("pairs", first))
    return df.select(F.lit(dataset.name).alias("dataset"), F.col("record").cast("long").alias("record"), "media", "num_tokens", "turns", "pairs")


def sample_rows(spark: SparkSession, path: str, most_tokens: int = 5120, system: str = "", odd: str = "error", **options) -> tuple[DataFrame | None, list[tuple[object, str]]]:
    """All training rows of a catalogue file: kind (instruction or trajectory) and the columns of instruction_rows and trajectory_rows,
    null where a kind has none; and the datasets that could not be read with their errors (None for rows if none could).

    Instruction datasets come first, each kind in the catalogue's order.  options: those of trajectory_rows."""
    found = catalog.read_catalog(path, spark=spark)
    talks, lost = episodes.load_all(found.mm_datasets, lambda x: instruction_rows(spark, x, most_tokens, system, odd).withColumn("kind", F.lit("instruction")))
    frames, skipped = episodes.load_all(found.lerobot_datasets, lambda x: trajectory_rows(spark, x, **options).withColumn("kind", F.lit("trajectory")))
    whole = None
    for part in [*talks, *frames]:
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return whole, lost + skipped


def dataset_statistics(spark: SparkSession, dataset: TrajectoryDataset, horizon: int = 16) -> DataFrame:
    """kind (absolute, or relative for actions relative to the state), feature, dim and statistics of a dataset's chosen columns.

    Its statistics file is made where there is none and read where there is one; so is the file of relative actions over this
    horizon, if the dataset asks for them.  A file is never made anew, so delete it when the frames change."""
    root = dataset.root or dataset.repo_id
    frames = episodes.read_dataset(spark, Catalog([], [dataset]), dataset.repo_id)
    state = episodes.columns_of(frames, "observation.state", dataset.select_state_keys)
    action = episodes.columns_of(frames, "action", dataset.select_action_keys)
    found = ensured_stats(spark, root, frames, [*state, *action])
    out = found.select(F.lit("absolute").alias("kind"), *found.columns)
    if not dataset.state_relative_action:
        return out
    path = f"{root}/{stats_files.RELATIVE.format(horizon=horizon)}"
    made = stats_files.read_stats(spark, path)
    if made is None:
        tree = stats_files.nested(found)
        widths = {c: len(tree[c]["mean"]) for c in action}
        moved = catalog.mask(dataset.embodiment_tag, sum(widths.values()))
        stats_files.write_stats(relative_stats(frames, state, widths, moved, horizon), path)
        made = stats_files.read_stats(spark, path)
    return out.unionByName(made.select(F.lit("relative").alias("kind"), *made.columns))


def compute_statistics(spark: SparkSession, path: str, horizon: int = 16) -> tuple[DataFrame | None, list[tuple[object, str]]]:
    """Makes the statistics files of all trajectory datasets of a catalogue file that lack them (see dataset_statistics).

    Gives dataset and its statistics (None if no dataset could be read), and the datasets that could not with their errors."""
    datasets = catalog.read_catalog(path, spark=spark).lerobot_datasets
    found, skipped = episodes.load_all(datasets, lambda x: dataset_statistics(spark, x, horizon).withColumn("dataset", F.lit(x.repo_id)))
    whole = None
    for part in found:
        whole = part if whole is None else whole.unionByName(part)
    return whole, skipped
