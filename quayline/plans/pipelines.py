"""The end-to-end programs as functions, with the same parameters and defaults as their command lines (``quayline.cli``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.functions import dsp
from quayline.functions.kernels import features
from quayline.functions.profiles import profile_frame
from quayline.operators import labels, reshape, sampling, series, summary, views
from quayline.operators.staging import staged
from quayline.sources import readers, sinks, wav

TTS_RATE = 24_000


#: A speech model: waveforms at TTS_RATE, as float32 from -1 to 1, of a list of texts.
Model = Callable[[list[str]], list[np.ndarray]]


def synthesize(rows: DataFrame, model: Model, batch_size: int = 8, rate: int = TTS_RATE) -> DataFrame:
    """``rows`` with samples and sample_rate of their ``text``, voiced by the caller's ``model`` inside the tasks.

    A batch that runs out of memory is halved and tried again, down to single texts. The model is sent to the tasks as it is, so
    one that holds weights should load them when it is first called there.
    """

    def voiced(texts: list[str]) -> list[np.ndarray]:
        try:
            return model(texts)
        except MemoryError:
            if len(texts) == 1:
                raise
            half = len(texts) // 2
            return voiced(texts[:half]) + voiced(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), batch_size):
                part = batch.iloc[at : at + batch_size]
                yield part.assign(samples=voiced(part["text"].tolist()), sample_rate=rate)

    return rows.mapInPandas(run, rows.select("*", F.array().cast("array<float>").alias("samples"), F.lit(rate).alias("sample_rate")).schema)


def clean_audio(rows: DataFrame, clean_dir: str, model: Model, batch_size: int = 8) -> DataFrame:
    """Rows with clean_audio, clean_duration_sec and sample_rate; files that are there are kept, the others are made."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(clean_dir)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(folder, "*.wav"))
    if there is not None and len(there):
        listing = wav.probe(spark, clean_dir, "*.wav").select(F.element_at(F.split("path", "/"), -1).alias("clean_audio"), dsp.python_round(F.col("duration_sec"), 3).alias("clean_duration_sec"), "sample_rate")
    else:
        listing = spark.createDataFrame([], "clean_audio string, clean_duration_sec double, sample_rate int")
    kept = reshape.clean_records(rows, listing).where("sample_rate IS NOT NULL")
    made = wav.write(synthesize(reshape.pending(rows, listing), model, batch_size), clean_dir, "clean_audio").withColumnRenamed("duration_sec", "clean_duration_sec")
    return kept.unionByName(made.select(*kept.columns))


def scenes(clean: DataFrame, clean_dir: str, output_dir: str, profiles: str = "all", seed: int = sampling.SPLIT_SEED, bank: list[tuple] | None = None, bank_name: str = "") -> DataFrame:
    """Every clean row through every profile's channel, written to ``output_dir``; the written clean file is what is read."""
    spark = clean.sparkSession
    audio = wav.read(spark, clean_dir, "*.wav").select(F.element_at(F.split("path", "/"), -1).alias("__file"), "samples")
    numbered = clean if "record_index" in clean.columns else reshape.record_index(clean)
    # a clip is joined once; its profiles multiply it inside the task that holds it
    with_audio = numbered.join(audio, F.col("clean_audio") == F.col("__file")).drop("__file")
    rows = reshape.profile_scenes(with_audio, profiles, seed, bank_name).drop("head_crop_ms", "tail_noise_ms", "profile_index", "record_index")
    rows = rows.join(F.broadcast(profile_frame(spark, profiles).drop("profile_index")), "profile")
    loud = dsp.augment(rows, bank=bank).drop(*[f for f in dsp.FIELDS if f != "profile"])
    return wav.write(loud, output_dir, "audio").drop("scene_seed")


def dialogues_to_scenes(
    spark: SparkSession, dialogues: str, output_dir: str, *, model: Model, clean_dir: str = "", profiles: str = "all", max_dialogues: int = 0, max_utterances: int = 0, batch_size: int = 8,
    seed: int = sampling.SPLIT_SEED, start_utterance_id: int = 1, shard_count: int = 1, shard_index: int = 0, bank: list[tuple] | None = None, noise_bank: str = "",
) -> DataFrame:
    """Dialogues to utterances.csv, clean and scene audio, the manifest and a run summary; returns the manifest."""
    reshape.require_shard(shard_index, shard_count)
    rows = reshape.flatten_dialogues(readers.load_dialogues(spark, dialogues), start_utterance_id, shard_count, shard_index, max_dialogues, max_utterances)
    sinks.write_utterances(rows, f"{output_dir}/utterances.csv")
    clean_dir = clean_dir or f"{output_dir}/clean"
    clean = clean_audio(rows, clean_dir, model, batch_size)
    sinks.write_jsonl(clean, f"{output_dir}/clean.jsonl")
    clean = spark.read.schema(clean.schema).json(f"{output_dir}/clean.jsonl")
    made = scenes(clean, clean_dir, output_dir, profiles, seed, bank, noise_bank)
    sinks.write_jsonl(made, f"{output_dir}/manifest.jsonl")
    manifest = spark.read.schema(made.schema).json(f"{output_dir}/manifest.jsonl")
    told = manifest.agg(F.countDistinct("utterance_id").alias("utterances"), F.count("*").alias("scenes"), F.sort_array(F.collect_set("profile")).alias("profiles"))
    facts = {"dialogues": dialogues, "batch_size": batch_size, "shard_count": shard_count, "shard_index": shard_index, "noise_bank": noise_bank}
    sinks.write_document(told.withColumns({k: F.lit(v) for k, v in facts.items()}), f"{output_dir}/run_summary.json")
    return manifest


def utterances_to_scenes(
    spark: SparkSession, utterances: str = "outputs/vhf_scene/utterances_256.csv", output_dir: str = "outputs/vhf_scene", *, model: Model, clean_dir: str = "", max_utterances: int = 256, batch_size: int = 8,
    profiles: str = "all", seed: int = sampling.SPLIT_SEED, bank: list[tuple] | None = None, noise_bank: str = "",
) -> DataFrame:
    """The same from an utterance CSV: clean and scene audio and the manifest; returns the manifest."""
    clean_dir = clean_dir or f"{output_dir}/clean"
    clean = clean_audio(readers.load_utterances(spark, utterances, max_utterances), clean_dir, model, batch_size)
    sinks.write_jsonl(clean, f"{output_dir}/clean.jsonl")
    clean = spark.read.schema(clean.schema).json(f"{output_dir}/clean.jsonl")
    made = scenes(clean, clean_dir, output_dir, profiles, seed, bank, noise_bank)
    sinks.write_jsonl(made, f"{output_dir}/manifest.jsonl")
    return spark.read.schema(made.schema).json(f"{output_dir}/manifest.jsonl")


def eta_seconds(done: int, total: int, elapsed: float) -> float | None:
    """The time left at the pace so far; unknown before the first item."""
    return elapsed * (total - done) / done if done > 0 else None


def label_and_split(
    spark: SparkSession, manifest: DataFrame, output_dir: str, seed: int = sampling.SPLIT_SEED, split_key: str = "dialogue_id", max_groups: int = 0, holdout_min_group_id: int = 0,
    bias: bool = False, bias_negative_count: int = labels.NEGATIVES, vhf_error_ratio: float = labels.ERROR_RATIO, generator: str = "keyed",
) -> DataFrame:
    """Group split, labels, sorted manifest and splits, and a nested summary; returns the labelled rows."""
    if split_key not in ("utterance_id", "dialogue_id"):
        raise ValueError(f"unknown split key {split_key}")
    splits = staged(sampling.split_groups(manifest, split_key, seed, max_groups, holdout_min_group_id, generator))
    rows = labels.labelled_rows(sampling.apply_split(manifest, splits, split_key), bias=bias, count=bias_negative_count, error_ratio=vhf_error_ratio, seed=seed, generator=generator)
    in_order = rows.orderBy(F.col("utterance_id").cast("bigint"), "profile")
    sinks.write_jsonl(in_order, f"{output_dir}/manifest.jsonl")
    back = spark.read.schema(rows.schema).json(f"{output_dir}/manifest.jsonl")
    sinks.write_splits(back, f"{output_dir}/splits")
    sinks.write_document(summary.split_summary(back, splits), f"{output_dir}/split_summary.json", "splits")
    return back


def select_and_calibrate(rows: DataFrame, output: str, discovery: str, confirmation: str, summary_path: str, total: int = 8000, calibration_rows: int = 1024, seed: int = sampling.SAMPLE_SEED) -> DataFrame:
    """A balanced selection and two calibration splits of it, each one file; nothing is written before all checks have passed, and
    the three appear together or not at all."""
    chosen = staged(sampling.balanced_sample(rows, total, seed))
    first, second = sampling.calibration_splits(chosen, calibration_rows, seed)
    parts = {output: chosen, discovery: first, confirmation: second}
    sinks.write_together(rows.sparkSession, {path: sampling.in_sample_order(part, seed, "id") for path, part in parts.items()}, f"{output}.commit", single=True)
    files = [sinks.byte_digests(rows.sparkSession, path).agg(F.sort_array(F.collect_list(F.struct("path", "length", "sha256"))).alias(f"{name}_files")) for name, path in zip(("output", "discovery", "confirmation"), parts, strict=True)]
    # each side is one row: the files of an output are few
    told = reduce(DataFrame.crossJoin, [summary.selection_summary(chosen), *files])
    told = told.withColumns({f"{name}_digest": F.lit(sinks.digest_of(part)) for name, part in zip(("output", "discovery", "confirmation"), parts.values(), strict=True)})
    sinks.write_document(told.withColumn("seed", F.lit(seed)), summary_path)
    return chosen


def select_test(train: DataFrame, candidates: DataFrame, output: str, summary_path: str, total: int = 2000, seed: int = sampling.SAMPLE_SEED) -> DataFrame:
    """A held-out test set and its summary."""
    test = staged(sampling.heldout_test(train, candidates, total, seed))
    sinks.write_together(train.sparkSession, {output: sampling.in_sample_order(test, seed, "id")}, f"{output}.commit", single=True)
    told = summary.selection_summary(test).crossJoin(summary.counter_map(test, "context_mode", "context_modes"))
    sinks.write_document(told.withColumns({"digest": F.lit(sinks.digest_of(test)), "seed": F.lit(seed)}), summary_path)
    return test


def write_paired_views(rows: DataFrame, output_prefix: str) -> DataFrame:
    """Three views of every row, a folder each, with a summary of rows and digests; returns the summary."""
    three = views.paired_views(rows)
    sinks.write_views(three, output_prefix)
    told = [summary.content_digest(three.where(F.col("view") == v)).withColumn("view", F.lit(v)) for v in views.VIEW_NAMES.values()]
    out = told[0].unionByName(told[1]).unionByName(told[2])
    sinks.write_document(out, f"{output_prefix}_summary.json", "views")
    return out


def _clip_features(df: DataFrame, rate: int) -> DataFrame:
    """Clips at the bank's rate with their features."""
    at_rate = df.withColumn("samples", dsp.resampled("samples", "sample_rate", rate)).withColumn("sample_rate", F.lit(rate))
    return at_rate.withColumn("f", dsp.feature_struct("samples", "sample_rate")).select("*", "f.*").drop("f")


def noise_windows(spark: SparkSession, source_dir: str, target_sr: int = 24_000, files: int = 12, windows_per_file: int = 24, window_sec: float = 4.0, max_per_category: int = series.MOST_PER_CATEGORY) -> DataFrame:
    """Classified windows of the long files, the first of each category in the order of path and start."""
    found = wav.long_files(spark, source_dir, files)
    clips = _clip_features(wav.windows(spark, found, source_dir, windows_per_file, window_sec), target_sr)
    named = clips.withColumn("category", series.noise_class(F.col("rms_db"), F.col("energy_300_3400"))).where("category IS NOT NULL")
    return series.capped(named, "category", series.path_order("path"), "start_sec", most=max_per_category)


def measured_frames(frames: DataFrame) -> DataFrame:
    """Frames with level, peak and centroid at their file's rate."""

    @F.pandas_udf("rms_db double, peak double, centroid_hz double")
    def measure(clips: pd.Series, rates: pd.Series) -> pd.DataFrame:
        rows = []
        for x, rate in zip(clips, rates, strict=True):
            x = np.asarray(x, np.float32)
            f = features(x, int(rate))
            rows.append((f["rms_db"], float(np.max(np.abs(x))), f["centroid_hz"]))
        return pd.DataFrame(rows, columns=["rms_db", "peak", "centroid_hz"])

    return frames.withColumn("m", measure("samples", "sample_rate")).select("path", "sample_rate", "frame_idx", "samples", "m.*")


def tail_clips(spark: SparkSession, source_dir: str, target_sr: int = 24_000, tail_files: int = 2, max_tail_events: int = series.MOST_EVENTS, files: int = 12) -> DataFrame:
    """Tail events of the first long files, each a clip of five frames, in the order of path and place, up to a cap.

    The first ``tail_files`` files alone are opened for their samples, in byte ranges.
    """
    some = wav.long_files(spark, source_dir, files).orderBy(F.split("path", "/")).limit(tail_files)
    cut = staged(measured_frames(wav.frames(spark, source_dir, 0.1, glob="*.WAV", only=[r["path"] for r in some.collect()])))
    events = series.tail_events(cut, series.event_hit(), "path")
    clips = series.event_clips(cut, series.capped_events(events, series.path_order("path"), "end_idx", most=max_tail_events), "path")
    rates = cut.groupBy("path").agg(F.first("sample_rate").alias("sample_rate"))
    order = Window.partitionBy("category").orderBy(series.path_order("path"), "end_idx")
    out = _clip_features(clips.join(rates, "path"), target_sr).withColumn("category", F.lit("tail_events")).withColumn("start_sec", F.col("event_idx") * F.lit(0.1))
    return out.withColumn("category_index", F.row_number().over(order)).drop("end_idx", "event_idx")


def build_noise_bank(
    spark: SparkSession, source_dir: str, output_dir: str = "outputs/vhf_noise_bank", target_sr: int = 24_000, files: int = 12, windows_per_file: int = 24, window_sec: float = 4.0,
    max_per_category: int = series.MOST_PER_CATEGORY, tail_files: int = 2, max_tail_events: int = series.MOST_EVENTS,
) -> DataFrame:
    """Windows and tail events as WAV files with a manifest; returns its items."""
    both = noise_windows(spark, source_dir, target_sr, files, windows_per_file, window_sec, max_per_category).unionByName(tail_clips(spark, source_dir, target_sr, tail_files, max_tail_events, files), allowMissingColumns=True)
    named = both.withColumnRenamed("path", "source_file").withColumn("path", F.format_string("%s/%s_%05d.wav", "category", "category", "category_index"))
    rounded = {c: dsp.python_round(F.col(c), 3 if c == "start_sec" else 6) for c in ("start_sec", *dsp.FEATURES)}
    items = wav.write(named.withColumns(rounded).drop("category_index"), output_dir, "path")
    told = items.groupBy().agg(F.lit(source_dir).alias("source_dir"), F.lit(target_sr).alias("target_sr"), F.collect_list(F.struct(*items.columns)).alias("items"))
    sinks.write_document(told, f"{output_dir}/manifest.json")
    return items


def load_bank(spark: SparkSession, root: str) -> list[tuple]:
    """The clips of a bank that ``build_noise_bank`` wrote, size-checked, in the order of their paths."""
    items = readers.load_bank_items(spark, f"{root}/manifest.json")
    audio = wav.read(spark, root, "*.wav").withColumn("__tail", F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2))).select("__tail", "samples")
    return dsp.load_bank(items.join(audio, F.col("path") == F.col("__tail")))
