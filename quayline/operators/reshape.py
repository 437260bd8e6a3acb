"""Dialogues to utterance rows, shards, profile scenes and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.functions.profiles import profile_frame
from quayline.functions.text import clean_name, scene_name
from quayline.operators.ranking import hash_rank, running_total
from quayline.operators.sampling import SPLIT_SEED

UTTERANCE_FIELDS = ("utterance_id", "dialogue_id", "turn_id", "event", "intent", "provider", "model", "ship_names", "text")


def require_shard(index: int, count: int) -> None:
    if count < 1 or not 0 <= index < count:
        raise ValueError(f"shard index {index} is not within {count} shards")


def flatten_dialogues(dialogues: DataFrame, start: int = 1, shard_count: int = 1, shard_index: int = 0, max_dialogues: int = 0, max_utterances: int = 0, order: str = "seq") -> DataFrame:
    """One row for each turn, with a running id over all dialogues in the order of ``order`` (a unique integer).

    Ids count every turn from ``start``, those of other shards too; a shard keeps the ids that leave ``shard_index``. The
    roster becomes JSON text, ids text. Zero stands for no limit; the utterance limit comes after the shard.
    """
    require_shard(shard_index, shard_count)
    rows = dialogues.orderBy(order).limit(max_dialogues) if max_dialogues else dialogues
    rows = running_total(rows.withColumn("__turns", F.size("utterance").cast("bigint")), order, "__turns", "__first")
    turns = rows.select("*", F.posexplode("utterance").alias("__pos", "text"))
    number = F.col("__first") + F.col("__pos") + start
    turns = turns.withColumn("__number", number).where(F.pmod(F.col("__number") - start, F.lit(shard_count)) == shard_index)
    if max_utterances:
        turns = turns.orderBy("__number").limit(max_utterances)
    text = lambda c: F.col(c).cast("string").alias(c) if c in dialogues.columns else F.lit("").alias(c)
    roster = F.to_json(F.coalesce(F.col("ship_names"), F.array().cast("array<string>"))) if "ship_names" in dialogues.columns else F.lit("[]")
    return turns.select(F.col("__number").cast("string").alias("utterance_id"), text("dialogue_id"), (F.col("__pos") + 1).cast("string").alias("turn_id"), *map(text, ("event", "intent", "provider", "model")), roster.alias("ship_names"), "text")


def batches(df: DataFrame, order: str, size: int, name: str = "batch") -> DataFrame:
    """``df`` with the number of its consecutive batch of ``size`` rows in the order of an integer column."""
    return running_total(df.withColumn("__one", F.lit(1).cast("bigint")), order, "__one", "__at").withColumn(name, F.floor(F.col("__at") / size)).drop("__one", "__at")


def record_index(df: DataFrame, ident: str = "utterance_id", shard: str | None = None) -> DataFrame:
    """``df`` with its place from 0 in the numeric order of ``ident``, within a shard column if one is named."""
    rows = df.withColumn("__id", F.col(ident).cast("bigint")).withColumn("__one", F.lit(1).cast("bigint"))
    return running_total(rows, "__id", "__one", "record_index", shard).drop("__id", "__one")


def profile_scenes(clean: DataFrame, profiles: str = "all", seed: int = SPLIT_SEED, noise_bank: str = "", ident: str = "utterance_id") -> DataFrame:
    """Every row with every selected profile: file name, bank (null if empty) and the scene's seed.

    The profile side has a handful of fixed rows, so it is broadcast. Seed: ``seed`` + 100 * record_index + profile_index.
    """
    dims = profile_frame(clean.sparkSession, profiles).select("profile", "profile_index", "head_crop_ms", "tail_noise_ms")
    rows = clean if "record_index" in clean.columns else record_index(clean, ident)
    return rows.crossJoin(F.broadcast(dims)).withColumns({
        "audio": scene_name(ident, "profile"),
        "noise_bank": F.nullif(F.lit(noise_bank), F.lit("")),
        "scene_seed": F.col("record_index") * 100 + F.col("profile_index") + seed,
    })


def scene_samples(scenes: DataFrame, samples: str, rate: str) -> DataFrame:
    """``scenes`` with the sample count of the finished scene: the head crop unless it takes all, then the tail."""
    at = lambda ms: F.floor(F.col(ms) / F.lit(1000.0) * F.col(rate)).cast("bigint")
    crop = at("head_crop_ms")
    kept = F.when((crop <= 0) | (crop >= F.col(samples)), F.col(samples)).otherwise(F.col(samples) - crop)
    return scenes.withColumn("scene_samples", kept + at("tail_noise_ms"))


def clean_records(rows: DataFrame, listing: DataFrame, ident: str = "utterance_id") -> DataFrame:
    """Rows with the clean file they have: ``listing`` (clean_audio, clean_duration_sec, sample_rate) joined by file name."""
    named = rows.withColumn("clean_audio", clean_name(ident))
    return named.join(listing.select("clean_audio", "clean_duration_sec", "sample_rate"), "clean_audio", "left")


def pending(rows: DataFrame, listing: DataFrame, ident: str = "utterance_id") -> DataFrame:
    """Rows whose clean file is not in ``listing``."""
    return rows.withColumn("clean_audio", clean_name(ident)).join(listing.select("clean_audio"), "clean_audio", "left_anti")


def group_order(df: DataFrame, group: str, seed: int = SPLIT_SEED) -> DataFrame:
    """Distinct numeric groups with their rank in a keyed hash order."""
    from quayline.functions.text import digest

    return hash_rank(df.select(F.col(group).cast("bigint").alias("group")).distinct(), digest(seed, F.lit("split"), "group"), "group")
