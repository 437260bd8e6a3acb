"""Balanced hash-ordered samples, leakage-safe splits and exclusions."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.functions.profiles import CONTEXT_MODES, CONTEXT_POLICY, NAMES, PAIR_TYPES
from quayline.functions.text import digest, family_normalized, family_raw, generation_shard, sample_key
from quayline.operators.ranking import hash_rank
from quayline.operators.staging import staged

SAMPLE_SEED = 20260830
SPLIT_SEED = 20260701
#: ``keyed``: salted hashes, alike at any scale. ``mersenne``: Python's generator, for the same members as a run on it.
GENERATORS = ("keyed", "mersenne")
#: Groups that a ``mersenne`` split may hold on the driver.
MOST_SHUFFLED = 5_000_000
SPLITS = ("train", "validation", "test")
DISCOVERY_SHARDS, CONFIRMATION_SHARDS = (0, 1, 2, 3), (4, 5, 6, 7)


def quota_of(total: int, profiles: Sequence[str]) -> int:
    if total <= 0 or total % len(profiles):
        raise ValueError(f"total must be positive and divisible by {len(profiles)}, not {total}")
    return total // len(profiles)


def duplicate_ids(df: DataFrame, *ident: str) -> DataFrame:
    """The ids that more than one row bears, with their counts."""
    return df.groupBy(*ident).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, ident: str) -> None:
    if found := duplicate_ids(df, ident).head(1):
        raise ValueError(f"duplicate {ident}: {found[0][ident]}")


def require_quota(df: DataFrame, profile: str, profiles: Sequence[str], quota: int) -> None:
    """Raise unless every profile has ``quota`` rows; one small aggregate on the driver."""
    found = {r[profile]: r["n"] for r in df.where(F.col(profile).isin(*profiles)).groupBy(profile).agg(F.count("*").alias("n")).collect()}
    if short := [p for p in profiles if found.get(p, 0) < quota]:
        raise ValueError(f"fewer than {quota} rows of {short[0]}: {found.get(short[0], 0)}")


def top_by_hash(df: DataFrame, quota: int, seed: int, ident: str, profile: str, profiles: Sequence[str]) -> DataFrame:
    """The first ``quota`` rows of each profile by (sample key, id); group limits run before the shuffle."""
    order = Window.partitionBy(profile).orderBy(sample_key(seed, ident), F.col(ident).cast("string"))
    eligible = df.where(F.col(profile).isin(*profiles))
    return eligible.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= quota).drop("__n")


def balanced_sample(df: DataFrame, total: int = 8000, seed: int = SAMPLE_SEED, ident: str = "id", profile: str = "profile", profiles: Sequence[str] = NAMES, validate: bool = True) -> DataFrame:
    """``total`` rows, as many of each profile, by the hash of seed and id. Rows of other profiles are ignored.

    With ``validate`` an id that is not unique over all rows, or a short profile, is an error before anything is written.
    """
    quota = quota_of(total, profiles)
    if validate:
        require_unique(df, ident)
        require_quota(df, profile, profiles, quota)
    return top_by_hash(df, quota, seed, ident, profile, profiles)


def in_sample_order(df: DataFrame, seed: int, ident: str) -> DataFrame:
    return df.orderBy(sample_key(seed, ident), F.col(ident).cast("string"))


def exclude_keys(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key, as text, no row of ``other`` has."""
    taken = other.select(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("__taken")).distinct()
    return df.join(taken, F.coalesce(df[key].cast("string"), F.lit("None")) == F.col("__taken"), "left_anti")


def exclude_overlap(df: DataFrame, other: DataFrame, ident: str, family: Column) -> DataFrame:
    """Rows whose set ``family`` shares nothing with any of ``other``: explode, semi-join, then anti-join on the id."""
    taken = other.select(F.explode(family).alias("__entity")).distinct()
    hit = df.select(F.col(ident).alias("__hit"), F.explode(family).alias("__entity")).join(taken, "__entity", "left_semi").select("__hit").distinct()
    return df.join(hit, df[ident] == F.col("__hit"), "left_anti")


def calibration_splits(
    df: DataFrame, rows: int = 1024, seed: int = SAMPLE_SEED, ident: str = "id", profile: str = "profile", profiles: Sequence[str] = NAMES,
    dialogue: str = "dialogue_id", utterance: str = "utterance_id", entities: str = "positive_entities", path: str = "audio", validate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Discovery from shards 0 to 3, then confirmation from 4 to 7 that shares no dialogue, utterance or entity with it."""
    quota = quota_of(rows, profiles)
    family = family_raw(F.col(entities))
    # the checks, both selections and both exclusions read the pool, and most read the discovery rows
    pool = staged(df.where(F.col(profile).isin(*profiles) & (F.size(family) > 0)).withColumn("__shard", generation_shard(path)))

    def pick(eligible: DataFrame) -> DataFrame:
        if validate:
            require_quota(eligible, profile, profiles, quota)
        return top_by_hash(eligible, quota, seed, ident, profile, profiles).drop("__shard")

    discovery = staged(pick(pool.where(F.col("__shard").isin(*DISCOVERY_SHARDS))))
    rest = pool.where(F.col("__shard").isin(*CONFIRMATION_SHARDS))
    rest = exclude_keys(exclude_keys(rest, discovery, dialogue), discovery, utterance)
    return discovery, pick(exclude_overlap(rest, discovery, ident, family))


def remainder(selected: DataFrame, *taken: DataFrame, ident: str = "id") -> DataFrame:
    """The rows of ``selected`` that no other selection took."""
    for other in taken:
        selected = exclude_keys(selected, other, ident)
    return selected


def counterfactual_fields(df: DataFrame, bias: str = "bias_type", ident: str = "id") -> DataFrame:
    """Context mode, policy, pair type and the defaulted columns of a test row.

    An unknown bias type is an error; a null or missing one counts as ``no_bias``.
    """
    modes = F.create_map(*[F.lit(x) for pair in CONTEXT_MODES.items() for x in pair])
    said = F.coalesce(F.col(bias), F.lit("no_bias")) if bias in df.columns else F.lit("no_bias")
    mode = F.coalesce(F.try_element_at(modes, said), F.raise_error(F.concat(F.lit("unknown bias type "), said)).cast("int"))
    pairs = F.create_map(*[F.lit(x) for pair in PAIR_TYPES.items() for x in pair])
    defaults = {"shuffled_candidate_entities": "array<string>", "source_min_token_lengths": "array<int>", "source_frequency_bins": "array<int>", "shuffled_min_token_lengths": "array<int>", "shuffled_frequency_bins": "array<int>"}
    out = df.withColumns({
        "context_mode": mode, "context_policy": F.lit(CONTEXT_POLICY), "counterfactual_pair_type": pairs[mode],
        "no_prompt": F.lit(""), "no_prompt_source_id": F.col(ident).cast("string"), "prompt_source_id": F.col(ident).cast("string"),
    })
    return out.withColumns({name: F.coalesce(F.col(name), F.array().cast(kind)) if name in df.columns else F.array().cast(kind) for name, kind in defaults.items()})


def heldout_test(
    train: DataFrame, candidates: DataFrame, total: int = 2000, seed: int = SAMPLE_SEED, ident: str = "id", profile: str = "profile", profiles: Sequence[str] = NAMES,
    dialogue: str = "dialogue_id", utterance: str = "utterance_id", entities: str = "positive_entities", validate: bool = True,
) -> DataFrame:
    """A balanced test set that shares no dialogue, utterance or normalized entity with ``train``, with context fields."""
    quota = quota_of(total, profiles)
    family = family_normalized(F.col(entities))
    train = staged(train.select(dialogue, utterance, entities))
    eligible = staged(candidates.where(F.size(family) > 0))
    eligible = exclude_overlap(exclude_keys(exclude_keys(eligible, train, dialogue), train, utterance), train, ident, family)
    if validate:
        eligible = staged(eligible)
        require_unique(eligible, ident)
        require_quota(eligible, profile, profiles, quota)
    return counterfactual_fields(top_by_hash(eligible, quota, seed, ident, profile, profiles), ident=ident)


def _shuffle_rank(pool: DataFrame, seed: int, n: int) -> DataFrame:
    if n > MOST_SHUFFLED:
        raise ValueError(f"{n} groups are too many to shuffle on the driver; use keyed ranks")
    order = [r["group"] for r in pool.orderBy("group").collect()]
    random.Random(seed).shuffle(order)
    return pool.sparkSession.createDataFrame(list(zip(order, range(len(order)), strict=True)), "group bigint, rank bigint")


def split_groups(df: DataFrame, group: str, seed: int = SPLIT_SEED, max_groups: int = 0, holdout_min: int = 0, generator: str = "keyed") -> DataFrame:
    """(group, split): 70, 15 and 15 in 100 of the distinct numeric groups, counts truncated, by the rank of a keyed hash.

    ``max_groups`` keeps only that many of the smallest groups. With ``holdout_min`` validation and test come only from
    groups of at least that id, an error if there are too few, and all others go to train. With ``generator`` "mersenne"
    the ranks come from one shuffle of the sorted groups on the driver, refused beyond MOST_SHUFFLED groups.
    """
    if generator not in GENERATORS:
        raise ValueError(f"unknown generator {generator}")
    groups = df.select(F.col(group).cast("bigint").alias("group")).where("group IS NOT NULL").distinct()
    if max_groups:
        groups = groups.orderBy("group").limit(max_groups)
    n = groups.count()
    train, validation = int(n * 0.70), int(n * 0.15)
    pool = groups.where(F.col("group") >= holdout_min) if holdout_min > 0 else groups
    held = n - train
    if holdout_min > 0:
        if (found := pool.count()) < held:
            raise ValueError(f"{held} hold-out groups are needed, {found} are there")
        edges = (0, validation, held)
    else:
        edges = (train, train + validation, n)
    ranked = hash_rank(pool, digest(seed, F.lit("split"), "group"), "group") if generator == "keyed" else _shuffle_rank(pool, seed, n)
    first, second, last = edges
    split = F.when((F.col("rank") >= first) & (F.col("rank") < second), "validation").when((F.col("rank") >= second) & (F.col("rank") < last), "test").otherwise("train")
    named = ranked.select("group", split.alias("split"))
    if holdout_min > 0:
        named = named.unionByName(groups.where(F.col("group") < holdout_min).select("group", F.lit("train").alias("split")))
    return named


def apply_split(df: DataFrame, splits: DataFrame, group: str) -> DataFrame:
    """``df`` with its group's split in place of any it had; rows of groups that have none vanish."""
    return df.drop("split").join(splits.withColumnRenamed("group", "__group"), F.col(group).cast("bigint") == F.col("__group")).drop("__group")
