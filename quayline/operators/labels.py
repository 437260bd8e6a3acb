"""Entity labels, bias prompts and the labelled output row."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import quayline

from quayline.functions.text import digest, hash_order, key_map, load_names, matching, phoneme_negatives, prompt, random_negatives, training_target, uniform, without
from quayline.operators.sampling import GENERATORS, SPLIT_SEED

# Python workers do not inherit the driver's sys.path, so functions of this package travel by value.
cloudpickle.register_pickle_by_value(quayline)

NEGATIVES, ERROR_RATIO = 4, 0.22


def _mersenne(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """One generator for each row, seeded with the first 16 hex digits of its key's digest: shuffle, draw, shuffle."""
    for digests, others, positives, counts in batches:
        rows = []
        for key, names, spoken, count in zip(digests, others, positives, counts, strict=True):
            rng, names = random.Random(int(key[:16], 16)), list(names)
            rng.shuffle(names)
            negatives, draw = names[:count], rng.random()
            mixed = [*spoken, *negatives]
            rng.shuffle(mixed)
            rows.append((negatives, draw, mixed))
        yield pd.DataFrame(rows, columns=["negatives", "draw", "mixed"])


def _draws(generator: str, count: int, seed: int, ident: str, profile: str) -> Column:
    """A struct of the shuffled negatives, the draw and the shuffled mix of positives and negatives."""
    roster, positives = F.col("__roster"), F.col("positive_entities")
    if generator == "mersenne":
        return F.pandas_udf(_mersenne, "negatives array<string>, draw double, mixed array<string>")(digest(seed, ident, profile), without(roster, positives), positives, F.lit(count))
    negatives = random_negatives(roster, positives, count, seed, ident, profile, F.lit("neg"))
    mixed = hash_order(F.concat(positives, negatives), seed, ident, profile, F.lit("cand"))
    return F.struct(negatives.alias("negatives"), uniform(seed, ident, profile, F.lit("draw")).alias("draw"), mixed.alias("mixed"))


def bias_fields(
    df: DataFrame, text: str = "text", names: str = "ship_names", ident: str = "utterance_id", profile: str = "profile",
    bias: bool = False, count: int = NEGATIVES, error_ratio: float = ERROR_RATIO, seed: int = SPLIT_SEED, generator: str = "keyed",
) -> DataFrame:
    """``df`` with prompt, bias_type, context_error_type, the entity lists and their phonetic keys.

    Draw and shuffles are keyed by seed, id and profile, so they do not depend on partitions or on other rows. The draw
    picks a wrong prompt below the error ratio (where there are negatives); the rest of its range is split 45, 20, 25
    and 10 in 100 between no, true, mixed and distracting prompts, or in halves without positives. ``generator``:
    ``keyed`` hashes, or ``mersenne`` for the same draws as Python's generator seeded for each row (an Arrow UDF).
    """
    if generator not in GENERATORS:
        raise ValueError(f"unknown generator {generator}")
    roster = load_names(names, is_json=dict(df.dtypes)[names] == "string")
    # one projection a step, so that each list is evaluated once and not inlined in all that use it
    step = df.withColumn("__roster", roster).withColumn("positive_entities", matching(F.col(text), F.col("__roster")))
    step = step.withColumns({
        "__draws": _draws(generator, count, seed, ident, profile),
        "phoneme_negative_entities": phoneme_negatives(F.col("__roster"), F.col("positive_entities"), count),
    })
    none = F.array().cast("array<string>")
    positives, negatives, draw = F.col("positive_entities"), F.col("__draws.negatives"), F.col("__draws.draw")
    if bias:
        ratio = min(max(error_ratio, 0.0), 0.95)
        rest = (draw - ratio) / (1.0 - ratio)
        spoken = F.size(positives) > 0
        kind = (
            F.when((F.size(negatives) > 0) & (draw < ratio), "vhf_error")
            .when(spoken & (rest < 0.45), "no_bias").when(spoken & (rest < 0.65), "oracle_bias").when(spoken & (rest < 0.90), "noisy_bias").when(spoken, "distractor_bias")
            .when(rest < 0.50, "no_bias").otherwise("distractor_bias")
        )
        chosen = F.when(F.col("bias_type") == "oracle_bias", positives).when(F.col("bias_type") == "noisy_bias", F.col("__draws.mixed")).when(F.col("bias_type") == "no_bias", none).otherwise(negatives)
        error = F.when(F.col("bias_type") != "vhf_error", "").when(spoken, "all_wrong_candidates_spoken_entity").otherwise("all_wrong_candidates_no_spoken_entity")
        step = step.withColumn("bias_type", kind).withColumn("candidate_entities", chosen)
    else:
        error = F.lit("")
        step = step.withColumn("bias_type", F.lit("no_bias")).withColumn("candidate_entities", none)
    candidates = F.col("candidate_entities")
    return step.withColumns({
        "prompt": F.when(F.size(candidates) > 0, prompt(candidates)).otherwise(""),
        "context_error_type": error,
        "negative_entities": without(candidates, positives),
        "positive_entity_phonemes": key_map(positives),
        "phoneme_negative_entity_phonemes": key_map("phoneme_negative_entities"),
    }).drop("__roster", "__draws")


def labelled_rows(df: DataFrame, text: str = "text", ident: str = "utterance_id", profile: str = "profile", **options) -> DataFrame:
    """``bias_fields`` with the row id, the text as reference and the training target in its place."""
    out = bias_fields(df, text=text, ident=ident, profile=profile, **options)
    return out.withColumn("id", F.concat_ws("_", F.col(ident).cast("string"), F.col(profile))).withColumn("reference_text", F.col(text)).withColumn(text, training_target(text))
