"""Counts, overlaps, ratios and nested summaries of a manifest."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.operators.sampling import SPLITS
from quayline.operators.staging import staged


def counter(df: DataFrame, key: str) -> DataFrame:
    """(key, n): rows of each value."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def counter_map(df: DataFrame, key: str, name: str) -> DataFrame:
    """One row with a map of counts in key order; ``key`` must be of few values."""
    return counter(df, key).groupBy().agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), "n")))).alias(name))


def ratios(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by ``keys`` and their part of the rows that share all keys but the last, to six places."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys[:-1]) if len(keys) > 1 else Window.partitionBy(F.lit(1))
    return counts.withColumn("ratio", F.round(F.col("n") / F.greatest(F.sum("n").over(whole), F.lit(1)), 6))


def split_overlaps(df: DataFrame, group: str, split: str = "split") -> DataFrame:
    """How many groups each pair of splits shares: the splits of a group are bits of one number, so partial results merge."""
    bit = F.lit(0)
    for i, name in enumerate(SPLITS):
        bit = F.when(F.col(split) == name, 1 << i).otherwise(bit)
    by_group = df.groupBy(group).agg(F.bit_or(bit).alias("splits"))
    pairs = {f"{a}_{b}": 1 << SPLITS.index(a) | 1 << SPLITS.index(b) for a, b in combinations(SPLITS, 2)}
    return by_group.agg(*[F.count_if(F.col("splits").bitwiseAND(both) == both).alias(name) for name, both in pairs.items()])


def distinct_counts(df: DataFrame, columns: dict[str, str], *by: str) -> DataFrame:
    """(by, then a count for each of ``columns``): different non-null values, as (name, column) pairs.

    Each column's values are brought down to different ones on their own, so no row is written once for each column; the
    counts are few rows.
    """
    counts = None
    for name, column in columns.items():
        one = df.select(*by, column).distinct().groupBy(*by).agg(F.count(column).alias(name))
        counts = one if counts is None else counts.join(one, list(by)) if by else counts.crossJoin(one)
    return counts


def split_summary(rows: DataFrame, splits: DataFrame, split_key: str = "dialogue_id", has_bias: bool = True) -> DataFrame:
    """One row for each split and ``all``: groups (of the split map), dialogues, utterances, records, conditional counts,
    and maps of profiles, bias types, their ratios and error types. Small counters are folded into maps after grouping."""
    either = [F.col("split"), F.lit("all")]
    filled = {"entity_positive_rows": "positive_entities", "entity_candidate_rows": "candidate_entities", "phoneme_negative_rows": "phoneme_negative_entities"}
    # labels are costly and read twice, so these few columns of them are staged
    slim = staged(rows.select("split", "dialogue_id", "utterance_id", "profile", "bias_type", "context_error_type", *[(F.size(c) > 0).cast("bigint").alias(name) for name, c in filled.items()]))
    # rows fold at once to counts of (split, profile, bias type, error type); all else but the distinct ids follows from these
    counts = [F.count("*").alias("n"), *[F.sum(name).alias(name) for name in filled]]
    # a row for each combination that occurs, read by five aggregates
    combined = staged(slim.groupBy("split", "profile", "bias_type", "context_error_type").agg(*counts))
    fine = combined.withColumn("split", F.explode(F.array(*either)))
    ids = slim.select("split", "dialogue_id", "utterance_id").distinct().withColumn("split", F.explode(F.array(*either)))
    base = distinct_counts(ids, {"dialogues": "dialogue_id", "utterances": "utterance_id"}, "split")
    base = base.join(fine.groupBy("split").agg(F.sum("n").alias("records"), *[F.sum(name).alias(name) for name in filled]), "split")

    def folded(key: str, name: str) -> DataFrame:
        by_key = fine.where(F.col(key) != "").groupBy("split", key).agg(F.sum("n").alias("n"))
        return by_key.groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))

    groups = splits.withColumn("split", F.explode(F.array(*either))).groupBy("split").agg(F.count("*").alias("groups"))
    out = groups.join(base, "split", "left").join(folded("profile", "profiles"), "split", "left").join(folded("bias_type", "bias_types"), "split", "left").join(folded("context_error_type", "context_error_types"), "split", "left")
    empty = F.create_map().cast("map<string,bigint>")
    out = out.withColumns({c: F.coalesce(c, empty) for c in ("profiles", "bias_types", "context_error_types")})
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("dialogues", "utterances", "records", "entity_positive_rows", "entity_candidate_rows", "phoneme_negative_rows")})
    return out.withColumn("bias_type_ratios", F.transform_values("bias_types", lambda _, n: F.round(n / F.greatest("records", F.lit(1)), 6)))


def selection_summary(df: DataFrame, profile: str = "profile", entities: str = "positive_entities") -> DataFrame:
    """One row: records, distinct dialogues, utterances and entities, and counts by profile."""
    base = df.agg(F.count("*").alias("records")).crossJoin(distinct_counts(df, {"dialogues": "dialogue_id", "utterances": "utterance_id"}))
    names = distinct_counts(df.select(F.explode(entities).alias("e")), {"entities": "e"})
    # each side is one row
    return base.crossJoin(names).crossJoin(counter_map(df, profile, "profiles"))


#: Row digests that one lane of a content digest may hold on average: 64 MB of them.
LANE_ROWS = 1 << 20


def content_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row: rows and a digest of them that does not depend on their order.

    Row digests are sorted inside lanes of equal leading digits, and the lanes' digests, in order, are digested again,
    so no task holds all rows. There are 16^3 lanes, and 16 times as many for each 16-fold of rows beyond LANE_ROWS a lane.
    """
    rows, digits = df.count(), 3
    while rows > LANE_ROWS * 16**digits:
        digits += 1
    row = F.sha2(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"}), 256)
    hashed = df.select(row.alias("h")).withColumn("lane", F.substring("h", 1, digits))
    by_lane = hashed.groupBy("lane").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ","), 256).alias("d"))
    return by_lane.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lane", "d"))), lambda x: x["d"]), ","), 256).alias("digest"))
