import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quayline.functions.profiles import NAMES
from quayline.operators import sampling

SCHEMA = "id string, profile string, dialogue_id bigint, utterance_id bigint, positive_entities array<string>, audio string"


def rows(n=240):
    return [(f"r{i}", (*NAMES, "other")[i % 5], i // 3, i, [f"e{i % 50}", ""] if i % 7 else [], f"o/shard_{i // 2 % 9}/{i}.wav") for i in range(n)]


def key(i):
    return hashlib.sha256(f"20260830:{i}".encode()).hexdigest(), i


def test_balanced_sample_is_the_first_by_hash_in_any_order(spark):
    data = rows()
    got = {r.id for r in sampling.balanced_sample(spark.createDataFrame(data[::-1], SCHEMA).repartition(3), 20).collect()}
    want = set()
    for p in NAMES:
        want |= set(sorted((r[0] for r in data if r[1] == p), key=key)[:5])
    assert got == want


def test_errors_come_first(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    for bad in (0, 6, -4):
        with pytest.raises(ValueError):
            sampling.balanced_sample(df, bad)
    with pytest.raises(ValueError, match="duplicate"):
        sampling.balanced_sample(df.union(df.where("profile = 'other'")), 4)
    with pytest.raises(ValueError, match="fewer"):
        sampling.balanced_sample(df, 4000)


def test_calibration_is_disjoint_on_three_keys(spark):
    a, b = (x.collect() for x in sampling.calibration_splits(spark.createDataFrame(rows(), SCHEMA), 8))
    assert len(a) == len(b) == 8
    assert {int(r.audio.split("_")[1].split("/")[0]) for r in a} <= {0, 1, 2, 3} and {int(r.audio.split("_")[1].split("/")[0]) for r in b} <= {4, 5, 6, 7}
    for field in ("dialogue_id", "utterance_id"):
        assert not {r[field] for r in a} & {r[field] for r in b}
    assert not {e for r in a for e in r.positive_entities if e} & {e for r in b for e in r.positive_entities}


def test_heldout_uses_normalized_entities(spark):
    train = spark.createDataFrame([("t", "vhf_clear", 900, 900, ["E1"], "x")], SCHEMA)
    pool = spark.createDataFrame([(f"c{i}", p, i, i, [e], "x") for i, (p, e) in enumerate((p, e) for p in NAMES for e in (" e1 ", f"f{p}"))], SCHEMA)
    got = sampling.heldout_test(train, pool, 4).collect()
    assert len(got) == 4 and all(r.positive_entities[0] != " e1 " for r in got)
    assert all(r.context_mode == 0 and r.source_frequency_bins == [] and r.no_prompt_source_id == r.id for r in got)


def test_unknown_bias_type_is_an_error(spark):
    with pytest.raises(Exception, match="unknown bias type"):
        sampling.counterfactual_fields(spark.createDataFrame([("a", "odd")], "id string, bias_type string")).collect()


@pytest.mark.parametrize("n,sizes", [(10, (7, 1, 2)), (20, (14, 3, 3)), (90, (62, 13, 15)), (100, (70, 15, 15))])
def test_split_sizes_truncate(spark, n, sizes):
    got = {r.split: r["count"] for r in sampling.split_groups(spark.range(n).withColumnRenamed("id", "g"), "g").groupBy("split").count().collect()}
    assert tuple(got[s] for s in sampling.SPLITS) == sizes


def test_split_options(spark):
    groups = spark.range(100).withColumnRenamed("id", "g")
    held = sampling.split_groups(groups, "g", holdout_min=60).collect()
    assert len(held) == 100 and all(r.split == "train" for r in held if r.group < 60) and sum(r.split == "test" for r in held) == 15
    with pytest.raises(ValueError):
        sampling.split_groups(groups, "g", holdout_min=90)
    few = sampling.split_groups(groups, "g", max_groups=10)
    assert sorted(r.group for r in few.collect()) == list(range(10))
    assert sampling.apply_split(groups, few, "g").count() == 10


def test_remainder(spark):
    df = spark.range(10).withColumn("id", F.col("id").cast("string"))
    assert sorted(r.id for r in sampling.remainder(df, df.where("id < 3"), df.where("id > 7")).collect()) == ["3", "4", "5", "6", "7"]


@pytest.mark.parametrize("holdout", [0, 40])
def test_mersenne_split_is_one_shuffle_of_the_sorted_groups(spark, holdout):
    got = {r.group: r.split for r in sampling.split_groups(spark.range(100).withColumnRenamed("id", "g"), "g", seed=9, holdout_min=holdout, generator="mersenne").collect()}
    order = [g for g in range(100) if g >= holdout]
    random.Random(9).shuffle(order)
    if holdout:
        validation, test = order[:15], order[15:30]
    else:
        validation, test = order[70:85], order[85:]
    assert {g for g, s in got.items() if s == "validation"} == set(validation) and {g for g, s in got.items() if s == "test"} == set(test) and len(got) == 100
    with pytest.raises(ValueError):
        sampling.split_groups(spark.range(9), "id", generator="other")
