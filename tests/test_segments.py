import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.operators import ranking, segments, selection, series


def brute_runs(places):
    out = []
    for s in {s for s, _ in places}:
        at = sorted({i for t, i in places if t == s})
        first = 0
        for k in range(1, len(at) + 1):
            if k == len(at) or at[k] != at[k - 1] + 1:
                out.append((s, at[first], at[k - 1] + 1))
                first = k
    return sorted(out)


@pytest.mark.parametrize("levels", [(1, 2), (2, 5), (12, 24)])
def test_runs_match_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(segments, "LEVELS", levels)
    rng = random.Random(1)
    places = [(s, i) for s, part in (("a", 0.5), ("b", 0.9), ("c", 1.0), ("d", 0.02)) for i in range(-40, 200) if rng.random() < part]
    df = spark.createDataFrame([*places, *places[:20], ("a", None), (None, 3)], "series_id string, n long")
    got = segments.runs(df, "series_id", "n")
    assert sorted(map(tuple, got.collect())) == brute_runs(places)
    assert segments.runs(spark.createDataFrame([], "series_id string, n int"), "series_id", "n").count() == 0


def test_one_long_series_takes_many_tasks(spark):
    n = 3_000_000
    # active but for a gap at every 700,000th frame, which the blocks do not know
    frames = spark.range(n).select(F.lit("s").alias("series_id"), F.col("id").alias("frame_idx"), F.when(F.col("id") % 700_000 == 699_999, -60.0).when(F.col("id") < 1_600_000, -60.0).otherwise(-20.0).alias("rms_db"))
    got = sorted((r.start_idx, r.end_idx, r.floor) for r in series.active_runs(frames).collect())
    assert got == [(1_600_000, 2_099_999, -60.0), (2_100_000, 2_799_999, -60.0), (2_800_000, n, -60.0)]
    # no exchange deals rows by the series alone
    plan = segments.runs(frames, "series_id", "frame_idx")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert dealt and all("__" in keys for keys in dealt)


@pytest.mark.parametrize("seed", range(3))
def test_percentiles_equal_the_built_in(spark, seed):
    rng = np.random.default_rng(seed)
    odd = [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, float("inf"), float("-inf"), float("nan"), 5e-324, 1.7e308]
    rows = [("hot", float(v)) for v in rng.normal(-60, 1e-3 if seed else 20, 4000)] + [("ties", float(v)) for v in rng.integers(-2, 3, 300)] + [("one", 2.5), ("none", None), (None, 1.0), (None, 4.0)]
    rows += [("odd", rng.choice(odd)) for _ in range(41)] + [("wide", float(10.0**k * s)) for k in range(-30, 31, 2) for s in (1, -1)]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double")
    points = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.g: [r[p] for p in points] for r in selection.exact_percentiles(df, "g", "v", points).collect()}
    want = {r.g: list(r[1:]) for r in df.where("v is not null").groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(p) for p, q in points.items()]).collect()}
    assert got.keys() == want.keys()
    for g, values in want.items():
        assert np.array_equal(got[g], values, equal_nan=True), (g, got[g], values)


@pytest.mark.parametrize("within", [None, "s"])
def test_running_totals_match_brute_force(spark, within):
    rng = random.Random(4)
    orders = rng.sample(range(-(10**6), 10**6), 500) + [2**60, -(2**60), 2**53, 2**53 + 1]
    rows = [(i, rng.choice(["x", "y", None]), rng.randrange(9)) for i in orders]
    got = ranking.running_total(spark.createDataFrame(rows, "i long, s string, n long"), "i", "n", "before", within)
    assert got.columns == ["i", "s", "n", "before"]
    want = {i: sum(m for j, t, m in rows if j < i and (within is None or t == s)) for i, s, n in rows}
    assert {r.i: r.before for r in got.collect()} == want
    assert ranking.running_total(spark.createDataFrame([], "i long, s string, n long"), "i", "n", "before", within).count() == 0


def test_a_running_total_evaluates_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).withColumn("n", F.lit(1).cast("long")).mapInArrow(count, "id long, n long")
    assert ranking.running_total(rows, "id", "n", "before").where("before != id").count() == 0
    assert seen.value == 1000
