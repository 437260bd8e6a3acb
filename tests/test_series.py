import numpy as np
from pyspark.sql import functions as F

from quayline.operators import series

SCHEMA = "series_id string, frame_idx bigint, rms_db double, peak double, centroid_hz double, samples array<double>"


def frames(spark, name, active, n=200, hits=()):
    level = lambda i: -20.0 if any(a <= i < b for a, b in active) else -10.0 if i in hits else -60.0
    return [(name, i, level(i), 0.5 if i in hits else 0.01, 900.0, [float(i)]) for i in range(n)]


def test_runs_of_nine_ten_eleven_and_to_the_end(spark):
    df = spark.createDataFrame(frames(spark, "a", [(5, 14), (30, 40), (60, 71), (190, 200)]), SCHEMA)
    assert sorted((r.start_idx, r.end_idx) for r in series.active_runs(df).collect()) == [(30, 40), (60, 71), (190, 200)]


def test_look_ahead_holds_ten_frames(spark):
    rows = frames(spark, "in", [(30, 40)], hits=(49,)) + frames(spark, "out", [(30, 40)], hits=(50,)) + frames(spark, "end", [(190, 200)])
    df = spark.createDataFrame(rows, SCHEMA)
    events = series.tail_events(df, series.event_hit())
    assert [(r.series_id, r.end_idx, r.event_idx) for r in events.collect()] == [("in", 40, 49)]
    clip = series.event_clips(df, events).first()
    assert clip.samples == [49.0, 50.0, 51.0, 52.0, 53.0]


def test_percentiles_are_interpolated(spark):
    values = [0.0, 1.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([("s", i, v, 0.0, 0.0, []) for i, v in enumerate(values)], SCHEMA)
    got = series.frame_stats(df).first()
    assert abs(got.floor - np.percentile(values, 20)) < 1e-12 and got.median_level == 2.0


def test_caps(spark):
    df = spark.range(10).withColumn("category", F.lit("c"))
    assert [r.id for r in series.capped(df, "category", "id", most=3).orderBy("id").collect()] == [0, 1, 2]
    assert series.capped_events(df, "id", most=0).count() == 1


def test_noise_classes(spark):
    rows = [(-58.0, 0.0), (-50.0, 0.45), (-50.0, 0.4), (-45.0, 0.5), (-31.0, 0.5), (-30.0, 0.9)]
    got = [r[0] for r in spark.createDataFrame(rows, "l double, b double").select(series.noise_class(F.col("l"), F.col("b"))).collect()]
    assert got == ["bed_static", "weak_channel", None, "weak_channel", "busy_channel", None]
