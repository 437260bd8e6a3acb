import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quayline.functions import dsp, kernels
from quayline.functions.profiles import FIELDS, PROFILES, SCHEMA
from quayline.plans import catalogue

RATE = 24_000


def tone(hz, n=RATE, rate=RATE):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate).astype(np.float32)


def test_bandpass_keeps_inside_and_loses_outside():
    mid = slice(4000, -4000)
    assert abs(kernels.decibels(kernels.bandpass(tone(1000), RATE, 300, 3400)[mid]) - kernels.decibels(tone(1000)[mid])) < 0.05
    assert kernels.decibels(kernels.bandpass(tone(60), RATE, 300, 3400)[mid]) < -60
    # forward and backward: half power twice at the edge
    assert abs(kernels.decibels(kernels.bandpass(tone(300), RATE, 300, 3400)[mid]) - kernels.decibels(tone(300)[mid]) + 6.02) < 0.1


def test_block_filter_is_the_recursion():
    x, s = np.random.default_rng(1).normal(size=700), kernels.butter_bandpass(4, 300, 3400, RATE)[2]
    z, want = [0.3, -0.2], []
    for v in x:
        o = s[0] * v + z[0]
        z = [s[1] * v - s[4] * o + z[1], s[2] * v - s[5] * o]
        want.append(o)
    assert np.allclose(kernels._filter(s, x, np.array([0.3, -0.2])), want, atol=1e-10)


def test_short_signals_are_refused():
    with pytest.raises(ValueError):
        kernels.bandpass(np.zeros(27, np.float32), RATE, 300, 3400)


def test_resampling_keeps_a_tone():
    out = kernels.resample(tone(440, 44_100, 44_100), 44_100, RATE)
    assert len(out) == RATE and np.abs(out - tone(440))[300:-300].max() < 1e-2
    assert len(kernels.resample(np.zeros(1000), 44_100, RATE)) == -(-1000 * 80 // 147)


def test_features_of_a_tone():
    f = kernels.features(tone(1000, 2400), RATE)
    assert f["energy_300_3400"] > 0.999 and abs(f["centroid_hz"] - 1000) < 5 and abs(f["rolloff95_hz"] - 1000) <= 20 and abs(f["rms_db"] + 3.01) < 0.05


@pytest.mark.parametrize("i", range(4))
def test_augmented_length_level_and_repeatability(i):
    profile = dict(zip(FIELDS, PROFILES[i], strict=True))
    out = kernels.Channel(profile, RATE, 5).augment(tone(700))
    crop, tail = (int(profile[k] / 1000 * RATE) for k in ("head_crop_ms", "tail_noise_ms"))
    assert len(out) == RATE - crop + tail and np.abs(out).max() <= 0.98
    assert np.array_equal(out, kernels.Channel(profile, RATE, 5).augment(tone(700)))
    assert not np.array_equal(out, kernels.Channel(profile, RATE, 6).augment(tone(700)))
    short = kernels.Channel(profile, RATE, 5).head(np.ones(crop))
    assert len(short) == crop


def test_bank_draws():
    bank = kernels.Bank([("a", np.arange(10, dtype=np.float32), RATE), ("tail_events", np.ones(4, np.float32), RATE)])
    rng = np.random.default_rng(1)
    assert bank.sample(["tail_events"], 9, RATE, rng).tolist() == [1.0] * 9
    got = bank.sample(["a"], 3, RATE, rng)
    assert np.diff(got).tolist() == [1.0, 1.0]
    with pytest.raises(KeyError):
        bank.sample(["none"], 3, RATE, rng)


def test_array_functions(spark):
    x = (tone(900, 64) * 0.5).tolist()
    df = spark.createDataFrame([(x, 64)], "x array<double>, n int")
    row = df.select(dsp.rms_db("x"), dsp.rms_db(dsp.set_rms("x", -30.0)), dsp.peak("x"), F.size(dsp.crop_head("x", 1000, 24)), F.size(dsp.crop_head("x", 1000, 64)), dsp.tile("x", 100)).first()
    assert abs(row[0] - kernels.decibels(np.array(x))) < 1e-9 and abs(row[1] + 30) < 1e-4 and abs(row[2] - max(map(abs, x))) < 1e-12
    assert row[3] == 40 and row[4] == 64 and row[5] == (x + x)[:100]
    f = df.withColumn("rate", F.lit(RATE)).select(dsp.feature_struct("x", "rate").alias("f")).first().f
    want = kernels.features(np.array(x), RATE)
    assert all(abs(f[k] - v) < 1e-6 for k, v in want.items())
    power = df.select(dsp.power_spectrum("x", 64)).first()[0]
    y = np.array(x) - np.mean(x)
    assert np.allclose(power, np.abs(np.fft.rfft(y * np.hanning(64))) ** 2, atol=1e-9)


def test_python_rounding(spark):
    values = [0.5005, 3.0625, 0.0005, 2.5]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(dsp.python_round(F.col("v"), 3)).collect()]
    assert got == [round(v, 3) for v in values]


def _scenes(spark, n):
    return spark.createDataFrame([(i, (tone(500 + i, 240) * 0.3).tolist(), RATE, i, *PROFILES[i % 4]) for i in range(n)], "id int, samples array<float>, sample_rate int, scene_seed int, " + SCHEMA).coalesce(1)


def test_noises_get_bounded_batches(spark):
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k in keys:
            spark.conf.unset(k)
        dsp.add_noise(_scenes(spark, 1))
        assert [int(spark.conf.get(k)) for k in keys] == [dsp.BATCH_ROWS, dsp.BATCH_BYTES]
        spark.conf.set(keys[0], "7")
        dsp.add_dropouts(_scenes(spark, 1))
        assert spark.conf.get(keys[0]) == "7"
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_what_kernels_make_is_handed_on_in_parts():
    batch = pd.DataFrame({"id": range(9), "samples": [np.ones(4, np.float32)] * 9})
    made = [np.full(n, n, np.float32) for n in (1 << 20, 1 << 20, 1, 2, 5 << 20, 3, 1 << 20, 1 << 20, 1 << 20)]
    parts = list(dsp.in_parts(batch, "samples", iter(made)))
    assert all(len(p) == 1 or sum(x.nbytes for x in p.samples) <= dsp.BATCH_BYTES for p in parts)
    assert [i for p in parts for i in p.id] == list(range(9)) and all(x is y for x, y in zip((x for p in parts for x in p.samples), made, strict=True))
    assert list(dsp.in_parts(batch[:0], "samples", iter([]))) == []


@pytest.mark.parametrize(("run", "step"), [(dsp.add_tail, "with_tail"), (dsp.augment, "augment")])
def test_parts_keep_every_clip(spark, monkeypatch, run, step):
    monkeypatch.setattr(dsp, "BATCH_BYTES", 50_000)  # tails of 3,600 to 14,400 samples: a part holds one to three clips
    df = _scenes(spark, 12)
    got = {r.id: r for r in run(df).collect()}
    assert len(got) == 12
    for i, r in got.items():
        profile = dict(zip(FIELDS, PROFILES[i % 4], strict=True))
        own = i if step == "augment" else [i, dsp._STEPS.index(step)]
        want = getattr(kernels.Channel(profile, RATE, own), step)((tone(500 + i, 240) * 0.3).astype(np.float32))
        assert np.array_equal(np.array(r.samples, np.float32), want.astype(np.float32)) and r.profile == profile["profile"]


def test_two_steps_in_one_stage(spark):
    df = _scenes(spark, 8)
    one = dsp.add_residual_noise_and_dropouts(df)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    want = dsp.add_dropouts(dsp.add_residual_noise(df))
    assert sorted(map(tuple, one.select("id", F.to_json("samples")).collect())) == sorted(map(tuple, want.select("id", F.to_json("samples")).collect()))


@pytest.mark.parametrize("name", ["augment", "add_tail", "add_noises"])
def test_clips_are_dealt_before_profiles_multiply_them(spark, name):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # a tree is written from its top: the one shuffle lies below the cross join
    assert plan.count("Repartition") == 1 and plan.index("Repartition") > plan.index("Join Cross")
