"""Signal functions on array columns: built-in array expressions where they suffice, Arrow batches of kernels elsewhere."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quayline

from quayline.functions.kernels import Bank, Channel, bandpass, features, resample
from quayline.functions.profiles import FIELDS

# Python workers do not inherit the driver's sys.path, so functions of this package travel by value.
cloudpickle.register_pickle_by_value(quayline)

FEATURES = ("rms_db", "energy_0_300", "energy_300_3400", "energy_3400_8000", "energy_8000_plus", "centroid_hz", "rolloff95_hz")
FEATURE_TYPE = ", ".join(f"{f} double" for f in FEATURES)


def _double(a: Column | str) -> Column:
    return (F.col(a) if isinstance(a, str) else a).cast("array<double>")


def _sum(a: Column, each) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + each(x))


def rms_db(a: Column | str) -> Column:
    """20 log10 of the root mean square, with 1e-12 under root and logarithm."""
    x = _double(a)
    return F.log10(F.sqrt(_sum(x, lambda v: v * v) / F.size(x) + 1e-12) + 1e-12) * 20


def peak(a: Column | str) -> Column:
    return F.array_max(F.transform(_double(a), F.abs))


def scale(a: Column | str, factor: Column | float) -> Column:
    return F.transform(_double(a), lambda v: v * factor)


def set_rms(a: Column | str, level: Column | float) -> Column:
    """``a`` scaled to the level in dB."""
    return scale(a, F.pow(F.lit(10.0), (F.lit(level) - rms_db(a)) / 20))


def saturate(a: Column | str, drive: Column | float) -> Column:
    return F.transform(_double(a), lambda v: F.tanh(v * drive))


def clip(a: Column | str, most: float = 0.98) -> Column:
    return F.transform(_double(a), lambda v: F.greatest(F.least(v, F.lit(most)), F.lit(-most)))


def crop_head(a: Column | str, ms: Column | int, rate: Column | int) -> Column:
    """Without the first milliseconds, unless that is nothing or all."""
    x = F.col(a) if isinstance(a, str) else a
    n = F.floor(F.lit(ms) / F.lit(1000.0) * F.lit(rate)).cast("int")
    return F.when((n <= 0) | (n >= F.size(x)), x).otherwise(F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))))


def tile(a: Column | str, length: int) -> Column:
    """``a`` repeated and cut to ``length``."""
    x = F.col(a) if isinstance(a, str) else a
    return F.slice(F.flatten(F.array_repeat(x, F.ceil(F.lit(length) / F.size(x)).cast("int"))), 1, length)


def window(a: Column | str, start: Column | int, length: Column | int) -> Column:
    """The clip from ``start`` (0-based), as long as there are samples."""
    return F.slice(F.col(a) if isinstance(a, str) else a, F.lit(start) + 1, F.lit(length))


def mono(channels: Column | str) -> Column:
    """The mean over channels (an array of equally long arrays)."""
    c = F.col(channels) if isinstance(channels, str) else channels
    first = F.transform(F.element_at(c, 1), lambda v: v * F.lit(0.0))
    return F.transform(F.aggregate(c, first.cast("array<double>"), lambda s, x: F.zip_with(s, x, lambda p, q: p + q)), lambda v: v / F.size(c))


def frames(df: DataFrame, samples: str, size: Column | int, index: str = "frame_idx") -> DataFrame:
    """One row for each consecutive frame of ``size`` samples; the last may be short."""
    n = F.ceil(F.size(samples) / F.lit(size)).cast("int")
    starts = F.when(F.size(samples) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return df.withColumn(index, F.explode(starts)).withColumn(samples, F.slice(F.col(samples), F.col(index) * F.lit(size) + 1, F.lit(size)))


def power_spectrum(a: Column | str, n: int) -> Column:
    """|DFT|^2 of the mean-free, Hann-windowed ``n`` samples, by sums of sines and cosines: for short frames only."""
    mean = F.aggregate(_double(a), F.lit(0.0), lambda s, v: s + v) / n
    win = [0.5 - 0.5 * np.cos(2 * np.pi * i / (n - 1)) for i in range(n)]
    shaped = F.transform(F.arrays_zip(_double(a).alias("v"), F.array(*map(F.lit, map(float, win))).alias("w")), lambda z: (z["v"] - mean) * z["w"])
    def part(turn) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(n // 2)), lambda k: F.aggregate(F.transform(shaped, lambda x, i: x * turn(F.lit(2 * np.pi / n) * ((k * i) % n))), F.lit(0.0), lambda s, v: s + v))
    return F.zip_with(part(F.cos), part(F.sin), lambda c, s: c * c + s * s)


def _array(values) -> np.ndarray:
    return np.asarray(values, np.float32)


def feature_struct(samples: str, rate: str) -> Column:
    """The features of a clip as a struct of doubles."""

    @F.pandas_udf(FEATURE_TYPE)
    def run(clips: pd.Series, rates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(_array(x), int(r)) for x, r in zip(clips, rates, strict=True)], columns=list(FEATURES))

    return run(F.col(samples), F.col(rate))


def bandpassed(samples: str, rate: str, low: Column | str, high: Column | str) -> Column:
    """The clip between the frequencies of two columns."""

    @F.pandas_udf("array<float>")
    def run(clips: pd.Series, rates: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.Series:
        return pd.Series([bandpass(_array(x), int(r), float(a), float(b)) for x, r, a, b in zip(clips, rates, lows, highs, strict=True)])

    return run(F.col(samples), F.col(rate), *(F.col(c) if isinstance(c, str) else c for c in (low, high)))


def resampled(samples: str, rate: str, target: int) -> Column:
    @F.pandas_udf("array<float>")
    def run(clips: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([resample(_array(x), int(r), target) for x, r in zip(clips, rates, strict=True)])

    return run(F.col(samples), F.col(rate))


def python_round(c: Column, digits: int) -> Column:
    """Half-even rounding of the exact binary value, which no built-in does."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else round(v, digits))

    return run(c)


#: Bytes of bank clips that one broadcast may hold.
MOST_BANK_BYTES = 512 << 20


def load_bank(items: DataFrame) -> list[tuple]:
    """The clips of a bank from rows (category, samples, sample_rate, and path for the order); refused beyond MOST_BANK_BYTES."""
    size = items.agg(F.coalesce(F.sum(F.size("samples")), F.lit(0)).alias("n")).first()["n"] * 4
    if size > MOST_BANK_BYTES:
        raise ValueError(f"the bank holds {size} bytes; at most {MOST_BANK_BYTES} are broadcast")
    rows = items.select("category", "samples", "sample_rate", "path").orderBy("category", F.split("path", "/")).collect()
    return [(r["category"], _array(r["samples"]), r["sample_rate"]) for r in rows]


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over the cores if its rows lie in so few partitions that some would be idle.

    The partitions with rows are counted by a job that reads no samples, and rows that a kernel has made were dealt before it. A
    table with partitions enough is never shuffled, and the shuffle of another costs far less than the kernels.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if re.search("InPandas|ArrowEvalPython", df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    filled = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(4 * cores) if filled < 2 * cores else df


#: Rows and bytes of an Arrow batch of clips, whichever is reached first. A tail makes a short clip many times as long, so what
#: kernels make is handed on in batches of at most as many bytes as well (a longer clip is one batch).
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that has set no bounds of its own; read when a plan runs, so they stay set."""
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(bound))


def in_parts(batch: pd.DataFrame, samples: str, made: Iterator[np.ndarray]) -> Iterator[pd.DataFrame]:
    """``batch`` with the clips that are ``made`` for its rows, in parts of at most BATCH_BYTES of them or of one row."""
    first, held, clips = 0, 0, []
    for clip in made:
        if clips and held + clip.nbytes > BATCH_BYTES:
            yield batch.iloc[first : first + len(clips)].assign(**{samples: clips})
            first, held, clips = first + len(clips), 0, []
        clips.append(clip)
        held += clip.nbytes
    if clips:
        yield batch.iloc[first:].assign(**{samples: clips})


#: Steps of the channel that can be run alone; each then draws from a stream of its own.
_STEPS = ("augment", "with_noise", "with_residual", "with_dropouts", "with_tail")


def _each(df: DataFrame, samples: str, rate: str, seed: str, bank: list[tuple] | None, *steps: str) -> DataFrame:
    """``df`` with its samples after ``steps`` in turn, all in one Python worker a task."""
    shared = df.sparkSession.sparkContext.broadcast(bank)
    fields = [f for f in FIELDS if f != "profile"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clips = None if shared.value is None else Bank(shared.value)
        def heard(row: dict) -> np.ndarray:
            profile, clip = {f: list(row[f]) if f == "noise_categories" else row[f] for f in fields}, _array(row[samples])
            for step in steps:
                number = _STEPS.index(step)
                channel = Channel(profile, int(row[rate]), [int(row[seed]), number] if number else int(row[seed]), clips)
                clip = _array(getattr(channel, step)(clip))
            return clip

        for batch in batches:
            yield from in_parts(batch, samples, map(heard, batch[[samples, rate, seed, *fields]].to_dict("records")))

    small_batches(df.sparkSession)
    rows = spread(df.withColumn(samples, F.col(samples).cast("array<float>")))
    return rows.mapInPandas(run, rows.schema)


def augment(df: DataFrame, samples: str = "samples", rate: str = "sample_rate", seed: str = "scene_seed", bank: list[tuple] | None = None) -> DataFrame:
    """``df`` (with the profile's fields) with its samples as that channel would carry them; one Arrow stage."""
    return _each(df, samples, rate, seed, bank, "augment")


def add_noise(df: DataFrame, samples: str = "samples", rate: str = "sample_rate", seed: str = "scene_seed", bank: list[tuple] | None = None) -> DataFrame:
    return _each(df, samples, rate, seed, bank, "with_noise")


def add_residual_noise(df: DataFrame, samples: str = "samples", rate: str = "sample_rate", seed: str = "scene_seed") -> DataFrame:
    return _each(df, samples, rate, seed, None, "with_residual")


def add_dropouts(df: DataFrame, samples: str = "samples", rate: str = "sample_rate", seed: str = "scene_seed") -> DataFrame:
    return _each(df, samples, rate, seed, None, "with_dropouts")


def add_residual_noise_and_dropouts(df: DataFrame, samples: str = "samples", rate: str = "sample_rate", seed: str = "scene_seed") -> DataFrame:
    """As ``add_dropouts`` over ``add_residual_noise``, in one stage."""
    return _each(df, samples, rate, seed, None, "with_residual", "with_dropouts")


def add_tail(df: DataFrame, samples: str = "samples", rate: str = "sample_rate", seed: str = "scene_seed", bank: list[tuple] | None = None) -> DataFrame:
    return _each(df, samples, rate, seed, bank, "with_tail")
