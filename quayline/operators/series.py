"""Frame series: floors, activity, runs of active frames, tail events, and noise classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.operators import segments
from quayline.operators.selection import exact_percentiles
from quayline.operators.staging import staged

# The noise categories and the thresholds of level and speech-band part.
BED_LEVEL, WEAK_LEVEL, BUSY_LEVEL, BAND_PART = -58.0, -45.0, -31.0, 0.45
FLOOR_PERCENTILE, FLOOR_RISE, MEDIAN_RISE = 0.2, 12.0, 6.0
EVENT_RISE, EVENT_PEAK, EVENT_CENTROID = 18.0, 0.08, 700.0
LEAST_RUN, LOOK_AHEAD, EVENT_FRAMES = 10, 10, 5
MOST_PER_CATEGORY, MOST_EVENTS = 128, 128


def noise_class(level: Column, band: Column) -> Column:
    """bed_static, weak_channel, busy_channel or null (rejected)."""
    return F.when(level <= BED_LEVEL, "bed_static").when((level <= WEAK_LEVEL) & (band >= BAND_PART), "weak_channel").when((level > WEAK_LEVEL) & (level <= BUSY_LEVEL) & (band >= BAND_PART), "busy_channel")


def path_order(path: str) -> Column:
    """Paths sort by their parts."""
    return F.split(path, "/")


def capped(df: DataFrame, category: str, *order: Column | str, most: int = MOST_PER_CATEGORY, index: str = "category_index") -> DataFrame:
    """The first ``most`` rows of each category in ``order``, numbered from 1; group limits run before the shuffle."""
    along = Window.partitionBy(category).orderBy(*order)
    return df.withColumn(index, F.row_number().over(along)).where(F.col(index) <= most)


def frame_stats(frames: DataFrame, series: str = "series_id", level: str = "rms_db") -> DataFrame:
    """(series, frames, floor, median_level, threshold): exact interpolated percentiles. Levels are selected, not gathered."""
    counts = frames.groupBy(series).agg(F.count("*").alias("frames"))
    found = exact_percentiles(frames, series, level, {"floor": FLOOR_PERCENTILE, "median_level": 0.5})
    stats = counts.join(found, counts[series].eqNullSafe(found[series]), "left").drop(found[series])
    return stats.withColumn("threshold", F.greatest(F.col("floor") + FLOOR_RISE, F.col("median_level") + MEDIAN_RISE))


def active_runs(frames: DataFrame, series: str = "series_id", index: str = "frame_idx", level: str = "rms_db", least: int = LEAST_RUN) -> DataFrame:
    """(series, start_idx, end_idx, floor): maximal runs of at least ``least`` frames above the threshold, end exclusive.

    Frames of a series are numbered without gaps. The few statistics are staged, so that a long series' frames can be dealt to
    many tasks where they meet its threshold; runs are joined over blocks (``segments.runs``).
    """
    stats = staged(frame_stats(frames, series, level))
    marked = frames.join(stats.select(series, "threshold"), series).where(F.col(level) > F.col("threshold"))
    found = segments.runs(marked, series, index).where(F.col("end_idx") - F.col("start_idx") >= least)
    return found.join(stats.select(series, "floor"), series)


def event_hit(level: str = "rms_db", peak: str = "peak", centroid: str = "centroid_hz") -> Column:
    """The event test of a frame that carries its series' ``floor``."""
    return (F.col(level) > F.col("floor") + EVENT_RISE) & (F.col(peak) > EVENT_PEAK) & (F.col(centroid) > EVENT_CENTROID)


def tail_events(frames: DataFrame, hit: Column, series: str = "series_id", index: str = "frame_idx", level: str = "rms_db", least: int = LEAST_RUN, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """(series, end_idx, event_idx): for each run the first frame of ``hit`` within ``look_ahead`` frames from its end.

    The range join is an equi-join: a run offers each of the next ``look_ahead`` places, a fixed number.
    """
    runs = active_runs(frames, series, index, level, least)
    places = runs.select(series, "end_idx", "floor", F.explode(F.sequence("end_idx", F.col("end_idx") + (look_ahead - 1))).alias(index))
    return places.join(frames, [series, index]).where(hit).groupBy(series, "end_idx").agg(F.min(index).alias("event_idx"))


def event_clips(frames: DataFrame, events: DataFrame, series: str = "series_id", index: str = "frame_idx", samples: str = "samples", count: int = EVENT_FRAMES) -> DataFrame:
    """``events`` with the samples of the event's frame and the next ones, joined (fewer at the end of a series)."""
    places = events.select("*", F.explode(F.sequence("event_idx", F.col("event_idx") + (count - 1))).alias(index))
    rows = places.join(frames.select(series, index, samples), [series, index])
    parts = rows.groupBy(series, "end_idx", "event_idx").agg(F.sort_array(F.collect_list(F.struct(index, samples))).alias("__parts"))
    return parts.withColumn(samples, F.flatten(F.transform("__parts", lambda p: p[samples]))).drop("__parts")


def capped_events(events: DataFrame, *order: Column | str, most: int = MOST_EVENTS) -> DataFrame:
    """The first events in ``order``: an ordered limit."""
    return events.orderBy(*order).limit(max(1, most))
