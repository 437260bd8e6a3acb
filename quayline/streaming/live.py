"""Streaming forms: an append log of rows, and tail events from a stream of frames with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

import quayline
from quayline.operators.series import LEAST_RUN

cloudpickle.register_pickle_by_value(quayline)


def read_rows(spark: SparkSession, path: str, schema: str | StructType, max_files: int = 64) -> DataFrame:
    """A stream of JSON lines; ``max_files`` a trigger bounds the work in flight, and the checkpoint makes reruns resume."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)


def append_rows(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream's rows to a JSON folder, once each."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def live_runs(frames: DataFrame, threshold: float, least: int = LEAST_RUN) -> DataFrame:
    """(series_id, start_idx, end_idx) of each run of at least ``least`` frames above ``threshold``, as soon as it ends.

    Frames (series_id string, frame_idx bigint, rms_db double) of a series come in order from one micro-batch to the next.
    State: the start of the open run and the next frame due. A stream has no whole-series percentile, so the threshold is given.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, due = state.get if state.exists else (-1, -1)
        rows = pd.concat(list(parts)).sort_values("frame_idx")
        ended = []
        for idx, level in zip(rows["frame_idx"].to_numpy(), rows["rms_db"].to_numpy(), strict=True):
            if start >= 0 and (idx != due or not level > threshold):
                if due - start >= least:
                    ended.append((key[0], start, due))
                start = -1
            if level > threshold and start < 0:
                start = int(idx)
            due = int(idx) + 1
        state.update((int(start), int(due)))
        yield pd.DataFrame(ended, columns=["series_id", "start_idx", "end_idx"]).astype({"start_idx": np.int64, "end_idx": np.int64})

    return frames.groupBy("series_id").applyInPandasWithState(step, "series_id string, start_idx bigint, end_idx bigint", "start bigint, due bigint", "append", GroupStateTimeout.NoTimeout)
