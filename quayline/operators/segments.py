"""Runs of consecutive places along long series, found in blocks and joined where blocks meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a place within a block, level by level; after the last one a whole series is one block. Of a series of n places a
#: task of the levels holds at most 2^12, 2^13 (two pieces for each smaller block) and n / 2^23 rows.
LEVELS = (12, 24)


def runs(places: DataFrame, series: str, index: str) -> DataFrame:
    """(series, start_idx, end_idx): the maximal runs of consecutive integers ``index`` of each series, end exclusive.

    Repeated rows count once; null places and null series are dropped. A segmented scan: runs inside a block are closed or
    touch an edge of it, and only those that touch one can go on in the next block. They alone meet in the blocks of the next
    level, where neighbours are joined; the others pass by under keys of their own, so no level gathers a series.
    """
    at = places.where(F.col(series).isNotNull() & F.col(index).isNotNull()).select(series, F.col(index).cast("bigint").alias("__at"), F.shiftright(F.col(index).cast("bigint"), LEVELS[0]).alias("__block")).distinct()
    island = F.col("__at") - F.row_number().over(Window.partitionBy(series, "__block").orderBy("__at"))
    pieces = at.withColumn("__island", island).groupBy(series, "__block", "__island").agg(F.min("__at").alias("start_idx"), (F.max("__at") + 1).alias("end_idx"))
    for below, bits in zip(LEVELS, (*LEVELS[1:], None), strict=True):
        width = F.lit(1 << below)
        open_ = (F.pmod("start_idx", width) == 0) | (F.pmod("end_idx", width) == 0)
        block = F.lit(0).cast("bigint") if bits is None else F.shiftright("start_idx", bits)
        keyed = pieces.select(series, "start_idx", "end_idx", F.when(open_, block).alias("__block"), F.when(~open_, F.col("start_idx")).alias("__alone"))
        along = Window.partitionBy(series, "__block", "__alone").orderBy("start_idx")
        begins = F.when(F.lag("end_idx").over(along) == F.col("start_idx"), 0).otherwise(1)
        numbered = keyed.withColumn("__begins", begins).withColumn("__run", F.sum("__begins").over(along))
        pieces = numbered.groupBy(series, "__block", "__alone", "__run").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"))
    return pieces.select(series, "start_idx", "end_idx")
