"""Global ranks and running sums without a single-task window."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quayline.operators.staging import staged

#: Ranges of a running sum at least; their sums are the only rows that meet in one task.
LEAST_RANGES = 16


def _offsets(df: DataFrame, amount: Column) -> DataFrame:
    sums = df.groupBy("__bucket").agg(F.sum(amount).alias("__sum"))
    return sums.select("__bucket", (F.sum("__sum").over(Window.orderBy("__bucket")) - F.col("__sum")).alias("__before"))


def hash_rank(df: DataFrame, digest: Column, *ties: str) -> DataFrame:
    """``df`` with ``rank`` (from 0) in the order of a hex digest, then of the columns ``ties``.

    The first three hex digits give 4096 even buckets: rows are ranked inside a bucket and shifted by the counts of the
    buckets before it (at most 4096 rows, so their broadcast is bounded).
    """
    rows = df.withColumn("__digest", digest).withColumn("__bucket", F.substring("__digest", 1, 3))
    inside = Window.partitionBy("__bucket").orderBy("__digest", *ties)
    ranked = rows.withColumn("__in", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(_offsets(rows, F.lit(1))), "__bucket").withColumn("rank", F.col("__before") + F.col("__in")).drop("__digest", "__bucket", "__in", "__before")


def running_total(df: DataFrame, order: str, amount: str, name: str, within: str | None = None) -> DataFrame:
    """``df`` with ``name``: the sum of ``amount`` over all rows with a smaller integer ``order`` (unique), of the same ``within`` if one is named.

    ``df`` is evaluated once: it is staged, and the job that writes it tells quantiles of ``order``. Rows fall in as many ranges
    as the session has shuffle partitions (LEAST_RANGES at least) with about as many rows in each, whatever the gaps and outliers;
    sums run inside a range and start from the sums of those before it, which are read from two columns of the staged table.
    """
    parts = max(LEAST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    told = Observation()
    steps = [i / parts for i in range(1, parts)]
    table = staged(df.observe(told, F.percentile_approx(F.col(order).cast("double"), steps, 8 * parts).alias("q")))
    edges = [float("-inf"), *sorted(set(told.get["q"] or [0.0])), float("inf")]
    bucketed = Bucketizer(splits=edges, inputCol="__order", outputCol="__bucket", handleInvalid="keep").transform(table.withColumn("__order", F.col(order).cast("double"))).drop("__order")
    groups = [within] if within else []
    inside = Window.partitionBy(*groups, "__bucket").orderBy(order)
    summed = bucketed.withColumn("__in", F.sum(amount).over(inside) - F.col(amount))
    sums = bucketed.groupBy(*groups, "__bucket").agg(F.sum(amount).alias("__sum"))
    # one row for each range of each group
    starts = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("__bucket")
    offsets = sums.select(F.col("__bucket").alias("__range"), *[F.col(g).alias("__group") for g in groups], (F.sum("__sum").over(starts) - F.col("__sum")).alias("__before"))
    met = F.col("__bucket") == F.col("__range")
    both = summed.join(offsets, met & F.col(within).eqNullSafe(F.col("__group"))) if within else summed.join(F.broadcast(offsets), met)
    return both.withColumn(name, F.col("__before") + F.col("__in")).select(*df.columns, name)
