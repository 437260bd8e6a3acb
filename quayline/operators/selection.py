"""Exact percentiles of groups of any size, without holding a group's values together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.operators.staging import staged

#: Cells for each e-fold of a value's size, the sizes from which on and up to which they are told apart, and even parts of a cell.
FOLD_CELLS, UNIT, LARGE, PARTS = 4096, 2.0**-20, 1e300, 4096


def _cell(value: Column) -> Column:
    """A number that does not fall as the value rises: cells of the logarithm of its size, with NaN above infinity."""
    size = F.floor(F.log1p(F.least(F.abs(value), F.lit(LARGE)) / F.lit(UNIT)) * FOLD_CELLS)
    size = F.when(F.abs(value) > F.lit(LARGE), F.lit(1 << 40)).otherwise(size)
    return F.when(F.isnan(value), F.lit(1 << 41)).when(value < 0, -size).otherwise(size).cast("bigint")


def _part(value: Column, low: Column, high: Column) -> Column:
    """The even part of a cell from ``low`` to ``high`` that a value falls in; cells without finite bounds are one part."""
    place = (value - low) / (high - low) * (PARTS - 1)
    fits = (high > low) & (F.abs(high) <= F.lit(LARGE)) & (F.abs(low) <= F.lit(LARGE))
    return F.when(fits, F.floor(F.when(fits, place).otherwise(0.0))).otherwise(0).cast("bigint")


def _narrow(counts: DataFrame, wanted: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """``wanted`` ranks with the cell that each falls in and its rank there. A key's cells are bounded, whatever its rows."""
    before = counts.withColumn("__before", F.sum("__n").over(Window.partitionBy(*keys).orderBy(cell)) - F.col("__n"))
    met = before.join(wanted, keys).where((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__n")))
    return met.withColumn("__rank", F.col("__rank") - F.col("__before")).drop("__before", "__n")


def exact_percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """(group, then a column for each of ``points``): percentiles from 0 to 1, interpolated as Spark's ``percentile``.

    Null values do not count, and a group without others has no row; NaN is the largest value. Selection by histograms: counts
    by cells of a value's logarithm tell in which cell a wanted rank lies, counts by even parts of that cell in which part, and
    only the different values of that part are sorted. So a task holds cells, parts or the values of one part, but no group.
    Values are staged, as three jobs read them. A null group is a group.
    """
    rows = staged(df.where(F.col(value).isNotNull()).select(F.struct(F.col(group)).alias("__g"), F.col(value).cast("double").alias("__v")).withColumn("__c", _cell(F.col("__v"))))
    cells = staged(rows.groupBy("__g", "__c").agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high")))
    total = cells.groupBy("__g").agg(F.sum("__n").alias("__total"))
    place = lambda q: (F.col("__total") - 1).cast("double") * F.lit(float(q))
    asked = [F.struct(F.lit(name).alias("__name"), F.lit(side).alias("__side"), half(place(q)).cast("bigint").alias("__rank")) for name, q in points.items() for side, half in (("low", F.floor), ("high", F.ceil))]
    wanted = total.select("__g", F.explode(F.array(*asked)).alias("__w")).select("__g", "__w.*")
    wanted = staged(_narrow(cells, wanted, ["__g"], "__c"))

    inside = rows.join(wanted.select("__g", "__c", "__low", "__high").distinct(), ["__g", "__c"]).withColumn("__p", _part(F.col("__v"), F.col("__low"), F.col("__high")))
    parts = inside.groupBy("__g", "__c", "__p").agg(F.count("*").alias("__n"))
    wanted = staged(_narrow(parts, wanted.drop("__low", "__high"), ["__g", "__c"], "__p"))

    keys = ["__g", "__c", "__p"]
    values = inside.join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, "__v").agg(F.count("*").alias("__n"))
    found = _narrow(values, wanted, keys, "__v").groupBy("__g").agg(*[F.max(F.when((F.col("__name") == name) & (F.col("__side") == side), F.col("__v"))).alias(f"__{side}_{name}") for name in points for side in ("low", "high")])

    def between(name: str, q: float) -> Column:
        low, high, at = F.col(f"__low_{name}"), F.col(f"__high_{name}"), place(q)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return found.join(total, "__g").select(F.col(f"__g.{group}").alias(group), *[between(name, q) for name, q in points.items()])
