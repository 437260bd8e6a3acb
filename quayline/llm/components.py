"""Connected components by alternating large-star and small-star steps, each one checkpointed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import broadcast_if, cut, forget, settled


def _minima(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(u, m): the least v of each u, checkpointed so that a join with it has two shuffles of which a hub's can be split; and that table with a broadcast hint if it is small."""
    least = cut(rows.groupBy("u").agg(F.min("v").alias("m")), most)
    return least, broadcast_if(least, 24)


def _large(edges: DataFrame, most: int) -> DataFrame:
    """Every node hands its larger neighbours to its least neighbour, itself included."""
    both = edges.union(edges.select("v", "u"))
    table, least = _minima(both, 2 * most)
    found = cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), most)
    forget(table)
    return found


def _small(edges: DataFrame, most: int) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    table, least = _minima(down, most)
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    found = cut(moved.union(table.select("u", F.col("m").alias("v"))).distinct(), 2 * most)
    forget(table)
    return found


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b) but the roots; the root is the smallest node it reaches.

    Self-links and repeats are harmless; no links give no rows. Work per round is linear in the links, hot nodes
    only join with their one minimum, and every step is checkpointed. Rounds go on until one changes nothing, which
    they do after about the logarithm of the longest chain, squared at most.
    """
    edges = settled(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        large = _large(edges, mark[0])
        grown = _small(large, mark[0])
        new = _mark(grown)
        forget(edges, large)
        edges = grown
        if new == mark:
            break
        mark = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
