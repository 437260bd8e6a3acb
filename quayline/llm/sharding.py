"""Sharding by a minimax contiguous partition of ordered atomic groups. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import lane

#: An atom is all rows whose text hashes to one cell, so equal texts are never parted. The cell count bounds
#: the one row on which the partition is searched (about 1 MB) at any size of the corpus.
CELLS = 1 << 16
#: Rows of a shard are numbered in this many lanes, so no task holds a whole shard or a whole group of copies.
LANES = 1024


def _plus(x: Column, y: Column) -> Column:
    return x + y


def _needed(sizes: Column, capacity: Column) -> Column:
    """How many contiguous shards of at most ``capacity`` a greedy pass over ``sizes`` fills."""
    start = F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("load"))
    return F.aggregate(
        sizes,
        start,
        lambda at, x: F.when(at["load"] + x > capacity, F.struct((at["n"] + 1).alias("n"), x.alias("load"))).otherwise(F.struct(at["n"].alias("n"), (at["load"] + x).alias("load"))),
        lambda at: at["n"],
    )


def _capacity(sizes: Column, shards: int) -> Column:
    """The smallest capacity at which ``shards`` contiguous shards hold all atoms, by binary search.

    A capacity of the fair share plus the largest atom always suffices, which gives the upper end.
    """
    total = F.aggregate(sizes, F.lit(0).cast("long"), _plus)
    largest = F.coalesce(F.array_max(sizes), F.lit(0).cast("long"))
    fair = F.ceil(total / F.lit(shards)).cast("long")
    ends = F.struct(F.greatest(largest, fair).alias("lo"), (fair + largest).alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("long")
        fits = F.struct(at["lo"].alias("lo"), mid.alias("hi"))
        fails = F.struct((mid + 1).alias("lo"), at["hi"].alias("hi"))
        return F.when(at["lo"] >= at["hi"], at).otherwise(F.when(_needed(sizes, mid) <= shards, fits).otherwise(fails))

    return F.aggregate(F.sequence(F.lit(1), F.lit(62)), ends, halve, lambda at: at["lo"])


def _cuts(atoms: Column, capacity: Column, shards: int, fair: bool) -> Column:
    """First cells of the shards after the first, and the largest load.

    A shard is closed before an atom that would pass the capacity. With ``fair`` it is also closed once it
    holds its part of what was left when it began, so that a giant atom does not empty the last shards.
    """
    total = F.aggregate(F.transform(atoms, lambda a: a["size"]), F.lit(0).cast("long"), _plus)
    start = F.struct(
        F.lit(0).cast("long").alias("load"),
        total.alias("left"),
        F.array().cast("array<int>").alias("cuts"),
        F.lit(0).cast("long").alias("most"),
    )

    def step(at: Column, a: Column) -> Column:
        open_shards = F.lit(shards) - F.size(at["cuts"])
        full = at["load"] + a["size"] > capacity
        if fair:
            full = full | ((at["load"] * open_shards >= at["left"]) & (open_shards > 1))
        close = full & (at["load"] > 0)
        load = F.when(close, a["size"]).otherwise(at["load"] + a["size"])
        return F.struct(
            load.alias("load"),
            F.when(close, at["left"] - at["load"]).otherwise(at["left"]).alias("left"),
            F.when(close, F.array_append(at["cuts"], a["cell"])).otherwise(at["cuts"]).alias("cuts"),
            F.greatest(at["most"], load).alias("most"),
        )

    return F.aggregate(atoms, start, step, lambda at: F.struct(at["cuts"].alias("cuts"), at["most"].alias("most")))


def partition_atoms(atoms: DataFrame, shards: int) -> DataFrame:
    """One row (atoms, capacity, cuts) from atoms (cell int, size long), at most one for each cell."""
    row = atoms.groupBy().agg(F.sort_array(F.collect_list(F.struct("cell", "size"))).alias("atoms"))
    row = row.withColumn("capacity", _capacity(F.transform("atoms", lambda a: a["size"]), shards))
    both = row.withColumn("even", _cuts(F.col("atoms"), F.col("capacity"), shards, True)).withColumn("plain", _cuts(F.col("atoms"), F.col("capacity"), shards, False))
    sound = (F.col("even.most") <= F.col("capacity")) & (F.size("even.cuts") < shards)
    return both.select("atoms", "capacity", F.when(sound, F.col("even.cuts")).otherwise(F.col("plain.cuts")).alias("cuts"))


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, cells: int = CELLS, lanes: int = LANES) -> DataFrame:
    """Deal documents to ``shards`` contiguous runs of text groups whose largest byte size is minimal.

    Size: UTF-8 bytes of ``text`` (null: none) plus ``overhead``. Atoms, in the order of their hash cell, are
    groups of equal texts; the least capacity is found by binary search with a greedy check, and the cuts stay
    within it. Returns doc_id, size, text_crc32, shard and slot, which counts the rows of a shard from 0.

    Null text: its own atom, crc32 of no bytes (0). Null or repeated ids and repeated rows are rows like any
    other. An empty table gives no rows. A group larger than a fair share stays whole and fills its shard alone.
    Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        lane("text", of=cells).alias("cell"),
    )
    plan = partition_atoms(rows.groupBy("cell").agg(F.sum("size").alias("size")), shards)
    dealt = plan.select(F.explode("atoms").alias("atom"), "cuts").select(F.col("atom.cell").alias("cell"), F.size(F.filter("cuts", lambda c: c <= F.col("atom.cell"))).alias("shard"))
    # at most one row for each cell: bounded by CELLS, so the broadcast is bounded too
    placed = rows.join(F.broadcast(dealt), "cell").withColumn("lane", lane("doc_id", "text_crc32", "size", of=lanes)).drop("cell")
    placed = placed.repartition("shard", "lane")
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")))
    # shards x lanes rows at most; the exchange above is reused
    counts = placed.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    before = counts.select("shard", "lane", (F.sum("n").over(Window.partitionBy("shard").orderBy("lane")) - F.col("n")).alias("before"))
    return numbered.join(F.broadcast(before), ["shard", "lane"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))
