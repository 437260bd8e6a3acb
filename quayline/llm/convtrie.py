"""Conversation prefix trie by smallest-member ownership.

Every node belongs to its smallest member, so each conversation owns a suffix of its path (perhaps an empty one). Sums over a
node's subtree are then sums over its members: of the tokens that they hold from there on, less those of nodes that they own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import durable, small_batches

NODE = ("depth", "p1", "p2")
#: Ids of conversations that end at one node are joined in blocks of 2 to this power.
BLOCK_BITS = 12
#: Conversations come in hundreds; fewer than HEADS first turns are taken from the first one of a hundred.
GROUP, HEADS = 100, 6


def digested(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, k1, k2, chars), stored: every turn numbered from 1 in its conversation, as a digest and its text's code points.

    Turns go by (turn, role, text), nulls first; null roles and texts are empty; repeated rows are repeated turns; rows with a
    null conv_id belong to no conversation. Other columns are ignored. Texts are shuffled once and not read again.
    """
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    said = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    numbered = rows.select("conv_id", F.row_number().over(in_order).alias("pos"), said.alias("said"), F.char_length("text").cast("long").alias("chars"))
    return durable(numbered.select("conv_id", "pos", F.xxhash64(F.lit(1), "said").alias("k1"), F.xxhash64(F.lit(2), "said").alias("k2"), "chars"), "turns")


def members(turns: DataFrame) -> DataFrame:
    """(conv_id): every conversation of digested turns."""
    return turns.select("conv_id").distinct()


def grafted(turns: DataFrame) -> DataFrame:
    """Digested turns of every conversation c rebuilt: the first h turns of conversation c - c % 100, then its own after its first h.

    h is the unsigned crc32 of c as decimal text, modulo 6. Of the other conversation fewer turns than h come if it has fewer, and
    none if it is absent, so a conversation may have no turn left. A conversation hands at most 5 turns to at most 199 others.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    own = turns.where(F.col("pos") > h).withColumn("part", F.lit(1))
    heads = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    wanted = members(turns).select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), h.alias("h")).where("h > 0")
    lent = wanted.join(heads, "base").where("pos <= h").withColumn("part", F.lit(0))
    columns = ("conv_id", "part", "pos", "k1", "k2", "chars")
    path = Window.partitionBy("conv_id").orderBy("part", "pos")
    return own.select(*columns).unionByName(lent.select(*columns)).withColumn("pos", F.row_number().over(path)).drop("part")


def _paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for every conversation and each of its prefixes, the empty one included.

    (depth, p1, p2) names the node: p1 and p2 are exclusive ors of 64-bit hashes of (place, turn), together 128 bits that are
    summed along a window. q1 and q2 are the parent's; ``size`` is the conversation's number of turns.
    """
    rows = turns.select("conv_id", "pos", "k1", "k2", "chars").unionByName(ids.select("conv_id", F.lit(0).alias("pos"), *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "chars")]))
    along = Window.partitionBy("conv_id").orderBy("pos")
    part = lambda salt: F.when(F.col("pos") == 0, F.lit(0)).otherwise(F.xxhash64(F.lit(salt), "pos", "k1", "k2"))
    summed = rows.select("conv_id", F.col("pos").alias("depth"), "chars", F.bit_xor(part(3)).over(along).alias("p1"), F.bit_xor(part(4)).over(along).alias("p2"), F.max("pos").over(Window.partitionBy("conv_id")).alias("size"))
    return summed.select("*", F.lag("p1").over(Window.partitionBy("conv_id").orderBy("depth")).alias("q1"), F.lag("p2").over(Window.partitionBy("conv_id").orderBy("depth")).alias("q2"))


def _first(paths: DataFrame, *order: Column | str) -> DataFrame:
    """One row of each node, the first in ``order``. A limit of one a node runs before the shuffle, so no node's rows meet."""
    return paths.withColumn("__n", F.row_number().over(Window.partitionBy(*NODE).orderBy(*order))).where("__n = 1").drop("__n")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest the sorted blocks of each node, one after the other."""
    node, digest = None, None

    def row() -> pa.RecordBatch:
        values = [*([x] for x in node), [digest.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32()), *(pa.array(x, pa.int64()) for x in values[1:3]), pa.array(values[3])], names=[*NODE, "ends_sha256"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if key != node:
                if node is not None:
                    yield row()
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
    if node is not None:
        yield row()


def _ends(paths: DataFrame) -> DataFrame:
    """(node, ends_sha256) of every node at which conversations end.

    Ids are joined in blocks of a bounded range of ids. A node with one block, as nearly all have, is digested by built-ins; the
    blocks of others are streamed in order, as a digest is one sequence: a task holds one block at a time.
    """
    block = F.shiftright("conv_id", BLOCK_BITS)
    listed = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = durable(paths.where("depth = size").groupBy(*NODE, block.alias("block")).agg(listed.alias("ids")), "ends")
    counted = blocks.groupBy(*NODE).agg(F.count("*").alias("n"), F.max("ids").alias("ids"))
    small_batches(paths.sparkSession)
    several = blocks.join(counted.where("n > 1").select(*NODE), list(NODE)).repartition(*NODE).sortWithinPartitions(*NODE, "block")
    streamed = several.select(*NODE, "ids").mapInArrow(_stream, "depth int, p1 bigint, p2 bigint, ends_sha256 string")
    return counted.where("n = 1").select(*NODE, F.sha2("ids", 256).alias("ends_sha256")).unionByName(streamed)


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of digested ``turns``, whose conversations are ``ids`` (those without turns too).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. (conv_id, depth) is unique. No conversations give no rows. A node's rows never meet in one task before they are
    summed; joins meet stored tables, so that hot keys of either side can be split.
    """
    paths = durable(_paths(turns, ids), "paths")
    owned = _first(paths, "conv_id").groupBy("conv_id").agg(F.min("depth").alias("from"))
    # the longest member of a node tells whether it is a leaf; all members of a leaf are as long, so that is its smallest
    leaves = _first(paths, F.col("size").desc(), "conv_id").where("depth = size").select("conv_id", F.lit(1).alias("leaf"))
    marked = paths.join(owned, "conv_id", "left").join(leaves, "conv_id", "left")
    marked = marked.withColumns({"from": F.coalesce("from", F.col("size") + 1), "leaf": F.coalesce("leaf", F.lit(0))})
    # tokens from a node on that the conversation does not own: all occurrences less the owned ones
    onwards = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    spare = F.sum(F.when(F.col("depth") < F.col("from"), F.col("chars")).otherwise(0)).over(onwards)
    child = (F.col("depth") < F.col("size")) & (F.col("from") <= F.col("depth") + 1)
    nodes = (
        marked.select("*", spare.alias("spare"), child.cast("long").alias("child"))
        .groupBy(*NODE)
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("spare").alias("saved_tokens"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    )
    nodes = durable(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(parents, ["depth", "q1", "q2"], "left").join(_ends(paths), list(NODE), "left")
    return known.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
