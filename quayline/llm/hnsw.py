"""Approximate nearest neighbours: one navigable small-world graph for each shard, shard results merged."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import durable, forget, gathered, lane, mix64

#: Bytes of vectors in a shard at most about: 8,192 vectors of 64 components, a size whose recall has been measured.
SHARD_BYTES = 4 << 20
#: Bytes of query vectors in one broadcast block.
QUERY_BYTES = 16 << 20
#: Neighbours of a node on the upper layers (twice as many on the lowest), and beam widths of building and searching.
DEGREE, BUILD_BEAM, SEARCH_BEAM = 16, 48, 192
#: Beam width on layers that are only passed through.
ENTRY_BEAM = 8
_EXPAND = 4
_BATCH = 256


def _distances(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows, n, d) to queries (rows, d)."""
    gap = points - queries[:, None, :]
    return np.einsum("rnd,rnd->rn", gap, gap)


def _beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes found for each query on one layer, nearest first; -1 and inf where there are fewer."""
    rows = len(queries)
    seen = np.zeros((rows, len(vectors) + 1), bool)
    ids = np.full((rows, width), -1)
    dist = np.full((rows, width), np.inf)
    done = np.zeros((rows, width), bool)
    n = min(entry.shape[1], width)
    ids[:, :n] = entry[:, :n]
    dist[:, :n] = np.where(ids[:, :n] >= 0, _distances(vectors[ids[:, :n]], queries), np.inf)
    np.put_along_axis(seen, ids[:, :n], True, 1)
    live = np.arange(rows)
    while len(live):
        open_dist = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_dist, min(_EXPAND, width - 1), axis=1)[:, :_EXPAND]
        real = np.isfinite(np.take_along_axis(open_dist, pick, 1))
        going = real.any(axis=1)
        live, pick, real = live[going], pick[going], real[going]
        if not len(live):
            break
        picked = np.where(real, np.take_along_axis(ids[live], pick, 1), -1)
        marks = done[live]
        np.put_along_axis(marks, pick, True, 1)
        done[live] = marks
        near = np.where(picked[:, :, None] >= 0, links[picked], -1).reshape(len(live), -1)
        near.sort(axis=1)
        fresh = (near >= 0) & ~seen[live[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        near = np.where(fresh, near, -1)
        seen[live[:, None], near] = True
        found = np.where(fresh, _distances(vectors[near], queries[live]), np.inf)
        all_ids, all_dist = np.concatenate([ids[live], near], 1), np.concatenate([dist[live], found], 1)
        all_done = np.concatenate([done[live], np.zeros_like(fresh)], 1)
        best = np.argpartition(all_dist, width - 1, axis=1)[:, :width]
        ids[live], dist[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_dist, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)


def _select(vectors: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int) -> np.ndarray:
    """Up to ``degree`` neighbours a row: first those nearer to the row's node than to any neighbour taken before, then the nearest left."""
    rows, width = ids.shape
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    points = vectors[ids]
    square = np.einsum("rnd,rnd->rn", points, points)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(points, points.transpose(0, 2, 1))
    real = np.isfinite(dist)
    taken = np.zeros((rows, width), bool)
    for i in range(width):
        clash = (taken[:, :i] & (between[:, i, :i] < dist[:, i : i + 1])).any(axis=1)
        taken[:, i] = real[:, i] & ~clash & (taken[:, :i].sum(axis=1) < degree)
    rank = np.where(taken, 0, np.where(real, 1, 2)) * (width + 1) + np.arange(width)
    best = np.argsort(rank, axis=1)[:, :degree]
    out = np.where(np.take_along_axis(real, best, 1), np.take_along_axis(ids, best, 1), -1)
    return out if out.shape[1] == degree else np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


class Graph:
    """Layers of flat neighbour arrays (nodes x degree, -1 where empty) over the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray], entry: int):
        self.vectors, self.layers, self.entry = vectors, layers, entry

    @classmethod
    def build(cls, vectors: np.ndarray, keys: np.ndarray) -> Graph:
        """Insert in batches of at most the size of the graph so far; levels come from a hash of the keys."""
        n = len(vectors)
        uniform = ((mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(11)).astype(float) + 1) / 2.0**53
        levels = np.minimum((-np.log(uniform) / np.log(DEGREE)).astype(int), 8)
        order = np.argsort(-levels, kind="stable")  # the upper layers come first and stay connected
        top = int(levels.max(initial=0))
        layers = [np.full((n + 1, DEGREE * (2 if layer == 0 else 1)), -1) for layer in range(top + 1)]
        graph = cls(vectors, layers, int(order[0]) if n else -1)
        at = 1
        while at < n:
            batch = order[at : at + min(_BATCH, max(1, at))]
            graph._insert(batch, levels)
            at += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, levels: np.ndarray) -> None:
        entry = np.full((len(batch), 1), self.entry)
        for layer in range(len(self.layers) - 1, -1, -1):
            links = self.layers[layer]
            here = levels[batch] >= layer
            # a layer that no vector of the batch enters only shows the way down
            ids, dist = _beam(self.vectors, links, self.vectors[batch], entry, BUILD_BEAM if here.any() else ENTRY_BEAM)
            entry = ids
            if not here.any():
                continue
            nodes, degree = batch[here], links.shape[1]
            chosen = _select(self.vectors, ids[here], dist[here], min(DEGREE, degree))
            links[nodes, : chosen.shape[1]] = chosen
            self._link_back(links, nodes, chosen)

    def _link_back(self, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
        source = np.repeat(nodes, chosen.shape[1])[chosen.ravel() >= 0]
        target = chosen.ravel()[chosen.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        uniq, start, count = np.unique(target, return_index=True, return_counts=True)
        degree = links.shape[1]
        for one in range(0, len(uniq), 512):
            own, first, many = uniq[one : one + 512], start[one : one + 512], count[one : one + 512]
            extra = np.full((len(own), int(many.max())), -1)
            for row, (a, m) in enumerate(zip(first, many, strict=True)):
                extra[row, :m] = source[a : a + m]
            both = np.concatenate([links[own], extra], axis=1)
            dist = np.where(both >= 0, _distances(self.vectors[both], self.vectors[own]), np.inf)
            if both.shape[1] > 4 * degree:
                near = np.argpartition(dist, 4 * degree, axis=1)[:, : 4 * degree]
                both, dist = np.take_along_axis(both, near, 1), np.take_along_axis(dist, near, 1)
            links[own] = _select(self.vectors, both, dist, degree)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Node places and squared distances of the ``width`` nearest found for each query, nearest first."""
        entry = np.full((len(queries), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry, _ = _beam(self.vectors, self.layers[layer], queries, entry, ENTRY_BEAM)
        return _beam(self.vectors, self.layers[0], queries, entry, width)


def _usable(vector: Column) -> Column:
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & real & F.exists(vector, lambda x: x != 0)


def _pack(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def _load(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    vectors = np.stack(rows["vector"].to_numpy()).astype(np.float64)
    ids = rows["ids"].to_numpy()
    graph = Graph.build(vectors, np.array([x[0] for x in ids], np.int64))
    sizes = np.array([len(x) for x in ids])
    return pd.DataFrame({"dim": [vectors.shape[1]], "entry": [graph.entry], "vectors": [_pack(vectors)], "layers": [[_pack(x.astype(np.int32)) for x in graph.layers]], "ids": [_pack(np.concatenate(ids).astype(np.int64))], "sizes": [_pack(sizes)]})


def build_index(embeddings: DataFrame, keep: int) -> DataFrame:
    """One durable row for each shard: its distinct vectors, flat neighbour arrays, and their ids.

    Equal vectors are one node, so copies neither fill a shard nor tie up its graph; of their ids the ``keep`` smallest
    are stored, and no others can be among ``keep`` nearest when ties go to the smaller id. Shards are hashes of the
    vector, apart by dimension, of about SHARD_BYTES of vectors. Their number follows from the vectors alone, so the neighbours
    found do not depend on the cluster.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & _usable(F.col("vector"))).distinct()
    least = Window.partitionBy("vector").orderBy("vec_id")
    ranked = rows.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= keep)
    nodes = durable(ranked.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    size = nodes.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0)).alias("bytes")).first()["bytes"]
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = nodes.withColumn("shard", lane("vector", of=shards)).withColumn("dim", F.size("vector"))
    # a fixed number of partitions, which the planner does not merge: building is what takes the time, not the bytes
    built = dealt.repartition(4 * shards, "shard", "dim").groupBy("shard", "dim").applyInPandas(_build, "dim int, entry int, vectors binary, layers array<binary>, ids binary, sizes binary")
    index = durable(built, "index")
    forget(nodes)
    return index


def _nearer(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest of the answers so far and new ones, ties to the smaller id."""
    ids, dist = np.concatenate([best[0], ids]), np.concatenate([best[1], dist])
    order = np.lexsort((ids, dist))[:k]
    return ids[order], dist[order]


def _searcher(shared, k: int, beam: int):
    """A task's shards, one after the other: for each query of the block the ``k`` nearest of them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.empty(0, np.int64), np.empty(0))
        best = {dim: [nothing] * len(ids) for dim, (ids, _) in shared.value.items()}
        for batch in batches:
            for at in range(batch.num_rows):
                shard = batch.slice(at, 1).to_pylist()[0]
                if shard["dim"] not in best:
                    continue
                asked, queries = shared.value[shard["dim"]]
                graph = Graph(_load(shard["vectors"]), [_load(x).astype(np.int64) for x in shard["layers"]], shard["entry"])
                ids, sizes = _load(shard["ids"]), _load(shard["sizes"])
                starts = np.concatenate([[0], np.cumsum(sizes)])
                own = best[shard["dim"]]
                for one in range(0, len(asked), 256):
                    places, _ = graph.search(queries[one : one + 256], max(beam, k + 1, 2 * math.isqrt(len(graph.vectors))))
                    for q, row in enumerate(places, one):
                        row = row[row >= 0]
                        exact = np.sqrt(((graph.vectors[row] - queries[q]) ** 2).sum(axis=1))
                        cand = np.concatenate([ids[starts[p] : starts[p + 1]] for p in row]) if len(row) else nothing[0]
                        real = cand != asked[q]
                        own[q] = _nearer(own[q], cand[real], np.repeat(exact, sizes[row])[real], k)
        for dim, answers in best.items():
            for one in range(0, len(answers), 4096):
                part = answers[one : one + 4096]
                who = np.repeat(shared.value[dim][0][one : one + 4096], [len(ids) for ids, _ in part])
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(np.concatenate([ids for ids, _ in part])), pa.array(np.concatenate([dist for _, dist in part]))], names=["query_id", "vec_id", "score"])

    return run


def _block(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of one block of queries, by dimension."""
    table = rows.select("vec_id", "vector").toArrow()
    ids, vectors = table.column("vec_id").to_numpy(), table.column("vector").combine_chunks()
    sizes = np.diff(np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())]))
    flat = vectors.flatten().to_numpy()
    ends = np.cumsum(sizes)
    return {int(dim): (ids[sizes == dim], np.stack([flat[e - dim : e] for e in ends[sizes == dim]])) for dim in np.unique(sizes)}


def search(index: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the ``k`` nearest found in ``index`` for each row of ``queries``.

    Queries are stored once and go in blocks of about QUERY_BYTES, one after the other: a block is broadcast, every task
    walks its shards with it and keeps the k nearest of them, these are merged by (distance, vec_id) and written, and the
    broadcast is released. Beams are ``beam`` wide at least, and twice the root of a larger shard's size, as recall falls with
    the size otherwise. Distances are Euclidean in double precision on the stored vectors.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))
    asked = durable(asked.where(F.col("vec_id").isNotNull() & _usable(F.col("vector"))).distinct(), "queries")
    blocks = max(1, -(-asked.agg(F.coalesce(F.sum(F.size("vector").cast("long") * 8), F.lit(0)).alias("n")).first()["n"] // QUERY_BYTES))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")

    def answers() -> Iterator[DataFrame]:
        for b in range(blocks):
            shared = spark.sparkContext.broadcast(_block(asked.where(lane("vec_id", of=blocks) == b)))
            found = index.mapInArrow(_searcher(shared, k, beam), "query_id bigint, vec_id bigint, score double")
            # a repeated query id with two vectors may meet one candidate twice; the nearer one counts
            once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            yield once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
            shared.destroy()

    found = gathered(spark, answers(), "query_id bigint, rank int, vec_id bigint, score double", "answers")
    forget(asked)
    return found


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 10, beam: int = SEARCH_BEAM) -> DataFrame:
    """Index ``embeddings`` (vec_id, embedding) and search it for ``queries``, a row's own id never being its answer.

    Vectors that are null, zero or hold null or non-finite components take no part on either side, nor do null ids;
    vectors only meet those of their dimension; fewer than ``k`` candidates are all returned; equal vectors tie and go by
    the smaller id; an empty table on either side gives no rows. Other columns are not read.
    """
    index = build_index(embeddings, k + 1)
    found = search(index, queries, k, beam)
    forget(index)
    return found
