import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, queries, k):
    usable = {(i, tuple(float(x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)}
    out = {}
    for q, v in ((i, v) for i, v in usable if queries(i)):
        far = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), i) for i, w in usable if i != q and len(w) == len(v))
        out[q] = far[:k]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(400, None), (401, [0.0] * 8), (402, [1.0, None] + [0.0] * 6), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, rows[0][1]), (500, [1.0, 2.0]), (501, [1.0, 3.0]), rows[5]]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("shard", F.lit(1)).withColumn("rank", F.lit(1))
    got: dict = {}
    for r in hnsw.nearest(df, df.where("vec_id % 100 = 0"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 100 == 0, 10)
    assert set(got) == {q for q, found in want.items() if found}
    for q, found in got.items():
        assert [i for _, i in found] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in found], [s for s, _ in want[q]], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("clusters", [0, 20])
def test_recall_of_one_shard(clusters):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4096, 64)) * (0.3 if clusters else 1)
    if clusters:
        x += rng.normal(size=(clusters, 64))[rng.integers(0, clusters, 4096)]
    graph = hnsw.Graph.build(x, np.arange(4096))
    queries = x[::64]
    ids, _ = graph.search(queries, hnsw.SEARCH_BEAM)
    true = np.argsort(((queries[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b[:11])) / 11 for a, b in zip(true, ids, strict=True)]) >= 0.9
    assert all(layer.shape[1] in (hnsw.DEGREE, 2 * hnsw.DEGREE) and layer.max() < 4096 for layer in graph.layers)


def test_recall_over_shards(spark):
    path = "/root/testdata/sf0.1/embeddings.parquet"
    df = spark.read.parquet(path)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    shards = hnsw.SHARD_BYTES, hnsw.QUERY_BYTES
    hnsw.SHARD_BYTES, hnsw.QUERY_BYTES = 50_000, 3_000
    try:
        got = hnsw.nearest(df, df.where("vec_id % 100 = 0")).collect()
    finally:
        hnsw.SHARD_BYTES, hnsw.QUERY_BYTES = shards
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert len(got) == 10 * len(want) and hits / len(got) >= 0.9


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(0, [1.0]), (1, [2.0])], SCHEMA)
    assert hnsw.nearest(none, none).count() == 0 and hnsw.nearest(some, none).count() == 0 and hnsw.nearest(none, some).count() == 0
