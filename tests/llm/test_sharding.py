import random
import zlib

import pytest

from quayline.llm import sharding
from tests.llm.fixtures import DOCS, frame, near_copies


def smallest_capacity(sizes, shards):
    """By dynamic programming over prefixes."""
    sums = [0]
    for s in sizes:
        sums.append(sums[-1] + s)
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(len(sizes) + 1)]
    return best[-1]


@pytest.mark.parametrize("shards,giant", [(3, 0), (5, 0), (4, 5000), (9, 300), (1, 0)])
def test_capacity_is_minimal_and_kept(spark, shards, giant):
    rng = random.Random(shards)
    sizes = [rng.randrange(1, 200) for _ in range(60)]
    if giant:
        sizes[rng.randrange(60)] = giant
    row = sharding.partition_atoms(spark.createDataFrame(list(enumerate(sizes)), "cell int, size long"), shards).first()
    assert row.capacity == smallest_capacity(sizes, shards)
    loads = [0] * shards
    for cell, size in enumerate(sizes):
        loads[sum(c <= cell for c in row.cuts)] += size
    assert max(loads) == row.capacity or max(loads) <= row.capacity
    if not giant:
        assert min(loads) > 0


def test_documents(spark):
    rows = near_copies(3)
    got = sharding.shard_documents(frame(spark, rows), shards=4).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    by_text = {}
    for r in got:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    texts = {zlib.crc32((r[1] or "").encode()) for r in rows if r[1]}
    assert all(len(by_text[c]) == 1 for c in texts)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], DOCS)).count() == 0
