import random

import numpy as np
import pytest

from quayline.llm import neardup
from tests.llm.fixtures import DOCS, frame, near_copies


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows, percent):
    sets = [shingles(r[1]) for r in rows]
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = rows[i][0], rows[j][0]
            if a is None or b is None or not sets[i] or not sets[j]:
                continue
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
    return sorted((str(r[0]), len(s), None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0]) for r, s in zip(rows, sets, strict=True))


@pytest.mark.parametrize("percent,seed", [(85, 1), (80, 2), (50, 3)])
def test_components_match_brute_force(spark, percent, seed):
    rows = near_copies(seed)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows), percent).collect())
    assert got == brute(rows, percent)


def test_chain_in_one_bucket_is_found_without_its_smallest_member(spark):
    """Copies of a hub that are far from each other: the hub, not the smallest id, holds them together."""
    rng = random.Random(4)
    hub = [f"w{i}" for i in range(400)]
    rows = [(500, " ".join(hub), None, None, None)]
    for i in range(60):
        copy = list(hub)
        for _ in range(5):
            copy[rng.randrange(400)] = f"y{rng.random()}"
        rows.append((i, " ".join(copy), None, None, None))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 88).collect())
    assert got == brute(rows, 88)


def test_groups_over_a_block_are_dealt_whole(spark, monkeypatch):
    """Blocks far smaller than the groups: several slots and set sizes, and no link lost between them."""
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 600)
    rng = random.Random(6)
    hub = [f"w{i}" for i in range(400)]
    rows = [(900, " ".join(hub), None, None, None)]
    for i in range(80):
        copy = list(hub) + [f"z{rng.random()}" for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(8)):
            copy[rng.randrange(400)] = f"y{rng.random()}"
        rows.append((i, " ".join(copy), None, None, None))
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, DOCS), 88).collect())
    assert got == brute(rows, 88)


def test_estimate_is_near_the_similarity():
    rng = np.random.default_rng(1)
    for both in (200, 600, 900):
        shared, a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (both, 1000 - both, 1000 - both))
        sig = neardup.pack(neardup.minima([np.concatenate([shared, a]), np.concatenate([shared, b])]))
        assert abs(neardup.estimate(sig[0], sig[1]) - both / (2000 - both)) < 0.16


def test_empty_and_keep_one(spark):
    empty = spark.createDataFrame([], DOCS)
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.keep_one(empty).count() == 0
    rows = near_copies(5)
    kept = [r.doc_id for r in neardup.keep_one(frame(spark, rows)).collect()]
    assert sorted(map(str, kept)) == sorted({x[0] for x in brute(rows, 80) if x[3]})
