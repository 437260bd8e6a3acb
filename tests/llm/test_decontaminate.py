import random

import numpy as np
import pytest

from quayline.llm import decontaminate as dc
from tests.llm.fixtures import DOCS, frame

BENCH = "item_id long, text string"


def brute_tiles(item, text, shortest):
    """Greedy string tiling by definition: again and again the longest match of unmarked tokens, the earliest on ties."""
    free_i, free_t, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_i[i + n] and free_t[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < shortest:
            return tiles
        tiles.append((i, t, n))
        for k in range(n):
            free_i[i + k] = free_t[t + k] = False


@pytest.mark.parametrize("seed", range(12))
def test_tiles_match_the_definition(seed):
    rng = random.Random(seed)
    item = [rng.randrange(3 + seed * 4) for _ in range(rng.randrange(5, 50))]
    text = [rng.randrange(3 + seed * 4) for _ in range(60)]
    for _ in range(3):
        a = rng.randrange(len(item))
        at = rng.randrange(50)
        text[at : at + 12] = item[a : a + 12]
    key = lambda x: np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got, want = dc.tile(key(item), key(text), 4), brute_tiles(item, text, 4)
    assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)


def test_documents(spark):
    rng = random.Random(1)
    words = lambda n, tag: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    item, other = words(30, "a"), words(40, "b")
    half = item[15:] + words(5, "n") + item[:15]
    rows = [
        (1, " ".join(words(50, "c") + item + words(50, "c"))), (2, " ".join(words(9, "c") + half)), (3, " ".join(words(500, "c"))), (4, " ".join(words(5000, "c") + [w.upper() + "," for w in item])),
        (5, " ".join(item[:8] + words(50, "c"))), (6, None), (7, ""), (None, " ".join(item)), (1, " ".join(item)), (8, " ".join(w for pair in zip(item, words(30, "z"), strict=True) for w in pair)),
    ]
    docs = frame(spark, [(i, t, None, None, None) for i, t in rows])
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(other)), (2, None), (3, "too short"), (0, "")], BENCH)
    for block in (1 << 24, 200):
        got = sorted((str(r.doc_id), r.item_id, r.n_tiles, round(r.coverage, 3)) for r in dc.find_contamination(docs, bench, block_chars=block).collect())
        assert got == [("1", 0, 1, 1.0), ("1", 0, 1, 1.0), ("2", 0, 2, 1.0), ("4", 0, 1, 1.0), ("None", 0, 1, 1.0)]
        kept = dc.drop_contaminated(docs, bench, block_chars=block)
        assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6, 7, 8] and kept.columns == docs.columns
    empty = spark.createDataFrame([], BENCH)
    assert dc.find_contamination(docs, empty).count() == 0 and dc.drop_contaminated(docs, empty).count() == len(rows)
    assert dc.find_contamination(spark.createDataFrame([], DOCS), bench).count() == 0


def test_short_items_are_whole_tiles(spark):
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(["So Paris, France it is.", "France Paris", "paris", None, "", "x y z " * 40])])
    bench = spark.createDataFrame([(0, "paris france"), (1, "Paris"), (2, "y z x y"), (3, " - "), (4, "Paris")], BENCH)
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in dc.find_contamination(docs, bench).collect())
    assert got == [(0, 0, 1.0, 1), (0, 1, 1.0, 1), (0, 4, 1.0, 1), (1, 1, 1.0, 1), (1, 4, 1.0, 1), (2, 1, 1.0, 1), (2, 4, 1.0, 1), (5, 2, 1.0, 1)]
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, bench).collect()) == [3, 4]
