import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quayline.llm import convtrie

TURNS = "conv_id long, turn long, role string, text string, depth int, p1 string, size int"


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in convs.items()}
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = {}
    for node, ids in nodes.items():
        below = [x for x in nodes if x[: len(node)] == node]
        ends = sorted(c for c in ids if len(paths[c]) == len(node))
        out[min(ids), len(node)] = (
            min(nodes[node[:-1]]) if node else None,
            len(ids),
            sum(len(x) == len(node) + 1 for x in below),
            sum(not any(len(y) > len(x) and y[: len(x)] == x for y in nodes) for x in below),
            sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )
    return out


def found(spark, rows):
    turns = convtrie.digested(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS))
    got = convtrie.trie(convtrie.grafted(turns), convtrie.members(turns)).collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}


def conversations(seed, convs, texts=3, most=8):
    rng = random.Random(seed)
    return [(c, t, "user" if t % 2 == 0 else "assistant", "x" * rng.randrange(texts) + "é") for c in convs for t in range(rng.randrange(1, most))]


@pytest.mark.parametrize("seed", range(3))
def test_nodes_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = conversations(seed, rng.sample(range(-150, 450), 220))
    assert found(spark, rows) == brute(rebuilt(rows))


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "no one"), (7, None, None, None), (7, 0, "user", "a"), (7, 0, "user", "a"), (7, 0, "user", "B"), (100, 3, "user", "ü" * 50_000), (101, 3, "user", "ü" * 50_000), (2**40, 0, "ab", "c"), (2**40 + 1, 0, "a", "bc")]
    rows += [(500 + i, t, "user", "same") for i in range(30) for t in range(9)]
    assert found(spark, rows) == brute(rebuilt(rows))
    assert found(spark, []) == {}


def test_a_conversation_may_lose_all_its_turns(spark):
    # no base conversation, and h is larger than the only turn
    lonely = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6)
    assert found(spark, [(lonely, 0, "user", "x")]) == {(lonely, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())}


def test_ends_of_many_blocks_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "BLOCK_BITS", 3)
    rows = [(c, t, "user", "same") for c in range(-130, 170) for t in range(9)] + conversations(5, range(1000, 1040))
    assert found(spark, rows) == brute(rebuilt(rows))


def test_equal_turns_far_apart_do_not_meet(spark):
    # the same turns in another order are other nodes
    turns = convtrie.digested(spark.createDataFrame([(c, t, "user", text, 1, "", 1) for c, texts in ((1, "ab"), (2, "ba"), (3, "ab")) for t, text in enumerate(texts)], TURNS))
    got = convtrie.trie(turns, convtrie.members(turns)).where(F.col("depth") == 2).orderBy("conv_id").collect()
    assert [(r.conv_id, r.n_convs) for r in got] == [(1, 2), (2, 1)]
