import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quayline.llm import collocations
from tests.llm.fixtures import DOCS, frame


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)) if w]


def brute(rows, least):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            total[lang] += len(words)
            for n in range(1, 6):
                f.update((lang, *words[i : i + n]) for i in range(len(words) - n + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = []
    for (lang, *words), a in candidates.items():
        score, k = min((int(Fraction(1000 * a * total[lang], f[lang, *words[:k]] * f[lang, *words[k:]])), k) for k in range(1, len(words)))
        inside = any(o[0] == lang and len(o) - 1 > len(words) and b >= a and any(list(o[1 + i : 1 + i + len(words)]) == words for i in range(len(o) - len(words))) for o, b in candidates.items())
        if not inside:
            out.append((lang, " ".join(words), a, f[lang, *words[:k]], f[lang, *words[k:]], total[lang], score))
    return sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))


def found(df, least):
    rows = collocations.report(collocations.collocations(*collocations.phrase_counts(df, least))).orderBy("lang", "rank").collect()
    assert all(r.rank == 1 + sum(o.lang == r.lang for o in rows[:i]) for i, r in enumerate(rows))
    return [(r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows]


def texts(seed, n, vocabulary=9):
    rng = random.Random(seed)
    said = lambda: "".join(rng.choice(["the", "The", "of", "ÉA", "x\xa0y", "a", "b", "c", "d"][:vocabulary]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x1c"]) for _ in range(rng.randrange(60)))
    return [(i, said(), rng.choice(["en", "de", None, ""]), "s", 1) for i in range(n)]


@pytest.mark.parametrize(("seed", "least"), [(1, 6), (2, 2), (3, 20)])
def test_phrases_match_brute_force(spark, seed, least):
    rows = texts(seed, 80)
    assert found(frame(spark, rows).repartition(3), least) == brute(rows, least)


def test_small_shards_count_what_crosses_their_cuts(spark, monkeypatch):
    rows = [(1, "a b c d e f " * 300, "en", "s", 1), (2, "a b. c d " * 100 + "z" * 500, "en", "s", 1), *texts(4, 40)]
    whole = found(frame(spark, rows), 5)
    for words, size in ((3, 7), (64, 40), (7, 1 << 22)):
        monkeypatch.setattr(collocations, "SHARD_WORDS", words)
        monkeypatch.setattr(collocations, "TASK_WORDS", 2 * words)
        monkeypatch.setattr(collocations, "SLICE_BYTES", size)
        monkeypatch.setattr(collocations, "MERGE_ROWS", words)
        monkeypatch.setattr(collocations, "MERGE_PAIRS", size)
        assert found(frame(spark, rows), 5) == whole == brute(rows, 5)


def test_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, " .,\n", "en", "s", 1), (3, "only", "en", "s", 1), (3, "only", "en", "s", 1), (4, "big deal " * 60_000, "en", "s", 1), (5, "w" * 100_000 + " x " + "w" * 100_000 + " x", None, "s", 1)]
    assert found(frame(spark, rows), 2) == brute(rows, 2)
    assert found(spark.createDataFrame([], DOCS), 1) == []


def test_products_beyond_64_bits_are_exact(spark):
    n = 9 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, 3 * 10**9 + 7), ("en", "b", 1, 10**10 + 1), ("en", "a b", 2, 3 * 10**9 - 1)], "lang string, phrase string, size int, n long")
    got = collocations.collocations(counts, spark.createDataFrame([("en", n)], "lang string, total long")).first()
    assert got.score == 1000 * (3 * 10**9 - 1) * n // ((3 * 10**9 + 7) * (10**10 + 1))


def test_suffix_arrays_match_brute_force():
    rng = np.random.default_rng(1)
    for head in (0, 3):
        ids = rng.integers(0, 4, 400)
        got = {}
        for n, places, counts in collocations.ngram_counts(ids, collocations._room(ids[1:] > 0, ids), head, range(2, 6)):
            got |= {tuple(ids[p : p + n]): c for p, c in zip(places, counts, strict=True) if c}
        want = Counter(tuple(ids[i : i + n]) for n in range(2, 6) for i in range(len(ids) - n + 1) if ids[i : i + n].all() and i + n > head)
        assert got == want


def test_pairs_merge_as_brute_force(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted((int(a), int(b), int(s), int(n)) for a, b, s, n in zip(rng.integers(0, 3, 300) ** 3, rng.integers(0, 3, 300), rng.permutation(300), rng.integers(0, 3, 300), strict=True))
    total = Counter()
    for a, b, _, n in rows:
        total[a, b] += n
    for size, pairs in ((4, 3), (16, 1 << 20), (1 << 16, 50)):
        monkeypatch.setattr(collocations, "MERGE_ROWS", size)
        monkeypatch.setattr(collocations, "MERGE_PAIRS", pairs)
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 7], strict=True)], names=["g1", "g2", "shard", "n"]) for i in range(0, 300, 7)]
        sums, lists = {}, []
        for batch in collocations._merge(30)(iter(batches)):
            for r in batch.to_pylist():
                if r["shard"] is None:
                    assert (r["g1"], r["g2"]) not in sums
                    sums[r["g1"], r["g2"]] = r["n"]
                else:
                    lists += [(r["shard"], *p) for p in np.frombuffer(r["pairs"], np.int64).reshape(-1, 2).tolist()]
        assert sums == {k: v for k, v in total.items() if v >= 30}
        assert sorted(lists) == sorted((s, a, b) for a, b, s, _ in rows if total[a, b] >= 30)


def test_only_phrases_of_full_cells_become_rows(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(collocations, "BLOCK_CELLS", 64)
    rng, cells, least, words = np.random.default_rng(3), 1 << 12, 12, [f"w{i}" for i in range(6)]
    said = [rng.choice(6, 400, p=[0.5, 0.3, 0.1, 0.05, 0.03, 0.02]) + 1 for _ in range(3)]
    every, total = np.array([(a, b) for a in range(100, 106) for b in range(100, 106)], np.int64), Counter()
    shards = []
    for shard, ids in enumerate(said):
        total.update(tuple(ids[i : i + n]) for n in (3, 4, 5) for i in range(len(ids) - n + 1))
        frequent = [{"idx": i + 1, "gid": 100 + i, "word": w} for i, w in enumerate(words)]
        shards.append({"shard": shard, "lang": "en", "head": 0, "ids": ids.astype(np.int32).tobytes(), "frequent": frequent, "pairs": [every.tobytes()]})
    kind = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("head", pa.int32()), ("ids", pa.binary()), ("frequent", pa.list_(pa.struct([("idx", pa.int32()), ("gid", pa.int64()), ("word", pa.string())]))), ("pairs", pa.list_(pa.binary()))])
    counted = pa.Table.from_batches(collocations._counted(cells)(iter(pa.Table.from_pylist(shards, kind).to_batches())))
    blocks = {b for b in counted.column("block").to_pylist() if b is not None}
    assert len(blocks) > 10 and max(blocks) < cells // 64
    rows, alive = counted.to_pylist(), {}
    for block in blocks:
        own = counted.filter(pa.array([r["block"] == block for r in rows]))
        for r in collocations._alive(least)(own).to_pylist():
            alive.setdefault(r["shard"], []).append(r["cells"])
    bodies = [r | {"alive": alive.get(r["shard"], [])} for r in rows if r["block"] is None]
    schema = pa.schema([f for f in counted.schema] + [pa.field("alive", pa.list_(pa.binary()))])
    made = [r for b in collocations._phrases(cells)(iter(pa.Table.from_pylist(bodies, schema).to_batches())) for r in b.to_pylist()]
    got = Counter()
    for r in made:
        assert r["size"] == len(r["phrase"].split(" "))
        got[tuple(words.index(w) + 1 for w in r["phrase"].split(" "))] += r["n"]
    want = {k: v for k, v in total.items() if v >= least}
    assert want and {k: v for k, v in got.items() if v >= least} == want
    assert len(got) < len(total) / 3
