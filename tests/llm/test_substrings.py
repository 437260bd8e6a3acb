import random

import numpy as np
import pyarrow as pa
import pytest

from quayline.llm import substrings
from quayline.llm.common import mix64
from tests.llm.fixtures import DOCS, frame, near_copies


def brute(rows):
    least = {}
    texts = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for doc, words in texts:
        if doc is not None:
            for i in range(len(words) - 49):
                key = tuple(words[i : i + 50])
                least[key] = min(doc, least.get(key, doc))
    out = []
    for doc, words in texts:
        gone = set()
        if doc is not None:
            for i in range(len(words) - 49):
                if least[tuple(words[i : i + 50])] < doc:
                    gone.update(range(i, i + 50))
        out.append((str(doc), len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    return sorted(out)


def planted(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((49, 50, 51, 70, 200, 300))] + [["aa", "bb"] * 40, ["zz"] * 90]
    rows = []
    for doc in rng.sample(range(200), 40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += [f"u{rng.random()}" for _ in range(rng.randrange(60))]
            p = rng.choice(passages)
            a, b = (0, len(p)) if rng.random() < 0.5 else sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            words += p[a:b]
        rows.append((doc, " ".join(words), None, None, None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_planted_passages_match_brute_force(spark, seed):
    rows = planted(seed)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == brute(rows)


def test_awkward_rows_match_brute_force(spark):
    rows = near_copies(7)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_empty_table(spark):
    assert substrings.dedup(spark.createDataFrame([], DOCS)).count() == 0


def edited(seed):
    """Copies of a few texts with random edits, cuts, joins and repeats, over a small vocabulary."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (90, 300, 900)]
    rows = []
    for doc in rng.sample(range(300), 60):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(5)}"
        if rng.random() < 0.3:
            words = words[rng.randrange(len(words) // 2) :] + words[: rng.randrange(len(words))]
        if rng.random() < 0.3:
            words += rng.choice(bases)[: rng.randrange(90)]
        rows.append((doc, " ".join(words), None, None, None))
    return rows + rows[:3] + [(rows[0][0], rows[5][1], None, None, None)]


def found_in(docs):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substrings.dedup(docs).collect())


def found(spark, rows):
    return found_in(spark.createDataFrame(rows, DOCS))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_edited_copies_match_brute_force(spark, seed):
    rows = edited(seed)
    assert found(spark, rows) == brute(rows)


def test_the_result_comes_through_the_paths(spark, monkeypatch):
    rows = planted(1)
    whole = brute(rows)
    assert found(spark, rows) == whole
    full = substrings.compact
    monkeypatch.setattr(substrings, "compact", lambda supers: full(supers.where("false")))
    assert sum(r[2] for r in found(spark, rows)) == 0
    # a path that is one place short of its walk loses that place's words
    monkeypatch.setattr(substrings, "compact", lambda supers: short(full(supers)))

    def short(paths):
        from quayline.llm.common import settled

        return settled(paths.where("place = 0"))

    assert found(spark, rows) != whole


def test_the_given_table_goes_through_the_paths(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found_in(docs) == brute(rows) and sum(r[2] for r in brute(rows)) > 500
    full = substrings.compact
    # neither whole copies nor what two boundary runs share is found without compaction
    monkeypatch.setattr(substrings, "compact", lambda supers: full(supers.where("false")))
    assert sum(r[2] for r in found_in(docs)) == 0


def test_every_edge_lies_in_one_super_edge():
    rng = np.random.default_rng(5)
    for n in (49, 50, 51, 60, 88, 400):
        for vocabulary in (1, 2, 1000):
            keys = mix64(rng.integers(0, vocabulary, n).astype(np.uint64) + np.uint64(1))
            _, _, lo, hi = substrings.super_edges(keys)
            assert [s for a, b in zip(lo, hi, strict=True) for s in range(a, b - 49)] == list(range(n - 49))


def test_paths_are_compacted(spark):
    names = "u long, h long, least long, most long, p0 long, p1 long, n0 long, n1 long"
    # 1-2-3-4 is one path; 7 has two forerunners; 5 is in one document; 6 is repeated and alone
    supers = [(1, 1, 1, 9, 0, 0, 2, 2), (2, 2, 1, 9, 1, 1, 3, 3), (3, 3, 1, 9, 2, 2, 4, 4), (4, 4, 1, 9, 3, 3, 0, 8), (7, 7, 1, 9, 8, 9, 0, 0), (5, 5, 1, 1, 6, 6, 0, 0), (6, 6, 1, 2, 0, 0, 0, 5)]
    got = {(r.u, r.path, r.place) for r in substrings.compact(spark.createDataFrame(supers, names)).collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (7, 7, 0), (6, 6, 0)}


def test_a_ring_is_refused(spark):
    names = "u long, h long, least long, most long, p0 long, p1 long, n0 long, n1 long"
    ring = [(1, 1, 1, 9, 3, 3, 2, 2), (2, 2, 1, 9, 1, 1, 3, 3), (3, 3, 1, 9, 2, 2, 1, 1)]
    with pytest.raises(RuntimeError):
        substrings.compact(spark.createDataFrame(ring, names))


def test_pointers_along_paths_are_not_broadcast(spark, monkeypatch):
    def refuse(*_args, **_kinds):
        raise AssertionError("a table of pointers grows with the corpus and would be broadcast at every doubling")

    monkeypatch.setattr(substrings, "broadcast_if", refuse)
    none = substrings.NONE
    # two paths, of 21 and of 3
    supers = [(u, 1, 2, p, p, n, n) for first, last in ((1, 21), (31, 33)) for u in range(first, last + 1) for p, n in [(u - 1 if u > first else none, u + 1 if u < last else none)]]
    got = {(r.u, r.path, r.place) for r in substrings.compact(spark.createDataFrame(supers, "u long, least long, most long, p0 long, p1 long, n0 long, n1 long")).collect()}
    assert got == {(u, 1, u - 1) for u in range(1, 22)} | {(u, 31, u - 31) for u in range(31, 34)}


def test_texts_worked_through_together_are_alike(monkeypatch):
    texts = [r[1] for r in edited(4)] + [None, "", " \t\n ", "a " * 60, "caf\u00e9\x1c\u00a0z \x0bq\x00 " * 40, "x" * 70, "ab" * 35 + " " + "y " * 55]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})

    def walks():
        return [r for b in substrings._walks(iter([batch])) for r in b.to_pylist()]

    together = walks()
    assert [r["n_words"] for r in together] == [len((t or "").encode().split()) for t in texts] and sum(len(r["h"]) for r in together) > 1000
    for bound in (1, 100, 5000):
        monkeypatch.setattr(substrings, "GROUP_BYTES", bound)
        assert walks() == together
    for row, text in zip(together, texts, strict=True):
        keys, _ = substrings.word_keys((text or "").encode())
        _, _, lo, hi = substrings.super_edges(keys)
        assert (row["lo"], row["hi"]) == (lo.tolist(), hi.tolist())


def test_keys_of_words_depend_on_the_words_alone(monkeypatch):
    rng = random.Random(6)
    words = [bytes(rng.choice(b"ab\x00\xc3") for _ in range(rng.choice((1, 2, 9, 63, 64, 65, 200)))) for _ in range(3000)]
    keys, at = substrings.word_keys(b" ".join(words))
    assert len(dict(zip(words, keys.tolist(), strict=True))) == len(set(words)) == len(set(keys.tolist()))
    assert [substrings.word_keys(w)[0][0] for w in words[:200]] == keys[:200].tolist()
    monkeypatch.setattr(substrings, "GROUP_BYTES", 100)
    other, places = substrings.word_keys(b"\n" + b"\r \x0c".join(words))
    assert (other == keys).all() and len(places) == len(at) == len(words)


def test_many_texts_go_on_in_few_batches():
    rows = edited(5)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(rows))), "text": [r[1] for r in rows]})
    walked = pa.Table.from_batches(substrings._walks(iter([batch])))
    places = [[{"lo": lo, "hi": hi} for lo, hi in zip(r["lo"], r["hi"], strict=True)] for r in walked.to_pylist()]
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    placed = pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], walked["name"].combine_chunks(), pa.array(places, kind)], names=["doc_id", "text", "name", "places"])
    edges, said = list(substrings._edges(iter([placed]))), list(substrings._sequences(iter([placed])))
    # one for each text before
    assert len(edges) == len(said) == 1
    words = [r[1].encode().split() for r in rows]
    got = {(r["doc_id"], r["start"]): r for r in edges[0].to_pylist()}
    assert sorted(got) == [(i, j) for i, w in enumerate(words) for j in range(len(w) - 49)]
    windows = {(i, j): tuple(words[i][j : j + 50]) for i, j in got}
    assert len({(windows[k], r["u"]) for k, r in got.items()}) == len(set(windows.values())) == len({r["u"] for r in got.values()})
    for (i, j), r in got.items():
        assert r["prev"] == (got[i, j - 1]["u"] if j else substrings.NONE) and r["nxt"] == (got[i, j + 1]["u"] if (i, j + 1) in got else substrings.NONE)
    assert [(r["doc_id"], r["start"], r["words"]) for r in said[0].to_pylist()] == [(i, p["lo"], b" ".join(words[i][p["lo"] : p["hi"]])) for i, own in enumerate(places) for p in own]
