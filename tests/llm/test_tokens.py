import math
import random
import re

import numpy as np
import pytest
import sentencepiece
import xxhash

from quayline.llm import sptokens, tokencount
from tests.llm.fixtures import DOCS, frame, near_copies

HARD = ["", " ", "  a  b\n", "x\n\n  y ", "日本語 text", "😀 hi", "a\tb", "\0", "</s><s>", "x" * 5000, "ab " * 3000, "Ünïcödé façade", "end.\nNext,", "▁", "a▁b ▁", "don't", " " * 40 + "z"]


@pytest.fixture(scope="module")
def model():
    return sptokens.load_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sptokens.MODEL)


def prose(seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeioustrnlé,.X") for _ in range(rng.randrange(1, 14))) for _ in range(400))


def test_without_dropout_it_is_the_library(model, library):
    texts = [t for t in HARD if "▁" not in t] + [prose(i) for i in range(5)]
    assert [x.tolist() for x in sptokens.Encoder(model, 0.0, 1).encode_all(texts, [0] * len(texts))] == library.encode(texts)


@pytest.mark.parametrize("dropout", [0.1, 0.5, 1.0])
def test_round_trip_and_variety(model, library, dropout):
    texts = HARD + [prose(9)]
    encoder = sptokens.Encoder(model, dropout, 3)
    ids = encoder.encode_all(texts, list(range(len(texts))))
    assert [encoder.decode(x) for x in ids] == texts
    assert [library.decode(x.tolist()) for x in ids] == texts
    again = sptokens.Encoder(model, dropout, 3).encode_all(texts, list(range(len(texts))))
    assert all(np.array_equal(a, b) for a, b in zip(ids, again, strict=True))
    other = sptokens.Encoder(model, dropout, 4).encode_all(texts, list(range(len(texts))))
    assert dropout == 1.0 or not np.array_equal(other[-1], ids[-1])
    if dropout == 0.5:
        same = encoder.encode_all(["wonderful " * 200], [5])[0]
        assert len({tuple(encoder.unit(" wonderful", s)) for s in range(sptokens.STREAMS)}) > 2 and encoder.decode(same) == "wonderful " * 200


def test_arrays_and_heap_agree(model):
    encoder = sptokens.Encoder(model, 0.3, 5)
    units = {u for t in [*HARD, prose(2), prose(3)] for u in encoder._UNIT.findall(" " + t) if len(u) <= encoder.short}
    jobs = [(u, s) for u in units for s in (0, 5)]
    assert [np.frombuffer(x, np.int32).tolist() for x in encoder.together(jobs)] == [list(encoder.unit(*j)) for j in jobs]


def test_every_occurrence_is_drawn_anew(model):
    """The rate of dropout holds for one word however often it occurs, and a long word is cut in many ways."""
    encoder = sptokens.Encoder(model, 0.1, 11)
    for word in ("a", "t"):
        ids = encoder.encode_all([" ".join([word] * 5000)] * 4, list(range(4)))
        merged = sum(len(x) == 1 for x in (encoder.unit(f" {word}", k) for k in range(500)))
        assert 420 < merged < 480
        split = sum(len(x) for x in ids) - 20000
        assert 0.09 < split / 20000 < 0.11
    text = " ".join(["wonderful"] * 3000)
    units = encoder._UNIT.findall(" " + text)
    cut = [encoder.unit(u, k) for u, k in zip(units, encoder.keys(len(units), 8).tolist(), strict=True)]
    assert len(set(cut)) > 20
    assert encoder.encode_all([text], [8])[0].tolist() == [i for c in cut for i in c]


@pytest.mark.parametrize("dropout", [0.05, 0.4, 1.0])
def test_remembered_outcomes_are_those_of_the_heap(model, dropout):
    encoder = sptokens.Encoder(model, dropout, 2)
    encoder.together_chars, encoder.nodes = 4000, 300
    texts = [*HARD, prose(7), prose(7), prose(8)]
    for key, ids in enumerate(encoder.encode_all(texts, list(range(len(texts))))):
        units = encoder._UNIT.findall(" " + texts[key]) if texts[key] else []
        assert ids.tolist() == [i for u, k in zip(units, encoder.keys(len(units), key).tolist(), strict=True) for i in encoder.unit(u, k)]


def by_the_rule(text, doc_id, dropout, seed, model):
    """Merge-dropout from its definition alone: a list of parts, all candidates looked at again for each step, plain integers.

    The key of an occurrence is a mix of its place, the document's key (xxh64 of the text under the xxh64 of its id under the
    seed) and the seed. From it come the numbers of steps between skips, geometric with the probability of dropout.
    """
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    document = xxhash.xxh64_intdigest(text, xxhash.xxh64_intdigest(str(doc_id), seed))
    out = []
    for place, unit in enumerate(re.findall(r" *[^ \n]+| +|\n", " " + text) if text else []):
        key = mix(place + document * 0xD6E8FEB86659FD93 + seed * 0xA0761D6478BD642F & mask)
        gap = lambda n, key=key: min(int(math.log(((mix(key + n * 0xE7037ED1A0B428DB & mask) >> 11) + 1) / 2**53) / math.log1p(-dropout)), 1 << 30)
        parts = [("▁" if c == " " else "" if c == "▁" else c, (i,)) for i, c in enumerate(unit)]
        passed, step, skips, skip = set(), 0, 0, gap(0)
        while True:
            open_ = [(model["pieces"][a + b][0], i) for i, ((a, at), (b, to)) in enumerate(zip(parts, parts[1:], strict=False)) if a and b and a + b in model["pieces"] and (at, to) not in passed]
            if not open_:
                break
            _, i = min(open_)
            (a, at), (b, to) = parts[i : i + 2]
            if step == skip:
                passed.add((at, to))
                skips += 1
                skip += 1 + gap(skips)
            else:
                parts[i : i + 2] = [(a + b, at + to)]
            step += 1
        for part, _ in parts:
            out += [model["pieces"][part][1]] if part in model["pieces"] else [model["byte_ids"][b] for b in (part or "▁").encode()]
    return out


@pytest.mark.parametrize("dropout", [0.1, 0.5])
def test_documents_follow_the_rule(spark, model, dropout):
    texts = [t for t in HARD if len(t) < 200] + [prose(5), prose(6)[:900], prose(6)[:900]]
    rows = [(i if i % 7 else None, t, None, None, None) for i, t in enumerate(texts)]
    got = sptokens.encode_documents(frame(spark, rows), dropout, 7).collect()
    want = {(i, t): by_the_rule(t, i, dropout, 7, model) for i, t, *_ in rows}
    assert len(got) == len(rows) and all(r.token_ids == want[r.doc_id, r.text] for r in got)


def test_about_a_tenth_is_dropped(model):
    """Without merges every character stands alone; with p = 0.1 the share of merges that are missed is small but there."""
    text = prose(4)
    n = [len(sptokens.Encoder(model, p, 1).encode_all([text], [1])[0]) for p in (0.0, 0.1, 1.0)]
    assert n[0] < n[1] < n[0] + 0.4 * (n[2] - n[0])


def test_documents(spark):
    rows = near_copies(4)
    got = sptokens.encode_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert all((r.token_ids is None) == (r.text is None) and r.n_tokens == len(r.token_ids or []) for r in got)
    assert sptokens.encode_documents(spark.createDataFrame([], DOCS)).count() == 0


def brute_count(text, logs, byte_log):
    best, count = [0.0] + [-math.inf] * len(text), [0] * (len(text) + 1)
    for end in range(1, len(text) + 1):
        raw = len(text[end - 1].encode())
        best[end], count[end] = best[end - 1] + raw * byte_log, count[end - 1] + raw
        for start in range(end - 1, -1, -1):
            log = logs.get(text[start:end])
            if log is not None and best[start] + log > best[end]:
                best[end], count[end] = best[start] + log, count[start] + 1
    return count[-1]


def test_counts_match_brute_force(spark, model):
    logs, byte_log = tokencount.log_probabilities(model)
    rows = [(i, t, None, None, None) for i, t in enumerate([*HARD, prose(1), None])]
    rows += rows[:3] + [(None, "null id", None, None, None)]
    got = sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in tokencount.count_tokens(frame(spark, rows)).collect())
    want = []
    for r in rows:
        words = [w.decode() for w in (r[1] or "").encode().split()]
        want.append((str(r[0]), len(words), sum(brute_count("▁" + w, logs, byte_log) for w in words)))
    assert got == sorted(want)
    assert tokencount.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_a_small_trie_starts_anew(model):
    trie = tokencount.Trie(*tokencount.log_probabilities(model))
    words = [w.encode() for w in prose(6).split()]
    want = [trie.tokens(w) for w in words]
    trie.clear()
    trie.most_nodes, trie.most_words = 40, 5
    assert [trie.tokens(w) for w in words] == want and len(trie.scores) <= 60
