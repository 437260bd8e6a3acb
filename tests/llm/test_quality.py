import math

import numpy as np
from pyspark.sql import functions as F

from quayline.llm import quality, queries
from tests.llm.fixtures import DOCS, frame

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = queries.op13_quality(spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").where("held_out").collect()
    right = {q: [r.predicted == r.quality for r in got if r.quality == q] for q in (0, 1)}
    assert len(right[0]) > 8 and len(right[1]) > 80
    assert np.mean(right[0]) >= 0.8 and np.mean(right[1]) >= 0.97
    ranks = [np.mean([(b.score > a.score) + (b.score == a.score) / 2 for b in got if b.quality == 1]) for a in got if a.quality == 0]
    assert np.mean(ranks) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def model(seed=1):
    return quality._start(np.random.default_rng(seed))._replace(bias=np.float32(0.3))


def brute(text, m):
    """One passage after the other, from the definition."""
    scores, codes = [], []
    for at in range(0, max(1, len(text)), quality.PASSAGE):
        n = [0] * (256 + quality.BUCKETS)
        for i in range(at, min(len(text), at + quality.PASSAGE)):
            if text[i]:
                a, b, c = (*text[i : i + 3], 0, 0)[:3]
                n[text[i]] += 1
                n[256 + ((((a << 16 | b << 8 | c) * 0x9E3779B1) & 0xFFFFFFFF) >> 16) % quality.BUCKETS] += 1
        three = n[256:]
        fill = [4 * sum(v > 0 for v in three) / max(1, sum(n[:256])), math.log(1 + max(three)), math.log(1 + sum(v * v for v in three))]
        h = np.tanh(np.array([*(math.log(1 + v) for v in n), *fill]) @ m.W.astype(float) + m.b)
        codes.append(h)
        scores.append(float(np.dot(m.g, np.tanh(h @ m.V) / (1 + np.exp(-(h @ m.U))))))
    weight = np.exp(np.array(scores) - max(scores))
    z = (weight / weight.sum()) @ np.array(codes)
    return 1 / (1 + math.exp(-(z @ m.c + m.bias)))


def test_scores_match_brute_force(monkeypatch):
    m = model()
    rng = np.random.default_rng(2)
    texts = [b"", b"a", b"\0\0", "é".encode() * 700, bytes(rng.integers(0, 256, 5000, np.uint8)), b"x" * 512, b"x" * 513, b"x" * 1024, *(bytes(rng.integers(97, 123, n, np.uint8)) for n in rng.integers(0, 3000, 20))]
    want = [brute(t, m) for t in texts]
    for chunk in (2048, 3):
        monkeypatch.setattr(quality, "_CHUNK", chunk)
        assert np.allclose(quality.score_texts(texts, m), want, atol=1e-4)


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    m = quality.Model(*(np.asarray(x, float) for x in model()))
    x, docs, labels = rng.random((9, quality.FEATURES)), np.repeat([0, 1, 2], [2, 4, 3]), np.array([1.0, 0.0, 1.0])

    def loss(m):
        _, p = quality.gradients(m, x, docs, labels)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads, _ = quality.gradients(m, x, docs, labels)
    for name in m._fields:
        value = getattr(m, name)
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            moved = [value.copy() for _ in range(2)]
            for sign, v in zip((1, -1), moved, strict=True):
                v[at] += sign * 1e-5
            slope = (loss(m._replace(**{name: moved[0]})) - loss(m._replace(**{name: moved[1]}))) / 2e-5
            assert np.isclose(slope, getattr(grads, name)[at], rtol=1e-3, atol=1e-8), name


def test_attention_finds_the_bad_passage():
    # long clean documents of which one passage is junk are told from clean ones
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, n, np.uint8)) for n in rng.integers(2, 9, 300)]
    prose = lambda n: b" ".join(words[i] for i in rng.integers(0, 300, n))
    texts = [prose(800) if i % 2 else prose(300) + b" ### $$$" * 60 + prose(430) for i in range(160)]
    m = quality.learn(texts[:120], np.arange(120) % 2.0, 0.5)
    assert np.mean((quality.score_texts(texts[120:], m) >= 0.5) == np.arange(40) % 2) >= 0.9


def test_awkward_rows(spark):
    rows = [(1, None, "en", "s", 1), (1, "", "en", "s", 1), (None, "x", None, None, None), (2, "word " * 300_000, "en", "s", 1), (3, "a fine text", "en", "s", 1), (3, "a fine text", "en", "s", 1)]
    df = frame(spark, rows).withColumn("predicted", F.lit("x")).withColumn("label", F.lit(9))
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    m = quality.fit(df, labels)
    got = quality.score(df, m).select("doc_id", "score", "predicted").collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1 and len({r.score for r in got if r.doc_id == 1}) == 1
    nothing = spark.createDataFrame([], DOCS)
    assert quality.score(nothing, m).count() == 0
    for none in (quality.fit(nothing, labels), quality.fit(df, labels.where("quality = 1")), quality.fit(df, labels.where("quality > 1"))):
        assert len({r.score for r in quality.score(df, none).collect()}) == 1


def test_the_sample_is_bounded(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "learn", lambda texts, labels, prior: seen.update(texts=texts, labels=labels, prior=prior))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x" * 1000).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    quality.fit(docs, labels, rows=400)
    assert 300 < len(seen["texts"]) < 500 and 0.4 < np.mean(seen["labels"]) < 0.6 and seen["prior"] == 0.9
    quality.fit(docs, labels, rows=400, size=100_000)
    assert 60 < len(seen["texts"]) < 140
    quality.fit(docs.withColumn("text", F.lit("x" * (quality.LONGEST + 1))), labels)
    assert seen["texts"] == []
