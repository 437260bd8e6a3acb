"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded alone; a gated attention says how much it weighs in its document, and
the weighted mean of the encodings is scored. Only documents have labels, so encoder, attention and score are learned together.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import lane, share, small_batches, within

#: UTF-8 bytes of a passage, and its features: as many single bytes as there are, then hash buckets of three bytes, then how the
#: buckets are filled.
PASSAGE, BUCKETS = 512, 256
FEATURES = 256 + BUCKETS + 3
#: Width of an encoding and of the attention.
HIDDEN, GATE = 32, 16
#: At most about this many labelled rows are learned from, half of each label, drawn evenly by a hash of doc_id at any corpus size,
#: and at most about so many bytes of text; longer documents than LONGEST are scored, but not learned from.
TRAIN_ROWS, TRAIN_BYTES, LONGEST = 8_000, 24 << 20, 1 << 18
EPOCHS, BAGS, RATE, DECAY, SEED = 12, 64, 3e-3, 1e-4, 20260830
#: Passages that are worked on at a time.
_CHUNK = 2_048


class Model(NamedTuple):
    """encode: tanh(x W + b). attend: softmax over passages of g . (tanh(h V) * sigmoid(h U)). score: sigmoid(z . c + bias)."""

    W: np.ndarray
    b: np.ndarray
    V: np.ndarray
    U: np.ndarray
    g: np.ndarray
    c: np.ndarray
    bias: np.ndarray


def passages(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, features) of the passages of all whole texts, in order and in chunks; an empty text is one empty passage.

    A feature is log(1 + n) of the bytes or buckets of three bytes that begin in the passage; the last ones of a text take in its
    end. The last features tell repetition: four times the filled buckets for each byte, and the logs of one more than the fullest
    one and than the sum of squares.
    """
    counts = np.fromiter((max(1, -(-len(t) // PASSAGE)) for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), counts)
    before = np.cumsum(counts) - counts
    for first in range(0, len(owner), _CHUNK):
        docs = owner[first : first + _CHUNK]
        cut = np.zeros((len(docs), PASSAGE + 2), np.uint8)
        for doc in range(docs[0], docs[-1] + 1):  # a slice of each text at a time
            low, high = max(first, before[doc]), min(first + len(docs), before[doc] + counts[doc])
            at = (low - before[doc]) * PASSAGE
            piece = np.frombuffer(texts[doc][at : (high - before[doc]) * PASSAGE + 2], np.uint8)
            padded = np.zeros((high - low) * PASSAGE + 2, np.uint8)
            padded[: len(piece)] = piece
            rows = cut[low - first : high - first]
            rows[:, :PASSAGE] = padded[:-2].reshape(-1, PASSAGE)
            rows[:, PASSAGE:] = np.lib.stride_tricks.sliding_window_view(padded, 2)[PASSAGE::PASSAGE]
        wide = cut.astype(np.uint32)
        three = (wide[:, :-2] << np.uint32(16) | wide[:, 1:-1] << np.uint32(8) | wide[:, 2:]) * np.uint32(0x9E3779B1)
        bucket = 256 + (three >> np.uint32(16)) % np.uint32(BUCKETS)
        base = (np.arange(len(docs)) * (256 + BUCKETS))[:, None]
        real = cut[:, :PASSAGE] > 0
        found = sum(np.bincount((base + x)[real], minlength=len(docs) * (256 + BUCKETS)) for x in (cut[:, :PASSAGE], bucket))
        found = found.reshape(len(docs), -1).astype(np.float32)
        three = found[:, 256:]
        fill = [4 * np.count_nonzero(three, axis=1) / np.maximum(real.sum(axis=1), 1), np.log1p(three.max(axis=1)), np.log1p(np.einsum("ij,ij->i", three, three))]
        yield docs, np.concatenate([np.log1p(found), np.stack(fill, axis=1).astype(np.float32)], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _attend(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Encodings, both halves of the gate, and the weights of passages before they are normed by document."""
    h = np.tanh(x @ model.W + model.b)
    t, s = np.tanh(h @ model.V), _sigmoid(h @ model.U)
    return h, t, s, np.exp((t * s) @ model.g)


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    """The score of each whole text; sums run over chunks, so a long text is never held encoded."""
    total, weight = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts))
    for docs, x in passages(texts):
        h, _, _, e = _attend(model, x)
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        weight[docs[starts]] += np.add.reduceat(e, starts, dtype=np.float64)
        total[docs[starts]] += np.add.reduceat(h * e[:, None], starts, axis=0, dtype=np.float64)
    return _sigmoid(total / weight[:, None] @ model.c + model.bias)


def _start(rng: np.random.Generator) -> Model:
    small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return Model(small(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), small(HIDDEN, GATE), small(HIDDEN, GATE), small(GATE), small(HIDDEN), np.zeros((), np.float32))


def gradients(model: Model, x: np.ndarray, docs: np.ndarray, labels: np.ndarray) -> tuple[Model, np.ndarray]:
    """The gradient of the mean cross entropy of bags (``docs`` numbers them from 0, in order, each with a passage), and their scores."""
    h, t, s, e = _attend(model, x)
    starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    a = e / np.add.reduceat(e, starts)[docs]
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    p = _sigmoid(z @ model.c + model.bias)
    off = (p - labels) / len(labels)
    dz = off[:, None] * model.c
    # a passage's weight moves the mean towards its encoding
    pull = np.einsum("ij,ij->i", h, dz[docs])
    dlogit = a * (pull - np.add.reduceat(a * pull, starts)[docs])
    dgate = dlogit[:, None] * model.g
    dt, ds = dgate * s * (1 - t * t), dgate * t * s * (1 - s)
    dh = a[:, None] * dz[docs] + dt @ model.V.T + ds @ model.U.T
    dpre = dh * (1 - h * h)
    return Model(x.T @ dpre, dpre.sum(axis=0), h.T @ dt, h.T @ ds, (t * s).T @ dlogit, z.T @ off, off.sum()), p


def learn(texts: list[bytes], labels: np.ndarray, prior: float) -> Model:
    """A model of ``texts`` and their labels 0 and 1, by Adam over shuffled bags; ``prior`` is the true share of label 1.

    The labels of a sample may be drawn at another rate than they occur: the bias is moved by the difference of log odds.
    With one label alone, or none, nothing is learned and every score is ``prior``.
    """
    rng = np.random.default_rng(SEED)
    model = _start(rng)
    odds = lambda q: np.log(q / (1 - q))
    if len(set(labels.tolist())) < 2:
        return model._replace(c=np.zeros(HIDDEN, np.float32), bias=np.float32(odds(min(max(prior, 1e-6), 1 - 1e-6))))
    held = [x for _, x in passages(texts)]
    held = np.concatenate(held).astype(np.float16)
    sizes = np.fromiter((max(1, -(-len(t) // PASSAGE)) for t in texts), np.int64, len(texts))
    first = np.cumsum(sizes) - sizes
    slope, square, step = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for at in range(0, len(order), BAGS):
            bags = order[at : at + BAGS]
            rows = np.concatenate([np.arange(first[d], first[d] + sizes[d]) for d in bags])
            grads, _ = gradients(model, held[rows].astype(np.float32), np.repeat(np.arange(len(bags)), sizes[bags]), labels[bags])
            step += 1
            moved = []
            for i, (m, grad) in enumerate(zip(model, grads, strict=True)):
                grad = grad + DECAY * m
                slope[i] = 0.9 * slope[i] + 0.1 * grad
                square[i] = 0.999 * square[i] + 0.001 * grad * grad
                moved.append((m - rate * (slope[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
            model = Model(*moved)
    drawn = float(np.mean(labels))
    return model._replace(bias=np.float32(model.bias + odds(min(max(prior, 1e-6), 1 - 1e-6)) - odds(drawn)))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Model:
    """Learn from the non-null ``quality`` of ``labels`` (doc_id) and the whole ``text`` of ``docs``; any quality above 0 is label 1.

    About ``rows`` labelled documents and ``size`` bytes are drawn, half of each label and all of a rarer one; rows longer than
    LONGEST bytes are not, nor null texts. A doc_id with several labels counts once with the least. Only the drawn texts reach
    the driver; documents are not shuffled. Rows of a repeated doc_id are rows of their own.
    """
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") > 0).cast("int")).alias("label"))
    texts = docs.where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text")).where(F.octet_length("text") <= LONGEST)
    # the drawn ids are as many as TRAIN_ROWS bounds, so they are broadcast; a first draw by rows tells how long they are
    per_label = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = known.where(lane("doc_id", of=1 << 20) < F.when(F.col("label") == 1, share(rows / 2, per_label.get(1, 0))).otherwise(share(rows / 2, per_label.get(0, 0))))
    found = texts.join(F.broadcast(drawn), "doc_id")
    whole = found.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if whole > size:
        found = found.where(lane(F.lit(1), "doc_id", of=1 << 20) < share(size, whole))
    sample = found.select("doc_id", "text", "label").toPandas()
    sample["key"] = [bytes(t) for t in sample["text"]]
    sample = sample.sort_values(["doc_id", "key"], kind="stable")
    total = sum(per_label.values())
    return learn(sample["key"].tolist(), sample["label"].to_numpy(np.float32), per_label.get(1, 0) / total if total else 0.5)


def _scorer(model: Broadcast, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*model.value)
        for batch in within(batches):
            columns = dict(zip(names, batch.columns, strict=True))
            score = score_texts([t or b"" for t in columns["text"].cast(pa.binary()).to_pylist()], known)
            columns |= {"score": pa.array(score, pa.float64()), "predicted": pa.array((score >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score and predicted, from the whole ``text`` alone (earlier columns of those names are replaced).

    A null text is empty, and an empty one is an empty passage. Rows are independent, so null and repeated ids come back as they
    are; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    # plain arrays: broadcasts, unlike functions, do not carry this package's classes to workers that lack it
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))
    schema = docs.select("*", F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.mapInArrow(_scorer(shared, docs.columns), schema)
