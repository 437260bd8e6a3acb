"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayline.llm.common import lane, share, small_batches, within

#: n-gram orders and hash buckets; the matrix has one row for each language and BUCKETS columns.
ORDERS, BUCKETS = (1, 2, 3), 1 << 15
#: At most about this many labelled rows are learned from, as many of each language (all of a rarer one, whose rest goes to the
#: others), drawn evenly by a hash of doc_id and text at any corpus size.
TRAIN_ROWS = 20_000
#: More languages than this are refused, which bounds the broadcast matrix to 128 MB.
MOST_LANGS = 1_000
UNKNOWN = "und"
_CHUNK = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def _ngrams(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """Chunks (first, last, starts, bucket arrays by order) of whole lower-cased texts; bucket BUCKETS holds no n-gram."""
    first = 0
    lower = [t.lower() for t in texts]
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(lower[last]) + 2 <= _CHUNK):
            size += len(lower[last]) + 2
            last += 1
        joined = "\0\0".join(lower[first:last]) + "\0\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        lengths = np.fromiter((len(t) + 2 for t in lower[first:last]), np.int64, last - first)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        grams, key, real = [], np.zeros(len(codes), np.uint64), np.ones(len(codes), bool)
        padded = np.concatenate([codes, np.zeros(max(ORDERS), np.uint64)])
        for order in range(1, max(ORDERS) + 1):
            nxt = padded[order - 1 : order - 1 + len(codes)]
            key = (key + nxt) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            real = real & (nxt != 0)
            if order in ORDERS:
                grams.append(np.where(real, (key >> np.uint64(17)) % np.uint64(BUCKETS), np.uint64(BUCKETS)).astype(np.int64))
        yield first, last, starts, grams
        first = last


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in within(batches):
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by_lang.setdefault(lang, []).append(text or "")
        for lang, texts in by_lang.items():
            total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for _, _, _, grams in _ngrams(texts):
                for g in grams:
                    total += np.bincount(g, minlength=BUCKETS + 1)
    for lang, total in totals.items():
        full = np.flatnonzero(total[:BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full, pa.int64()), pa.array(total[full], pa.int64())], names=["lang", "bucket", "n"])


def _quota(sizes: list[int], bound: float) -> float:
    """So many rows of each language that all together make ``bound``, given that a language has no more than its size."""
    left = bound
    for i, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - i) > left:
            return left / (len(sizes) - i)
        left -= size
    return float(max(sizes, default=0))


def fit(labelled: DataFrame, bound: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log priors and the (BUCKETS + 1) x languages matrix of log probabilities (add-one; last row 0).

    Learns from the non-null ``lang`` and whole ``text`` of about ``bound`` rows: of each language the same number, all of
    a language with fewer. Priors are the shares of all labelled rows. A language whose rows hold no n-gram (null or
    empty texts) is not learned. Counts are summed in Spark and reach the driver language by language.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull()).select("doc_id", "lang", "text")
    per_lang = known.groupBy("lang").count().orderBy("lang").limit(MOST_LANGS + 1).collect()
    if len(per_lang) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    quota = _quota([r["count"] for r in per_lang], bound)
    # a row for each language, MOST_LANGS at most
    limits = labelled.sparkSession.createDataFrame([(r["lang"], share(quota, r["count"])) for r in per_lang], "lang string, __keep int")
    drawn = known.join(F.broadcast(limits), "lang").where(lane("doc_id", "text", of=1 << 20) < F.col("__keep"))
    counts = drawn.select("lang", "text").mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # a row for each language, of BUCKETS pairs at most, brought one after the other
    rows = counts.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("x")).select("lang", F.col("x.bucket").alias("buckets"), F.col("x.n").alias("counts"))
    columns = {}
    for row in rows.toLocalIterator():
        column = np.ones(BUCKETS, np.float64)
        column[np.array(row["buckets"])] += np.array(row["counts"], float)
        columns[row["lang"]] = np.log(column / column.sum()).astype(np.float32)
    known_langs = [r for r in per_lang if r["lang"] in columns]
    langs, sizes = [r["lang"] for r in known_langs], np.array([r["count"] for r in known_langs], float)
    logs = np.zeros((BUCKETS + 1, len(langs)), np.float32)
    for i, lang in enumerate(langs):
        logs[:BUCKETS, i] = columns.pop(lang)
    return langs, np.log(sizes / sizes.sum()), logs


def score_texts(texts: list[str], langs: list[str], priors: np.ndarray, logs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior; ``und`` and 0 where there is no letter or nothing learned."""
    sums = np.tile(priors, (len(texts), 1))
    for first, last, starts, grams in _ngrams(texts):
        for g in grams:
            sums[first:last] += np.add.reduceat(logs[g], starts, axis=0, dtype=np.float64)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = sums.argmax(axis=1)
    post = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
    letters = np.fromiter((_LETTER.search(t) is not None for t in texts), bool, len(texts))
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, post, 0.0)


def _scorer(model: Broadcast, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, priors, logs = model.value
        for batch in within(batches):
            columns = dict(zip(names, batch.columns, strict=True))
            pred, score = score_texts([t or "" for t in columns["text"].to_pylist()], langs, priors, logs)
            columns |= {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score, pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """``docs`` with lang_pred and score, from the whole ``text`` alone (earlier columns of those names are replaced).

    Null or letterless texts, and an empty model, give ``und`` with score 0. Rows are independent, so null and
    repeated ids and repeated rows come back as they are; an empty table gives none. Ties go to the first language.
    """
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("lang_pred", "score")
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").cast("string").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return docs.mapInArrow(_scorer(shared, docs.columns), schema)
