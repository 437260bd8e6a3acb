"""Phrase collocations: n-gram counts from word-id suffix arrays of shards, merged by key, and their best-explained cuts.

A shard holds the word ids of at most ``SHARD_WORDS`` consecutive words of one language that a task read. Its suffix array is
built by prefix doubling in numpy, and the intervals of its LCP array are its n-grams with their counts. Counts are merged over
shards in three rounds, each of which only counts what can still be frequent: words, pairs of frequent words, and longer
phrases all of whose pairs are frequent. The last are first counted by hash cells (Park, Chen and Yu), and only those of full
cells by name. This loses nothing, as no phrase is more frequent than its parts or its cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import broadcast_if, cut, durable, forget, mix64, settled, small_batches, within

#: Words of a phrase, its least count and the rows of a language's report.
MOST_WORDS, LEAST_COUNT, TOP = 5, 100, 2000
#: Words of a shard, of all open shards of a task (one for each language), and bytes of text that are split into words at once.
SHARD_WORDS, TASK_WORDS, SLICE_BYTES = 1 << 21, 1 << 22, 1 << 22
#: Bytes of text that a task reads at least where there are more than the cluster's cores can take at once: fuller shards repeat fewer n-grams.
TASK_BYTES = 128 << 20
_BREAK = b"\xff"  # stands in no UTF-8 text
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + _BREAK * 10 + b" ")
SHARDS = "shard bigint, lang string, idx int, word string, n bigint, head int, ids binary"
PAIRS = "g1 bigint, g2 bigint, shard bigint, n bigint"
PHRASES = "lang string, phrase string, size int, n bigint"
MERGED = "g1 bigint, g2 bigint, n bigint, shard bigint, pairs binary"
#: What is stored of a shard's longer phrases: their number by size, and the shard's own words and ids that they are made of.
_BODY = {"lang": pa.string(), "sizes": pa.list_(pa.int32()), "places": pa.binary(), "counts": pa.binary(), "ids": pa.binary(), "gids": pa.binary(), "words": pa.list_(pa.string())}
COUNTED = "shard bigint, block bigint, cells binary, sums binary, lang string, sizes array<int>, places binary, counts binary, ids binary, gids binary, words array<string>"
#: Cells whose counts are added up by one group.
BLOCK_CELLS = 1 << 19
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Pairs that a merging task gathers before it hands them to their shards, and rows that it works on at a time.
MERGE_PAIRS, MERGE_ROWS = 1 << 20, 1 << 16


class _Ids(dict):
    """Ids of words by first occurrence; 0 is the break between pieces."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _slices(text: bytes) -> Iterator[bytes]:
    """Folded ``text`` in slices of about SLICE_BYTES that end between words."""
    first = 0
    while first < len(text):
        last = first + SLICE_BYTES
        if last < len(text):
            at = max(text.rfind(b" ", first, last), text.rfind(_BREAK, first, last))
            if at < 0:  # one word longer than a slice
                ends = [x for x in (text.find(b" ", last), text.find(_BREAK, last)) if x >= 0]
                at = min(ends, default=len(text))
            last = max(at, first + 1)
        yield text[first:last]
        first = last


class _Shard:
    """Words of one language. The first ``head`` of them are the last words of the shard before, so that n-grams over the cut
    are counted here, where their last word is."""

    def __init__(self, context: list[bytes]) -> None:
        self.ids = _Ids({_BREAK: 0})
        self.parts = [self.numbers(context)]
        self.head, self.words, self.last = len(context), 0, context

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words))

    def add(self, words: list[bytes]) -> None:
        numbers = self.numbers(words)
        self.parts.append(numbers)
        self.words += int(np.count_nonzero(numbers))
        self.last = (self.last + words[1 - MOST_WORDS :])[1 - MOST_WORDS :]

    def context(self) -> list[bytes]:
        """Up to four words since the last break."""
        return self.last[len(self.last) - self.last[::-1].index(_BREAK) :] if _BREAK in self.last else self.last

    def rows(self, shard: int, lang: str) -> Iterator[pa.RecordBatch]:
        """A row for each word that stands behind the head, and one with the ids of all; nothing if there is none."""
        if not self.words:
            return
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids[self.head :], minlength=len(self.ids))
        words = list(self.ids)
        found = np.flatnonzero(counts[1:]) + 1
        for first in range(0, len(found), 1 << 16):
            some = found[first : first + (1 << 16)]
            size = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * size, pa.int64()), pa.array([lang] * size), pa.array(some, pa.int32()), pa.array([words[i] for i in some], pa.binary()).cast(pa.string()), pa.array(counts[some], pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                names=["shard", "lang", "idx", "word", "n", "head", "ids"],
            )
        # a context word that does not come again is not listed above, but stands in the ids
        rest = np.flatnonzero(counts[1:] == 0) + 1
        size = len(rest) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([shard] * size, pa.int64()), pa.array([lang] * size), pa.array([*rest, None], pa.int32()), pa.array([*(words[i] for i in rest), None], pa.binary()).cast(pa.string()), pa.array([*([0] * (size - 1)), self.words], pa.int64()), pa.array([*([None] * (size - 1)), self.head], pa.int32()), pa.array([*([None] * (size - 1)), ids.tobytes()], pa.binary())],
            names=["shard", "lang", "idx", "word", "n", "head", "ids"],
        )


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shards: dict[str, _Shard] = {}
    number = TaskContext.get().partitionId() << 32

    def flush(lang: str) -> Iterator[pa.RecordBatch]:
        nonlocal number
        yield from shards.pop(lang).rows(number, lang)
        number += 1

    for batch in within(batches):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            texts.setdefault("und" if lang is None else lang, []).append(text or b"")
        for lang, some in texts.items():
            for part in _slices(_BREAK.join(x.translate(_FOLD) for x in some) + _BREAK):
                words = part.replace(_BREAK, b" \xff ").split()
                for first in range(0, len(words), SHARD_WORDS):
                    shards.setdefault(lang, _Shard([])).add(words[first : first + SHARD_WORDS])
                    if shards[lang].words >= SHARD_WORDS:
                        context = shards[lang].context()
                        yield from flush(lang)
                        shards[lang] = _Shard(context)
            while sum(x.words for x in shards.values()) >= TASK_WORDS:  # not in the middle of a document
                yield from flush(max(shards, key=lambda x: shards[x].words))
    for lang in list(shards):
        yield from flush(lang)


def _room(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many words, at most MOST_WORDS, follow from each place on; ``linked`` tells whether a word goes with its next one."""
    room = (ids > 0).astype(np.int8)
    alive = ids > 0
    for step in range(1, min(MOST_WORDS, len(ids))):
        alive = alive[:-1] & linked[step - 1 : len(ids) - 1]
        room[: len(alive)] += alive
    return room


def ngram_counts(ids: np.ndarray, room: np.ndarray, head: int, sizes: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, counts) for each n of ``sizes``: one place of each different n-gram and how often it occurs.

    ``ids`` are word ids, 0 a break; an n-gram may begin where ``room`` is n or more, and counts if it ends behind the first
    ``head`` words (one that only stands there has count 0). Equal n-grams must have equal room. Ranks of suffixes are doubled until they tell ``sizes[-1]`` words apart.
    """
    if not len(ids):
        return
    width, known, ranks = sizes[-1], 1, ids.astype(np.int64)
    while known < width:
        key = ranks * (ranks.max() + 1)
        key[:-known] += ranks[known:]
        del ranks
        ranks = np.unique(key, return_inverse=True)[1] + 1
        del key
        known *= 2
    starts = np.flatnonzero(room >= sizes[0])
    array = starts[np.argsort(ranks[starts], kind="stable")]
    del ranks, starts
    if not len(array):
        return
    # words that a suffix shares with the one before
    lcp, same = np.zeros(len(array), np.int8), np.ones(len(array) - 1, bool)
    padded = np.concatenate([ids, np.zeros(width, ids.dtype)])
    for step in range(width):
        words = padded[array + step]
        same &= (words[1:] == words[:-1]) & (words[1:] > 0)
        lcp[1:] += same
    for n in sizes:
        interval = np.cumsum(lcp < n) - 1
        fits = room[array] >= n
        counts = np.bincount(interval[fits & (array + n > head)], minlength=interval[-1] + 1)
        full = np.unique(interval[fits])
        yield n, array[np.flatnonzero(lcp < n)[full]], counts[full]


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Scalar]]:
    for i in range(batch.num_rows):
        yield {name: column[i] for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _local(row: dict[str, pa.Scalar]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The ids of a shard's words, numbered anew from 1 for the frequent ones and 0 for others; and those words' global ids and texts."""
    ids, found = np.frombuffer(row["ids"].as_buffer(), np.int32), row["frequent"].values
    at = found.field("idx").to_numpy()
    local = np.zeros(max(int(ids.max(initial=0)), int(at.max(initial=0))) + 1, np.int32)
    local[at] = np.arange(1, len(at) + 1)
    return local[ids], found.field("gid").to_numpy(), found.field("word")


def _compact(ids: np.ndarray, linked: np.ndarray, inside: np.ndarray, head: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Without the words that are not ``inside``, a stretch of which becomes one break. Of two places that are linked both are inside, or none."""
    kept = inside.copy()
    kept[1:] |= inside[:-1]
    linked = np.append(linked, False) & inside
    return np.where(inside, ids, np.int32(0))[kept], linked[kept][:-1], int(np.count_nonzero(kept[:head]))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of frequent words of each shard."""
    for batch in batches:
        for row in _rows(batch):
            ids, gids, _ = _local(row)
            linked = (ids[:-1] > 0) & (ids[1:] > 0)
            inside = np.append(linked, False)
            inside[1:] |= linked
            ids, linked, head = _compact(ids, linked, inside, row["head"].as_py())
            for _, places, counts in ngram_counts(ids, _room(linked, ids), head, range(2, 3)):
                for first in range(0, len(places), 1 << 18):
                    some = places[first : first + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.array(gids[ids[some] - 1]), pa.array(gids[ids[some + 1] - 1]), pa.array([row["shard"].as_py()] * len(some), pa.int64()), pa.array(counts[first : first + len(some)], pa.int64())], names=["g1", "g2", "shard", "n"])


def _merge(least: int):
    """Of pairs in order (g1, g2, shard, n) those that occur ``least`` times: a row with their sum, and rows for their shards with
    all frequent pairs that a task found there. Of a pair that ever so many shards hold, a few rows are kept at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, list[np.ndarray]] = {}
        names, types = ["g1", "g2", "n", "shard", "pairs"], (pa.int64(),) * 4 + (pa.binary(),)
        held, pending = 0, []
        rest = np.empty((0, 4), np.int64)

        def hand_out() -> Iterator[pa.RecordBatch]:
            nonlocal held
            size = len(told)
            if size:
                pairs = [np.concatenate(x).tobytes() for x in told.values()]
                yield pa.RecordBatch.from_arrays([*(pa.nulls(size, t) for t in types[:3]), pa.array(list(told), pa.int64()), pa.array(pairs, pa.binary())], names=names)
            told.clear()
            held = 0

        def settle(rows: np.ndarray, last: bool) -> tuple[list[pa.RecordBatch], np.ndarray]:
            nonlocal held
            out = []
            if not len(rows):
                return out, rows
            starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            sums = np.add.reduceat(rows[:, 3], starts)
            open_ = len(starts) if last else len(starts) - 1  # the last pair may go on
            often = sums[:open_] >= least
            if often.any():
                keys = rows[starts[:open_][often]]
                out.append(pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(sums[:open_][often]), *(pa.nulls(len(keys), t) for t in types[3:])], names=names))
            alive = np.repeat(np.r_[often, False] if not last else often, np.diff(np.r_[starts, len(rows)]))
            rest = rows[:0]
            if not last:
                rest = rows[starts[-1] :]
                if len(rest) > MERGE_ROWS // 4 and sums[-1] >= least:  # one row without a shard stands for those that are handed out
                    alive[starts[-1] :] = True
                    rest = np.array([[*rest[0, :2], -1, sums[-1]]], np.int64)
            found = rows[alive & (rows[:, 2] >= 0)]
            found = found[np.argsort(found[:, 2], kind="stable")]
            for part in np.split(found, np.flatnonzero(np.diff(found[:, 2])) + 1) if len(found) else ():
                told.setdefault(int(part[0, 2]), []).append(np.ascontiguousarray(part[:, :2]))
                held += len(part)
            return out, rest

        for batch in batches:
            pending.append(np.stack([batch.column(c).to_numpy() for c in ("g1", "g2", "shard", "n")], axis=1))
            if sum(map(len, pending)) >= MERGE_ROWS or len(pending) >= MERGE_ROWS:
                out, rest = settle(np.concatenate([rest, *pending]), False)
                pending = []
                yield from out
                if held >= MERGE_PAIRS:
                    yield from hand_out()
        out, _ = settle(np.concatenate([rest, *pending]), True)
        yield from out
        yield from hand_out()

    return run


def _cell(ids: np.ndarray, gids: np.ndarray, places: np.ndarray, n: int, cells: int) -> np.ndarray:
    """The cell, one of ``cells`` (a power of two), of each n-gram at ``places``: the same in every shard."""
    h = np.full(len(places), n, np.uint64)
    for step in range(n):
        h = mix64(h * _MIX + gids[ids[places + step] - 1].astype(np.uint64))
    return (h & np.uint64(cells - 1)).astype(np.int64)


def _counted(cells: int):
    """Of each shard the phrases of three words and more all of whose pairs are frequent: a row with their places, counts and
    words, and a row for each block of BLOCK_CELLS cells with the counts of the cells that they fall into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                ids, gids, words = _local(row)
                order, wide = np.argsort(gids), len(gids) + 1
                pairs = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in row["pairs"].values]).reshape(-1, 2)
                first, second = (order[np.searchsorted(gids, pairs[:, i], sorter=order)] + 1 for i in (0, 1))
                linked = np.isin(ids[:-1].astype(np.int64) * wide + ids[1:], first * wide + second)
                inside = np.zeros(len(ids), bool)
                for step in range(3):  # three words that are linked
                    inside[step : len(ids) - 2 + step] |= linked[:-1] & linked[1:]
                ids, linked, head = _compact(ids, linked, inside, row["head"].as_py())
                used = np.unique(ids[ids > 0])
                renumbered = np.zeros(len(gids) + 1, np.int32)
                renumbered[used] = np.arange(1, len(used) + 1)
                ids, gids, words = renumbered[ids], gids[used - 1], words.take(pa.array(used - 1))
                held = []
                for n, places, counts in ngram_counts(ids, _room(linked, ids), head, range(3, MOST_WORDS + 1)):
                    held.append((n, places[counts > 0].astype(np.int32), counts[counts > 0]))
                if not any(len(places) for _, places, _ in held):
                    continue
                at, inverse = np.unique(np.concatenate([_cell(ids, gids, places, n, cells) for n, places, _ in held]), return_inverse=True)
                sums = np.bincount(inverse, np.concatenate([counts for *_, counts in held])).astype(np.int32)
                starts = np.flatnonzero(np.diff(at // BLOCK_CELLS, prepend=-1))
                shard, size = row["shard"].as_py(), len(starts)
                parts = [[x.tobytes() for x in np.split(y.astype(np.int32), starts[1:])] for y in (at % BLOCK_CELLS, sums)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * size, pa.int64()), pa.array(at[starts] // BLOCK_CELLS, pa.int64()), *(pa.array(x, pa.binary()) for x in parts), *(pa.nulls(size, t) for t in _BODY.values())], names=["shard", "block", "cells", "sums", *_BODY])
                body = [row["lang"].as_py(), [len(places) for _, places, _ in held], np.concatenate([places for _, places, _ in held]).tobytes(), np.concatenate([counts for *_, counts in held]).astype(np.int32).tobytes(), ids.tobytes(), gids.tobytes(), words.to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), *(pa.array([x], t) for x, t in zip(body, _BODY.values(), strict=True))], names=["shard", "block", "cells", "sums", *_BODY])

    return run


def _alive(least: int):
    """Of one block's rows: for each shard the cells that are filled ``least`` times over all shards, if it has any."""

    def run(table: pa.Table) -> pa.Table:
        cells, sums = ([np.frombuffer(x, np.int32) for x in table.column(c).to_pylist()] for c in ("cells", "sums"))
        often = np.bincount(np.concatenate(cells), np.concatenate(sums), BLOCK_CELLS) >= least
        base = table.column("block")[0].as_py() * BLOCK_CELLS
        found = [(shard, base + own[often[own]]) for shard, own in zip(table.column("shard").to_pylist(), cells, strict=True) if often[own].any()]
        return pa.table({"shard": pa.array([s for s, _ in found], pa.int64()), "cells": pa.array([c.astype(np.int64).tobytes() for _, c in found], pa.binary())})

    return run


def _phrases(cells: int):
    """Counts of the phrases whose cells are filled often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                every, counted, ids, gids = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("places", np.int32), ("counts", np.int32), ("ids", np.int32), ("gids", np.int64)))
                alive = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in row["alive"].values])
                names = pa.concat_arrays([pa.array([""]), row["words"].values])
                first = 0
                for n, size in enumerate(row["sizes"].as_py(), 3):
                    places, counts = every[first : first + size], counted[first : first + size]
                    first += size
                    kept = np.isin(_cell(ids, gids, places, n, cells), alive)
                    places, counts = places[kept], counts[kept]
                    phrase = pc.binary_join_element_wise(*(names.take(pa.array(ids[places + step])) for step in range(n)), " ")
                    left = len(places)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"].as_py()] * left, pa.string()), phrase.cast(pa.string()), pa.array([n] * left, pa.int32()), pa.array(counts, pa.int64())], names=["lang", "phrase", "size", "n"])

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, n) of every phrase of 1 to 5 words that occurs ``least`` times or more, and (lang, total) words, both stored.

    Texts (null: empty) are lower-cased A to Z, split at ``[.,;:!?\\n\\v\\f\\r]`` into pieces and those at spaces and tabs into
    words; a null ``lang`` is ``und``. Overlapping occurrences count, also of repeated rows; none goes over the end of a piece.
    Other columns are ignored. An empty table has no counts. Long texts may fill several shards and are cut anywhere.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("lang", F.col("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    tasks = max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    shards = durable(texts.coalesce(tasks).mapInArrow(_tokenize, SHARDS), "shards", "zstd")
    totals = settled(shards.where("ids is not null").groupBy("lang").agg(F.sum("n").alias("total")))
    heard = shards.where("ids is null")
    frequent = settled(heard.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).withColumn("gid", F.monotonically_increasing_id()))

    known = heard.select("shard", "lang", "idx", "word").join(broadcast_if(frequent.select("lang", "word", "gid"), 64), ["lang", "word"])
    lists = durable(known.groupBy("shard").agg(F.collect_list(F.struct("idx", "gid", "word")).alias("frequent")), "frequent", "zstd")
    bodies = shards.where("ids is not null").select("shard", "lang", "head", "ids").join(lists, "shard")

    # frequent pairs go back to their shards in lists, so a pair is no row for each of its shards
    pairs = bodies.mapInArrow(_pairs, PAIRS).repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    merged = durable(pairs.mapInArrow(_merge(least), MERGED), "merged")
    linked = merged.where("shard is not null").groupBy("shard").agg(F.collect_list("pairs").alias("pairs"))
    # phrases fall into cells, more of them as words grow; only those of cells that are filled ``least`` times become rows
    words = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    cells = max(BLOCK_CELLS, 1 << (words // 2).bit_length())
    counted = durable(bodies.join(linked, "shard").mapInArrow(_counted(cells), COUNTED), "counted", "zstd")
    alive = counted.where("block is not null").select("shard", "block", "cells", "sums").groupBy("block").applyInArrow(_alive(least), "shard bigint, cells binary")
    alive = alive.groupBy("shard").agg(F.collect_list("cells").alias("alive"))
    longer = counted.where("block is null").select("shard", *_BODY).join(alive, "shard").mapInArrow(_phrases(cells), PHRASES)
    longer = longer.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    first, second = (frequent.select("lang", F.col("word").alias(w), F.col("gid").alias(g)) for w, g in (("w1", "g1"), ("w2", "g2")))
    named = merged.where("shard is null").select("g1", "g2", "n").join(broadcast_if(first, 64), "g1").join(broadcast_if(second.drop("lang"), 64), "g2")
    one = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    two = named.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.lit(2).alias("size"), "n")
    counts = settled(one.unionByName(two).unionByName(longer))
    forget(shards, lists, merged, frequent, counted)
    return counts, totals


def collocations(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase of two words or more that no longer phrase as frequent contains.

    A cut after k words gives l and r, the counts of the two parts, and floor(1000 * a * n / (l * r)); the least counts, ties to
    the smallest k. Products are decimals of 38 digits. A longer phrase that contains this one and is as frequent contains one of
    one word more that is as frequent, so only those are looked at.
    """
    words = F.split("phrase", " ")
    joined = lambda of, size: F.array_join(F.slice(words, of, size), " ")
    longer = counts.where("size > 1")
    cuts = longer.select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda name, count: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(count))
    cuts = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    cuts = cuts.join(broadcast_if(totals.withColumnRenamed("total", "n"), 64), "lang").withColumns({f"__{c}": x for c, x in exact.items()})
    score = F.expr("(__a * __n * cast(1000 as decimal(4,0))) div (__l * __r)")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n")).alias("b")).select("lang", "phrase", "b.*")
    inner = counts.where("size > 2").select("lang", "n", F.explode(F.array(joined(F.lit(1), F.col("size") - 1), joined(F.lit(2), F.col("size") - 1))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = best.join(inner, ["lang", "phrase"], "left").where("most is null or most < a")
    return kept.select("lang", "phrase", "a", "l", "r", "n", "score")


def report(found: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their ``rank``: score and a descending, then phrase in byte order."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
