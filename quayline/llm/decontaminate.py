"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import WordKeys, lane, rolling, small_batches, within

#: Shortest tile in tokens, and the part of an item's tokens that tiles must cover.
SHORTEST, COVERAGE = 5, 0.5
#: Characters of benchmark text that one broadcast holds; a larger benchmark is matched in blocks of this size.
BLOCK_CHARS = 16 << 20
_WORD = re.compile(r"\w+")
_BITS = 22


def token_keys(text: str, keys: WordKeys) -> np.ndarray:
    """Keys of the lower-cased runs of letters, digits and underscores."""
    return keys.of([w.encode("utf-8", "replace") for w in _WORD.findall(text.lower())])


def tile(item: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """Tiles (item start, text start, length): longest matches first, no token of either side in two tiles.

    Running Karp-Rabin: windows of the search length are hashed on both sides, equal ones are extended over unmarked
    equal tokens, tiles are marked from the longest down, and the search length falls to ``shortest``. A match that
    a longer tile has cut is kept for what is left of it. Ties go to the smaller item start, then text start.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles: list[tuple[int, int, int]] = []
    width = max(shortest, min(len(item), len(text), 32))
    while min(len(item), len(text)) >= width:
        own = rolling(item, width)
        clear = np.convolve(free_item, np.ones(width, int), "valid") == width
        starts: dict[int, list[int]] = {}
        for i in np.flatnonzero(clear):
            starts.setdefault(int(own[i]), []).append(int(i))
        seen = rolling(text, width)
        clear = np.convolve(free_text, np.ones(width, int), "valid") == width
        hits = np.flatnonzero(np.isin(seen, np.fromiter(starts, np.uint64, len(starts))) & clear)
        matches = []
        for t in map(int, hits):
            for i in starts[int(seen[t])]:
                if i and t and item[i - 1] == text[t - 1] and free_item[i - 1] and free_text[t - 1]:
                    continue  # it starts earlier
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and free_item[i + n] and free_text[t + n]:
                    n += 1
                if n >= width:
                    matches.append((-n, i, t))
        heapq.heapify(matches)
        while matches:
            n, i, t = heapq.heappop(matches)
            ok = free_item[i : i - n] & free_text[t : t - n]
            if ok.all():
                free_item[i : i - n] = free_text[t : t - n] = False
                tiles.append((i, t, -n))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if b - a >= width:
                    heapq.heappush(matches, (a - b, i + a, t + a))
        if width == shortest:
            break
        width = max(shortest, width // 2)
    return tiles


class Items:
    """Benchmark items with their seeds: every run of SHORTEST tokens, by hash, with the item and place it starts at.

    A shorter item is one seed, its whole sequence; items without tokens match nothing.
    """

    def __init__(self, rows: list[tuple], shortest: int = SHORTEST):
        keys = WordKeys()
        self.shortest = shortest
        known = [(i, token_keys(t or "", keys)) for i, t in rows]
        self.items = [(i, k) for i, k in known if len(k) >= shortest]
        self.short: dict[int, dict[bytes, list]] = {}
        for name, k in known:
            if 0 < len(k) < shortest:
                self.short.setdefault(len(k), {}).setdefault(k.tobytes(), []).append(name)
        seeds = [rolling(k, shortest) for _, k in self.items]
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds = flat[order]
        self.owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])[order] if seeds else np.empty(0, int)
        self.place = np.concatenate([np.arange(len(s)) for s in seeds])[order] if seeds else np.empty(0, int)
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def matches(self, text: np.ndarray, coverage: float) -> list[tuple[int, float, int]]:
        """(item, coverage, tiles) of the items that tiles of ``text`` cover to at least ``coverage``, a short item as a whole."""
        grams = rolling(text, self.shortest)
        grams = np.unique(grams[self.maybe[(grams >> np.uint64(64 - _BITS)).astype(np.int64)]])
        lo, hi = np.searchsorted(self.seeds, grams, "left"), np.searchsorted(self.seeds, grams, "right")
        at = np.concatenate([np.arange(a, b) for a, b in zip(lo[hi > lo], hi[hi > lo], strict=True)] or [np.empty(0, int)]).astype(int)
        found = []
        for owner in np.unique(self.owner[at]):
            name, item = self.items[owner]
            covered = np.zeros(len(item), bool)
            for p in self.place[at[self.owner[at] == owner]]:
                covered[p : p + self.shortest] = True
            if covered.sum() < coverage * len(item):
                continue  # tiles lie within seeds, so they cannot cover more
            tiles = tile(item, text, self.shortest)
            part = sum(n for _, _, n in tiles) / len(item)
            if part >= coverage:
                found.append((name, part, len(tiles)))
        for size, whole in self.short.items():
            runs = np.lib.stride_tricks.sliding_window_view(text, size) if len(text) >= size else text[:0].reshape(0, size)
            first = np.fromiter((np.frombuffer(k, np.uint64)[0] for k in whole), np.uint64, len(whole))
            for run in {r.tobytes() for r in runs[np.isin(runs[:, 0], first)]}:
                found += [(name, 1.0, 1) for name in whole.get(run, ())]
        return found


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``block_chars`` characters, one block on the driver at a time."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-chars // block_chars))
    for b in range(blocks):
        yield [tuple(r) for r in items.where(lane("item_id", "text", of=blocks) == b).collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, coverage and n_tiles of every document row and benchmark item whose tokens are covered.

    Coverage: tokens of the item in tiles over its tokens, so a reordered passage still counts. Whole texts are
    read; no row is shuffled. Null or empty texts match nothing; an item of fewer than ``shortest`` tokens is matched as one tile
    of its whole sequence; repeated rows give repeated results; an empty table on either side gives none. A benchmark over
    ``block_chars`` is matched in several passes over the documents.
    """
    small_batches(docs.sparkSession)
    doc_kind, item_kind = (f.schema[n].dataType.simpleString() for f, n in ((docs, "doc_id"), (benchmark, "item_id")))
    item_type = pa.string() if item_kind == "string" else pa.int64()
    found = None
    for rows in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, keys = Items(shared.value, shortest), WordKeys()
            for batch in within(batches):
                at, hits = [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    own = items.matches(token_keys(text or "", keys), coverage)
                    at += [i] * len(own)
                    hits += own
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array([h[0] for h in hits], item_type), pa.array([h[1] for h in hits], pa.float64()), pa.array([h[2] for h in hits], pa.int32())],
                    names=["doc_id", "item_id", "coverage", "n_tiles"],
                )

        part = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_kind}, item_id {'string' if item_kind == 'string' else 'bigint'}, coverage double, n_tiles int")
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item; cases as in ``find_contamination``."""
    small_batches(docs.sparkSession)
    names = docs.columns
    for rows in _blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items, keys = Items(shared.value, shortest), WordKeys()
            for batch in within(batches):
                texts = batch.columns[names.index("text")].to_pylist()
                yield batch.filter(pa.array([not items.matches(token_keys(t or "", keys), coverage) for t in texts], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
