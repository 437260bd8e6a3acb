"""SentencePiece BPE encoding with seeded merge-dropout, and decoding."""

from __future__ import annotations

import gc
import heapq
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import mix64, small_batches, within

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: How many keys of occurrences tests try on one unit; it bounds nothing.
STREAMS = 8
SPACE = "▁"
_MASK = (1 << 64) - 1
_MOST_MODEL_BYTES = 64 << 20


def load_model(path: str = MODEL) -> dict:
    """The normal pieces with their ranks, the byte pieces and each id's bytes; the file's size is checked."""
    import os

    import sentencepiece

    if os.path.getsize(path) > _MOST_MODEL_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, out, byte_ids = {}, [], [0] * 256
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            out.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            out.append(b"")
        else:
            pieces[piece] = (-sp.get_score(i), i)
            out.append(piece.replace(SPACE, " ").encode())
    if any(SPACE in piece.lstrip(SPACE) or ("\n" in piece and len(piece) > 1) for piece in pieces):
        raise ValueError("a piece joins a word to a later space or line break, so words cannot be encoded apart")
    return {"pieces": pieces, "bytes": out, "byte_ids": byte_ids}


_C1, _C2, _C3 = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_NONE = np.iinfo(np.int32).max
#: Pairs of characters below this are looked up in a table of all of them.
_LATIN = 512


class Pool:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.data, self.n = np.empty(1024, dtype), 0

    def add(self, more: np.ndarray) -> None:
        end = self.n + len(more)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(max(end, 2 * self.n) - self.n, self.data.dtype)])
        self.data[self.n : end] = more
        self.n = end


class Encoder:
    """Encodes whole texts. No piece joins a word to the space after it, so units (spaces and a word) are encoded apart.

    A unit is cut by agenda processing: of the candidate merges the best-ranked, leftmost one comes first; it is skipped
    for good with the probability of dropout, and a merge makes new candidates with its neighbours. Every occurrence of a
    unit has its own key, from which the gaps between its skipped steps are drawn. How a unit is cut depends only on the
    numbers of the steps that were skipped, so outcomes with few skips are remembered by just these (``nodes``); an
    occurrence with more is cut by itself. Units of up to ``short`` characters are worked through together, one agenda
    step of each at a time, in arrays; longer ones one by one with a heap. Both give the same pieces.
    """

    #: Units and nodes remembered by one task, the most skips of a node, the longest unit worked through in arrays.
    remembered, nodes, deepest, short, rows = 150_000, 400_000, 3, 32, 4096
    #: Characters whose units are looked up together (one text at least).
    together_chars = 1 << 21
    _UNIT = re.compile(r" *[^ \n]+| +|\n")

    def __init__(self, model: dict, dropout: float, seed: int):
        self.pieces, self.bytes, self.byte_ids = model["pieces"], model["bytes"], model["byte_ids"]
        self.dropout, self.seed = dropout, seed
        self.per_log = 0.0 if dropout >= 1 else 1 / math.log1p(-dropout) if dropout > 0 else None
        self._forget()
        self._tables()

    def _forget(self) -> None:
        """No unit is known. A node is a unit with some steps skipped: its ids, its number of steps, its children by the next skip."""
        self.roots: dict[str, int] = {}
        self.ids, self.child = Pool(np.int32), Pool(np.int32)
        self.start, self.size, self.steps, self.child_at = Pool(np.int64), Pool(np.int32), Pool(np.int32), Pool(np.int64)

    def _tables(self) -> None:
        """Symbols are piece ids, or a number beyond them for a character outside the vocabulary; pairs are sorted by both symbols."""
        ranks = sorted({r for r, _ in self.pieces.values()})
        place = {r: i for i, r in enumerate(ranks)}
        self.symbol = np.full(0x110000, -1, np.int32)
        for piece, (_, i) in self.pieces.items():
            if len(piece) == 1:
                self.symbol[ord(" " if piece == SPACE else piece)] = i
        keys, rank, merged = [], [], []
        for piece, (r, i) in self.pieces.items():
            for cut in range(1, len(piece)):
                left, right = self.pieces.get(piece[:cut]), self.pieces.get(piece[cut:])
                if left and right:
                    keys.append(left[1] << 32 | right[1])
                    rank.append(place[r])
                    merged.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.pair_rank, self.pair_piece = (np.append(np.array(x, np.int32)[order], np.int32(_NONE)) for x in (rank, merged))

        left, right = np.divmod(np.arange(_LATIN * _LATIN), _LATIN)
        self.latin_rank, self.latin_piece = self._pairs(self.symbol[left], self.symbol[right])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or _NONE) and piece of the pairs of symbols; -1 and unknown characters pair with nothing."""
        keys = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.pair_keys, keys)
        at = np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == keys), at, len(self.pair_keys) - 1)
        return self.pair_rank[at], self.pair_piece[at]

    def _gaps(self, keys: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """How many steps are taken between an occurrence's skip n - 1 and skip n: geometric, by its key."""
        z = mix64(keys + np.asarray(n, np.uint64) * np.array([_C3], np.uint64))
        return np.minimum(np.log(((z >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) * self.per_log, 1 << 30).astype(np.int64)

    def _plans(self, keys: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The steps to skip of occurrences of such lengths, in a row each, the last one beyond all steps."""
        if self.per_log is None:
            return np.full((len(keys), 1), _NONE, np.int64)
        columns = [self._gaps(keys, 0)]
        # each of at most length - 1 merges makes at most two new candidates
        while (columns[-1] < 3 * lengths).any():
            columns.append(columns[-1] + 1 + self._gaps(keys, len(columns)))
        return np.stack(columns, axis=1)

    def _skips(self, key: int) -> Iterator[int]:
        at = -1
        for n in itertools.count(0, 64):
            for gap in self._gaps(np.full(64, key, np.uint64), np.arange(n, n + 64, dtype=np.uint64)).tolist():
                at += gap + 1
                yield at

    def together(self, jobs: list[tuple[str, int]]) -> list[bytes]:
        """The ids, as bytes, of short units under the keys of their occurrences."""
        units = [u for u, _ in jobs]
        made = self._add(units, self._plans(np.array([k for _, k in jobs], np.uint64), np.array([len(u) for u in units])))
        return [self._of(n).tobytes() for n in made.tolist()]

    def _of(self, node: int) -> np.ndarray:
        return self.ids.data[self.start.data[node] : self.start.data[node] + self.size.data[node]]

    def _add(self, units: list[str], plans: np.ndarray) -> np.ndarray:
        """New nodes for short units with the planned steps skipped."""
        made = np.empty(len(units), np.int64)
        order = np.argsort(np.fromiter(map(len, units), np.int64, len(units)), kind="stable")
        for one in range(0, len(order), self.rows):
            part = order[one : one + self.rows]
            made[part] = self._nodes(*self._chunk([units[j] for j in part.tolist()], plans[part]))
        return made

    def _nodes(self, flat: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        first = self.start.n
        self.start.add(self.ids.n + np.cumsum(sizes) - sizes)
        self.child_at.add(self.child.n + np.cumsum(steps) - steps)
        self.ids.add(flat)
        self.size.add(sizes)
        self.steps.add(steps)
        self.child.add(np.full(int(steps.sum()), -1, np.int32))
        return np.arange(first, self.start.n)

    def _chunk(self, units: list[str], plans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all units in a row, how many each has, and how many steps each took."""
        rows = len(units)
        lengths = np.array([len(u) for u in units])
        width = int(lengths.max()) + 1
        codes = np.frombuffer("".join([u.ljust(width, "\0") for u in units]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, width)
        inside = np.arange(width) < lengths[:, None]
        known = self.symbol[codes]
        # unknown characters are numbered down from -2; -1 is no symbol: the end of a row or the right part of a merge
        final = np.where(inside, np.where(known < 0, -2 - codes.astype(np.int32), known), -1)
        rank = np.full((rows, width), _NONE, np.int32)
        piece = np.zeros((rows, width), np.int32)
        if int(codes.max()) < _LATIN:
            first = codes[:, :-1].astype(np.int64) * _LATIN + codes[:, 1:]
            rank[:, :-1], piece[:, :-1] = self.latin_rank[first], self.latin_piece[first]
        else:
            rank[:, :-1], piece[:, :-1] = self._pairs(final[:, :-1], final[:, 1:])
        after = np.tile(np.arange(1, width + 1), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        steps, skipped = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        live = np.arange(rows)
        for step in itertools.count():
            at = rank[live].argmin(axis=1)
            going = rank[live, at] != _NONE
            live, at = live[going], at[going]
            if not len(live):
                break
            steps[live] += 1
            skip = plans[live, skipped[live]] == step
            if skip.any():
                rank[live[skip], at[skip]] = _NONE
                skipped[live[skip]] += 1
                row, i = live[~skip], at[~skip]
            else:
                row, i = live, at
            new = piece[row, i]
            j = after[row, i]
            k = after[row, j]
            final[row, i], final[row, j] = new, -1
            rank[row, j] = _NONE
            after[row, i] = k
            # a row's last column is never a symbol, so it can stand for what lies beyond
            k = np.minimum(k, width - 1)
            before[row, k] = i
            rank[row, i], piece[row, i] = self._pairs(new, final[row, k])
            h = before[row, i]
            row, h, new = row[h >= 0], h[h >= 0], new[h >= 0]
            rank[row, h], piece[row, h] = self._pairs(final[row, h], new)
        raw = np.flatnonzero((final < -1).any(axis=1))
        sizes = (final != -1).sum(axis=1)
        flat = final[final != -1]
        if len(raw):
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for i in raw.tolist():
                parts[i] = self._with_bytes(parts[i].tolist())
                sizes[i] = len(parts[i])
            flat = np.concatenate(parts)
        return flat, sizes, steps

    def _with_bytes(self, row: list[int]) -> np.ndarray:
        out: list[int] = []
        for sym in row:
            out += [sym] if sym >= 0 else [self.byte_ids[b] for b in chr(-2 - sym).encode("utf-8", "replace")]
        return np.array(out, np.int32)

    def unit(self, unit: str, key: int) -> tuple[int, ...]:
        """The pieces of one unit of any length under the key of its occurrence, by a heap."""
        pieces = self.pieces
        # a literal mark is an empty part: never merged, written as bytes
        parts: list[str | None] = [SPACE if c == " " else "" if c == SPACE else c for c in unit]
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        skips = self._skips(key) if self.per_log is not None else iter(())
        step, skip = -1, next(skips, None)
        agenda = []
        for i in range(n - 1):
            if parts[i] and parts[i + 1] and (hit := pieces.get(parts[i] + parts[i + 1])):
                agenda.append((hit[0], i, i + 1, len(parts[i]) + len(parts[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            left, right = parts[i], parts[j]
            if left is None or right is None or after[i] != j or len(left) + len(right) != size:
                continue
            step += 1
            if step == skip:
                skip = next(skips)
                continue
            parts[i] = left = left + right
            parts[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if parts[k] and (hit := pieces.get(left + parts[k])):
                    heapq.heappush(agenda, (hit[0], i, k, len(left) + len(parts[k])))
            h = before[i]
            if h >= 0 and parts[h] and (hit := pieces.get(parts[h] + left)):
                heapq.heappush(agenda, (hit[0], h, i, len(parts[h]) + len(left)))
        out: list[int] = []
        for part in parts:
            if part is None:
                continue
            if part and (hit := pieces.get(part)):
                out.append(hit[1])
            else:
                out += [self.byte_ids[b] for b in (part or SPACE).encode("utf-8", "replace")]
        return tuple(out)

    def encode_all(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Token ids of each text; its key and the place of a unit make the key of the unit's occurrence."""
        out, part, chars = [], [], 0
        for text, key in zip(texts, keys, strict=True):
            if part and chars + len(text) > self.together_chars:
                out += self._encode(part)
                part, chars = [], 0
            part.append((text, key))
            chars += len(text)
        return out + self._encode(part)

    def keys(self, n: int, key: int) -> np.ndarray:
        """The keys of the occurrences at the first places of a text."""
        return mix64(np.arange(n, dtype=np.uint64) + np.uint64(key * _C1 + self.seed * _C2 & _MASK))

    def _encode(self, texts: list[tuple[str, int]]) -> list[np.ndarray]:
        if len(self.roots) >= self.remembered or self.start.n >= self.nodes:
            self._forget()
        docs = [self._UNIT.findall(" " + text) if text else [] for text, _ in texts]
        units = list(itertools.chain.from_iterable(docs))
        if not units:
            return [np.empty(0, np.int32) for _ in docs]
        keys = np.concatenate([self.keys(len(d), key) for d, (_, key) in zip(docs, texts, strict=True)])
        missing = [u for u in set(units).difference(self.roots) if len(u) <= self.short]
        self.roots.update(zip(missing, self._add(missing, np.full((len(missing), 1), _NONE, np.int64)).tolist(), strict=True))
        node = np.fromiter((self.roots.get(u, -1) for u in units), np.int64, len(units))
        alone = self._walk(units, keys, node) if self.per_log is not None else []
        pools = (self.ids, self.child, self.start, self.size, self.steps, self.child_at)
        ends = [p.n for p in pools]
        if len(alone):
            some = [units[i] for i in alone.tolist()]
            node[alone] = self._add(some, self._plans(keys[alone], np.fromiter(map(len, some), np.int64, len(some))))
        long = np.flatnonzero(node < 0).tolist()
        if long:
            cuts = self._long([units[i] for i in long], keys[long].tolist())
            sizes = np.array([len(c) for c in cuts])
            node[long] = self._nodes(np.concatenate(cuts), sizes, np.zeros(len(cuts), np.int64))
        out, at = [], 0
        for d in docs:
            mine = node[at : at + len(d)]
            size = self.size.data[mine].astype(np.int64)
            behind = np.cumsum(size)
            out.append(self.ids.data[np.repeat(self.start.data[mine] - behind + size, size) + np.arange(behind[-1] if len(d) else 0)])
            at += len(d)
        # what was cut for one occurrence is not remembered
        for p, n in zip(pools, ends, strict=True):
            p.n = n
        return out

    def _long(self, units: list[str], keys: list[int]) -> list[np.ndarray]:
        if self.per_log is not None:
            return [np.array(self.unit(u, k), np.int32) for u, k in zip(units, keys, strict=True)]
        cuts = {u: np.array(self.unit(u, 0), np.int32) for u in set(units)}
        return [cuts[u] for u in units]

    def _walk(self, units: list[str], keys: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Move each occurrence from its unit's root to the node of its skips; the occurrences with too many are returned."""
        at = np.flatnonzero(node >= 0)
        skip = self._gaps(keys[at], 0)
        path: list[np.ndarray] = []
        while True:
            more = skip < self.steps.data[node[at]]
            at, skip, path = at[more], skip[more], [p[more] for p in path]
            if not len(at) or len(path) == self.deepest:
                return at
            path.append(skip)
            slot = self.child_at.data[node[at]] + skip
            unknown = np.flatnonzero(self.child.data[slot] < 0)
            if len(unknown):
                slots, first = np.unique(slot[unknown], return_index=True)
                first = unknown[first]
                plans = np.stack([*(p[first] for p in path), np.full(len(first), _NONE, np.int64)], axis=1)
                made = self._add([units[i] for i in at[first].tolist()], plans)
                self.child.data[slots] = made
            node[at] = self.child.data[slot]
            skip = skip + 1 + self._gaps(keys[at], len(path))

    def decode(self, ids: np.ndarray) -> str:
        """The text: pieces with marks as spaces and raw bytes, without the space that encoding put first."""
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def encode_documents(docs: DataFrame, dropout: float = 0.1, seed: int = 7, model_path: str = MODEL) -> DataFrame:
    """``docs`` with token_ids, n_tokens and lossless (the ids decode to the text), from the whole ``text``.

    Each candidate merge of each occurrence of a word is skipped with probability ``dropout``, by a hash of seed, document
    (id and text), place and step, so a run can be repeated exactly and no two occurrences share a draw. Null texts have
    null ids and count 0; empty texts have no ids; both are lossless. A literal U+2581 is written as bytes, so it comes
    back as itself. Null and repeated ids and repeated rows are rows like any other; earlier columns of the three
    names are replaced; an empty table gives none. The model is read on the driver, size-checked and broadcast.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("token_ids", "n_tokens", "lossless")
    names = docs.columns
    shared = spark.sparkContext.broadcast(load_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, dropout, seed)
        gc.freeze()  # the tables live as long as the task; collections need not walk them
        for batch in within(batches):
            columns = dict(zip(names, batch.columns, strict=True))
            texts = columns["text"].to_pylist()
            keys = [xxhash.xxh64_intdigest(t or "", xxhash.xxh64_intdigest(str(i), seed & _MASK)) for i, t in zip(columns["doc_id"].to_pylist(), texts, strict=True)]
            flat, ends, lossless = [], [0], []
            for text, ids in zip(texts, encoder.encode_all([t or "" for t in texts], keys), strict=True):
                lossless.append(encoder.decode(ids) == (text or ""))
                flat.append(ids)
                ends.append(ends[-1] + len(ids))
            offsets = pa.array([None if t is None else e for t, e in zip([*texts, ""], ends, strict=True)], pa.int32())
            columns["token_ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
            columns["n_tokens"] = pa.array(np.diff(ends), pa.int64())
            columns["lossless"] = pa.array(lossless, pa.bool_())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = docs.select("*", F.lit(None).cast("array<int>").alias("token_ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("lossless")).schema
    return docs.mapInArrow(run, schema)
