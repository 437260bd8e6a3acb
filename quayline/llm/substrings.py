"""Substring dedup: token k-mers are edges, repeated nonbranching paths are compacted and verified at their coordinates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayline.llm.common import broadcast_if, cut, forget, having, held, mix64, release, rolling, settled, signed, small_batches, within

#: The k of the graph: an edge is a window of 50 consecutive words, its two nodes are the 49-word ends.
WINDOW = 50
#: Anchors are KMER-word grams with the least hash of some SPREAD consecutive ones. With 2 * SPREAD + KMER <= WINDOW + 1
#: the two anchors about the middle of a window depend on the words of the window alone.
KMER, SPREAD = 10, 20
#: Texts are worked through together until they have so many bytes, and words go on in parts of about so many: arrays of single
#: short texts cost more to set up than to fill.
GROUP_BYTES, PART_BYTES = 1 << 19, 4 << 20
#: Longer words are hashed one by one: modulo 2^64, sums of powers do not tell all long words of a few letters apart.
LONG_WORD = 64
#: Stands for "no edge before" and "no edge after" in a walk.
NONE = 0

_Q = 0x9E3779B97F4A7C15
_STEPS = [np.uint64(_Q), np.uint64(pow(_Q, -1, 1 << 64))]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each run of ``width`` values, by doubling."""
    span, out = 1, values
    while 2 * span <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def anchors(keys: np.ndarray, ends: np.ndarray, kmer: int = KMER, spread: int = SPREAD) -> np.ndarray:
    """Places of the anchor grams: those least in some run of ``spread`` of one text; texts end at ``ends``."""
    grams = rolling(keys, kmer)
    if len(grams) < spread:
        return np.empty(0, np.int64)
    least = _slide(grams, spread, np.minimum)
    for end in ends[:-1].tolist():
        least[max(0, end - (spread + kmer - 2)) : end] = 0  # these runs go on in the next text
    edge = np.zeros(spread - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), spread, np.maximum) == grams)


def _power(which: int, n: int) -> np.ndarray:
    """The powers 0 to ``n`` of the hash base or of its inverse, modulo 2^64."""
    if len(_powers[which]) <= n:
        steps = np.full(2 * n + 1, _STEPS[which], np.uint64)
        steps[0] = 1
        _powers[which] = np.multiply.accumulate(steps)
    return _powers[which]


def range_hashes(keys: np.ndarray, *ranges: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """For each pair of arrays (starts, ends): one 64-bit hash of the words of every range."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(keys * _power(0, len(keys))[: len(keys)], dtype=np.uint64)])
    back = _power(1, len(keys))
    return [mix64((sums[end] - sums[start]) * back[start]) for start, end in ranges]


_letters = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_Q))
_is_space = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def word_keys(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each word of ``text``, which depends on the word alone, and the byte at which it starts."""
    letters = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~_is_space[letters], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    keys = np.empty(len(starts), np.uint64)
    for first in range(0, len(letters), GROUP_BYTES):
        lo, hi = np.searchsorted(starts, [first, first + GROUP_BYTES])
        part = _letters[letters[first : first + GROUP_BYTES + LONG_WORD]]
        keys[lo:hi] = range_hashes(part, (starts[lo:hi] - first, np.minimum(ends[lo:hi] - first, len(part))))[0]
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        keys[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]])
    return keys, starts


def _identity(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _texts(column: pa.Array) -> list[bytes]:
    """UTF-8 as it came; null as empty. ``split`` cuts bytes at ASCII white space."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def super_edges(keys: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(home, name, lo, hi) of the super-edges of the texts that end at ``ends`` (None: of one text), in order: runs of consecutive edges with one home.

    The home of the edge that starts at word s is the segment between the anchors on either side of gram s + SPREAD - 1;
    equal edges have equal homes at equal offsets. words[lo:hi] holds the edges of a super-edge and no others, and
    ``name`` hashes these words and the place of the home in them. Every edge of the text lies in one super-edge.
    """
    ends = np.array([len(keys)]) if ends is None else ends
    at = anchors(keys, ends)
    if len(at) < 2:
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    a, b, text = at[:-1], at[1:], np.searchsorted(ends, at, side="right")
    first, last = np.concatenate([[0], ends])[text[:-1]], ends[text[:-1]]
    lo, hi = np.maximum(a - (SPREAD - 1), first), np.minimum(b + (WINDOW - SPREAD), last)
    real = (hi - lo >= WINDOW) & (text[:-1] == text[1:])
    a, b, lo, hi = a[real], b[real], lo[real], hi[real]
    home, whole = range_hashes(keys, (a, b + KMER), (lo, hi))
    return home, mix64(whole + mix64((((a - lo) << 20) + (hi - lo)).astype(np.uint64)) * np.uint64(_Q)), lo, hi


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row: word count, identity of its text, and its super-edges in order."""
    for batch in within(batches):
        texts, first, held = _texts(batch.column("text")), 0, 0
        for row, text in enumerate(texts, 1):
            held += len(text)
            if held >= GROUP_BYTES or row == len(texts):
                group = texts[first:row]
                keys, at = word_keys(b" ".join(group))
                ends = np.searchsorted(at, np.cumsum([len(t) + 1 for t in group]))
                counts = np.diff(ends, prepend=0)
                home, name, lo, hi = super_edges(keys, ends)
                inside = np.searchsorted(ends, lo, side="right")
                start = (ends - counts)[inside]
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(inside, minlength=len(group)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (signed(home), signed(name), (lo - start).astype(np.int32), (hi - start).astype(np.int32))]
                own = [batch.column("doc_id").slice(first, len(group)), pa.array(counts, pa.int64()), pa.array([_identity(t) for t in group], pa.int64())]
                yield pa.RecordBatch.from_arrays([*own, *lists], names=["doc_id", "n_words", "name", "h", "u", "lo", "hi"])
                first, held = row, 0


def _steps() -> Column:
    """The super-edges of a walk, each with the one before and the one after it."""
    near = lambda i: F.coalesce(F.get("u", i), F.lit(NONE))
    return F.transform("h", lambda h, i: F.struct(h.alias("h"), F.get("u", i).alias("u"), F.get("lo", i).alias("lo"), F.get("hi", i).alias("hi"), near(i - 1).alias("prev"), near(i + 1).alias("nxt")))


def compact(supers: DataFrame) -> DataFrame:
    """(u, path, place): the nonbranching path of every repeated super-edge, named by its first one, and its place there.

    ``supers`` holds one row for each super-edge with the least and most doc_id in which it occurs and the least and
    most of its forerunners (p0, p1) and followers (n0, n1). Two are joined where every occurrence of one is followed
    by the other and every occurrence of the other follows it, so all documents of a path walk the whole of it.
    Pointers to forerunners are doubled until all reach the first of their path. No ring can be joined, as a walk has a
    first edge; should colliding hashes ever make one, this raises.
    """
    repeated = supers.where("least < most")
    after = repeated.where(f"n0 = n1 AND n0 != {NONE}").select("u", F.col("n0").alias("nxt"))
    before = repeated.where(f"p0 = p1 AND p0 != {NONE}").select(F.col("p0").alias("u"), F.col("u").alias("nxt"))
    at = settled(after.join(before, ["u", "nxt"]).select(F.col("nxt").alias("u"), F.col("u").alias("path"), F.lit(1).cast("long").alias("place"), F.lit(True).alias("moved")))
    rows = at.count()
    for _ in range(rows.bit_length() + 1):
        ahead = at.select(F.col("u").alias("path"), F.col("path").alias("__path"), F.col("place").alias("__place"))
        # no broadcast: one for each doubling, of a table that grows with the corpus, fills the driver
        joined = at.where("moved").drop("moved").join(ahead, "path", "left")
        joined = joined.select("u", F.coalesce("__path", "path").alias("path"), (F.col("place") + F.coalesce("__place", F.lit(0))).alias("place"), F.col("__path").isNotNull().alias("moved"))
        grown = cut(joined.unionByName(at.where("NOT moved")), rows)
        forget(at)
        at = grown
        if not at.where("moved").head(1):
            break
    else:
        raise RuntimeError("a path of the graph has no first edge")
    out = settled(repeated.select("u").join(at.drop("moved"), "u", "left").select("u", F.coalesce("path", "u").alias("path"), F.coalesce("place", F.lit(0)).alias("place")))
    forget(at)
    return out


def _ends() -> list[Column]:
    return [f(c).alias(n) for c, (x, y) in (("prev", ("p0", "p1")), ("nxt", ("n0", "n1"))) for f, n in ((F.min, x), (F.max, y))]


def _placed(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes], list[tuple[int, int]]]]:
    """(doc_id, name, words, places) of the rows whose text the name tells."""
    lists = batch.column("places")
    flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).tolist()
    spans = list(zip(flat.field("lo").to_pylist(), flat.field("hi").to_pylist(), strict=True))
    for row, (doc, text, name) in enumerate(zip(batch.column("doc_id").to_pylist(), _texts(batch.column("text")), batch.column("name").to_pylist(), strict=True)):
        if _identity(text) == name:  # else another row of the same doc_id
            yield doc, name, text.split(), spans[cuts[row] : cuts[row + 1]]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, doc_id, name, start, prev, nxt): the single edges of the given places, each with the ones beside it there."""
    for batch in within(batches):
        said, stretches, held = [], [], 0
        for doc, name, words, places in _placed(batch):
            ranges: list[list[int]] = []  # edges in a row, over all places that touch
            for lo, hi in sorted((lo, hi - WINDOW + 1) for lo, hi in places):
                if ranges and lo <= ranges[-1][1]:
                    ranges[-1][1] = max(hi, ranges[-1][1])
                else:
                    ranges.append([lo, hi])
            for lo, hi in ranges:
                said.append(b" ".join(words[lo : hi + WINDOW - 1]))
                stretches.append((doc, name, lo, hi - lo))
                held += len(said[-1])
            if held >= GROUP_BYTES:
                yield _edge_rows(said, stretches)
                said, stretches, held = [], [], 0
        if said:
            yield _edge_rows(said, stretches)


def _edge_rows(said: list[bytes], stretches: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    """Rows of ``_edges`` for stretches (doc_id, name, first edge, edges) of the given words."""
    doc, name, start, size = np.array(stretches, np.int64).T
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    # a stretch has WINDOW - 1 words more than edges
    edges = signed(rolling(word_keys(b" ".join(said))[0], WINDOW))[np.repeat(np.cumsum(size + WINDOW - 1) - (size + WINDOW - 1), size) + place]
    edges = np.where(edges == NONE, 1, edges)
    prev, nxt = np.concatenate([[NONE], edges[:-1]]), np.concatenate([edges[1:], [NONE]])
    prev[place == 0] = nxt[place == np.repeat(size, size) - 1] = NONE
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (edges, np.repeat(doc, size), np.repeat(name, size), np.repeat(start, size) + place, prev, nxt)], names=["u", "doc_id", "name", "start", "prev", "nxt"])


def _listed(spans: DataFrame) -> DataFrame:
    """(doc_id, name, places) of rows (doc_id, name, lo, hi)."""
    return settled(spans.groupBy("doc_id", "name").agg(F.collect_list(F.struct("lo", "hi")).alias("places")))


def _places(table: DataFrame, docs: DataFrame, keep: list[DataFrame]) -> DataFrame:
    """doc_id, name and places (lo, hi) of the path walks of all documents, whole copies among them.

    Paths are compacted twice. First over super-edges: equal ones in a row with equal neighbours are one path. Super-edges of one
    home but different words may still share some of their edges; there the graph is opened into its single edges, once for each
    such super-edge (in the document with the least id, by whom all others that hold it are judged by the paths of super-edges),
    and these are compacted over the corpus in turn, so that what two of them share is one path of edges again.
    """
    each = table.select("doc_id", F.explode("h").alias("h"))
    homes = settled(each.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h"))
    own = table.select("doc_id", "name", F.posexplode(_steps()).alias("idx", "e")).select("doc_id", "name", "idx", "e.*")
    walks = held(own.join(broadcast_if(homes, 16), "h", "left_semi"), keep)
    supers = settled(walks.groupBy("u", "h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), *_ends()))
    paths = compact(supers)
    # checkpointed apart, here and below, so that a join has two shuffles of which a hot home's or super-edge's can be split
    several = settled(supers.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", F.lit(True).alias("open")))
    told = supers.select("u", "h", "least").join(broadcast_if(several, 16), "h", "left").join(paths, "u", "left").where("path IS NOT NULL OR open")
    marks = settled(told.select("u", "least", "path", "place", F.coalesce("open", F.lit(False)).alias("open")))
    forget(homes, supers, several, paths)
    on = walks.join(marks, "u")
    whole = on.where("path IS NOT NULL").groupBy("doc_id", "name", "path", (F.col("idx") - F.col("place")).alias("first")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    opened = _listed(on.where("open AND doc_id = least").select("doc_id", "name", "lo", "hi").distinct())
    edges = held(having(docs, opened).join(opened, "doc_id").mapInArrow(_edges, "u bigint, doc_id bigint, name bigint, start bigint, prev bigint, nxt bigint"), keep)
    small = settled(edges.groupBy("u").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), *_ends()).where("least < most"))
    inner = compact(small)
    along = edges.join(broadcast_if(inner, 96), "u").groupBy("doc_id", "name", "path", (F.col("start") - F.col("place")).alias("first"))
    parts = along.agg(F.min("start").cast("int").alias("lo"), (F.max("start") + WINDOW).cast("int").alias("hi"))
    out = _listed(whole.select("doc_id", "name", "lo", "hi").unionByName(parts.select("doc_id", "name", "lo", "hi")))
    forget(marks, opened, small, inner)
    release(keep)
    return out


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, size, doc_id, name, start, words): the words at the given places and a 128-bit digest of them."""

    def part(said: list[bytes], at: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, said)), np.int64).reshape(-1, 2)
        doc, name, lo, hi = np.array(at, np.int64).T
        columns = [pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array((hi - lo).astype(np.int32)), pa.array(doc), pa.array(name), pa.array(lo.astype(np.int32)), pa.array(said, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["x", "y", "size", "doc_id", "name", "start", "words"])

    for batch in within(batches):
        said, at, held = [], [], 0
        for doc, name, words, places in _placed(batch):
            for lo, hi in places:
                said.append(b" ".join(words[lo:hi]))
                at.append((doc, name, lo, hi))
                held += len(said[-1])
                if held >= PART_BYTES:
                    yield part(said, at)
                    said, at, held = [], [], 0
        if said:
            yield part(said, at)


def repeated_spans(docs: DataFrame, keep: list[DataFrame]) -> DataFrame:
    """doc_id, name and spans (start, end in words) of all words that a repeated window covers; cases as in ``dedup``.

    Walks of one path are met by digest and size, and the words at a walk's place are compared with those at the place where
    the least document holds them. Tables that the result still reads are added to ``keep``, for the caller to release.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    own: list[DataFrame] = []
    table = held(docs.where("doc_id IS NOT NULL").mapInArrow(_walks, "doc_id bigint, n_words bigint, name bigint, h array<bigint>, u array<bigint>, lo array<int>, hi array<int>").where(f"n_words >= {WINDOW}"), own)
    places = _places(table.drop("n_words"), docs, own)
    read = having(docs, places).join(places, "doc_id")
    found = held(read.mapInArrow(_sequences, "x bigint, y bigint, size int, doc_id bigint, name bigint, start int, words binary"), keep)
    same = ["x", "y", "size"]
    # as above: a hot passage's rows can be split from the one row that they are compared with
    least = settled(found.groupBy(*same).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select(*same, "a"))
    source = settled(found.join(broadcast_if(least, 96), same).where("doc_id = a").groupBy(*same, "a").agg(F.min_by("words", "start").alias("source")))
    hits = found.join(source, same).where("doc_id > a AND words = source").select("doc_id", "name", "start", (F.col("start") + F.col("size")).alias("end"))
    along = Window.partitionBy("doc_id", "name").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(along))
    spans = runs.groupBy("doc_id", "name", "run").agg(F.struct(F.min("start").alias("start"), F.max("end").alias("end")).alias("span"))
    return spans.groupBy("doc_id", "name").agg(F.sort_array(F.collect_list("span")).alias("spans"))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in within(batches):
        texts, counts, gone, spans = [], [], [], []
        for text, found in zip(_texts(batch.column("text")), batch.column("found").to_pylist(), strict=True):
            words = text.split()
            own = []
            if found:
                name = _identity(text)
                own = [{"start": f["start"], "end": f["end"]} for f in found if f["name"] == name]
            kept = words
            if own:
                kept, at = [], 0
                for s in own:
                    kept += words[at : s["start"]]
                    at = s["end"]
                kept += words[at:]
            counts.append(len(words))
            gone.append(len(words) - len(kept))
            spans.append(own)
            texts.append(b" ".join(kept).decode("utf-8", "replace"))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "spans", "kept_text"])


def dedup(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, spans (start, end in words) and kept_text.

    Words are runs of characters other than ASCII white space. Every word that a window of 50 words covers goes if that
    window also starts in a document with a smaller doc_id; all windows are judged on the input. ``kept_text`` joins
    what is left by single spaces. Null, empty and shorter texts lose nothing (null: no words), nor do rows with a null
    doc_id, which count against no other row. Rows that share a doc_id do not count against each other. Repeated rows
    come out alike. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    keep: list[DataFrame] = []
    own = repeated_spans(docs, keep).select("doc_id", "name", F.explode("spans").alias("s")).select("doc_id", F.struct("name", "s.start", "s.end").alias("s"))
    found = settled(own.groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("found")))
    release(keep)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    whole, few = F.lit(None).cast(found.schema["found"].dataType), broadcast_if(found, 24, "found")
    read = texts.join(few, "doc_id", "left")
    if few is found:  # too many to broadcast: only the texts that lose words are shuffled, if their ids can be
        ids = broadcast_if(found.select("doc_id"), 16)
        read = texts.join(ids, "doc_id", "left_semi").join(found, "doc_id").unionByName(texts.join(ids, "doc_id", "left_anti").withColumn("found", whole))
    return read.mapInArrow(_keep, "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept_text string")
