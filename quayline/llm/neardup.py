"""MinHash near-duplicate detection with b-bit signatures and links confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayline.llm.common import WordKeys, broadcast_if, durable, forget, held, mix64, release, rolling, settled, signed, small_batches, within
from quayline.llm.components import components

WIDTH = 5
#: Minima of a document, dealt to bands of as many as keep the chance below MISSED that a pair at the threshold shares no band.
LANES, MISSED = 140, 2e-5
#: Low bits kept of each minimum, and how far below the threshold an estimate may lie: over five deviations.
BITS, MARGIN = 4, 0.2
#: Shingles in a block of documents of the last candidate pass, in which blocks are compared with blocks (a document at least).
BLOCK_SHINGLES = 1 << 18
#: Set sizes of one block of a larger group lie within this factor.
CLASS_STEP = 1.1
_CHUNK = 1 << 15

_seeds = mix64(np.arange(1, 2 * LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_MULTIPLY, _ADD = _seeds[:LANES] | np.uint64(1), _seeds[LANES:]


def shingle_set(text: str, keys: WordKeys, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; A-Z lower-cased, words parted by ASCII white space.

    Fewer words than ``width`` make one shingle of the whole sequence; no words make an empty set.
    """
    own = keys.of(text.encode("utf-8", "replace").lower().split())
    if 0 < len(own) < width:
        return np.array([xxhash.xxh64_intdigest(own.tobytes(), len(own))], np.uint64)
    return np.unique(rolling(own, width))


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The LANES minima of each non-empty set: one row for each set."""
    out = np.empty((len(sets), LANES), np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= _CHUNK):
            size += len(sets[last])
            last += 1
        flat = np.concatenate(sets[first:last])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[first : last - 1]], dtype=np.int64)]).astype(np.int64)
        room = np.empty_like(flat)
        for lane in range(LANES):
            np.multiply(flat, _MULTIPLY[lane], out=room)
            np.add(room, _ADD[lane], out=room)
            np.minimum.reduceat(room, starts, out=out[first:last, lane])
        first = last
    return out


def band_rows(percent: int) -> int:
    """Minima in a band for the threshold ``percent``: 5 from 80 on (a pair at 85 is missed with probability 7e-8, at 80 with 1.5e-5), fewer below."""
    for rows in range(5, 0, -1):
        if (1 - (percent / 100) ** rows) ** (LANES // rows) <= MISSED:
            return rows
    raise ValueError(f"{LANES} minima do not find pairs of {percent} percent")


def band_keys(mins: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` full minima."""
    bands = LANES // rows
    key = np.zeros((len(mins), bands), np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
    for row in range(rows):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + mins[:, row : bands * rows : rows])
    return key


def pack(mins: np.ndarray) -> np.ndarray:
    """Signatures: the low BITS of each mixed minimum, two lanes to a byte."""
    low = (mix64(mins) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by counting equal lanes, corrected for the 2^-BITS that agree by chance."""
    x = a ^ b
    x = x | (x >> 2)
    x = (x | (x >> 1)) & 0x11
    equal = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / LANES
    chance = 2.0**-BITS
    return (equal - chance) / (1 - chance)


def _sketch(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = WordKeys()
        for batch in within(batches):
            sets = [shingle_set(t or "", keys) for t in batch.column("text").to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            mins = minima([sets[i] for i in full])
            place = np.full(len(sets), -1)
            place[full] = np.arange(len(full))
            digests = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            take = pa.array([None if p < 0 else int(p) for p in place], pa.int64())
            bands = pa.FixedSizeListArray.from_arrays(pa.array(signed(band_keys(mins, rows)).ravel()), LANES // rows).cast(pa.list_(pa.int64()))
            packed = pa.array([p.tobytes() for p in pack(mins)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), bands.take(take), packed.take(take)],
                names=["doc_id", "n_shingles", "digest", "bands", "signature"],
            )

    return run


def sketches(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band keys and packed signature (null for empty sets) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketch(band_rows(percent)), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, signature binary")


def _near(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in within(batches):
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array(estimate(a, b) >= floor))

    return run


def _estimated(pairs: DataFrame, signatures: DataFrame, floor: float) -> DataFrame:
    """The pairs (a, b) whose estimate is at least ``floor``."""
    both = pairs.join(signatures.select(F.col("doc_id").alias("a"), F.col("signature").alias("sa")), "a").join(signatures.select(F.col("doc_id").alias("b"), F.col("signature").alias("sb")), "b")
    return both.mapInArrow(_near(floor), "a bigint, b bigint")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = WordKeys()
    for batch in within(batches):
        sets = [shingle_set(t or "", keys).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in within(batches):
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _full_sets(ids: DataFrame, docs: DataFrame, keep: list[DataFrame]) -> DataFrame:
    """doc_id and the full shingle set of the documents in the held table ``ids``; their texts are read again."""
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(broadcast_if(ids, 16), "doc_id", "left_semi")
    return held(texts.mapInArrow(_sets, "doc_id bigint, shingles binary"), keep)


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, keep: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    wanted = settled(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    full = _full_sets(wanted, docs, keep)
    joined = pairs.join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("xb")), "b")
    joined = joined.join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("xa")), "a")
    return settled(joined.mapInArrow(_confirm(percent), "a bigint, b bigint"))


def _between(floor: float, percent: int):
    """Of two blocks of documents: the links between documents of different components, one for each pair that it joins.

    Estimates of all pairs of the two blocks come at once; those that pass are confirmed on the full sets, unless links
    found before in this pair of blocks have already joined the two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for row in range(batch.num_rows):
                one, two = batch.column("xa")[row].as_py(), batch.column("xb")[row].as_py()
                sigs = [np.frombuffer(b"".join(d["signature"] for d in block), np.uint8).reshape(len(block), -1) for block in (one, two)]
                parent: dict[int, int] = {}

                def find(x: int, parent=parent) -> int:
                    while parent.get(x, x) != x:
                        x = parent[x]
                    return x

                near = np.concatenate([estimate(sigs[0][i : i + 64, None, :], sigs[1][None, :, :]) for i in range(0, len(one), 64)])
                for i, j in sorted(zip(*np.nonzero(near >= floor), strict=True), key=lambda ij: -near[ij]):
                    a, b = one[i], two[j]
                    ra, rb = find(a["root"]), find(b["root"])
                    if ra == rb:
                        continue
                    x, y = np.frombuffer(a["shingles"], np.uint64), np.frombuffer(b["shingles"], np.uint64)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        parent[max(ra, rb)] = min(ra, rb)
                        left.append(a["doc_id"])
                        right.append(b["doc_id"])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _rest(buckets: DataFrame, signatures: DataFrame, labels: DataFrame, docs: DataFrame, floor: float, percent: int, keep: list[DataFrame]) -> DataFrame:
    """Links that the first pass left: between bucket mates in different components.

    Only buckets of several components matter. Their documents are put in blocks of about BLOCK_SHINGLES, by component
    and the smallest document they share a bucket with, and by set size beyond one block, so that blocks meet in few buckets; two blocks that meet
    in a bucket are compared once, whatever the number of buckets, and never if they are of one component or if no two of
    their set sizes are near enough. No pair of documents becomes a row unless it is a link.
    """
    known = settled(labels.union(labels.select(F.col("root").alias("node"), "root").distinct()))
    # part: the component of a document that is linked at all
    marked = buckets.join(broadcast_if(known, 24), F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "head", F.coalesce("root", "doc_id").alias("root"), F.col("root").alias("part"))
    # checkpointed apart, as an aggregate on the join's own key would be joined where it lies, and a hot key could not be split
    several = settled(marked.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"))
    open_rows = settled(marked.join(broadcast_if(several, 16), "key", "left_semi"))
    own = open_rows.groupBy("doc_id").agg(F.min("root").alias("root"), F.min("head").alias("near"), F.min("part").alias("part")).join(signatures.select("doc_id", "n_shingles"), "doc_id")
    own = settled(own.withColumn("group", F.xxhash64("part", "near")).withColumn("class", F.floor(F.log(CLASS_STEP, F.greatest("n_shingles", F.lit(1))))))
    # groups over a block are dealt by set size and a hash of doc_id, from counts alone, so that no task holds a whole group
    counts = own.groupBy("group", "class").agg(F.sum("n_shingles").alias("shingles"))
    large = counts.groupBy("group").agg(F.sum("shingles").alias("all")).where(F.col("all") > BLOCK_SHINGLES).select("group")
    slots = settled(counts.join(large, "group", "left_semi").select("group", "class", F.ceil(F.col("shingles") / BLOCK_SHINGLES).alias("slots")))
    slot = F.xxhash64("group", "class", F.pmod(F.xxhash64("doc_id"), F.col("slots")))
    placed = own.join(broadcast_if(slots, 24), ["group", "class"], "left").withColumn("block", F.when(F.col("slots").isNull(), F.col("group")).otherwise(slot))
    placed = settled(placed.select("doc_id", "root", "part", "block", "n_shingles"))
    sizes = placed.groupBy("block").agg(F.min("n_shingles").alias("lo"), F.max("n_shingles").alias("hi"))
    meets = open_rows.select("key", "doc_id").join(placed.select("doc_id", "block", "part"), "doc_id").select("key", "block", "part").distinct().join(sizes, "block")
    other = meets.select("key", F.col("block").alias("other"), F.col("part").alias("other_part"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"))
    apart = F.col("part").isNull() | F.col("other_part").isNull() | (F.col("part") != F.col("other_part"))
    near = (F.col("hi") * 100 >= F.col("other_lo") * percent) & (F.col("other_hi") * 100 >= F.col("lo") * percent)
    pairs = meets.join(other, "key").where((F.col("block") <= F.col("other")) & apart & near).select("block", "other").distinct()
    sets = _full_sets(placed.select("doc_id"), docs, keep)
    blocks = placed.drop("n_shingles").join(sets, "doc_id").join(signatures.select("doc_id", "signature"), "doc_id").groupBy("block").agg(F.collect_list(F.struct("doc_id", "root", "signature", "shingles")).alias("x"))
    blocks = held(blocks, keep)
    both = pairs.join(blocks.withColumnRenamed("x", "xa"), "block").join(blocks.select(F.col("block").alias("other"), F.col("x").alias("xb")), "other")
    found = settled(both.select("xa", "xb").mapInArrow(_between(floor, percent), "a bigint, b bigint"))
    forget(known, several, open_rows, own, slots, placed)
    return found


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id and kept.

    Links join documents with 100 * intersection >= ``percent`` * union of their sets of distinct five-word shingles;
    bands have as many rows as the threshold allows (``band_rows``, which refuses thresholds below 8).
    Rows with equal sets form one class, held by its smallest doc_id. Classes that share a band key are candidates:
    first each with the smallest of its bucket; then, after components, all bucket mates that are still in different
    components, in blocks. b-bit estimates drop clear misses and full sets confirm the rest. component_id is the smallest doc_id
    reachable and ``kept`` marks the row that bears it.

    Null and empty texts have no shingles, link with nothing and are kept. Rows with a null doc_id have a null
    component_id, are kept and link nothing; rows that share a doc_id are one node. An empty table gives no rows.
    Other columns are not read.
    """
    small_batches(docs.sparkSession)
    floor = percent / 100 - MARGIN
    table = durable(sketches(docs, percent), "sketches")
    known = table.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    heads = known.join(classes, "digest").where("doc_id = class_id").select("doc_id", "n_shingles", "bands", "signature")
    # rows that repeat a document are alike: one of them stands for it
    spread = heads.select("doc_id", F.explode("bands").alias("key"))
    least = spread.groupBy("key").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("last")).where("head < last").select("key", "head")
    least = settled(least)
    keep: list[DataFrame] = []
    buckets = settled(spread.join(broadcast_if(least, 24), "key").distinct())
    forget(least)
    members = buckets.select("doc_id").distinct()
    signatures = settled(heads.select("doc_id", "signature", "n_shingles").join(members, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    firsts = buckets.where("doc_id != head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely = settled(_estimated(firsts, signatures, floor))
    links = _confirmed(likely, docs, percent, keep)
    labels = components(links)
    more = _rest(buckets, signatures, labels, docs, floor, percent, keep)
    if more.head(1):
        labels = components(links.union(more))
    forget(buckets, signatures, likely, links, more)
    release(keep)
    # checkpointed apart, so that the join below has two shuffles of which a hot set of copies can be split
    roots = settled(classes.join(broadcast_if(labels, 24), F.col("class_id") == F.col("node"), "left").select("digest", F.coalesce("root", "class_id").alias("root")))
    told = table.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return told.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps: one document of each group.

    Of rows that repeat a kept doc_id and its text one stays; rows of one doc_id and different texts all stay.
    """
    verdict = near_duplicates(docs, percent).where("kept AND doc_id IS NOT NULL")
    kept = settled(verdict.groupBy(F.col("doc_id").alias("__kept")).agg(F.count("*").alias("__n")))

    def those(condition: str) -> DataFrame:
        return docs.join(broadcast_if(kept.where(condition), 24), docs["doc_id"] == F.col("__kept"), "left_semi")

    stay = those("__n = 1").unionByName(docs.where("doc_id IS NULL"))
    return stay.unionByName(those("__n > 1").dropDuplicates(["doc_id", "text"])) if kept.where("__n > 1").head(1) else stay
