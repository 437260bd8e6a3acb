"""One JSON array, or one CSV with quoted line breaks, read by many tasks.

Whether a byte stands inside quotes, and how deep inside brackets, depends on all bytes before it. So a first pass tells of every
block of bytes what it does to each state that it may begin in; these few facts are combined along a file; and a second pass, which
knows the state that its block begins in, cuts the records that begin there, reading on past the block for the end of the last one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import quayline

from quayline.sources.stores import open_at

cloudpickle.register_pickle_by_value(quayline)

#: Bytes of a block, and of a record at most: one that is longer is an error.
BLOCK_BYTES, RECORD_BYTES = 16 << 20, 512 << 20
#: Partitions of blocks at most.
MOST_TASKS = 10_000
#: Bytes that are read on for the end of a block's last record, again and again doubled.
_MORE = 1 << 16
RECORDS = "path string, place bigint, record string"

_JSON = re.compile(rb'["\\{}\[\],]')
_STRING = re.compile(rb'["\\]')


def _quote_facts(data: bytes) -> list[int]:
    """Of a CSV block: whether its quotes are odd. A doubled quote leaves and enters again, so it needs no care."""
    return [data.count(b'"') & 1]


#: States that a JSON block may begin in: outside strings, inside, and inside behind a backslash.
_OUT, _IN, _ESCAPED = range(3)


def _json_facts(data: bytes) -> list[int]:
    """Of a JSON block, for each state that it may begin in: the state that it ends in, by how much its depth grows, and whether
    anything but white space stands outside of strings."""
    facts = []
    for state in (_OUT, _IN, _ESCAPED):
        at, depth, said = 0, 0, state != _OUT
        if state == _ESCAPED and data:
            state, at = _IN, 1
        while at < len(data):
            if state == _IN:
                m = _STRING.search(data, at)
                if m is None:
                    break
                if m[0] == b'"':
                    state, at = _OUT, m.end()
                elif m.end() < len(data):
                    at = m.end() + 1
                else:
                    state = _ESCAPED
                    break
            else:
                end = data.find(b'"', at)
                part = data[at : end if end >= 0 else len(data)]
                depth += part.count(b"[") + part.count(b"{") - part.count(b"]") - part.count(b"}")
                said = said or end >= 0 or bool(part.strip())
                if end < 0:
                    break
                state, at = _IN, end + 1
        facts += [state, depth, int(said)]
    return facts


def _blocks(files: DataFrame) -> DataFrame:
    """(path, length, block) of files (path, length), dealt so that a task has few blocks."""
    last = F.greatest(F.ceil(F.col("length") / BLOCK_BYTES).cast("long") - 1, F.lit(0))
    return _dealt(files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block")), files)


def _dealt(blocks: DataFrame, files: DataFrame) -> DataFrame:
    """A fixed number of partitions, as many as there are blocks up to MOST_TASKS: the planner would merge rows so small, but each is much work."""
    total = files.agg(F.coalesce(F.sum(F.ceil(F.col("length") / BLOCK_BYTES)), F.lit(0)).alias("n")).first()["n"]
    return blocks.repartition(max(1, min(int(total), MOST_TASKS)), "path", "block")


def _facts(files: DataFrame, kind: str) -> DataFrame:
    """(path, length, block, facts) of every block."""
    tell = _json_facts if kind == "json" else _quote_facts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, block in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with open_at(path) as file:
                    file.seek(block * BLOCK_BYTES)
                    out.append(tell(file.read(BLOCK_BYTES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=["path", "length", "block", "facts"])

    return _blocks(files).mapInArrow(run, "path string, length bigint, block bigint, facts array<bigint>")


def _states(facts: DataFrame, kind: str) -> DataFrame:
    """(path, length, block, state, depth, said) in which every block begins: the facts of a file, a few numbers for each block, in order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        begins, state, depth, said = [], 0, 0, False
        for fact in rows["facts"]:
            begins.append((state, depth, said))
            if kind == "json":
                state, depth, said = int(fact[3 * state]), depth + int(fact[3 * state + 1]), said or bool(fact[3 * state + 2])
            else:
                state ^= int(fact[0])
        states, depths, spoken = zip(*begins, strict=True)
        return rows[["path", "length", "block"]].assign(state=states, depth=depths, said=spoken)

    return facts.groupBy("path").applyInPandas(run, "path string, length bigint, block bigint, state int, depth bigint, said boolean")


class _Window:
    """The bytes of a file from ``first`` on, read further as they are wanted."""

    def __init__(self, file, first: int, length: int, size: int) -> None:
        self.file, self.first, self.length = file, first, length
        file.seek(first)
        self.data, self.step = file.read(size), _MORE

    def more(self) -> bool:
        if len(self.data) > BLOCK_BYTES + RECORD_BYTES:
            raise ValueError(f"a record of more than {RECORD_BYTES} bytes")
        self.file.seek(self.first + len(self.data))
        new = self.file.read(self.step)
        self.data += new
        self.step *= 2
        return bool(new)


def _csv_records(window: _Window, inside: bool, lead: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Records that begin in ``size`` bytes behind ``lead`` ones, at the file's start or behind a line break outside quotes.

    ``inside`` tells whether the byte behind the lead stands inside quotes. Records without a byte are skipped.
    """
    at, end = lead, lead + size
    start = at if not inside and window.data[:lead] in (b"", b"\n") else None
    mark = re.compile(rb'["\n]')
    while True:
        m = mark.search(window.data, at)
        if m is None:
            at = len(window.data)
            if start is None and at >= end or not window.more():
                break
            continue
        at = m.end()
        if m[0] == b'"':
            inside = not inside
        elif not inside:
            if start is not None and (record := window.data[start : m.start()].removesuffix(b"\r")):
                yield window.first + start, record
            start = at
            if at >= end:
                return
    if start is not None and start < len(window.data):
        if inside:
            raise ValueError(f"a quoted field of the record at byte {window.first + start} is not closed")
        yield window.first + start, window.data[start:]


def _json_records(window: _Window, state: int, depth: int, said: bool, size: int) -> Iterator[tuple[int, bytes]]:
    """Elements of the outer array that begin in the first ``size`` bytes: behind its bracket or a comma between elements."""
    at, start = 0, None
    if not said and window.data.lstrip()[:1] not in (b"[", b""):
        raise ValueError("the document is not an array")
    if state == _ESCAPED:
        state, at = _IN, 1
    while True:
        m = (_STRING if state == _IN else _JSON).search(window.data, at)
        if m is None:
            at = len(window.data)
            if start is None and at >= size or not window.more():
                break
            continue
        mark, place = m[0], m.start()
        if place >= size and start is None:
            return
        if state == _IN and mark == b"\\" and m.end() == len(window.data) and not window.more():
            break
        at = m.end()
        if state == _IN:
            if mark == b'"':
                state = _OUT
            else:
                at += 1
            continue
        if mark == b'"':
            state = _IN
        elif mark in b"[{":
            depth += 1
            if depth == 1:
                if said or window.data[:place].strip():
                    raise ValueError("something follows the array")
                start = at
        elif mark == b"," and depth == 1 or mark in b"]}":
            if mark != b",":
                depth -= 1
            if depth < 0 or depth == 0 and mark == b"}":
                raise ValueError(f"a bracket at byte {window.first + place} closes nothing")
            if mark == b"," or depth == 0:
                element = window.data[start:place].strip() if start is not None else None
                if element:
                    yield window.first + start, element
                elif start is not None and (mark == b"," or window.data[start - 1 : start] == b","):
                    raise ValueError(f"an empty element at byte {window.first + place}")
                start = at if mark == b"," and place < size else None
                if place >= size:
                    return
    if start is not None or depth > 0 and window.first + len(window.data) >= window.length:
        raise ValueError("the array does not end")


def records(files: DataFrame, kind: str) -> DataFrame:
    """(path, place, record): the records of ``files`` (path, length), ``csv`` or ``json``, with the byte that each begins at.

    CSV: what stands between line breaks outside quotes, without them; quotes are doubled inside quotes. JSON: the elements of the
    one array that a file holds. A file is as many tasks as it has blocks. Unclosed quotes and arrays, empty elements and other
    documents than arrays are errors; what stands inside a record is left to its parser. UTF-8 without a byte order mark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, block, state, depth, said in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "block", "state", "depth", "said")), strict=True):
                with open_at(path) as file:
                    first = block * BLOCK_BYTES
                    size = min(BLOCK_BYTES, length - first)
                    # one byte before the block: a line break there ends the record before
                    lead = 1 if kind == "csv" and first else 0
                    window = _Window(file, first - lead, length, size + lead)
                    found = _csv_records(window, bool(state), lead, size) if kind == "csv" else _json_records(window, state, depth, said, size)
                    some: list[tuple[int, bytes]] = []
                    held = 0
                    for record in found:
                        some.append(record)
                        held += len(record[1])
                        if held > 1 << 20:
                            yield _batch(path, some)
                            some, held = [], 0
                    yield _batch(path, some)

    return _dealt(_states(_facts(files, kind), kind), files).mapInArrow(run, RECORDS)


def _batch(path: str, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    texts = pa.array([r for _, r in found], pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([p for p, _ in found], pa.int64()), texts], names=["path", "place", "record"])
