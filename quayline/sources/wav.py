"""WAV files to rows and back: a data source of byte ranges and a writer that commits, and whole clips through Spark's binary reader."""

from __future__ import annotations

import io
import json
import struct
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

import quayline

from quayline.functions import dsp
from quayline.operators.staging import staged
from quayline.sources.stores import open_at, seekable, store

cloudpickle.register_pickle_by_value(quayline)

#: Clips must last this long to be scanned for noise.
LEAST_SECONDS = 60.0


def walk(file: BinaryIO, size: int) -> dict:
    """Format, channels, rate, sample width, the place of the samples and the number of whole frames, from chunk to chunk.

    Other chunks are stepped over, however long they are. A length that runs beyond the ``size`` of the file ends with it.
    """
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, {}
    while at + 8 <= size:
        file.seek(at)
        name, length = struct.unpack("<4sI", file.read(8))
        if name == b"fmt ":
            body = file.read(min(length, 40))
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE:
                kind = struct.unpack("<H", body[24:26])[0]
            found |= {"kind": kind, "channels": channels, "sample_rate": rate, "width": bits // 8}
        elif name == b"data" and found:
            step = found["channels"] * found["width"]
            return found | {"start": at + 8, "step": step, "frames": min(length, size - at - 8) // step}
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


def parse_header(data: bytes, size: int | None = None) -> dict:
    """``walk`` over the bytes of a file of ``size`` bytes, or over its first ones if the samples begin there."""
    return walk(io.BytesIO(data), len(data) if size is None else size)


def _values(raw: bytes, head: dict) -> np.ndarray:
    """Whole frames as float32 from -1 to 1, one column for each channel."""
    width = head["width"]
    if head["kind"] == 3:
        values = np.frombuffer(raw, "<f4" if width == 4 else "<f8").astype(np.float32)
    elif head["kind"] != 1:
        raise ValueError(f"WAV format {head['kind']} is not supported")
    elif width == 1:
        values = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        values = (wide.view("<i4").ravel() / float(1 << 31)).astype(np.float32)
    else:
        values = (np.frombuffer(raw, f"<i{width}") / float(1 << (8 * width - 1))).astype(np.float32)
    return values.reshape(-1, head["channels"])


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples from -1 to 1 as float32, one column for each channel, and the rate."""
    head = parse_header(data)
    return _values(data[head["start"] : head["start"] + head["frames"] * head["step"]], head), head["sample_rate"]


def encode(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit PCM file."""
    body = np.clip(np.rint(np.asarray(samples, float) * 32768), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", len(body))
    return head + body


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def probe(spark: SparkSession, path: str, glob: str = "*.WAV") -> DataFrame:
    """path, sample_rate, channels, n_frames and duration_sec of every file below ``path``.

    Headers are walked by seeks where the store can be read at places; elsewhere Spark reads the file.
    """
    files = _files(spark, path, glob)

    def told(heads: Iterator[dict]) -> pd.DataFrame:
        rows = list(heads)
        return pd.DataFrame({"sample_rate": [r["sample_rate"] for r in rows], "channels": [r["channels"] for r in rows], "n_frames": [r["frames"] for r in rows]}, columns=["sample_rate", "channels", "n_frames"])

    @F.pandas_udf("sample_rate int, channels int, n_frames bigint")
    def brought(data: pd.Series) -> pd.DataFrame:
        return told(map(parse_header, data))

    @F.pandas_udf("sample_rate int, channels int, n_frames bigint")
    def sought(names: pd.Series, size: pd.Series) -> pd.DataFrame:
        def heads() -> Iterator[dict]:
            for name, n in zip(names, size, strict=True):
                with open_at(name) as f:
                    yield walk(f, int(n))

        return told(heads())

    head = sought("path", "length") if seekable(files) else brought("content")
    rows = files.select("path", head.alias("h")).select("path", "h.*")
    return rows.withColumn("duration_sec", F.col("n_frames") / F.col("sample_rate"))


def long_files(spark: SparkSession, path: str, limit: int = 12, least: float = LEAST_SECONDS, glob: str = "*.WAV") -> DataFrame:
    """The first ``limit`` files of at least ``least`` seconds, in the order of their path parts."""
    return probe(spark, path, glob).where(F.col("duration_sec") >= least).orderBy(F.split("path", "/")).limit(limit)


def read(spark: SparkSession, path: str, glob: str = "*.[wW][aA][vV]") -> DataFrame:
    """path, sample_rate and the samples as float32, averaged over the channels."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                values, rate = decode(data)
                yield pd.DataFrame({"path": [name], "sample_rate": [rate], "samples": [values.mean(axis=1).astype(np.float32)]})

    return _files(spark, path, glob).select("path", "content").mapInPandas(run, "path string, sample_rate int, samples array<float>")


def windows(spark: SparkSession, files: DataFrame, glob_root: str, count: int = 24, seconds: float = 4.0, glob: str = "*.WAV") -> DataFrame:
    """path, start_sec, sample_rate and samples of ``count`` evenly spaced clips of every file in ``files``.

    Starts run from 0 to the duration less ``seconds``; places in samples are truncated. Only the clips are read where the
    store can be read at places.
    """

    def clips(name: str, head: dict, frames: Callable[[int, int], bytes]) -> Iterator[pd.DataFrame]:
        rate, total = head["sample_rate"], head["frames"]
        for start in np.linspace(0, max(total / rate - seconds, 0), count):
            first = int(start * rate)
            n = max(0, min(int(seconds * rate), total - first))
            clip = _values(frames(first, n), head).mean(axis=1).astype(np.float32)
            yield pd.DataFrame({"path": [name], "start_sec": [float(start)], "sample_rate": [rate], "samples": [clip]})

    def brought(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                head = parse_header(data)
                yield from clips(name, head, lambda first, n, d=data, h=head: d[h["start"] + first * h["step"] : h["start"] + (first + n) * h["step"]])

    def sought(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, size in zip(batch["path"], batch["length"], strict=True):
                with open_at(name) as f:
                    head = walk(f, int(size))

                    def frames(first: int, n: int, f=f, head=head) -> bytes:
                        f.seek(head["start"] + first * head["step"])
                        return f.read(n * head["step"])

                    yield from clips(name, head, frames)

    found = _files(spark, glob_root, glob).join(files.select("path"), "path", "left_semi")
    schema = "path string, start_sec double, sample_rate int, samples array<float>"
    if seekable(files):
        return found.select("path", "length").mapInPandas(sought, schema)
    return found.select("path", "content").mapInPandas(brought, schema)


#: Bytes of one or more files that a task reads, and bytes of samples that it decodes at a time.
RANGE_BYTES, PIECE_BYTES = 64 << 20, 4 << 20
FRAMES = "path string, sample_rate int, frame_idx bigint, samples array<float>"


class Span(NamedTuple):
    """A byte range of a file of ``size`` bytes."""

    path: str
    size: int
    low: int
    high: int


class _Range(InputPartition):
    def __init__(self, spans: list[Span]) -> None:
        self.spans = spans


class _Reader(DataSourceReader):
    """Partitions are byte ranges, so a long file is many tasks and short ones share a task; a frame belongs to the range in
    which its first byte lies, which a task finds from the file's own header."""

    def __init__(self, options: dict[str, str]) -> None:
        self.files = json.loads(options["files"])
        self.seconds = float(options.get("seconds", "0"))
        self.samples = int(options.get("samples", "0"))

    def partitions(self) -> list[_Range]:
        out, spans, held = [], [], 0
        for path, size in self.files:
            for low in range(0, size, RANGE_BYTES):
                span = Span(path, size, low, min(size, low + RANGE_BYTES))
                if spans and held + span.high - low > RANGE_BYTES:
                    out.append(_Range(spans))
                    spans, held = [], 0
                spans.append(span)
                held += span.high - low
        return [*out, _Range(spans)] if spans else out or [_Range([])]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        for span in partition.spans:
            with open_at(span.path) as file:
                head = walk(file, span.size)
                size = self.samples or int(head["sample_rate"] * self.seconds)
                if size < 1:
                    raise ValueError("a frame holds at least one sample")
                wide = size * head["step"]
                place = lambda at, head=head, wide=wide: max(0, -(-(at - head["start"]) // wide))
                first, last = place(span.low), min(place(span.high), -(-head["frames"] // size))
                many = max(1, PIECE_BYTES // wide)
                for at in range(first, last, many):
                    some = min(many, last - at)
                    file.seek(head["start"] + at * wide)
                    count = min(some * size, head["frames"] - at * size)
                    values = _values(file.read(count * head["step"]), head).mean(axis=1).astype(np.float32)
                    ends = np.minimum(np.arange(some + 1) * size, count)
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                    yield pa.RecordBatch.from_arrays([pa.array([span.path] * some), pa.array([head["sample_rate"]] * some, pa.int32()), pa.array(np.arange(at, at + some)), lists], names=["path", "sample_rate", "frame_idx", "samples"])


class _Written(WriterCommitMessage):
    def __init__(self, folder: str, names: list[str]) -> None:
        self.folder, self.names = folder, names


class _Writer(DataSourceArrowWriter):
    """Tasks write below a hidden folder of their own attempt; only the commit moves files to their names, and it or an abort
    removes the folder, so that failed and repeated attempts leave nothing."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].rstrip("/")
        self.staging = f"{self.root}/.staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        task = TaskContext.get()
        folder = f"{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        held, inside = store(folder)
        held.create_dir(inside)
        names = []
        for batch in batches:
            for i in range(batch.num_rows):
                name, rate = batch.column("name")[i].as_py(), batch.column("sample_rate")[i].as_py()
                with held.open_output_stream(f"{inside}/{len(names)}") as out:
                    out.write(encode(batch.column("samples")[i].values.to_numpy(), rate))
                names.append(name)
        return _Written(folder, names)

    def commit(self, messages: list[_Written | None]) -> None:
        made = set()
        for message in filter(None, messages):
            held, inside = store(message.folder)
            _, root = store(self.root)
            for i, name in enumerate(message.names):
                target = f"{root}/{name}"
                folder = target.rpartition("/")[0]
                if folder not in made:
                    held.create_dir(folder)
                    made.add(folder)
                held.move(f"{inside}/{i}", target)
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        held, inside = store(self.staging)
        if held.get_file_info(inside).type != fs.FileType.NotFound:
            held.delete_dir(inside)


class WavFiles(DataSource):
    """``quayline_wav``. Reads frames of ``files`` (a JSON list of path and size) that last ``seconds`` or hold ``samples``; writes
    rows (name, sample_rate, samples) as mono files below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "quayline_wav"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def frames(spark: SparkSession, path: str, seconds: float = 0.1, samples: int = 0, glob: str = "*.[wW][aA][vV]", only: list[str] | None = None) -> DataFrame:
    """path, sample_rate, frame_idx and the samples, averaged over the channels, of the consecutive frames of every file below ``path``.

    A frame lasts ``seconds`` at its file's rate, or holds ``samples`` of them; the last of a file may be short, and a file
    without samples has none. Of the files only those named in ``only`` are opened, if it is given. A task reads a byte range,
    so neither a file's length nor that of its header matters; where the store cannot be read at places, Spark brings whole files.
    """
    files = _files(spark, path, glob)
    if only is not None:
        files = files.where(F.col("path").isin(only))
    if not seekable(files):
        size = F.lit(samples) if samples else F.floor(F.col("sample_rate") * seconds).cast("int")
        whole = read(spark, path, glob)
        cut = dsp.frames(whole.where(F.col("path").isin(only)) if only is not None else whole, "samples", size)
        return cut.select("path", "sample_rate", F.col("frame_idx").cast("bigint").alias("frame_idx"), "samples")
    # names and sizes, as Spark's own listing holds them on the driver
    listed = [(r["path"], r["length"]) for r in files.select("path", "length").orderBy("path").collect()]
    spark.dataSource.register(WavFiles)
    return spark.read.format("quayline_wav").options(files=json.dumps(listed), seconds=str(seconds), samples=str(samples)).load()


def write(df: DataFrame, root: str, name: str = "audio", samples: str = "samples", rate: str = "sample_rate") -> DataFrame:
    """Write one file for each row to ``root``/``name`` and return the rows without samples, with duration_sec.

    ``root`` is a folder in any store that Arrow's file systems reach. The rows are staged, so they are made once; files appear
    when all of them are written, and a row of a name that is there replaces its file.
    """
    spark = df.sparkSession
    rows = staged(df.withColumn(samples, F.col(samples).cast("array<float>")))
    spark.dataSource.register(WavFiles)
    named = rows.select(F.col(name).alias("name"), F.col(rate).cast("int").alias("sample_rate"), F.col(samples).alias("samples"))
    named.write.format("quayline_wav").mode("append").option("path", root).save()
    return rows.withColumn("duration_sec", dsp.python_round(F.size(samples) / F.col(rate), 3)).drop(samples)
