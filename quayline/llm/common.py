"""Plumbing shared by the corpus operators: shipping code, durable cuts, checked broadcasts, hashing."""

from __future__ import annotations

import atexit
import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quayline

# Python workers do not inherit the driver's sys.path, so functions of this package travel by value.
cloudpickle.register_pickle_by_value(quayline)

#: Rows and bytes of an Arrow batch sent to Python, whichever is reached first, and rows that Python works on at a time.
BATCH_ROWS, BATCH_BYTES = 400, 32 << 20

_made: list[tuple[SparkSession, str]] = []


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that has set no bounds of its own to BATCH_ROWS rows and BATCH_BYTES.

    Spark reads the bounds when a plan runs, which for a lazy result is after its function has returned, so they stay set;
    at its defaults (10,000 rows, 64 MB) batches of long texts take several hundred MB of an executor.
    """
    for key, bound in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(bound))


def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``BATCH_ROWS`` rows, whatever the session sends at once; no empty ones."""
    for batch in batches:
        for first in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(first, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and one process does all (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quayline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


atexit.register(_clean)


#: Rows that are worth a task and a file where their number is known.
TASK_ROWS = 200_000


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and survives lost executors.

    It is written by the tasks that make it, under Parquet's ``compression``. The table is removed when the interpreter ends, or earlier by ``forget``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quayline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    _made.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    back._quayline_path = path
    return back


def gathered(spark: SparkSession, frames: Iterator[DataFrame], schema: str, name: str) -> DataFrame:
    """The rows of all ``frames``, each written to one durable table before the next is asked for."""
    path = f"{shared_dir(spark)}/quayline/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    for df in frames:
        df.write.mode("append").parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._quayline_path = path
    return back


def held(df: DataFrame, keep: list[DataFrame]) -> DataFrame:
    """``df`` kept on the executors' disks until ``release(keep)``; what a lost executor held is computed again."""
    keep.append(df.persist(StorageLevel.DISK_ONLY))
    return df


def cut(df: DataFrame, rows: int) -> DataFrame:
    """A reliable checkpoint of about ``rows`` rows, in no more files than they fill."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    back = df.coalesce(max(1, -(-rows // TASK_ROWS))).checkpoint()
    back._quayline_path = back._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get()
    _made.append((spark, back._quayline_path))
    return back


def settled(df: DataFrame) -> DataFrame:
    """``cut`` for a result whose rows are not known: computed once at full width, then checkpointed."""
    keep: list[DataFrame] = []
    back = cut(held(df, keep), df.count())
    release(keep)
    return back


def release(keep: list[DataFrame]) -> None:
    for df in keep:
        df.unpersist()
    keep.clear()


def forget(*tables: DataFrame) -> None:
    """Delete durable tables and cuts that no later plan reads."""
    for table in tables:
        path = table._quayline_path
        _remove(table.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def broadcast_if(df: DataFrame, row_bytes: int, items: str | None = None, limit_bytes: int = 24 << 20, known: int | None = None) -> DataFrame:
    """Hint a broadcast of the durable or held table ``df`` only if its measured size fits ``limit_bytes``.

    Size: rows (``known`` if they have been counted) times ``row_bytes``, plus as much for each element of the array
    column ``items``. Otherwise the frame comes back without a hint and the join shuffles.
    """
    units = F.count("*") + (F.coalesce(F.sum(F.size(items)), F.lit(0)) if items else 0)
    rows = df.agg(units.alias("n")).first()["n"] if known is None else known
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


def having(texts: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id the durable or held ``table`` holds, found before any shuffle if its ids fit a broadcast."""
    ids = table.select("doc_id").distinct()
    few = broadcast_if(ids, 16)
    return texts if few is ids else texts.join(few, "doc_id", "left_semi")


def lane(*columns: Column | str, of: int) -> Column:
    """A stable lane from 0 to ``of`` - 1."""
    return F.pmod(F.xxhash64(*columns), F.lit(of)).cast("int")


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordKeys(dict):
    """64-bit keys of byte words, remembered up to a bounded number of words."""

    limit = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word)
        return key

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(keys: np.ndarray, width: int) -> np.ndarray:
    """One mixed 64-bit hash for each run of ``width`` consecutive keys (none if there are fewer)."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # h(i, 2s) = h(i, s) * p^s + h(i + s, s); the binary digits of width say which spans to join
    level, span, power, at, out, left = keys, 1, _PRIME, 0, None, width
    while left:
        if left & 1:
            part = level[at : at + n]
            out = part.copy() if out is None else out * power + part
            at += span
        left >>= 1
        if left:
            level = level[:-span] * power + level[span:]
            span, power = 2 * span, np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF)
    return mix64(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def share(bound: float, total: int, scale: int = 1 << 20) -> int:
    """How many of ``scale`` hash lanes keep about ``bound`` of ``total`` rows."""
    return scale if total <= bound else max(1, math.floor(scale * bound / total))
