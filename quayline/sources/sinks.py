"""Sinks with their overwrite policies. Spark's commit protocol makes each write all or nothing, ``write_together`` several at once."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quayline

from quayline.operators.reshape import UTTERANCE_FIELDS
from quayline.operators.summary import content_digest
from quayline.sources.stores import open_at, seekable

cloudpickle.register_pickle_by_value(quayline)


def write_new_jsonl(df: DataFrame, path: str) -> None:
    """Refuse if ``path`` is there."""
    df.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace what is there."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_views(df: DataFrame, path: str) -> None:
    """One folder for each view of ``paired_views``."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("view").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder for each split."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("split").json(path)


def write_utterances(df: DataFrame, path: str) -> None:
    """CSV with a header and the fixed fields; white space at the ends of a field is kept."""
    options = {"header": "true", "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "emptyValue": ""}
    df.select(*UTTERANCE_FIELDS).write.mode("overwrite").options(**options).csv(path)


def document(df: DataFrame, name: str | None = None) -> DataFrame:
    """One row with a JSON document: the only row of ``df``, or all its rows as the array ``name``."""
    row = F.struct(*df.columns)
    if name is None:
        return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value"))
    return df.groupBy().agg(F.collect_list(row).alias(name)).select(F.to_json(F.struct(name), {"ignoreNullFields": "false"}).alias("value"))


def write_document(df: DataFrame, path: str, name: str | None = None) -> None:
    """A small JSON document (a summary, a bank's items) as one text file."""
    document(df, name).coalesce(1).write.mode("overwrite").text(path)


class _Files:
    """The few calls of Hadoop's file systems that a commit needs, so that any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.conf), where

    def exists(self, path: str) -> bool:
        fs, where = self.at(path)
        return fs.exists(where)

    def create(self, path: str, text: str) -> None:
        """A new file; refused if there is one."""
        fs, where = self.at(path)
        out = fs.create(where, False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, where = self.at(path)
        stream = fs.open(where)
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def rename(self, source: str, target: str) -> None:
        fs, where = self.at(source)
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        if to.getParent() is not None:
            fs.mkdirs(to.getParent())
        if fs.exists(to) or not fs.rename(where, to):
            raise FileExistsError(f"{target} cannot be given its content")

    def remove(self, path: str) -> None:
        fs, where = self.at(path)
        fs.delete(where, True)

    def merge(self, folder: str, target: str) -> None:
        """The part files of ``folder`` one after the other as one file, copied in small pieces."""
        fs, where = self.at(folder)
        out = fs.create(self.jvm.org.apache.hadoop.fs.Path(target), False)
        for name in sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-")):
            part = fs.open(self.jvm.org.apache.hadoop.fs.Path(where, name))
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            part.close()
        out.close()

    def names(self, folder: str) -> list[str]:
        fs, where = self.at(folder)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def write_together(spark: SparkSession, outputs: dict[str, DataFrame], journal: str, single: bool = False) -> None:
    """JSON lines for every path of ``outputs``, in the order of each frame's partitions: all of them appear, or none does.

    Every path is claimed by an exclusive create beside it, so of two runs one is refused, as is a run that meets an output. Then
    all outputs are written below ``journal``, a folder for what is under way; when all are there, a list of renames is written
    and they are carried out. A failure before that list undoes everything; after it, ``recover`` ends what a lost driver left.
    ``single`` makes each output one file, for sizes that one writer should handle; else it is a folder.
    """
    files, run = _Files(spark), uuid.uuid4().hex
    claims: list[str] = []
    moves: list[list[str]] = []
    try:
        for path in outputs:
            try:
                files.create(f"{path}.claim", run)
            except Exception as refused:
                raise FileExistsError(f"{path} is being written by another run") from refused
            claims.append(f"{path}.claim")
            if files.exists(path):
                raise FileExistsError(f"PATH_ALREADY_EXISTS: {path}")
        for i, (path, df) in enumerate(outputs.items()):
            part = f"{journal}/{run}/{i}"
            df.write.option("ignoreNullFields", "false").json(part)
            if single:
                files.merge(part, f"{part}.file")
            moves.append([f"{part}.file" if single else part, path])
        files.create(f"{journal}/{run}.json", json.dumps({"moves": moves, "claims": claims}))
    except BaseException:
        files.remove(f"{journal}/{run}")
        for claim in claims:
            files.remove(claim)
        raise
    recover(spark, journal, run)


def recover(spark: SparkSession, journal: str, run: str | None = None) -> int:
    """Carry out the listed renames of ``run``, or of all runs that a lost driver left below ``journal``; returns how many runs."""
    files, done = _Files(spark), 0
    for name in files.names(journal):
        if name.endswith(".json") and (run is None or name == f"{run}.json"):
            told = json.loads(files.read(f"{journal}/{name}"))
            for source, target in told["moves"]:
                if files.exists(source):
                    files.rename(source, target)
            files.remove(f"{journal}/{name.removesuffix('.json')}")
            for claim in told["claims"]:
                files.remove(claim)
            files.remove(f"{journal}/{name}")
            done += 1
    return done


#: Bytes of a file that are digested at a time.
DIGEST_BYTES = 1 << 20


def byte_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SHA-256 of the bytes of every file that an output consists of.

    A task reads a file of any length in pieces of DIGEST_BYTES; where the store cannot be read at places, Spark brings it whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            digests = []
            for name in batch["path"]:
                digest = hashlib.sha256()
                with open_at(name) as file:
                    while piece := file.read(DIGEST_BYTES):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield batch.assign(sha256=digests)

    if not seekable(files):
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    return files.select("path", "length").mapInPandas(run, "path string, length bigint, sha256 string")


def digest_of(df: DataFrame) -> str:
    """The content digest that summaries record for an output; it does not depend on row order."""
    return content_digest(df).first()["digest"]
