"""Tables written once and read several times, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and one process does all."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quayline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder for outputs that nothing needs after this run; removed when the interpreter ends."""
    path = f"{shared_folder(spark)}/quayline/{spark.sparkContext.applicationId}/out-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back, so that what made it runs once; removed when the interpreter ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quayline/{spark.sparkContext.applicationId}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _clean() -> None:
    for spark, path in _made:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended before the interpreter
            return


atexit.register(_clean)
