"""Readers of manifests, dialogues, utterances and bank documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quayline.operators.ranking import running_total
from quayline.operators.staging import staged
from quayline.sources import splitting
from quayline.sources.stores import seekable

DIALOGUES = "seq bigint, dialogue_id string, event string, intent string, provider string, model string, ship_names array<string>, utterance array<string>"
UTTERANCES = "utterance_id string, dialogue_id string, turn_id string, event string, intent string, provider string, model string, ship_names string, text string"
SCENES = UTTERANCES + ", clean_audio string, clean_duration_sec double, sample_rate int, profile string, audio string, noise_bank string, duration_sec double"
BANK = (
    "source_dir string, target_sr int, items array<struct<source_file:string,start_sec:double,rms_db:double,energy_0_300:double,energy_300_3400:double,"
    "energy_3400_8000:double,energy_8000_plus:double,centroid_hz:double,rolloff95_hz:double,category:string,path:string,duration_sec:double,sample_rate:int>>"
)


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame:
    """One JSON object a line; blank lines are skipped and a malformed one is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def load_dialogues(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """Dialogues in the order of ``seq``; 0 stands for all."""
    rows = read_jsonl(spark, path, DIALOGUES)
    return rows.orderBy("seq").limit(limit) if limit else rows


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length")


def load_manifest(spark: SparkSession, path: str, schema: str | StructType = SCENES) -> DataFrame:
    """The rows of one JSON document that is an array; a malformed one is an error.

    Many tasks read a long document (``splitting``); where the store cannot be read at places, one reads it whole.
    """
    files = _listed(spark, path)
    if not seekable(files):
        return spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(schema).json(path)
    rows = splitting.records(files, "json")
    return rows.select(F.from_json("record", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def load_rows(spark: SparkSession, path: str, schema: str | StructType = SCENES) -> DataFrame:
    """Scene rows from one JSON document (a file named .json) or from JSON lines."""
    return load_manifest(spark, path, schema) if path.endswith(".json") else read_jsonl(spark, path, schema)


def load_utterances(spark: SparkSession, path: str, limit: int = 256) -> DataFrame:
    """A CSV with header, all text. The first ``limit`` rows in the order of the file (of a folder: of its files by name): 0 gives none, unlike elsewhere."""
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "mode": "FAILFAST"}
    files = _listed(spark, path)
    if seekable(files):
        rows = splitting.records(files, "csv").where("place > 0")  # a file begins with its header
        parsed = rows.select("path", "place", F.from_csv("record", UTTERANCES, options).alias("r"))
        return parsed.orderBy("path", "place").limit(limit).select("r.*")
    rows = spark.read.options(header="true", multiLine="true", **options).schema(UTTERANCES).csv(path)
    # quoted line breaks keep a file in one partition, where the id rises with the line
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().alias("__row"))
    return placed.orderBy("__file", "__row").limit(limit).drop("__file", "__row")


def load_bank_items(spark: SparkSession, path: str) -> DataFrame:
    """The items of a bank document with their place in their category, from 0 in document order."""
    items = spark.read.option("multiLine", "true").schema(BANK).json(path).select(F.posexplode("items").alias("pos", "item")).select("pos", "item.*")
    return category_places(items, "category", "pos")


def category_places(items: DataFrame, category: str, order: str, name: str = "category_pos") -> DataFrame:
    """``items`` with their place from 0 in their category, in the order of a unique integer; a large category is many tasks."""
    return running_total(items.withColumn("__one", F.lit(1).cast("bigint")), order, "__one", name, category).drop("__one")


def lookup_items(rows: DataFrame, items: DataFrame, category: str, *key: str | int) -> DataFrame:
    """Each row with one item of its category, chosen by a keyed hash modulo the category's size: an equi-join.

    A category without items is an error. The sizes are staged, so the planner knows whether they fit a broadcast, and can split
    the rows of a common category if they do not; an item is met by category and place.
    """
    from quayline.functions.text import hash_number

    sizes = staged(items.groupBy(F.col("category").alias("__c")).agg(F.count("*").alias("__n")))
    sized = rows.join(sizes, F.col(category) == F.col("__c"), "left")
    known = F.coalesce("__n", F.raise_error(F.concat(F.lit("no items of "), F.col(category))).cast("bigint"))
    chosen = sized.withColumn("__pos", F.pmod(hash_number(*key), known)).drop("__c", "__n")
    named = items.select(F.col("category").alias("__c"), F.col("category_pos").alias("__p"), F.col("path").alias("item_path"))
    return chosen.join(named, (F.col(category) == F.col("__c")) & (F.col("__pos") == F.col("__p"))).drop("__c", "__p", "__pos")
