"""Whole-word matches of a global roster without comparing every row with every name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import quayline

from quayline.functions.text import normalize_text

cloudpickle.register_pickle_by_value(quayline)

try:
    import ahocorasick
except ImportError:  # then names are met by the join
    ahocorasick = None

#: Characters of names that an automaton may hold: some 100 bytes for each, in every task.
AUTOMATON_CHARS = 1 << 20


def roster_matches(docs: DataFrame, roster: DataFrame, ident: str, text: str = "text", name: str = "name") -> DataFrame:
    """(ident, name) of every name that stands in a document's normalized text.

    Names of at most AUTOMATON_CHARS characters in all are sent to the tasks, each of which finds them in one walk over every
    text; beyond that they are met in a join. Rows with a null ``ident`` match nothing, nor do names without letters or digits.
    """
    names = roster.select(name, normalize_text(name).alias("__key")).where("__key != ''")
    chars = names.agg(F.coalesce(F.sum(F.length("__key") + 2), F.lit(0)).alias("n")).first()["n"]
    return found_by_automaton(docs, names, ident, text, name) if ahocorasick and chars <= AUTOMATON_CHARS else found_by_join(docs, names, ident, text, name)


def found_by_automaton(docs: DataFrame, names: DataFrame, ident: str, text: str, name: str) -> DataFrame:
    """Matches of names (name, __key), which must be few: an automaton of the keys walks over the texts, which are not shuffled."""
    known: dict[str, list[str]] = {}
    for row in names.distinct().collect():
        known.setdefault(row["__key"], []).append(row[name])
    shared = docs.sparkSession.sparkContext.broadcast(known)
    plain = docs.where(F.col(ident).isNotNull()).select(ident, F.concat(F.lit(" "), normalize_text(text), F.lit(" ")).alias("__text"))
    schema = docs.select(ident, F.lit("").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for key in shared.value:
            automaton.add_word(f" {key} ", key)
        automaton.make_automaton()
        for batch in batches:
            at, found = [], []
            for i, said in enumerate(batch.column("__text").to_pylist() if shared.value else ()):
                # a word's spaces belong to both neighbours: matches may overlap
                for key in {key for _, key in automaton.iter(said or "")}:
                    found += shared.value[key]
                    at += [i] * len(shared.value[key])
            yield pa.RecordBatch.from_arrays([batch.column(ident).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[ident, name])

    return plain.mapInArrow(run, schema).distinct()


def found_by_join(docs: DataFrame, names: DataFrame, ident: str, text: str, name: str) -> DataFrame:
    """The same for any number of names.

    Words that some name begins with are cut out with the words that follow, once for each length that names with this
    first word have, and these runs meet the whole names in an equi-join: a name meets only texts that hold it, however
    many names share a first word.
    """
    names = names.withColumn("__words", F.split("__key", " "))
    longest = names.agg(F.max(F.size("__words")).alias("n")).first()["n"] or 1
    starts = names.select(F.col("__words")[0].alias("__first"), F.size("__words").alias("__size")).distinct()
    plain = docs.where(F.col(ident).isNotNull()).select(ident, F.split(normalize_text(text), " ").alias("__text"))
    # no run is longer than the longest name, so exploded rows stay short
    at = F.transform("__text", lambda w, i: F.struct(w.alias("__first"), F.slice("__text", i + 1, longest).alias("__run")))
    runs = plain.select(ident, F.explode(at).alias("r")).select(ident, "r.*").join(starts, "__first").where(F.size("__run") >= F.col("__size"))
    said = runs.select(ident, F.array_join(F.slice("__run", 1, F.col("__size")), " ").alias("__key")).distinct()
    return said.join(names.select(name, "__key"), "__key").select(ident, name).distinct()
