import csv
import io
import json
import random

import pytest
from pyspark.sql import functions as F

from quayline.sources import readers, sinks, splitting


def files(spark, path):
    return spark.read.format("binaryFile").load(str(path)).select("path", "length")


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", ",", "\n", "\r\n", "[", "]", "{", "}", "é", "a", " ", "b", "日"]) for _ in range(rng.randrange(12)))


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 24])
def test_csv_records_over_any_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(splitting, "BLOCK_BYTES", block)
    monkeypatch.setattr(splitting, "_MORE", 3)
    monkeypatch.setattr(splitting, "MOST_TASKS", 8)
    rng = random.Random(block)
    rows = [["h1", "h2"], *([odd_text(rng), odd_text(rng)] for _ in range(25 if block < 7 else 120))]
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        out = io.StringIO()
        csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(rows)
        (tmp_path / name).write_bytes(out.getvalue().encode()[: -len(end) if name == "a.csv" else None])
    got = splitting.records(files(spark, tmp_path), "csv").orderBy("path", "place").collect()
    assert [next(csv.reader(io.StringIO(r.record, newline=""))) for r in got] == rows * 2
    (tmp_path / "c.csv").write_text('a,"b\nc,d\n')
    with pytest.raises(Exception, match="is not closed"):
        splitting.records(files(spark, tmp_path), "csv").collect()


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 24])
def test_json_elements_over_any_blocks(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(splitting, "BLOCK_BYTES", block)
    monkeypatch.setattr(splitting, "_MORE", 3)
    monkeypatch.setattr(splitting, "MOST_TASKS", 8)
    rng = random.Random(block)
    value = lambda: rng.choice([odd_text(rng), rng.randrange(99), None, [odd_text(rng), [1, {"x": odd_text(rng)}]], {odd_text(rng): odd_text(rng)}])
    wanted = [{"k": value(), odd_text(rng): value()} if rng.random() < 0.9 else value() for _ in range(20 if block < 7 else 150)]
    (tmp_path / "a.json").write_text(json.dumps(wanted, ensure_ascii=False), "utf-8")
    (tmp_path / "b.json").write_text("  \n" + json.dumps(wanted, indent=1) + " \n", "utf-8")
    (tmp_path / "c.json").write_text(" [ ] ")
    (tmp_path / "d.json").write_text("")
    got = splitting.records(files(spark, tmp_path), "json").orderBy("path", "place").collect()
    assert [json.loads(r.record) for r in got] == wanted * 2


@pytest.mark.parametrize("text", ['{"a": 1}', "5", "[1, 2", "[1,, 2]", "[1, 2,]", "[1] [2]", '["a]', "[1}", "[]]"])
@pytest.mark.parametrize("block", [1, 1 << 24])
def test_other_documents_fail(spark, tmp_path, monkeypatch, text, block):
    monkeypatch.setattr(splitting, "BLOCK_BYTES", block)
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="array|empty element|closes nothing"):
        splitting.records(files(spark, tmp_path), "json").collect()


def test_a_long_file_is_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splitting, "BLOCK_BYTES", 1 << 12)
    monkeypatch.setattr(splitting, "MOST_TASKS", 8)
    rows = [{"utterance_id": str(i), "text": 'a "quoted",\nline ' + "x" * (i % 50)} for i in range(3000)]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    read = readers.load_rows(spark, str(tmp_path / "m.json"))
    assert sorted((int(r.utterance_id), r.text) for r in read.collect()) == [(i, r["text"]) for i, r in enumerate(rows)]
    blocks = splitting.records(files(spark, tmp_path / "m.json"), "json").select(F.floor(F.col("place") / (1 << 12)).alias("b"), F.spark_partition_id().alias("p")).distinct().collect()
    assert len({r.b for r in blocks}) > 40 and len({r.p for r in blocks}) > 1
    spark.createDataFrame(rows).select(*[F.lit("x").alias(c) if c not in ("utterance_id", "text") else c for c in readers.UTTERANCES.replace(" string", "").split(", ")]).coalesce(1).transform(lambda df: sinks.write_utterances(df, str(tmp_path / "u")) or df)
    back = readers.load_utterances(spark, str(tmp_path / "u"), 2000).collect()
    assert sorted((int(r.utterance_id), r.text) for r in back) == [(i, r["text"]) for i, r in enumerate(rows[:2000])]


def test_malformed_rows_fail(spark, tmp_path):
    (tmp_path / "m.json").write_text('[{"utterance_id": "1"}, {"utterance_id" "2"}]')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.load_manifest(spark, str(tmp_path / "m.json")).collect()
    (tmp_path / "u.csv").write_text(readers.UTTERANCES.replace(" string", "").replace(", ", ",") + "\n1,2\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        readers.load_utterances(spark, str(tmp_path / "u.csv"), 5).collect()
