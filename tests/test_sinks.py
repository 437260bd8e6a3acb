import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from quayline.operators import matching, summary
from quayline.sources import sinks


def outputs(tmp_path, names=("a", "b", "c")):
    return [str(tmp_path / "out" / f"{n}.jsonl") for n in names]


def left(tmp_path):
    return sorted(f"{os.path.relpath(d, tmp_path)}/{f}" for d, _, files in os.walk(tmp_path) for f in files if not f.startswith((".", "_")))


@pytest.mark.parametrize("single", [True, False])
def test_outputs_appear_together(spark, tmp_path, single):
    paths, rows = outputs(tmp_path), spark.range(300).repartition(3)
    journal = str(tmp_path / "journal")
    sinks.write_together(spark, {p: rows.where(F.col("id") % 3 == i).orderBy(F.desc("id")) for i, p in enumerate(paths)}, journal, single)
    for i, p in enumerate(paths):
        assert os.path.isfile(p) == single
        assert sorted(r.id for r in spark.read.json(p).collect()) == list(range(i, 300, 3))
        if single:
            assert [json.loads(line)["id"] for line in open(p)] == list(range(i, 300, 3))[::-1]
    assert not [x for x in left(tmp_path) if "claim" in x or "journal" in x]
    before = left(tmp_path)
    with pytest.raises(FileExistsError, match="PATH_ALREADY_EXISTS"):
        sinks.write_together(spark, {str(tmp_path / "out/new.jsonl"): rows, paths[1]: rows}, journal, single)
    assert left(tmp_path) == before


def test_a_failure_in_the_third_leaves_none(spark, tmp_path):
    paths = outputs(tmp_path)
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="broken row"):
        sinks.write_together(spark, {paths[0]: spark.range(2), paths[1]: spark.range(2), paths[2]: broken}, str(tmp_path / "journal"))
    assert left(tmp_path) == []
    sinks.write_together(spark, {paths[0]: spark.range(2)}, str(tmp_path / "journal"))


def test_of_two_runs_one_is_refused(spark, tmp_path):
    path = outputs(tmp_path)[0]
    os.makedirs(os.path.dirname(path))
    with open(f"{path}.claim", "w") as f:
        f.write("another run")
    with pytest.raises(FileExistsError, match="another run"):
        sinks.write_together(spark, {path: spark.range(2)}, str(tmp_path / "journal"))
    assert open(f"{path}.claim").read() == "another run"


def test_what_a_lost_driver_left_is_ended(spark, tmp_path, monkeypatch):
    paths, real = outputs(tmp_path), sinks._Files.rename
    calls = []

    def lost(self, source, target):
        calls.append(target)
        if len(calls) == 2:
            raise KeyboardInterrupt
        real(self, source, target)

    monkeypatch.setattr(sinks._Files, "rename", lost)
    with pytest.raises(KeyboardInterrupt):
        sinks.write_together(spark, {p: spark.range(3) for p in paths}, str(tmp_path / "journal"))
    monkeypatch.setattr(sinks._Files, "rename", real)
    assert [os.path.exists(p) for p in paths] == [True, False, False]
    assert sinks.recover(spark, str(tmp_path / "journal")) == 1 and sinks.recover(spark, str(tmp_path / "journal")) == 0
    assert all(spark.read.json(p).count() == 3 for p in paths) and not [x for x in left(tmp_path) if "claim" in x]


def test_digests_of_bytes(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/small").write_bytes(b"abc")
    with open(tmp_path / "x/large", "wb") as f:  # beyond what one value can hold
        f.truncate((2 << 30) + 5)
    got = {r.path[-5:]: (r.length, r.sha256) for r in sinks.byte_digests(spark, str(tmp_path / "x")).collect()}
    assert got["small"] == (3, hashlib.sha256(b"abc").hexdigest())
    assert got["large"][0] == (2 << 30) + 5 and len(got["large"][1]) == 64


def test_automaton_and_join_agree(spark):
    docs = spark.createDataFrame([(1, "Aurora Star calling, AURORA  star!"), (2, "a a a b"), (3, None), (4, ""), (None, "aurora star"), (5, "star-aurora x y"), (1, "b a")], "id long, text string")
    names = spark.createDataFrame([("Aurora Star",), ("aurora-star",), ("a a",), ("A",), ("a b",), ("",), ("--",), (None,), ("star",), ("y",)], "name string")
    keys = names.select("name", matching.normalize_text("name").alias("__key")).where("__key != ''")
    found = [sorted(map(tuple, f(docs, keys, "id", "text", "name").collect())) for f in (matching.found_by_automaton, matching.found_by_join)]
    assert found[0] == found[1] and (1, "aurora-star") in found[0] and (2, "a a") in found[0] and (2, "a b") in found[0]
    whole = matching.roster_matches(docs, names, "id")
    assert sorted(map(tuple, whole.collect())) == found[0]
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert ("Generate explode" in plan) == (matching.ahocorasick is None)
    assert matching.found_by_automaton(docs, keys.limit(0), "id", "text", "name").count() == 0


def test_distinct_counts_write_no_row_twice(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", None), (1, "b", "x"), (2, None, None)], "g int, u string, v string")
    got = summary.distinct_counts(df, {"us": "u", "vs": "v"}, "g")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1), (2, 0, 0)]
    assert tuple(summary.distinct_counts(df, {"us": "u", "vs": "v"}).first()) == (2, 1)
    assert "Expand" not in got._jdf.queryExecution().executedPlan().toString()
