"""Sources, sinks, end-to-end programs and streams on small generated inputs."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.functions.kernels import features
from quayline.functions.profiles import NAMES as PROFILE_NAMES
from quayline.operators import reshape
from quayline.plans import pipelines
from quayline.sources import readers, sinks, wav
from quayline.streaming import live

DIALOGUES = [
    {"seq": 0, "dialogue_id": "1", "event": "overtaking", "intent": "request", "provider": "p", "model": "m", "ship_names": ["Aurora Star", "Arrow Star", "Knight Queen"], "utterance": ["Aurora Star, this is Knight Queen, over.", 'Go "ahead", \n please. ']},
    {"seq": 1, "dialogue_id": "2", "event": "berthing", "intent": "report", "provider": "p", "model": "m", "ship_names": ["Ocean Zebra"], "utterance": []},
    {"seq": 2, "dialogue_id": "3", "event": "berthing", "intent": "report", "provider": "p", "model": "m", "ship_names": ["Pacific  Vicky", " ", "Ocean Zebra"], "utterance": ["PACIFIC-VICKY, channel 12."]},
]


def tones(texts, rate=24_000):
    """A tone for each text whose pitch and length depend on the text alone."""
    return [(0.3 * np.sin(2 * np.pi * (180 + sum(map(ord, t)) % 400) * np.arange(int(rate * (0.3 + 0.06 * len(t)))) / rate)).astype(np.float32) for t in texts]


@pytest.fixture()
def dialogues(tmp_path):
    path = tmp_path / "dialogues.jsonl"
    path.write_text("\n\n".join(json.dumps(d) for d in DIALOGUES) + "\n")
    return str(path)


def test_flatten_and_shards(spark, dialogues):
    rows = readers.load_dialogues(spark, dialogues)
    whole = [(r.utterance_id, r.dialogue_id, r.turn_id) for r in reshape.flatten_dialogues(rows).orderBy("utterance_id").collect()]
    assert whole == [("1", "1", "1"), ("2", "1", "2"), ("3", "3", "1")]
    parts = [[r.utterance_id for r in reshape.flatten_dialogues(rows, shard_count=2, shard_index=i).collect()] for i in (0, 1)]
    assert [sorted(p) for p in parts] == [["1", "3"], ["2"]]
    assert reshape.flatten_dialogues(rows, max_dialogues=1).count() == 2
    with pytest.raises(ValueError):
        reshape.flatten_dialogues(rows, shard_count=2, shard_index=2)
    assert readers.load_dialogues(spark, dialogues, 2).count() == 2


def test_malformed_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": "a"}\n{bad\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "id string").collect()


def test_utterance_csv_round_trip(spark, dialogues, tmp_path):
    rows = reshape.flatten_dialogues(readers.load_dialogues(spark, dialogues))
    sinks.write_utterances(rows, str(tmp_path / "u.csv"))
    back = readers.load_utterances(spark, str(tmp_path / "u.csv"), 10)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert readers.load_utterances(spark, str(tmp_path / "u.csv"), 0).count() == 0


def test_utterances_come_in_the_order_of_the_file(spark, tmp_path):
    head = "utterance_id,dialogue_id,turn_id,event,intent,provider,model,ship_names,text"
    (tmp_path / "u.csv").write_text("\n".join([head, *[f"{i},1,1,e,i,p,m,[],t{i}" for i in (9, 2, 7, 1)]]) + "\n")
    assert sorted(r.utterance_id for r in readers.load_utterances(spark, str(tmp_path / "u.csv"), 2).collect()) == ["2", "9"]


def test_byte_digests(spark, tmp_path):
    import hashlib

    sinks.write_jsonl(spark.range(3).coalesce(1), str(tmp_path / "a"))
    rows = sinks.byte_digests(spark, str(tmp_path / "a")).collect()
    for r in rows:
        data = open(r.path.removeprefix("file:"), "rb").read()
        assert (r.length, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert any(r.length for r in rows)


@pytest.mark.parametrize("seekable", [True, False])
def test_clips_and_headers_with_and_without_seeking(spark, tmp_path, monkeypatch, seekable):
    rate, x = 8000, (np.random.default_rng(3).normal(0, 0.1, 8000 * 61)).astype(np.float32)
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.WAV").write_bytes(wav.encode(x, rate))
    if not seekable:
        monkeypatch.setattr(wav, "seekable", lambda files: False)
    found = wav.long_files(spark, str(tmp_path))
    assert [(r.sample_rate, r.n_frames, r.duration_sec) for r in found.collect()] == [(rate, len(x), 61.0)]
    clips = wav.windows(spark, found, str(tmp_path), 5, 4.0).orderBy("start_sec").collect()
    assert [r.start_sec for r in clips] == [0.0, 14.25, 28.5, 42.75, 57.0]
    for r in clips:
        at = int(r.start_sec * rate)
        assert len(r.samples) == 4 * rate and np.abs(np.array(r.samples) - x[at : at + 4 * rate]).max() <= 1 / 32768


def test_command_lines(spark, tmp_path):
    from quayline import cli

    rows = [{"id": f"{p}{i}", "profile": p, "dialogue_id": str(i), "utterance_id": str(i), "positive_entities": [f"n{p}{i}"], "audio": f"o/shard_{i % 8}/{p}{i}.wav", "bias_type": "no_bias", "phoneme_negative_entities": []} for i in range(16) for p in PROFILE_NAMES]
    (tmp_path / "in.jsonl").write_text("\n".join(map(json.dumps, rows)))
    out = {k: str(tmp_path / k) for k in ("output", "summary", "discovery", "confirmation")}
    flags = [x for k, v in out.items() for x in (f"--{k}", v)]
    assert cli.main(["select-and-calibrate", "--input", str(tmp_path / "in.jsonl"), "--total", "64", "--calibration-rows", "8", *flags], spark) == 64
    told = spark.read.json(out["summary"]).first()
    assert told.records == 64 and told.output_digest and all(len(f.sha256) == 64 for f in told.output_files)
    assert cli.main(["paired-views", "--input", out["discovery"], "--output-prefix", str(tmp_path / "views")], spark) == 3
    given = vars(cli.parser().parse_args(["label-and-split", "--bias", "yes"]))
    assert given["bias"] is True and given["vhf_error_ratio"] == 0.22 and given["split_key"] == "dialogue_id"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["select-test", "--train", "x"])


def test_overwrite_policies(spark, tmp_path):
    df = spark.range(3)
    sinks.write_new_jsonl(df, str(tmp_path / "a"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_new_jsonl(df, str(tmp_path / "a"))
    sinks.append_jsonl(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 6
    sinks.write_jsonl(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 3
    assert sinks.digest_of(df) == sinks.digest_of(df.orderBy(F.desc("id")).repartition(3))


def test_wav_codec():
    x = np.sin(np.arange(500) / 9).astype(np.float32) * 0.7
    data = wav.encode(x, 8000)
    back, rate = wav.decode(data)
    assert rate == 8000 and back.shape == (500, 1) and np.abs(back[:, 0] - x).max() <= 1 / 32768
    assert wav.parse_header(data[:64], len(data))["frames"] == 500
    with pytest.raises(ValueError):
        wav.decode(b"nonsense" * 10)


def chunked(x, rate, junk, width=2):
    """A WAV file with a long chunk before its samples."""
    plain = wav.encode(x, rate)
    return plain[:36] + b"JUNK" + junk.to_bytes(4, "little") + b"j" * (junk + junk % 2) + plain[36:]


def test_headers_of_any_length(spark, tmp_path):
    x = (np.arange(5000) % 100 / 128).astype(np.float32)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.WAV").write_bytes(chunked(x, 1000, 70_001))
    (tmp_path / "in/b.WAV").write_bytes(wav.encode(x[:0], 1000))
    told = {r.path[-5:]: (r.n_frames, r.duration_sec) for r in wav.probe(spark, str(tmp_path / "in")).collect()}
    assert told == {"a.WAV": (5000, 5.0), "b.WAV": (0, 0.0)}
    (tmp_path / "in/c.WAV").write_bytes(b"RIFF1234WAVEfmt ")
    with pytest.raises(Exception, match="without samples|unpack|buffer"):
        wav.probe(spark, str(tmp_path / "in")).collect()


def test_frames_are_the_same_over_any_ranges(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    parts = {"a.wav": rng.normal(0, 0.2, 4321), "b.wav": rng.normal(0, 0.2, 7), "c.WAV": rng.normal(0, 0.2, 0), "d.wav": rng.normal(0, 0.2, 1000)}
    for i, (name, x) in enumerate(parts.items()):
        (tmp_path / name).write_bytes(chunked(x, 1000, 777) if i % 2 == 0 else wav.encode(x, 1000))
    want = {(name, k): np.clip(np.rint(x[k * 50 : k * 50 + 50] * 32768), -32768, 32767) / 32768 for name, x in parts.items() for k in range(-(-len(x) // 50))}
    for size in (64 << 20, 1000, 90):
        monkeypatch.setattr(wav, "RANGE_BYTES", size)
        monkeypatch.setattr(wav, "PIECE_BYTES", 300)
        df = wav.frames(spark, str(tmp_path), seconds=0.05)
        got = {(r.path.rpartition("/")[2], r.frame_idx): r.samples for r in df.collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], v, atol=1e-7) for k, v in want.items())
    assert df.rdd.getNumPartitions() > 20
    only = wav.frames(spark, str(tmp_path), seconds=0.05, only=[f"file:{tmp_path}/d.wav"])
    assert {r.path.rpartition("/")[2] for r in only.collect()} == {"d.wav"}


def test_files_beyond_two_gigabytes(spark, tmp_path):
    # a sparse file of 2.4 GB: eight channels of 24 bits
    head = bytearray(wav.encode(np.zeros(0), 50_000)[:36])
    head[22:24], head[32:34], head[34:36] = (8).to_bytes(2, "little"), (24).to_bytes(2, "little"), (24).to_bytes(2, "little")
    frames = 100_000_000
    with open(tmp_path / "big.WAV", "wb") as f:
        f.write(bytes(head) + b"data" + (frames * 24).to_bytes(4, "little"))
        f.truncate(44 + frames * 24)
        f.seek(44 + (frames - 1) * 24)
        f.write(b"\0\0\x40" * 8)
    told = wav.probe(spark, str(tmp_path)).first()
    assert told.n_frames == frames and told.duration_sec == 2000.0
    cut = wav.frames(spark, str(tmp_path), seconds=0.1)
    assert cut.rdd.getNumPartitions() == -(-(44 + frames * 24) // wav.RANGE_BYTES)
    last = wav._Reader({"files": json.dumps([[f"file:{tmp_path}/big.WAV", 44 + frames * 24]]), "seconds": "0.1"})
    batch = list(last.read(last.partitions()[-1]))[-1]
    assert batch.column("frame_idx")[-1].as_py() == frames // 5000 - 1 and batch.column("samples")[-1].as_py()[-1] == 0.5
    assert wav.windows(spark, wav.long_files(spark, str(tmp_path)), str(tmp_path), 2, 0.1).count() == 2


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    @F.udf("array<float>")
    def samples(i):
        if i == 7:
            raise RuntimeError("no clip")
        return [0.25] * i

    rows = spark.range(8).select(F.format_string("x/%d.wav", "id").alias("audio"), F.lit(8000).alias("sample_rate"), samples("id").alias("samples"))
    with pytest.raises(Exception, match="no clip"):
        wav.write(rows, str(tmp_path / "out"))
    assert not os.path.exists(tmp_path / "out") or not os.listdir(tmp_path / "out")
    spark.dataSource.register(wav.WavFiles)
    bad = rows.select(F.col("audio").alias("name"), "sample_rate", "samples").repartition(4)
    with pytest.raises(Exception, match="no clip"):
        bad.write.format("quayline_wav").mode("append").option("path", str(tmp_path / "out")).save()
    assert not os.path.exists(tmp_path / "out") or not os.listdir(tmp_path / "out")
    done = wav.write(rows.where("audio != 'x/7.wav'"), str(tmp_path / "out")).collect()
    assert sorted(os.listdir(tmp_path / "out/x")) == [f"{i}.wav" for i in range(7)] and os.listdir(tmp_path / "out") == ["x"]
    assert {r.audio: r.duration_sec for r in done}["x/6.wav"] == round(6 / 8000, 3)


def test_dialogues_to_paired_views(spark, dialogues, tmp_path):
    out = str(tmp_path / "step2")
    manifest = pipelines.dialogues_to_scenes(spark, dialogues, out, model=tones)
    rows = manifest.collect()
    assert len(rows) == 12 and {r.profile for r in rows} == {"vhf_clear", "vhf_busy", "vhf_weak", "vhf_tail_beep"}
    for r in rows:
        x, rate = wav.decode(open(f"{out}/{r.audio}", "rb").read())
        assert round(len(x) / rate, 3) == r.duration_sec and r.noise_bank is None
    again = pipelines.dialogues_to_scenes(spark, dialogues, out, model=tones)
    assert sorted((r.audio, r.duration_sec) for r in again.collect()) == sorted((r.audio, r.duration_sec) for r in rows)
    labelled = pipelines.label_and_split(spark, again, str(tmp_path / "step3"), bias=True)
    got = {r.id: r for r in labelled.collect()}
    assert len(got) == 12 and got["1_vhf_clear"].positive_entities == ["Aurora Star", "Knight Queen"] and got["1_vhf_clear"].phoneme_negative_entities == ["Arrow Star"]
    assert got["3_vhf_weak"].positive_entities == ["Pacific Vicky"] and got["3_vhf_weak"].reference_text == "PACIFIC-VICKY, channel 12."
    told = pipelines.write_paired_views(labelled, str(tmp_path / "views")).collect()
    assert sorted((r.view, r.n_rows) for r in told) == [("no_prompt", 12), ("true_prompt", 12), ("unsupported_prompt", 12)]


def test_utterances_to_scenes_and_pace(spark, dialogues, tmp_path):
    rows = reshape.flatten_dialogues(readers.load_dialogues(spark, dialogues))
    sinks.write_utterances(rows, str(tmp_path / "u.csv"))
    made = pipelines.utterances_to_scenes(spark, str(tmp_path / "u.csv"), str(tmp_path / "out"), max_utterances=2, profiles="vhf_weak,vhf_clear", model=tones)
    assert sorted((r.utterance_id, r.profile) for r in made.collect()) == [("1", "vhf_clear"), ("1", "vhf_weak"), ("2", "vhf_clear"), ("2", "vhf_weak")]
    assert pipelines.eta_seconds(0, 10, 5.0) is None and pipelines.eta_seconds(2, 10, 5.0) == 20.0


def test_a_model_that_runs_out_of_memory_gets_half_as_much(spark):
    calls = spark.sparkContext.accumulator(0)

    def small(texts):
        calls.add(1)
        if len(texts) > 2 or texts == ["never"]:
            raise MemoryError
        return tones(texts)

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(8)], "id long, text string").coalesce(1)
    got = pipelines.synthesize(rows, small).orderBy("id").collect()
    assert calls.value == 7 and all(np.array_equal(np.float32(r.samples), tones([r.text])[0]) and r.sample_rate == 24_000 for r in got)
    with pytest.raises(Exception, match="MemoryError"):
        pipelines.synthesize(spark.createDataFrame([(1, "never")], "id long, text string"), small).collect()


def test_noise_bank(spark, tmp_path):
    rng = np.random.default_rng(1)
    rate, root = 8000, tmp_path / "src"
    root.mkdir()
    x = rng.normal(0, 1e-4, rate * 62).astype(np.float32)
    for start in range(5, 60, 8):
        x[start * rate : start * rate + 2 * rate] += 0.2 * np.sin(2 * np.pi * 1000 * np.arange(2 * rate) / rate)
        x[(start + 2) * rate + 1600 : (start + 2) * rate + 3200] += 0.6 * np.sin(2 * np.pi * 1500 * np.arange(1600) / rate)
    (root / "a.WAV").write_bytes(wav.encode(x, rate))
    (root / "short.WAV").write_bytes(wav.encode(x[: rate * 10], rate))
    items = pipelines.build_noise_bank(spark, str(root), str(tmp_path / "bank"), target_sr=8000).collect()
    kinds = {r.category for r in items}
    assert "tail_events" in kinds and "bed_static" in kinds
    for r in items:
        clip, own = wav.decode((tmp_path / "bank" / r.path).read_bytes())
        assert own == 8000 and abs(features(clip[:, 0], own)["rms_db"] - r.rms_db) < 6
    bank = pipelines.load_bank(spark, str(tmp_path / "bank"))
    assert len(bank) == len(items)


def test_streams(spark, tmp_path):
    rows = [("s", i, -20.0 if 3 <= i < 15 or 20 <= i < 25 else -60.0) for i in range(40)]
    (tmp_path / "in").mkdir()
    for part in range(4):
        lines = [json.dumps({"series_id": s, "frame_idx": i, "rms_db": v}) for s, i, v in rows[part * 10 : part * 10 + 10]]
        file = tmp_path / "in" / f"{part}.json"
        file.write_text("\n".join(lines))
        os.utime(file, (1_700_000_000 + part,) * 2)  # files come in the order of their times
    stream = live.read_rows(spark, str(tmp_path / "in"), "series_id string, frame_idx bigint, rms_db double", max_files=1)
    query = live.live_runs(stream, -40.0).writeStream.format("memory").queryName("runs").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("SELECT * FROM runs").collect()] == [("s", 3, 15)]
    live.append_rows(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(120)
    live.append_rows(stream, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 40
