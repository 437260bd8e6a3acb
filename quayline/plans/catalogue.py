"""The registered queries of the engine over the driver's tables, and DuckDB SQL for them.

Stand-ins: a document's language or an order's priority is its profile, a customer a dialogue, an order an utterance,
the parts of an order its entities, a user's events a frame series, an embedding a short waveform.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quayline.functions import dsp, text
from quayline.functions.profiles import profile_frame
from quayline.operators import labels, matching, reshape, sampling, series, summary, views
from quayline.operators.staging import scratch, staged
from quayline.plans import oracles
from quayline.sources import readers, sinks, wav
from quayline.sources.readers import lookup_items

LANGS = ("en", "fr", "de", "es")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")
# few enough to be there at the smallest scale, where two hundred parts make most families overlap
SAMPLE_TOTAL, CALIBRATION_ROWS, TRAIN_TOTAL, TEST_TOTAL, SELECTED_TOTAL = 40, 16, 8, 40, 400
HOLDOUT_MIN = 50
RATE = 24_000

_registry: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _registry[f.__name__] = f
    return f


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return balanced_sample(spark, d)


# ---- samples and splits ----


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.balanced_sample(_t(spark, d, "documents").select("doc_id", "lang", "source"), SAMPLE_TOTAL, ident="doc_id", profile="lang", profiles=LANGS)


@_query
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    # the rank spans the sample's few rows only
    order = Window.orderBy(text.sample_key(sampling.SAMPLE_SEED, "doc_id"), F.col("doc_id").cast("string"))
    return _sample(spark, d).select("doc_id", "lang", F.row_number().over(order).cast("bigint").alias("sample_rank"))


@_query
def balanced_sample_summary(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).groupBy("lang").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    families = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.col("l_partkey").cast("string")).alias("positive_entities"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("profile"), F.col("o_custkey").alias("dialogue_id"), F.col("o_orderkey").alias("utterance_id"), F.format_string("out/shard_%d/%d.wav", F.col("o_orderkey") % 9, "o_orderkey").alias("audio"), F.element_at(F.array(*map(F.lit, oracles.BIAS_TYPES)), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("bias_type"))
    return orders.join(families, "id", "left").withColumn("positive_entities", F.coalesce("positive_entities", F.array().cast("array<string>")))


def _calibration(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.calibration_splits(_orders(spark, d), CALIBRATION_ROWS, profiles=PRIORITIES)


@_query
def calibration_discovery(spark: SparkSession, d: str) -> DataFrame:
    return _calibration(spark, d)[0].select("id", "profile")


@_query
def calibration_confirmation(spark: SparkSession, d: str) -> DataFrame:
    return _calibration(spark, d)[1].select("id", "profile")


@_query
def train_remainder(spark: SparkSession, d: str) -> DataFrame:
    selected = sampling.balanced_sample(_orders(spark, d), SELECTED_TOTAL, profiles=PRIORITIES)
    return sampling.remainder(selected, *_calibration(spark, d)).select("id", "profile")


@_query
def heldout_test(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d).withColumn("positive_entities", F.transform("positive_entities", lambda e: F.concat(F.lit(" "), e)))
    train = sampling.balanced_sample(rows, TRAIN_TOTAL, profiles=PRIORITIES)
    return sampling.heldout_test(train, rows, TEST_TOTAL, profiles=PRIORITIES).select("id", "profile", F.col("context_mode").cast("bigint").alias("context_mode"), "context_policy", "counterfactual_pair_type", "no_prompt_source_id")


@_query
def counterfactual_fields(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.counterfactual_fields(_orders(spark, d).select("id", "bias_type"))
    return out.select("id", F.col("context_mode").cast("bigint").alias("context_mode"), "counterfactual_pair_type", "context_policy", F.size("source_frequency_bins").cast("bigint").alias("n_bins"))


def _names(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the names of their parts, every second one with a space behind."""
    lines = _t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    named = lines.join(_t(spark, d, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    padded = F.concat("p_name", F.when(F.col("l_linenumber") % 2 == 0, " ").otherwise(""))
    return named.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(padded).alias("names"), F.sort_array(F.collect_set("p_name")).alias("roster"))


@_query
def entity_family_raw(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("id", _joined(text.family_raw("names")).alias("family"))


@_query
def entity_family_norm(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("id", _joined(text.family_normalized("names")).alias("family"))


@_query
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    return sampling.duplicate_ids(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@_query
def shard_of_path(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).groupBy(text.generation_shard("audio").cast("bigint").alias("shard")).agg(F.count("*").alias("n"))


@_query
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_groups(_t(spark, d, "orders"), "o_custkey")


@_query
def group_split_holdout(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split_groups(_t(spark, d, "orders"), "o_custkey", holdout_min=HOLDOUT_MIN)


def _split_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return sampling.apply_split(orders, sampling.split_groups(orders, "o_custkey"), "o_custkey")


@_query
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    return _split_orders(spark, d).select("o_orderkey", "split")


@_query
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    rows = _split_orders(spark, d)
    by_priority = summary.split_overlaps(rows, "o_orderpriority").select(F.lit("o_orderpriority").alias("key"), "*")
    return by_priority.unionByName(summary.split_overlaps(rows, "o_custkey").select(F.lit("o_custkey").alias("key"), "*"))


@_query
def split_ratios(spark: SparkSession, d: str) -> DataFrame:
    return summary.ratios(_split_orders(spark, d), "split", "o_orderpriority")


# ---- text, keys and labels ----


@_query
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", text.normalize_text("text").alias("normalized"))


def _roster(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ")
    return _t(spark, d, "benchmark").select("item_id", F.concat_ws(" ", words[0], words[1]).alias("name"))


@_query
def phoneme_key(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select(F.col("p_name").alias("name")).union(_roster(spark, d).select("name")).distinct()
    return names.select("name", text.phoneme_key("name").alias("phonemes"))


@_query
def phoneme_similarity(spark: SparkSession, d: str) -> DataFrame:
    # every order's first name against the others of its roster
    pairs = _names(spark, d).select(F.col("roster")[0].alias("a"), F.explode(F.slice("roster", 2, 1 << 30)).alias("b")).distinct()
    return pairs.select("a", "b", text.phoneme_similarity("a", "b").cast("bigint").alias("similarity"))


@_query
def entity_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.roster_matches(_t(spark, d, "documents"), _roster(spark, d).select("name").distinct(), "doc_id")


@_query
def phoneme_map(spark: SparkSession, d: str) -> DataFrame:
    keys = text.key_map("roster")
    pairs = F.transform(F.array_sort(F.map_keys(keys)), lambda n: F.concat(n, F.lit("="), keys[n]))
    return _names(spark, d).select("id", _joined(pairs).alias("phonemes"))


@_query
def phoneme_negatives(spark: SparkSession, d: str) -> DataFrame:
    return _names(spark, d).select("id", _joined(text.phoneme_negatives(F.col("roster"), F.slice("roster", 1, 1), 4)).alias("negatives"))


@_query
def random_negatives(spark: SparkSession, d: str) -> DataFrame:
    key = (sampling.SPLIT_SEED, "id", F.lit("p"), F.lit("neg"))
    return _names(spark, d).select("id", _joined(text.random_negatives(F.col("roster"), F.slice("roster", 1, 1), 4, *key)).alias("negatives"))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """Orders as utterances: two in three name their first part."""
    said = F.when(F.col("id") % 3 == 0, "radio check over").otherwise(F.concat(F.lit("calling "), F.upper(F.col("roster")[0]), F.lit(", over")))
    return _names(spark, d).select(F.col("id").alias("utterance_id"), F.lit("vhf_clear").alias("profile"), said.alias("text"), F.col("roster").alias("ship_names"))


_LISTS = ("positive_entities", "negative_entities", "candidate_entities", "phoneme_negative_entities")


@_query
def bias_fields(spark: SparkSession, d: str) -> DataFrame:
    out = labels.labelled_rows(_spoken(spark, d), bias=True)
    return out.select("id", "bias_type", "context_error_type", "prompt", "text", "reference_text", *[_joined(c).alias(c) for c in _LISTS])


@_query
def unbiased_fields(spark: SparkSession, d: str) -> DataFrame:
    out = labels.labelled_rows(_spoken(spark, d), bias=False)
    return out.select("id", "bias_type", "prompt", *[_joined(c).alias(c) for c in _LISTS])


@_query
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.labelled_rows(_spoken(spark, d), bias=True)
    filled = lambda c: F.count_if(F.size(c) > 0)
    return rows.groupBy("bias_type", "context_error_type").agg(F.count("*").alias("n"), filled("positive_entities").alias("entity_positive_rows"), filled("candidate_entities").alias("entity_candidate_rows"), filled("phoneme_negative_entities").alias("phoneme_negative_rows"))


@_query
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.labelled_rows(_spoken(spark, d).withColumn("dialogue_id", F.col("utterance_id") % 100), bias=True)
    splits = sampling.split_groups(rows, "dialogue_id")
    out = summary.split_summary(sampling.apply_split(rows, splits, "dialogue_id"), splits)
    flat = lambda m: _joined(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.select("split", "groups", "dialogues", "utterances", "records", "entity_positive_rows", "entity_candidate_rows", "phoneme_negative_rows", flat("profiles").alias("profiles"), flat("bias_types").alias("bias_types"), flat("context_error_types").alias("context_error_types"))


@_query
def paired_views(spark: SparkSession, d: str) -> DataFrame:
    out = views.paired_views(labels.labelled_rows(_spoken(spark, d), bias=False))
    return out.select("id", "paired_source_id", "view", F.col("context_mode").cast("bigint").alias("context_mode"), "bias_type", "counterfactual_pair_type", "prompt", _joined("candidate_entities").alias("candidates"), _joined("negative_entities").alias("negatives"))


@_query
def asr_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", text.training_target("text").alias("target"), text.prompt(F.array("role", F.upper("role"))).alias("prompt"))


@_query
def roster_json(spark: SparkSession, d: str) -> DataFrame:
    raw = F.to_json(F.array(F.concat(F.lit("  "), "p_name", F.lit("\t x ")), F.lit("  "), F.col("p_name")))
    names = text.load_names(F.col("raw"), is_json=True)
    return _t(spark, d, "part").select("p_partkey", raw.alias("raw")).select("p_partkey", F.to_json(names).alias("names"))


@_query
def parse_bool(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("quality") == 1, F.when(F.col("doc_id") % 2 == 0, " Yes").otherwise("TRUE")).otherwise(F.when(F.col("doc_id") % 2 == 0, "n").otherwise("0"))
    return _t(spark, d, "labels").groupBy(text.parse_bool_column(said).cast("string").alias("good")).agg(F.count("*").alias("n"))


@_query
def keyed_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", text.hash_number(sampling.SPLIT_SEED, "o_orderkey", F.lit("draw")).alias("draw"))


# ---- dialogues and scenes ----


def _dialogues(spark: SparkSession, d: str) -> DataFrame:
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return turns.select(F.col("conv_id").alias("seq"), F.col("conv_id").alias("dialogue_id"), F.transform("t", lambda x: x["text"]).alias("utterance"), F.array(F.lit("Aurora Star"), F.lit("Arrow")).alias("ship_names"))


@_query
def flatten_turns(spark: SparkSession, d: str) -> DataFrame:
    return reshape.flatten_dialogues(_dialogues(spark, d)).select("utterance_id", "dialogue_id", "turn_id", "ship_names", "text")


@_query
def shard_turns(spark: SparkSession, d: str) -> DataFrame:
    return reshape.flatten_dialogues(_dialogues(spark, d), start=100, shard_count=4, shard_index=1, max_utterances=50).select("utterance_id", "dialogue_id", "turn_id")


@_query
def turn_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = reshape.flatten_dialogues(_dialogues(spark, d)).select(F.col("utterance_id").cast("bigint").alias("uid"))
    return reshape.batches(rows, "uid", 8).groupBy("batch").agg(F.count("*").alias("n"), F.min("uid").alias("first_uid"))


@_query
def profile_cross(spark: SparkSession, d: str) -> DataFrame:
    rows = reshape.flatten_dialogues(_dialogues(spark, d)).select("utterance_id")
    return reshape.profile_scenes(rows, noise_bank="").select("utterance_id", "profile", "audio", "noise_bank", "record_index", "scene_seed")


@_query
def scene_lengths(spark: SparkSession, d: str) -> DataFrame:
    rows = reshape.flatten_dialogues(_dialogues(spark, d)).select("utterance_id", F.length("text").cast("bigint").alias("n_samples")).withColumn("sample_rate", F.lit(RATE))
    return reshape.scene_samples(reshape.profile_scenes(rows), "n_samples", "sample_rate").select("utterance_id", "profile", "scene_samples")


def _listing(spark: SparkSession, d: str) -> DataFrame:
    returned = _t(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.max("l_quantity").alias("clean_duration_sec"))
    return returned.select(text.clean_name("l_orderkey").alias("clean_audio"), "clean_duration_sec", F.lit(RATE).alias("sample_rate"))


@_query
def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    return reshape.pending(_t(spark, d, "orders").select("o_orderkey"), _listing(spark, d), "o_orderkey").select("o_orderkey", "clean_audio")


@_query
def clean_records(spark: SparkSession, d: str) -> DataFrame:
    return reshape.clean_records(_t(spark, d, "orders").select("o_orderkey"), _listing(spark, d), "o_orderkey").select("o_orderkey", "clean_audio", "clean_duration_sec", F.coalesce("sample_rate", F.lit(0)).cast("bigint").alias("sample_rate"))


# ---- series ----


@_query
def noise_class(spark: SparkSession, d: str) -> DataFrame:
    level = F.log10(F.col("value") / 1000.0) * 20
    band = F.get_json_object("props", "$.k").cast("double") / 100
    named = _t(spark, d, "events").where("value > 0").withColumn("category", series.noise_class(level, band)).where("category IS NOT NULL")
    return series.capped(named, "category", "ts", "event_id").select("event_id", "category", F.col("category_index").cast("bigint").alias("category_index"))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, d, "events").select(F.col("user_id").alias("series_id"), (F.row_number().over(order) - 1).cast("bigint").alias("frame_idx"), F.col("value").alias("rms_db"), (F.abs("value") / 100).alias("peak"), F.when(F.col("event_type").isin("purchase", "error"), 900.0).otherwise(600.0).alias("centroid_hz"), F.array("value").alias("samples"))


@_query
def frame_stats(spark: SparkSession, d: str) -> DataFrame:
    six = lambda c: F.round(c, 6).alias(c)
    return series.frame_stats(_frames(spark, d)).select("series_id", "frames", six("floor"), six("median_level"), six("threshold"))


@_query
def active_runs(spark: SparkSession, d: str) -> DataFrame:
    return series.active_runs(_frames(spark, d), least=3).select("series_id", "start_idx", "end_idx")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _frames_and_events(spark, d)[1]


def _frames_and_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # numbering the frames needs a shuffle, and they are read several times
    frames = staged(_frames(spark, d))
    return frames, series.tail_events(frames, series.event_hit(), least=3)


@_query
def tail_events(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d)


@_query
def event_clips(spark: SparkSession, d: str) -> DataFrame:
    clips = series.event_clips(*_frames_and_events(spark, d))
    return clips.select("series_id", "end_idx", "event_idx", F.size("samples").cast("bigint").alias("n_frames"), F.round(F.element_at("samples", -1), 6).alias("last_value"))


@_query
def capped_events(spark: SparkSession, d: str) -> DataFrame:
    return series.capped_events(_events(spark, d), "series_id", "end_idx", most=20)


# ---- sources and sinks ----


@_query
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders written as JSON lines, the odd ones appended, and read back."""
    rows, path = _orders(spark, d).select("id", "profile", F.array_sort("positive_entities").alias("positive_entities")), scratch(spark)
    sinks.write_new_jsonl(rows.where("id % 2 = 0"), path)
    sinks.append_jsonl(rows.where("id % 2 = 1"), path)
    back = readers.read_jsonl(spark, path, "id bigint, profile string, positive_entities array<string>")
    return back.select("id", "profile", _joined("positive_entities").alias("entities"))


@_query
def utterance_csv(spark: SparkSession, d: str) -> DataFrame:
    """Turns as an utterance CSV and back, all text and line breaks kept."""
    path = scratch(spark)
    turns = _t(spark, d, "conversations")
    names = ("event", "intent", "provider", "model")
    rows = turns.select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("utterance_id"), F.col("conv_id").cast("string").alias("dialogue_id"), F.col("turn").cast("string").alias("turn_id"), *[F.lit(f'{n} "x", y').alias(n) for n in names], F.lit("[]").alias("ship_names"), F.concat(F.lit(' "a",\n'), F.col("text")).alias("text"))
    sinks.write_utterances(rows, path)
    return readers.load_utterances(spark, path, turns.count()).select("utterance_id", "turn_id", "event", "text")


@_query
def outputs_together(spark: SparkSession, d: str) -> DataFrame:
    """Orders in two files that appear together, by the digests of their bytes."""
    rows, root = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority"), scratch(spark)
    halves = {f"{root}/{name}.jsonl": rows.where(F.col("o_orderkey") % 2 == i).orderBy("o_orderkey") for i, name in enumerate(("even", "odd"))}
    sinks.write_together(spark, halves, f"{root}/journal", single=True)
    files = sinks.byte_digests(spark, f"{root}/*.jsonl")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256")


@_query
def views_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The three views of every order, a folder each, replaced once and read back."""
    path, three = scratch(spark), views.paired_views(labels.labelled_rows(_spoken(spark, d), bias=False)).select("id", "view", "prompt")
    sinks.write_views(three.limit(10), path)
    sinks.write_views(three, path)
    back = readers.read_jsonl(spark, path, "id string, prompt string, view string")
    return back.groupBy("view").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.col("prompt").isNotNull()).alias("prompts"))


@_query
def splits_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Orders by split, a folder each, read back."""
    path = scratch(spark)
    sinks.write_splits(_split_orders(spark, d), path)
    back = readers.read_jsonl(spark, path, "o_orderkey bigint, o_custkey bigint, split string")
    return back.select("o_orderkey", "o_custkey", "split")


@_query
def dialogue_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first dialogues, written as JSON lines that replace others, and read in their order."""
    path = scratch(spark)
    sinks.write_jsonl(_dialogues(spark, d).limit(1), path)
    sinks.write_jsonl(_dialogues(spark, d).withColumn("dialogue_id", F.col("dialogue_id").cast("string")), path)
    first = readers.load_dialogues(spark, path, 25)
    return first.select("seq", "dialogue_id", F.size("utterance").cast("bigint").alias("turns"), _joined("ship_names").alias("names"), F.sha2(_joined("utterance"), 256).alias("said"))


@_query
def bank_document(spark: SparkSession, d: str) -> DataFrame:
    """A bank's items as one JSON document and back, each with its place in its category."""
    path = scratch(spark)
    # a small document, written in the order of one partition
    items = _t(spark, d, "benchmark").repartition(1).sortWithinPartitions("item_id").select(F.col("item_id").cast("string").alias("path"), F.concat(F.lit("c"), F.col("item_id") % 3).alias("category"), (F.col("item_id") / 8).alias("start_sec"))
    sinks.write_document(items, path, "items")
    return readers.load_bank_items(spark, path).select("path", "category", "start_sec", (F.col("category_pos") + 1).cast("bigint").alias("place"))


# ---- signals ----


def _waves(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("samples"))


@_query
def levels(spark: SparkSession, d: str) -> DataFrame:
    rows = _waves(spark, d).withColumn("scaled", dsp.scale("samples", F.col("vec_id") % 7 + 1))
    return rows.select("vec_id", F.round(dsp.rms_db("scaled"), 6).alias("rms_db"), F.round(dsp.peak("scaled"), 6).alias("peak"))


@_query
def set_rms(spark: SparkSession, d: str) -> DataFrame:
    out = dsp.set_rms("samples", -36.0)
    return _waves(spark, d).select("vec_id", F.round(F.element_at(out, 1), 6).alias("first_sample"), F.round(dsp.peak(out), 6).alias("peak"))


@_query
def saturate_clip(spark: SparkSession, d: str) -> DataFrame:
    out = dsp.clip(dsp.saturate("samples", 8.0), 0.9)
    return _waves(spark, d).select("vec_id", F.round(F.element_at(out, 1), 6).alias("first_sample"), F.round(dsp.peak(out), 6).alias("peak"))


@_query
def crop_tile_window(spark: SparkSession, d: str) -> DataFrame:
    crop, tiled, part = dsp.crop_head("samples", F.col("vec_id") % 10, 8000), dsp.tile("samples", 150), dsp.window("samples", 60, 10)
    six = lambda c: F.round(c.cast("double"), 6)
    return _waves(spark, d).select("vec_id", F.size(crop).cast("bigint").alias("n_cropped"), six(F.element_at(crop, 1)).alias("first_cropped"), F.size(tiled).cast("bigint").alias("n_tiled"), six(F.element_at(tiled, -1)).alias("last_tiled"), F.size(part).cast("bigint").alias("n_window"))


@_query
def mono_mix(spark: SparkSession, d: str) -> DataFrame:
    mixed = dsp.mono(F.array(F.col("samples"), F.reverse("samples")))
    return _waves(spark, d).select("vec_id", F.round(F.element_at(mixed, 1), 6).alias("first_sample"), F.size(mixed).cast("bigint").alias("n"))


@_query
def wave_frames(spark: SparkSession, d: str) -> DataFrame:
    cut = dsp.frames(_waves(spark, d), "samples", 10)
    return cut.select("vec_id", F.col("frame_idx").cast("bigint").alias("frame_idx"), F.size("samples").cast("bigint").alias("n"), F.round(dsp.rms_db("samples"), 6).alias("rms_db"))


@_query
def spectral_features(spark: SparkSession, d: str) -> DataFrame:
    rows = dsp.spread(_waves(spark, d)).withColumn("sample_rate", F.lit(RATE)).withColumn("f", dsp.feature_struct("samples", "sample_rate"))
    digits = {"centroid_hz": 3, "rolloff95_hz": 3}
    return rows.select("vec_id", *[F.round(F.col(f"f.{name}"), digits.get(name, 6)).alias(name) for name in dsp.FEATURES])


@_query
def noise_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "embeddings").select("vec_id", F.concat(F.lit("c"), F.col("label")).alias("category"))
    items = readers.category_places(rows, "category", "vec_id").select("category", "category_pos", F.col("vec_id").cast("string").alias("path"))
    return lookup_items(rows, items, "category", sampling.SPLIT_SEED, F.lit("bank"), "vec_id").select("vec_id", "category", "item_path")


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    # dealt while they are short: tiled, times the profiles, they are 150 times as large, and a shuffle would sort that in the heap
    tiled = dsp.spread(_waves(spark, d)).select("vec_id", dsp.tile(F.col("samples").cast("array<float>"), 2400).alias("samples")).withColumn("sample_rate", F.lit(RATE))
    # four profile rows
    return tiled.crossJoin(F.broadcast(profile_frame(spark))).withColumn("scene_seed", F.col("vec_id") * 100 + F.col("profile_index"))


def _measured(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "profile", F.size("samples").cast("bigint").alias("n_samples"), (dsp.peak("samples") <= 0.9801).alias("within"))


@_query
def augment(spark: SparkSession, d: str) -> DataFrame:
    return _measured(dsp.augment(_scenes(spark, d)))


def _rounded(*places: int) -> list[Column]:
    """Samples at these places, to four digits; zero has no sign."""
    return [(F.round(F.col("samples")[i].cast("double"), 4) + F.lit(0.0)).alias(f"sample_{i}") for i in places]


@_query
def add_tail(spark: SparkSession, d: str) -> DataFrame:
    out = dsp.add_tail(_scenes(spark, d))
    return out.select("vec_id", "profile", F.size("samples").cast("bigint").alias("n_samples"), *[F.round(F.col("samples")[i].cast("double"), 6).alias(f"sample_{i}") for i in (0, 2399)])


@_query
def add_noises(spark: SparkSession, d: str) -> DataFrame:
    """Noise at the profile's ratio, measured from what it added; then the residual noise and the dropouts over it."""
    scenes = _scenes(spark, d).withColumn("clean", F.col("samples"))
    noisy = dsp.add_noise(scenes).withColumn("added", F.zip_with("samples", "clean", lambda a, b: a - b))
    noisy = noisy.withColumn("snr", F.round(dsp.rms_db("clean") - dsp.rms_db("added"), 1)).drop("clean", "added")
    done = dsp.add_residual_noise_and_dropouts(noisy)
    return done.select("vec_id", "profile", F.size("samples").cast("bigint").alias("n_samples"), "snr")


@_query
def resample(spark: SparkSession, d: str) -> DataFrame:
    rows = _waves(spark, d).select("vec_id", dsp.tile(F.col("samples").cast("array<float>"), 1000).alias("samples")).withColumn("sample_rate", F.lit(44_100))
    out = rows.withColumn("samples", dsp.resampled("samples", "sample_rate", RATE))
    return out.select("vec_id", F.size("samples").cast("bigint").alias("n_samples"), *_rounded(10, 272, 540))


@_query
def bandpass(spark: SparkSession, d: str) -> DataFrame:
    """Every wave through every profile's band."""
    tiled = _waves(spark, d).select("vec_id", dsp.tile(F.col("samples").cast("array<float>"), 240).alias("samples")).withColumn("sample_rate", F.lit(RATE))
    bands = profile_frame(spark).select("profile", "low_hz", "high_hz")
    # four profile rows
    out = tiled.crossJoin(F.broadcast(bands)).withColumn("samples", dsp.bandpassed("samples", "sample_rate", "low_hz", "high_hz"))
    return out.select("vec_id", "profile", F.size("samples").cast("bigint").alias("n_samples"), *_rounded(60, 120))


# ---- recordings ----


def _recordings(spark: SparkSession, d: str) -> str:
    """A folder with a WAV file for each hundred vectors, one after the other."""
    hundreds = _t(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 100).alias("k")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    files = hundreds.select(F.format_string("part/%03d.WAV", "k").alias("audio"), F.lit(RATE).alias("sample_rate"), F.flatten(F.transform("x", lambda v: v["embedding"])).alias("samples"))
    root = scratch(spark)
    wav.write(files, root)
    return root


def _file() -> Column:
    return F.element_at(F.split("path", "/"), -1).alias("file")


@_query
def wav_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of 250 samples of recordings, read in byte ranges."""
    cut = wav.frames(spark, _recordings(spark, d), samples=250)
    return cut.select(_file(), "sample_rate", "frame_idx", F.size("samples").cast("bigint").alias("n"), F.round(F.col("samples")[0].cast("double"), 6).alias("first_sample"), F.round(F.element_at("samples", -1).cast("double"), 6).alias("last_sample"))


@_query
def wav_frames_of_two(spark: SparkSession, d: str) -> DataFrame:
    """Frames of the first two recordings that last a twentieth of a second; the others are not opened for samples."""
    root = _recordings(spark, d)
    wanted = [r["path"] for r in wav.long_files(spark, root, limit=2, least=0.05).collect()]
    return wav.frames(spark, root, samples=1000, only=wanted).groupBy(_file()).agg(F.count("*").alias("frames"), F.sum(F.size("samples")).alias("samples"))


@_query
def wav_decode(spark: SparkSession, d: str) -> DataFrame:
    """Whole recordings."""
    held = wav.read(spark, _recordings(spark, d))
    samples = F.transform("samples", lambda v: F.round(v * 32768).cast("bigint"))
    return held.select(_file(), "sample_rate", F.size("samples").cast("bigint").alias("n"), F.sha2(F.array_join(samples, ","), 256).alias("sha256"))


@_query
def wav_probe(spark: SparkSession, d: str) -> DataFrame:
    told = wav.probe(spark, _recordings(spark, d))
    return told.select(_file(), "sample_rate", F.col("channels").cast("bigint").alias("channels"), "n_frames", F.round("duration_sec", 9).alias("duration_sec"))


@_query
def wav_windows(spark: SparkSession, d: str) -> DataFrame:
    """Three clips of 10 ms of each of the first five recordings."""
    root = _recordings(spark, d)
    clips = wav.windows(spark, wav.long_files(spark, root, limit=5, least=0.0), root, 3, 0.01)
    return clips.select(_file(), F.round("start_sec", 6).alias("start_sec"), F.size("samples").cast("bigint").alias("n"), F.round(F.col("samples")[0].cast("double"), 6).alias("first_sample"))


# ---- digests ----


@_query
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return summary.content_digest(_t(spark, d, "documents").select("doc_id", "lang", "source"))


@_query
def priority_counter(spark: SparkSession, d: str) -> DataFrame:
    counts = summary.counter_map(_t(spark, d, "orders"), "o_orderpriority", "counts")
    return counts.select(_joined(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))).alias("counts"))


@_query
def selection_summary(spark: SparkSession, d: str) -> DataFrame:
    return summary.selection_summary(_orders(spark, d)).select("records", "dialogues", "utterances", "entities")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registry)


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
