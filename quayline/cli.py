"""The seven programs as commands: ``python -m quayline PROGRAM --flag value``. Flags and defaults are those of SURVEY Appendix B."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from functools import partial

from pyspark.sql import SparkSession

from quayline.functions.text import parse_bool
from quayline.plans import pipelines
from quayline.sources import readers

REQUIRED = object()

# The flags of each program with their types and defaults.
_MODEL = {"device": (str, "cuda:0"), "max_new_tokens": (int, 384), "model": (str, "")}
FLAGS: dict[str, dict[str, tuple]] = {
    "select-and-calibrate": {"input": (str, REQUIRED), "output": (str, REQUIRED), "summary": (str, REQUIRED), "discovery": (str, REQUIRED), "confirmation": (str, REQUIRED), "total": (int, 8000), "calibration_rows": (int, 1024), "seed": (int, 20260830)},
    "select-test": {"train": (str, REQUIRED), "candidates": (str, REQUIRED), "output": (str, REQUIRED), "summary": (str, REQUIRED), "total": (int, 2000), "seed": (int, 20260830)},
    "paired-views": {"input": (str, REQUIRED), "output_prefix": (str, REQUIRED)},
    "noise-bank": {
        "source_dir": (str, REQUIRED), "output_dir": (str, "outputs/vhf_noise_bank"), "target_sr": (int, 24_000), "files": (int, 12), "windows_per_file": (int, 24), "window_sec": (float, 4.0),
        "max_per_category": (int, 128), "tail_files": (int, 2), "max_tail_events": (int, 128),
    },
    "utterances-to-scenes": {
        "utterances": (str, "outputs/vhf_scene/utterances_256.csv"), "output_dir": (str, "outputs/vhf_scene"), "clean_dir": (str, ""), "max_utterances": (int, 256), "batch_size": (int, 8), "profiles": (str, "all"),
        "noise_bank": (str, ""), "seed": (int, 20260701), **_MODEL,
    },
    "dialogues-to-scenes": {
        "dialogues": (str, "outputs/llm_vhf_dialogues/dialogues.jsonl"), "output_dir": (str, "outputs/step2_tts_vhf"), "clean_dir": (str, ""), "noise_bank": (str, "outputs/vhf_noise_bank"), "profiles": (str, "all"),
        "max_dialogues": (int, 0), "max_utterances": (int, 0), "batch_size": (int, 8), "seed": (int, 20260701), "start_utterance_id": (int, 1), "shard_count": (int, 1), "shard_index": (int, 0), **_MODEL,
    },
    "label-and-split": {
        "manifest": (str, "outputs/step2_tts_vhf_h100/manifest.json"), "output_dir": (str, "outputs/step3_asr"), "seed": (int, 20260701), "split_key": (str, "dialogue_id"), "max_groups": (int, 0), "holdout_min_group_id": (int, 0),
        "bias": (parse_bool, False), "bias_negative_count": (int, 4), "vhf_error_ratio": (float, 0.22),
    },
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quayline")
    programs = top.add_subparsers(dest="program", required=True)
    for name, flags in FLAGS.items():
        own = programs.add_parser(name)
        for flag, (kind, default) in flags.items():
            more = {"required": True} if default is REQUIRED else {"default": default}
            choices = ("utterance_id", "dialogue_id") if flag == "split_key" else None
            own.add_argument(f"--{flag.replace('_', '-')}", type=kind, choices=choices, **more)
    return top


def _voice(given: dict) -> dict:
    """The model named by --model as MODULE:FUNCTION, which takes device and max_new_tokens beside the texts."""
    device, most, name = given.pop("device"), given.pop("max_new_tokens"), given.pop("model")
    if ":" not in name:
        raise SystemExit("--model must name a speech model as MODULE:FUNCTION")
    module, function = name.split(":")
    return {"model": partial(getattr(importlib.import_module(module), function), device=device, max_new_tokens=most)}


def _bank(spark: SparkSession, given: dict) -> dict:
    return {"bank": pipelines.load_bank(spark, given["noise_bank"])} if given["noise_bank"] else {}


def _programs(spark: SparkSession, given: dict) -> dict[str, Callable]:
    rows = lambda flag: readers.read_jsonl(spark, given.pop(flag))
    return {
        "select-and-calibrate": lambda: pipelines.select_and_calibrate(rows("input"), summary_path=given.pop("summary"), **given),
        "select-test": lambda: pipelines.select_test(rows("train"), rows("candidates"), summary_path=given.pop("summary"), **given),
        "paired-views": lambda: pipelines.write_paired_views(rows("input"), **given),
        "noise-bank": lambda: pipelines.build_noise_bank(spark, **given),
        "utterances-to-scenes": lambda: pipelines.utterances_to_scenes(spark, **_voice(given), **_bank(spark, given), **given),
        "dialogues-to-scenes": lambda: pipelines.dialogues_to_scenes(spark, **_voice(given), **_bank(spark, given), **given),
        "label-and-split": lambda: pipelines.label_and_split(spark, readers.load_rows(spark, given.pop("manifest")), **given),
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one program; returns the rows of its result."""
    given = vars(parser().parse_args(argv))
    program = given.pop("program")
    return _programs(spark or SparkSession.builder.appName("quayline").getOrCreate(), given)[program]().count()
