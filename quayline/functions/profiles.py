"""The fixed dimension of channel profiles and of context modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values, one row for each profile in order:
# profile, low_hz, high_hz, snr_db, target_rms_db, drive, dropout_prob, dropout_min_ms, dropout_max_ms, head_crop_ms,
# tail_noise_ms, tail_beep_prob, tail_beep_min_hz, tail_beep_max_hz, tail_beep_min_ms, tail_beep_max_ms, low_noise_db,
# high_noise_db, noise_categories
PROFILES = (
    ("vhf_clear", 300.0, 3400.0, 24.0, -36.0, 1.2, 0.0, 20, 80, 40, 150, 0.10, 320.0, 670.0, 80, 160, -49.0, -60.0, ["bed_static"]),
    ("vhf_busy", 300.0, 3200.0, 14.0, -34.0, 1.8, 0.015, 30, 100, 100, 350, 0.35, 320.0, 670.0, 120, 300, -46.0, -55.0, ["weak_channel", "busy_channel"]),
    ("vhf_weak", 350.0, 2800.0, 8.0, -39.0, 2.4, 0.045, 40, 140, 180, 600, 0.35, 320.0, 670.0, 160, 450, -45.0, -52.0, ["weak_channel"]),
    ("vhf_tail_beep", 300.0, 3400.0, 18.0, -35.0, 1.6, 0.01, 20, 90, 80, 500, 0.75, 320.0, 670.0, 150, 500, -47.0, -56.0, ["bed_static", "busy_channel"]),
)
SCHEMA = (
    "profile string, low_hz double, high_hz double, snr_db double, target_rms_db double, drive double, dropout_prob double, "
    "dropout_min_ms int, dropout_max_ms int, head_crop_ms int, tail_noise_ms int, tail_beep_prob double, tail_beep_min_hz double, "
    "tail_beep_max_hz double, tail_beep_min_ms int, tail_beep_max_ms int, low_noise_db double, high_noise_db double, noise_categories array<string>"
)
FIELDS = tuple(part.split()[0] for part in SCHEMA.split(", "))
NAMES = tuple(row[0] for row in PROFILES)

# The context mode of each bias type, and the pair type of each mode.
CONTEXT_MODES = {"no_bias": 0, "oracle_bias": 1, "noisy_bias": 1, "distractor_bias": 2, "vhf_error": 2}
CONTEXT_POLICY = "counterfactual_entity_consistency_v1"
PAIR_TYPES = {0: "no_context_control", 1: "supported_prompt_consistency", 2: "unsupported_prompt_invariance"}


def selected(names: str = "all") -> list[tuple]:
    """The profiles of a comma list in its order, blanks dropped, or all; an unknown name is a KeyError."""
    by_name = {row[0]: row for row in PROFILES}
    wanted = NAMES if names == "all" else [n.strip() for n in names.split(",") if n.strip()]
    return [by_name[n] for n in wanted]


def profile_frame(spark: SparkSession, names: str = "all") -> DataFrame:
    """The selected profiles with ``profile_index``, their place in the selection."""
    rows = [(*row, i) for i, row in enumerate(selected(names))]
    return spark.createDataFrame(rows, SCHEMA + ", profile_index int")
