"""Paired evaluation views of a row: no prompt, supported prompt, unsupported prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayline.functions.profiles import PAIR_TYPES
from quayline.functions.text import prompt

# The view's file suffix and bias type by mode.
VIEW_NAMES = {0: "no_prompt", 1: "true_prompt", 2: "unsupported_prompt"}
VIEW_BIAS = {0: "no_bias", 1: "noisy_bias", 2: "vhf_error"}


def paired_views(df: DataFrame, ident: str = "id") -> DataFrame:
    """Three rows for each row, from one scan: the changed columns come as an array of structs that is exploded.

    ``view`` names the file a row belongs to; all other columns are carried over. Missing entity columns are an error.
    """
    positives, negatives = (F.transform(c, lambda x: x.cast("string")) for c in ("positive_entities", "phoneme_negative_entities"))
    lists = {0: F.array().cast("array<string>"), 1: F.concat(negatives, positives), 2: negatives}

    def fields(mode: int) -> Column:
        said = prompt(lists[mode]) if mode else F.lit("")
        parts = {
            "view": F.lit(VIEW_NAMES[mode]), "prompt": said, "bias_type": F.lit(VIEW_BIAS[mode]), "counterfactual_pair_type": F.lit(PAIR_TYPES[mode]), "context_mode": F.lit(mode),
            "candidate_entities": lists[mode], "negative_entities": negatives, "paired_source_id": F.col(ident).cast("string"), ident: F.concat(F.col(ident).cast("string"), F.lit(f"_context{mode}")),
        }
        return F.struct(*[c.alias(n) for n, c in parts.items()])

    replaced = ["view", "prompt", "bias_type", "counterfactual_pair_type", "context_mode", "candidate_entities", "negative_entities", "paired_source_id", ident]
    kept = [c for c in df.columns if c not in replaced]
    return df.select(*kept, F.explode(F.array(*[fields(m) for m in VIEW_NAMES])).alias("__v")).select(*kept, "__v.*")
