import hashlib
import random

import pytest

from quayline.operators import labels, views

NAMES = ["Aurora Star", "Arrow Star", "Knight Queen", "Ocean Zebra", "Pacific Vicky", "Aurora Star"]
SCHEMA = "utterance_id bigint, profile string, text string, ship_names array<string>"


def rows(n=150):
    said = ["Aurora Star, this is Knight Queen, over.", "radio check", "OCEAN-ZEBRA go"]
    return [(i, "vhf_weak", said[i % 3], NAMES if i % 10 else []) for i in range(n)]


def expected(i, text, names):
    """One row by the rules, with Python's generator."""
    positives = [n for n in names if n.upper() in text.upper().replace("-", " ")]
    rng = random.Random(int(hashlib.sha256(f"20260701:{i}:vhf_weak".encode()).hexdigest()[:16], 16))
    negatives = [n for n in names if n not in positives]
    rng.shuffle(negatives)
    negatives, draw = negatives[:4], rng.random()
    mixed = positives + negatives
    rng.shuffle(mixed)
    rest = (draw - 0.22) / 0.78
    if negatives and draw < 0.22:
        return "vhf_error", negatives
    if positives:
        for edge, kind, names in ((0.45, "no_bias", []), (0.65, "oracle_bias", positives), (0.90, "noisy_bias", mixed)):
            if rest < edge:
                return kind, names
        return "distractor_bias", negatives
    return ("no_bias", []) if rest < 0.5 else ("distractor_bias", negatives)


def test_mersenne_draws(spark):
    data = rows()
    got = {r.utterance_id: (r.bias_type, r.candidate_entities) for r in labels.labelled_rows(spark.createDataFrame(data, SCHEMA), bias=True, generator="mersenne").collect()}
    assert got == {i: expected(i, t, n) for i, _, t, n in data}
    assert len({k for k, _ in got.values()}) == 5
    with pytest.raises(ValueError):
        labels.bias_fields(spark.createDataFrame(data, SCHEMA), generator="other")


@pytest.mark.parametrize("generator", ["keyed", "mersenne"])
def test_fields_hang_together(spark, generator):
    out = labels.labelled_rows(spark.createDataFrame(rows(), SCHEMA), bias=True, generator=generator).collect()
    for r in out:
        assert r.id == f"{r.utterance_id}_vhf_weak" and r.text == "language English<asr_text>" + r.reference_text
        assert (r.prompt == "") == (not r.candidate_entities)
        assert set(r.negative_entities) == set(r.candidate_entities) - set(r.positive_entities)
        assert set(r.positive_entity_phonemes) == set(r.positive_entities)
        assert (r.context_error_type != "") == (r.bias_type == "vhf_error")
    again = labels.labelled_rows(spark.createDataFrame(rows()[::-1], SCHEMA).repartition(3), bias=True, generator=generator).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_three_views_of_each_row(spark):
    df = labels.labelled_rows(spark.createDataFrame(rows(9), SCHEMA), bias=False)
    out = views.paired_views(df).collect()
    assert len(out) == 27 and len({r.id for r in out}) == 27 and {r.paired_source_id for r in out} == {r.id for r in df.collect()}
    empty = [r for r in out if r.view == "unsupported_prompt" and not r.phoneme_negative_entities]
    assert empty and all(r.prompt == "Candidate vessel names: . Use a candidate only if it is spoken." for r in empty)
