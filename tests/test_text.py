import pytest
from pyspark.sql import functions as F

from quayline.functions import text
from quayline.functions.profiles import NAMES, selected

KEYS = {"KNIGHT QUEEN": "NGT KN", "Church Ship": "XRX XP", "Wright": "RGT", "Pacific": "PKFK", "Zebra": "SBR", "Star": "STR", "Aurora": "AR", "Arrow": "AR", "Ocean": "OKN", "Vicky": "FK", "7 Seas": "7 S", "": ""}


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'array<string>'}" for k, v in values.items())).select(column).first()[0]


def test_phonetic_keys(spark):
    rows = spark.createDataFrame([(k,) for k in KEYS], "name string").select("name", text.phoneme_key("name").alias("k")).collect()
    assert {r.name: r.k for r in rows} == KEYS


def test_similarity(spark):
    assert one(spark, text.phoneme_similarity("a", "b"), a="Aurora", b="Arrow") == 2
    assert one(spark, text.phoneme_similarity("a", "b"), a="", b="") == 0


def test_negatives_rank_descending_on_all_keys(spark):
    names = ["Aurora Star", "Arrow Star", "Knight Queen"]
    pick = lambda pos: one(spark, text.phoneme_negatives(F.col("n"), F.col("p"), 4), n=names, p=pos)
    assert pick(["Aurora Star", "Knight Queen"]) == ["Arrow Star"]
    assert pick([]) == ["Knight Queen", "Aurora Star", "Arrow Star"]


def test_rosters(spark):
    assert one(spark, text.load_names("n", is_json=True), n='["Pacific  Vicky", " ", "Ocean\\u00a0Zebra"]') == ["Pacific Vicky", "Ocean Zebra"]
    assert one(spark, text.matching(F.col("t"), F.col("n")), t="PACIFIC-VICKY, channel 12.", n=["Pacific Vicky", "Vick", "Pacific Vicky"]) == ["Pacific Vicky"] * 2
    assert one(spark, text.family_raw("n"), n=["b", "", "a", "b", " "]) == [" ", "a", "b"]
    assert one(spark, text.family_normalized("n"), n=["b", "", " B", " "]) == ["B"]


def test_paths_and_names(spark):
    assert one(spark, text.generation_shard("p"), p="out/shard_7/a/shard_9.wav") == 7
    with pytest.raises(Exception, match="no shard part"):
        one(spark, text.generation_shard("p"), p="out/x.wav")
    assert one(spark, text.clean_name("i"), i="7") == "000007.wav"
    assert one(spark, text.clean_name("i"), i="12345678") == "12345678.wav"


def test_booleans(spark):
    assert [text.parse_bool(x) for x in ("Yes", "0", "TRUE", "n")] == [True, False, True, False]
    with pytest.raises(ValueError):
        text.parse_bool("maybe")


def test_hash_order_is_a_permutation(spark):
    names = [f"n{i}" for i in range(20)]
    got = one(spark, text.hash_order(F.col("n"), 1, F.lit("x")), n=names)
    assert sorted(got) == sorted(names) and got != names


def test_profile_selection():
    assert [p[0] for p in selected()] == list(NAMES)
    assert [p[0] for p in selected(" vhf_weak,, vhf_clear ")] == ["vhf_weak", "vhf_clear"]
    with pytest.raises(KeyError):
        selected("other")
