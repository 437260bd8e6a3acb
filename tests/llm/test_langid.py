import numpy as np
from pyspark.sql import functions as F

from quayline.llm import langid, queries
from tests.llm.fixtures import DOCS

DATA = "/root/testdata/sf0.001"


def test_held_out_accuracy(spark):
    got = queries.op4_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and np.mean([r.lang == r.lang_pred for r in got]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_texts(spark):
    rows = [(i, t, lang, None, None) for i, (t, lang) in enumerate([("the house and the tree", "en"), ("das haus und der baum", "de"), (None, "en"), ("12 -- !", "de"), ("", None), ("the " * 50_000, None), ("x", None), (None, None)])]
    df = spark.createDataFrame([*rows, rows[0], (None, "und das haus", "de", None, None)], DOCS).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, langid.fit(df)).collect()}
    assert got[0][0] == "en" and got[1][0] == "de" and got[5][0] == "en" and got[None][0] == "de"
    assert all(got[i] == ("und", 0.0) for i in (2, 3, 4, 7))
    nothing = spark.createDataFrame([], DOCS)
    assert [r.lang_pred for r in langid.predict(df.where("doc_id = 0"), langid.fit(nothing)).collect()] == ["und", "und"]
    assert langid.predict(nothing, langid.fit(df)).count() == 0


def brute(text, langs, priors, logs):
    sums = np.array(priors, float)
    codes = [ord(c) for c in text.lower()]
    mask = (1 << 64) - 1
    for i in range(len(codes)):
        key = 0
        for order in range(1, max(langid.ORDERS) + 1):
            if i + order > len(codes):
                break
            key = (key + codes[i + order - 1]) * 0x9E3779B97F4A7C15 & mask
            key ^= key >> 29
            if order in langid.ORDERS:
                sums += logs[(key >> 17) % langid.BUCKETS]
    return langs[int(sums.argmax())], 1 / np.exp(sums - sums.max()).sum()


def test_scores_match_brute_force():
    rng = np.random.default_rng(1)
    langs, priors = ["a", "b", "c"], np.log([0.5, 0.3, 0.2])
    logs = np.zeros((langid.BUCKETS + 1, 3), np.float32)
    logs[:-1] = rng.normal(-9, 0.2, (langid.BUCKETS, 3))
    texts = ["", "a", "Ab", "Straße É", "x" * 300, "hello world again", "日本"]
    pred, score = langid.score_texts(texts, langs, priors, logs)
    for t, p, s in zip(texts, pred, score, strict=True):
        want = brute(t, langs, priors, logs)
        assert (p, round(s, 6)) == ((want[0], round(want[1], 6)) if t else ("und", 0.0))


def test_the_sample_is_bounded(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.lit("en").alias("lang"))
    sizes = [int(np.exp(-langid.fit(df, bound)[2][:-1].min()) // 1) for bound in (500, 20_000)]
    assert sizes[0] < sizes[1] / 10


def test_counts_match_brute_force(spark):
    rows = [(1, "The cat", "en"), (2, "", "en"), (3, None, "fr"), (4, "le\tchat é", "fr"), (5, "x", None), (6, None, "xx"), (7, "", "xx")]
    langs, priors, logs = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert langs == ["en", "fr"] and np.allclose(np.exp(priors), [0.5, 0.5])
    mask = (1 << 64) - 1
    for column, lang in enumerate(langs):
        want = np.ones(langid.BUCKETS)
        for _, text, own in rows:
            codes = [ord(c) for c in (text or "").lower()] if own == lang else []
            for i in range(len(codes)):
                key = 0
                for order, code in enumerate(codes[i : i + max(langid.ORDERS)], 1):
                    key = (key + code) * 0x9E3779B97F4A7C15 & mask
                    key ^= key >> 29
                    if order in langid.ORDERS:
                        want[(key >> 17) % langid.BUCKETS] += 1
        assert np.allclose(logs[:-1, column], np.log(want / want.sum()), atol=1e-5)
    assert not logs[-1].any()


def test_rare_languages_are_learned_in_full(spark):
    rows = [(i, f"the house number {i} and the tree", "en") for i in range(3000)] + [(9000 + i, t, "ja") for i, t in enumerate(["これはペンです", "私は学生です"])] + [(9999, "das ist ein haus", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, bound=100)
    assert model[0] == ["de", "en", "ja"] and np.allclose(np.exp(model[1]), np.array([1, 3000, 2]) / 3003)
    got = {r.doc_id: r.lang_pred for r in langid.predict(df, model).where("doc_id IN (9000, 9001) OR doc_id < 5").collect()}
    assert got == {9000: "ja", 9001: "ja", **dict.fromkeys(range(5), "en")}


def test_what_rare_languages_leave_goes_to_the_others():
    assert langid._quota([10, 10, 10], 15) == 5 and langid._quota([1, 100, 100], 101) == 50 and langid._quota([1, 2], 100) == 2 and langid._quota([], 5) == 0
    sizes = [1_000_000] + [3] * 999
    assert abs(sum(min(x, langid._quota(sizes, 20_000)) for x in sizes) - 20_000) < 1e-6
