"""Small tables that hold the awkward cases: nulls, empty and long texts, copies, ties, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near_copies(seed=1):
    """Rows with exact copies, chains of near copies, short, empty and null texts, and a null id."""
    rng = random.Random(seed)
    rows, texts = [], []
    for _ in range(12):
        base = prose(rng, rng.choice([3, 6, 40, 120]))
        texts.append(base)
        for _ in range(rng.randrange(4)):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            texts.append(copy)
    texts.append(["same"] * 300)
    texts.append(["same"] * 280)
    texts += [texts[0], [w.upper() for w in texts[2]]]
    long_one = prose(rng, 6000, 3000)
    texts += [long_one, long_one[:5900], long_one[50:]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    for doc_id, t in zip(order, texts, strict=True):
        rows.append((doc_id, rng.choice([" ", "  ", "\n", "\t"]).join(t), "en", "s", 1))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, " \n\t", "en", "s", 3), (None, rows[0][1], "en", "s", 1), (1003, " nb  sp", "en", "s", 1), rows[3]]
    return rows


def frame(spark, rows):
    """The rows with extra columns whose names operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, DOCS).withColumn("key", F.lit(1)).withColumn("name", F.lit("x")).withColumn("component_id", F.lit(5)).withColumn("lang_pred", F.lit("q")).withColumn("score", F.lit(1)).withColumn("spans", F.lit(0)).withColumn("shard", F.lit(0)).withColumn("token_ids", F.lit(0))
