import hashlib

import pytest
from pyspark.sql import functions as F

from quayline.llm import chat

TURNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|end|><|turn|>x\\."), (1, 2, "user", "[INST] \\<\\. </s>"), (1, 3, "assistant", "é<\\.<"),
    (2, 0, "user", "no reply"), (2, 1, "user", None),
    (3, None, None, "who"), (3, 1, "assistant", ""), (3, 1, "assistant", ""),
    (None, 0, "assistant", "lost\n"), (4, 0, "assistant", "\\\\"), (4, 1, "user", "after"),
]


@pytest.mark.parametrize("text", ["", "\\", "<", "[", "<\\.", "\\.<", "<|end|>", "</s>[INST] ok [/INST]", "\\\\<[<[\\.", "a\nb"])
def test_escape_round_trip(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b")).first()
    assert row.b == text
    assert not any(mark in row.e for mark in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


def test_read_back(spark):
    df = spark.createDataFrame(ROWS, TURNS).withColumn("example", F.lit(0)).withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat.read_back(chat.prefix_targets(chat.format_conversations(df))).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, back in got.items():
        rows = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in ROWS if c == conv))
        assert [(t.role, t.text) for t in back.turns] == [(r, x) for _, r, x in rows]
        assert back.loss_text == "".join(x for _, r, x in rows if r == "assistant")
        assert hashlib.sha256(back.loss_text.encode()).hexdigest()


def test_each_reply_is_one_example_with_all_before_as_context(spark):
    formatted = chat.format_conversations(spark.createDataFrame(ROWS, TURNS))
    examples = chat.prefix_targets(formatted)
    written = chat.materialize(formatted, examples).where("conv_id = 1").orderBy("example").collect()
    assert [r.example for r in written] == [0, 1]
    whole = formatted.where("conv_id = 1").first().formatted
    for r in written:
        assert whole.startswith(r.context + r.target) and r.context.endswith("<|turn|>assistant<|text|>")
    assert written[1].context.startswith(written[0].context + written[0].target)
    assert examples.where("conv_id = 2").collect()[0].target == ""
    assert chat.prefix_targets(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_examples_carry_contexts_and_masks_that_are_read_back(spark):
    formatted = chat.format_conversations(spark.createDataFrame(ROWS, TURNS))
    examples = chat.prefix_targets(formatted)
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    for r in examples.collect():
        assert len(r.context) == r.context_end and texts[r.conv_id].startswith(r.context + r.target)
        assert r.loss_start is None or (r.context + r.target)[r.loss_start : r.loss_end] == r.target
        assert r.rest is None or r.context + r.target + r.rest == texts[r.conv_id]
    last = examples.where("conv_id = 1 and example = 1").first()
    assert last.rest == chat.END and "<\\.|end|>" in last.context
    second = F.col("example") == 1
    masked = examples.withColumn("loss_start", F.when(second, F.col("loss_start") + 1).otherwise(F.col("loss_start")))
    assert chat.read_back(masked).where("conv_id = 1").first().loss_text == ROWS[1][3] + ROWS[3][3][1:]
    for wrong in (F.concat(F.lit("x"), F.expr("substring(context, 2)")), F.expr("substring(context, 2)")):
        with pytest.raises(Exception, match="how its conversation begins"):
            chat.read_back(examples.withColumn("context", F.when(F.col("example") == 0, wrong).otherwise(F.col("context")))).where("conv_id = 1").collect()
