"""Chat formatting by prefix-target expansion. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Every mark that a template may use begins with one of these; a text never shows them bare.
OPENERS = "<["
_GUARD = "\\."


def escape(text: Column) -> Column:
    """Double the backslashes, then guard every ``<`` and ``[``, so no control string survives in a text."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for opener in OPENERS:
        out = F.replace(out, F.lit(opener), F.lit(opener + _GUARD))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    for opener in OPENERS:
        text = F.replace(text, F.lit(opener + _GUARD), F.lit(opener))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, its formatted text and the spans of its assistant replies.

    A turn is written ``<|turn|>`` role ``<|text|>`` text ``<|end|>``, role and text escaped. Turns go by
    (turn, role, text), nulls first; null roles and texts are empty; rows with a null conv_id form one
    conversation; repeated rows are repeated turns. ``replies`` holds start and end (code points, end exclusive)
    of each escaped reply. Positions come from a running sum, so the work is linear in the turns.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))).withColumn("body", escape(F.col("text")))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    size = F.char_length("head") + F.char_length("body") + len(END)
    rows = rows.select(
        "conv_id",
        F.row_number().over(in_order).alias("n"),
        F.concat("head", "body", F.lit(END)).alias("piece"),
        (F.sum(size).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("body") - len(END)).alias("start"),
        F.char_length("body").cast("long").alias("chars"),
        (F.col("role") == "assistant").alias("reply"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "start", "chars", "reply"))).alias("turns"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["reply"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["chars"]).alias("end"))).alias("replies"),
    )


def prefix_targets(formatted: DataFrame) -> DataFrame:
    """Explode every assistant turn into its own example.

    Example: conv_id, example (from 0), context, target, context_end, loss_start, loss_end and rest. Its input is
    ``context`` (all turns before the reply and the reply's head) and ``target`` behind it; only the code points from
    loss_start to loss_end of that input are trained. ``rest`` is what follows the last example's input in the
    conversation, and null in the others. A conversation without replies gives one example with all of it as context,
    an empty target and a null span. The written contexts of a conversation grow with the square of its turns.
    """
    replies = F.transform("replies", lambda r, i: F.struct(i.alias("example"), r["start"].alias("context_end"), r["start"].alias("loss_start"), r["end"].alias("loss_end"), (i == F.size("replies") - 1).alias("last")))
    nothing = F.lit(None).cast("long")
    alone = F.array(F.struct(F.lit(0).alias("example"), F.char_length("formatted").cast("long").alias("context_end"), nothing.alias("loss_start"), nothing.alias("loss_end"), F.lit(True).alias("last")))
    # only spans are exploded, so no row holds more than one written context
    spans = formatted.select("conv_id", "formatted", F.explode(F.when(F.size("replies") > 0, replies).otherwise(alone)).alias("e")).select("conv_id", "formatted", "e.*")
    return spans.select(
        "conv_id",
        "example",
        F.expr("substring(formatted, 1, int(context_end))").alias("context"),
        F.expr("coalesce(substring(formatted, int(loss_start) + 1, int(loss_end - loss_start)), '')").alias("target"),
        "context_end",
        "loss_start",
        "loss_end",
        F.when(F.col("last"), F.expr("substring(formatted, int(coalesce(loss_end, context_end)) + 1)")).alias("rest"),
    )


def materialize(formatted: DataFrame, examples: DataFrame) -> DataFrame:
    """conv_id, example, context and target, the contexts cut anew from the formatted texts by the examples' spans."""
    both = examples.join(formatted.select("conv_id", "formatted"), formatted["conv_id"].eqNullSafe(examples["conv_id"])).drop(formatted["conv_id"])
    return both.select("conv_id", "example", F.expr("substring(formatted, 1, int(context_end))").alias("context"), "target")


def read_back(examples: DataFrame) -> DataFrame:
    """Parse the examples: one row for each conversation with its turns and the text under the loss masks.

    Turns come from the last example's input and rest, the loss text from each example's own mask over its own input.
    Fails if an example's context does not end where it says, or if its input is not how the conversation begins.
    """
    text = F.concat("context", "target")
    whole = (
        examples.select(
            "conv_id",
            F.when(F.col("rest").isNotNull(), F.concat("context", "target", "rest")).alias("formatted"),
            F.struct(
                "example",
                F.coalesce(F.substring(text, (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")), F.lit("")).alias("loss"),
                F.char_length(text).alias("chars"),
                F.xxhash64(text).alias("digest"),
                (F.char_length("context") == F.col("context_end")).alias("fits"),
            ).alias("e"),
        )
        .groupBy("conv_id")
        .agg(F.max("formatted").alias("formatted"), F.sort_array(F.collect_list("e")).alias("examples"))
    )
    begins = F.forall("examples", lambda e: e["fits"] & (F.xxhash64(F.substring(F.col("formatted"), F.lit(1), e["chars"])) == e["digest"]))
    whole = whole.withColumn("formatted", F.when(begins, F.col("formatted")).otherwise(F.raise_error(F.lit("an example's context is not how its conversation begins"))))
    # what stands before the first mark is empty
    pieces = F.filter(F.split("formatted", "<\\|turn\\|>"), lambda p, i: i > 0)
    turns = F.transform(pieces, lambda p: F.split(F.regexp_replace(p, "<\\|end\\|>$", ""), "<\\|text\\|>"))
    return whole.select(
        "conv_id",
        F.transform(turns, lambda t: F.struct(unescape(t[0]).alias("role"), unescape(t[1]).alias("text"))).alias("turns"),
        F.array_join(F.transform("examples", lambda e: unescape(e["loss"])), "").alias("loss_text"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
