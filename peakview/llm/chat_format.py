"""Multi-party chat formatting by perspective rotation. DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered once
with that speaker as the assistant and the others as named users; loss is on
the assistant's own turns. Participants are the distinct speakers. Speakers
named `system` (a parameter) are context in every perspective and take no perspective of their own.
The rendering is one row per perspective and turn: header, text and end mark,
the character span in the rendered dialogue and the loss mask of the text;
a dialogue is the concatenation of its rows by `seq`, so no dialogue of any length has to
fit into one row or one task.

Turns are ordered by turn number (nulls first), then speaker and text. Turn
ranges are numbered and summed apart and then chained, so a conversation with a
large share of all rows is spread. Equal rows are grouped with their count first
and given out again at the end, each as a turn of its own. A null speaker is
the participant named `unknown`, null text is empty, rows without conv_id are
one conversation with a null id. Speakers' names have `<`, `>`, `|` and line ends
replaced by `_` where they are rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 64  # turn numbers in a range that is summed as one


def _name(role: Column) -> Column:
    return F.translate(role, "<>|\n\r", "_____")


def rotate(turns: DataFrame, context_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, seq, turn, speaker, role, segment, seg_start, seg_end, loss_start, loss_end.

    Spans count characters of the rendered dialogue, end exclusive; loss spans are null outside the assistant's turns.
    """
    rows = (turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"),
                         F.coalesce("text", F.lit("")).alias("text"))
            .groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("times")))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / SPAN).cast("long"), F.lit(-(1 << 62))))
    context = F.col("speaker").isin(*context_roles)

    # what a turn takes differs by perspective only in its header; so lengths are summed per speaker's own and others' headers
    user_head = F.concat(F.lit("<|user:"), _name(F.col("speaker")), F.lit("|>\n"))
    rows = rows.withColumns({
        "context": context,
        "own_len": F.when(context, F.length("speaker") + 5).otherwise(F.lit(len("<|assistant|>\n"))).cast("long"),
        "user_len": F.when(context, F.length("speaker") + 5).otherwise(F.length(user_head)).cast("long"),
        "body_len": (F.length("text") + len("<|end|>\n")).cast("long")})

    who = turns.select("conv_id", F.coalesce("role", F.lit("unknown")).alias("perspective")).filter(~F.col("perspective").isin(*context_roles)).distinct()
    each = rows.join(who.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    own = F.col("speaker") == F.col("perspective")
    each = each.withColumns({"own": own, "seg_len": F.col("body_len") + F.when(own, F.col("own_len")).otherwise(F.col("user_len"))})

    # within a range, then the ranges before it
    order = ["turn", "speaker", "text"]
    inside = Window.partitionBy("conv_id", "perspective", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"n0": F.coalesce(F.sum("times").over(inside), F.lit(0)),
                             "s0": F.coalesce(F.sum(F.col("times") * F.col("seg_len")).over(inside), F.lit(0))})
    ranges = each.groupBy("conv_id", "perspective", "part").agg(F.sum("times").alias("n"), F.sum(F.col("times") * F.col("seg_len")).alias("s"))
    before = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("part").alias("q"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n1"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s1"))
    each = each.join(ranges, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("part") == F.col("q")))

    each = each.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("s0") + F.col("s1") + F.col("copy") * F.col("seg_len")
    role = F.when(F.col("context"), "system").when(F.col("own"), "assistant").otherwise("user")
    head = (F.when(F.col("context"), F.concat(F.lit("<|"), _name(F.col("speaker")), F.lit("|>\n")))
            .when(F.col("own"), F.lit("<|assistant|>\n")).otherwise(user_head))
    each = each.withColumns({"seg_start": start, "seg_end": start + F.col("seg_len"), "seq": F.col("n0") + F.col("n1") + F.col("copy")})
    learn = F.col("own") & ~F.col("context")
    return each.select(
        "conv_id", "perspective", F.col("seq").cast("long").alias("seq"), "turn", "speaker", role.alias("role"),
        F.concat(head, F.col("text"), F.lit("<|end|>\n")).alias("segment"),
        F.col("seg_start").cast("long").alias("seg_start"), F.col("seg_end").cast("long").alias("seg_end"),
        # the end mark is learnt, its line end isn't
        F.when(learn, F.col("seg_start") + F.col("own_len")).cast("long").alias("loss_start"),
        F.when(learn, F.col("seg_end") - 1).cast("long").alias("loss_end"))
