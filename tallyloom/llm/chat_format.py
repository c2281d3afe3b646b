"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

The two sides are matched turn by turn; the first position at which they differ ends the common prefix, which is
rendered once as the prompt. What is left of each side is its completion, with a mask that is 1 on the text of
assistant turns and on the mark that ends them. Turns are only gathered when a conversation's text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template.
BEGIN, END, LEARNED = "<|im_start|>", "<|im_end|>", "assistant"


def numbered(turns: DataFrame, pair: str, turn: str, role: str, text: str) -> DataFrame:
    order = Window.partitionBy("pair").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    rows = turns.select(F.col(pair).alias("pair"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.withColumn("place", F.row_number().over(order))


def head(role: Column) -> Column:
    return F.concat(F.lit(BEGIN), role, F.lit("\n"))


def body(text: Column) -> Column:
    return F.concat(text, F.lit(END + "\n"))


def runs(role: Column, text: Column) -> Column:
    """A turn's mask as "flag:characters" of its head and its body."""
    flag = F.when(role == LEARNED, F.lit("1:")).otherwise(F.lit("0:"))
    return F.concat(F.lit("0:"), F.length(head(role)).cast("string"), F.lit(","), flag, F.length(body(text)).cast("string"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair: str = "pair_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per pair: pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.

    Turns are ordered by ``turn``, nulls last, then by role and text; the same turn is one of equal role and text
    (nulls count as empty) at the same place. A mask is "flag:characters" runs joined by commas that cover the
    completion. A side that has no turn after the prompt has an empty completion and mask, and so has a side that is
    missing; the prompt of such a pair is empty. Rows without a pair are left out: they belong to no conversation.
    """
    sides = [numbered(side.filter(F.col(pair).isNotNull()), pair, turn, role, text).select("pair", "place", F.struct("role", "text").alias(name)) for side, name in ((chosen, "chosen"), (rejected, "rejected"))]
    both = sides[0].join(sides[1], ["pair", "place"], "full")
    # the smallest place that differs, by a sum that is combined before the shuffle
    split = both.groupBy("pair").agg(F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("place"))).alias("split"))
    placed = both.join(split, "pair").withColumn("common", F.coalesce(F.col("place") < F.col("split"), F.lit(True)))

    def put_together(what: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(what)), lambda x: x["s"]), "")

    def rendered(side: str, when: Column) -> Column:
        s = F.col(side)
        return F.when(when & s.isNotNull(), F.struct("place", F.concat(head(s["role"]), body(s["text"])).alias("s")))

    def masked(side: str) -> Column:
        s = F.col(side)
        inner = F.when(~F.col("common") & s.isNotNull(), F.struct("place", runs(s["role"], s["text"]).alias("s")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(inner)), lambda x: x["s"]), ",")

    return placed.groupBy("pair").agg(
        F.count_if("common").alias("prompt_turns"),
        put_together(rendered("chosen", F.col("common"))).alias("prompt"),
        put_together(rendered("chosen", ~F.col("common"))).alias("chosen"),
        masked("chosen").alias("chosen_mask"),
        put_together(rendered("rejected", ~F.col("common"))).alias("rejected"),
        masked("rejected").alias("rejected_mask"),
    ).withColumnRenamed("pair", "pair_id")
