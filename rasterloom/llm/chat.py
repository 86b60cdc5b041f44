"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbours of the same role are merged by
an array aggregation; the blocks are concatenated into one text:

    <|role|>first text<|turn|>next text of the same role<|end|>

Inside texts and roles a backslash is doubled, ``<|`` becomes ``<\\|`` and ``|>`` becomes ``|\\>``, so no text
can hold a control string, and reading back undoes it exactly. The loss mask covers the texts between the control strings of
the blocks whose role is in LOSS_ROLES.

Edge cases: a null text or role is empty; turns with the same number follow in the order of role and text;
a null turn comes first; repeated rows are turns of their own; a null conv_id is a conversation; other
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, TURN, END = "<|", "|>", "<|turn|>", "<|end|>"
ESCAPES = (("\\", "\\\\"), (OPEN, "<\\|"), (CLOSE, "|\\>"))
LOSS_ROLES = ("assistant",)


def escaped(c: Column) -> Column:
    out = c
    for plain, safe in ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(safe))
    return out


def unescaped(c: Column) -> Column:
    out = c
    for plain, safe in reversed(ESCAPES):
        out = F.replace(out, F.lit(safe), F.lit(plain))
    return out


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id and the formatted text of each conversation."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # each turn opens a block, or goes on with the block of the turn before it
    parts = F.transform(
        F.arrays_zip(F.col("turns"), F.transform(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: F.when(i > 0, F.get(F.col("turns.role"), i - 1)).otherwise(F.lit(None))).alias("before")),
        lambda x: F.when(x["turns"]["role"] == x["before"], F.concat(F.lit(TURN), escaped(x["turns"]["text"]))).otherwise(
            F.concat(F.when(x["before"].isNotNull(), F.lit(END)).otherwise(F.lit("")), F.lit(OPEN), escaped(x["turns"]["role"]), F.lit(CLOSE), escaped(x["turns"]["text"]))
        ),
    )
    return lists.select("conv_id", F.concat(F.array_join(parts, ""), F.lit(END)).alias("formatted"))


def read_back(formatted_rows: DataFrame) -> DataFrame:
    """The turns that the formatted texts hold, as an array of (role, text)."""
    blocks = F.transform(
        F.filter(F.split(F.col("formatted"), r"<\|end\|>"), lambda b, i: b != ""),
        lambda b: F.struct(
            unescaped(F.regexp_extract(b, r"(?s)^<\|(.*?)\|>", 1)).alias("role"),
            F.split(F.regexp_replace(b, r"(?s)^<\|.*?\|>", ""), r"<\|turn\|>").alias("texts"),
        ),
    )
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescaped(t).alias("text")))))
    return formatted_rows.withColumn("turns", turns)


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation with digests of what its formatted text gives back."""
    out = read_back(formatted(turns))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(*LOSS_ROLES)), lambda t: t["text"]), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PLANTED = ((-7, 0, "user"), (-7, 1, "assistant"))


def report_with_planted(turns: DataFrame, text: str = "</s>[INST] ok [/INST]") -> DataFrame:
    """report() over the turns and one more conversation, -7, whose texts look like control strings."""
    more = turns.sparkSession.createDataFrame([(*p, text) for p in PLANTED], "conv_id long, turn long, role string, text string")
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return report(own.unionByName(more))
