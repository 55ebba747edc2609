"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled, and
one is put after the first character of every control string, so none of CONTROL occurs in an escaped text;
in roles a newline gets one before it. Dropping each backslash that escapes the next character undoes all.

Every assistant turn becomes one example: all turns before it and the turn itself, of which only its text is
under the loss mask. Turns after the last assistant turn (all turns, if there is none) come as one further
example that trains nothing, so no turn is lost.

An example holds all turns before its target, so a conversation's turns meet in one row by what the method
is; conversations are independent of one another and nothing else is gathered.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm.common import read

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of public chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL)


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, target_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), n_turns, formatted, loss_start, loss_end (code points), trainable.

    Null text and null role are empty. Turns go by turn, ties by role and text; a null turn comes first.
    A null conv_id is a conversation of its own. No rows give no rows; other columns are ignored.
    """
    c = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), c.alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def head(t: Column) -> Column:
        return F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))

    convs = convs.select("conv_id", F.transform("ts", lambda t: F.struct((t["role"] == target_role).alias("target"), head(t).alias("head"), escape(t["text"]).alias("body"))).alias("ts"))
    convs = convs.select(
        "conv_id", "ts",
        F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))).alias("whole"),
        F.filter(F.transform("ts", lambda t, i: F.when(t["target"] | (i == F.size("ts") - 1), i + 1)), lambda i: i.isNotNull()).alias("ends"),
    )
    at = F.col("ts")[F.col("n_turns") - 1]
    context = F.array_join(F.slice("whole", F.lit(1), F.col("n_turns") - 1), "")
    start = F.char_length(context) + F.when(at["target"], F.char_length(at["head"])).otherwise(F.char_length(F.col("whole")[F.col("n_turns") - 1]))
    return (
        convs.select("conv_id", "ts", "whole", F.posexplode("ends").alias("example", "n_turns"))
        .select(
            "conv_id", "example", "n_turns",
            F.array_join(F.slice("whole", F.lit(1), F.col("n_turns")), "").alias("formatted"),
            start.cast("long").alias("loss_start"),
            (start + F.when(at["target"], F.char_length(at["body"])).otherwise(0)).cast("long").alias("loss_end"),
            at["target"].alias("trainable"),
        )
    )


def parse_turns(formatted: Column) -> Column:
    """The turns read back from a formatted example: an array of (role, text)."""
    parts = F.slice(F.split(formatted, re.escape(START), -1), 2, 1 << 30)
    roles = r"(?s)^((?:[^\\\n]|\\.)*)\n.*$"
    bodies = r"(?s)^(?:[^\\\n]|\\.)*\n(.*)" + re.escape(END) + "\n$"
    return F.transform(parts, lambda p: F.struct(unescape(F.regexp_extract(p, roles, 1)).alias("role"), unescape(F.regexp_extract(p, bodies, 1)).alias("text")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    examples = format_chats(turns)
    masked = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    per = examples.groupBy("conv_id").agg(
        F.max_by("formatted", "n_turns").alias("last"),
        F.array_sort(F.collect_list(F.struct("example", masked.alias("text")))).alias("loss"),
        F.sum(F.char_length("formatted")).alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    loss = F.array_join(F.transform("loss", lambda x: x["text"]), "")
    per = per.select("conv_id", parse_turns(F.col("last")).alias("turns"), loss.alias("loss"), "formatted_chars", "n_examples")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples",
    )
