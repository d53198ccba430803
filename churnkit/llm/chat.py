"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted by (turn,
role, text). Adjacent turns of one role become one block:

    <|start|>role<|text|>first text<|turn|>second text<|end|>\\n

Every control string starts with ``<|``. Inside roles and texts a backslash
becomes ``\\b`` and ``<|`` becomes ``\\l``, so a text can hold any control
string and ``parse`` gives back the exact turns.

The output carries its loss mask: ``segments`` are the pieces of the
formatted text in order, each with ``loss`` true for an assistant text.

Edge cases: NULL text or role counts as empty; NULL turns sort first; equal
rows stay as separate turns; NULL conv_id is one conversation; extra columns
are ignored; no rows give no conversations. A conversation is one output row,
so its size is bound by one row of Spark whatever the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, TEXT, TURN, END = "<|start|>", "<|text|>", "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _pieces(turns: Column, loss_role: str):
    def of(turn: Column, i: Column) -> Column:
        before, after = F.get(turns, i - 1)["role"], F.get(turns, i + 1)["role"]
        role = turn["role"]
        opening = F.when(F.coalesce(before == role, F.lit(False)), F.lit(TURN)).otherwise(F.concat(F.lit(START), escape(role), F.lit(TEXT)))
        closing = F.when(F.coalesce(after == role, F.lit(False)), F.lit("")).otherwise(F.lit(END))
        no = F.lit(False)
        return F.array(*(F.struct(text.alias("text"), loss.alias("loss")) for text, loss in
                         ((opening, no), (escape(turn["text"]), role == loss_role), (closing, no))))

    return of


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, segments (text, loss), formatted."""
    rows = turns.select("conv_id", F.struct("turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).alias("turn"))
    sorted_turns = rows.groupBy("conv_id").agg(F.collect_list("turn").alias("turns")).select("conv_id", F.array_sort("turns").alias("turns"))
    segments = sorted_turns.select("conv_id", F.flatten(F.transform("turns", _pieces(F.col("turns"), loss_role))).alias("segments"))
    return segments.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


def _literal(text: str) -> str:
    return text.replace("|", r"\|")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    blocks = F.filter(F.split(formatted, _literal(END), -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        parts = F.split(block, _literal(TEXT), -1)
        role = unescape(F.substr(F.get(parts, F.lit(0)), F.lit(len(START) + 1)))
        texts = F.split(F.get(parts, F.lit(1)), _literal(TURN), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def digest(formatted: DataFrame) -> DataFrame:
    read = formatted.select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), "formatted")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant turn whose text looks like control strings."""
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
