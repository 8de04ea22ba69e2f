"""Preference formatting (operator 10), native functions only.

A chosen and a rejected conversation are compared turn by turn. Their longest common turn prefix is
rendered once as the prompt; what follows on each side is a completion, and the spans of assistant
text in it are those a trainer takes the loss of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.base import stage

OPEN, HEAD, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"  # fixed marks of the chat template


def numbered(turns: DataFrame, key: str) -> DataFrame:
    """Turns with place 1, 2, ...: by turn, then role and text; turns without a number come last."""
    order = Window.partitionBy(key).orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return turns.select(key, "side", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.row_number().over(order).cast("long").alias("place"))


def preference_pairs(turns: DataFrame) -> DataFrame:
    """One row per pair: pair_id, prompt_turns, prompt, chosen, rejected and the loss spans of both.

    turns: pair_id, side ("chosen" or "rejected"), turn, role, text. Null role or text is empty. A
    missing side has an empty completion, and so has a side that is a prefix of the other. Spans are
    "start:end" in code points of the completion, end exclusive, joined by commas: the text and the
    closing mark of each assistant turn.
    """
    sided = turns.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')").withColumn("key", F.concat_ws("|", "pair_id", "side"))
    rows = numbered(sided, "key").withColumn("pair_id", F.split("key", r"\|")[0].cast("long")).drop("key")
    rows = stage(rows.withColumn("print", F.sha2(F.concat_ws("\u0000", "role", "text"), 256)), "op10-turns")
    # a place where both sides have the same turn; the first other place ends the prefix
    both = rows.groupBy("pair_id", "place").agg(F.countDistinct("print").alias("kinds"), F.count("*").alias("sides"))
    prefix = both.groupBy("pair_id").agg(F.coalesce(F.min(F.when((F.col("sides") < 2) | (F.col("kinds") > 1), F.col("place"))) - 1, F.max("place")).alias("prompt_turns"))
    turn = F.concat(F.lit(OPEN), "role", F.lit(HEAD), "text", F.lit(CLOSE))
    parts = rows.join(prefix, "pair_id").where("side = 'chosen' OR place > prompt_turns").select(
        "pair_id", "prompt_turns", "place", turn.alias("turn"), F.when(F.col("place") <= F.col("prompt_turns"), "prompt").otherwise(F.col("side")).alias("part"),
        F.length("role").alias("head"), (F.col("role") == "assistant").alias("loss"))
    listed = parts.groupBy("pair_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "turn", "head", "loss"))).alias("list"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    lead = len(OPEN) + len(HEAD)
    spans = F.aggregate("list", begin, lambda a, x: F.struct(
        (a.at + F.length(x.turn)).alias("at"),
        F.when(x.loss, F.concat(a.spans, F.array(F.concat_ws(":", (a.at + lead + x.head).cast("string"), (a.at + F.length(x.turn) - 1).cast("string"))))).otherwise(a.spans).alias("spans")))
    text = listed.select("pair_id", "part", F.array_join(F.transform("list", lambda x: x.turn), "").alias("text"), F.array_join(spans.spans, ",").alias("spans"))
    pick = lambda part, column: F.coalesce(F.max(F.when(F.col("part") == part, F.col(column))), F.lit(""))
    wide = text.groupBy("pair_id").agg(
        pick("prompt", "text").alias("prompt"), pick("chosen", "text").alias("chosen"), pick("chosen", "spans").alias("chosen_spans"),
        pick("rejected", "text").alias("rejected"), pick("rejected", "spans").alias("rejected_spans"))
    return prefix.join(wide, "pair_id", "left").select(
        "pair_id", "prompt_turns", *[F.coalesce(c, F.lit("")).alias(c) for c in ("prompt", "chosen", "chosen_spans", "rejected", "rejected_spans")])
