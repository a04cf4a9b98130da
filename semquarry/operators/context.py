"""Context compilation: natural, compact and mixed variants of a conversation, and their costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, rough_tokens, telegraph


def compile_context(messages: DataFrame, conversation: str, eligible: Column) -> DataFrame:
    """Per conversation: messages, tokens of the three variants, ratio, savings and the mode to serve."""
    code = telegraph(F.col("text"))
    rows = messages.select(conversation, rough_tokens(F.col("text")).alias("_n"), rough_tokens(code).alias("_c"), eligible.alias("_e"))
    out = rows.groupBy(conversation).agg(F.count(F.lit(1)).alias("messages"), F.sum("_n").alias("natural_tokens"), F.sum("_c").alias("code_tokens"), F.sum(F.when(F.col("_e"), F.col("_c")).otherwise(F.col("_n"))).alias("mixed_tokens"), F.count(F.when(F.col("_e"), 1)).alias("eligible"))
    ratio = F.col("mixed_tokens") / F.col("natural_tokens")
    mode = F.when(F.col("eligible") == 0, "natural").when(F.col("eligible") == F.col("messages"), "lunum").otherwise("mixed")
    return out.withColumns({"ratio": F.round(ratio, 6), "savings": F.round(1 - ratio, 6), "mode": mode})


def token_atlas(texts: DataFrame, by: list[str]) -> DataFrame:
    """Average, median, population deviation, extremes and mean reduction of compact against natural tokens."""
    rows = texts.select(*by, estimated_tokens(F.col("text")).alias("n"), estimated_tokens(telegraph(F.col("text"))).alias("c"))
    return rows.groupBy(*by).agg(F.round(F.avg("c"), 3).alias("mean"), F.round(F.median("c"), 3).alias("median"), F.round(F.stddev_pop("c"), 3).alias("sd"), F.min("c").alias("lowest"), F.max("c").alias("highest"), F.round(F.avg(F.when(F.col("n") > 0, 1 - F.col("c") / F.col("n"))), 6).alias("reduction"))
