"""Turns of conversations: pairs, history tails and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_pairs(messages: DataFrame) -> DataFrame:
    """(conv_id, user_turn, assistant_turn): each user message with the first assistant message after it and before the next."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    told = messages.withColumn("g", F.sum((F.col("role") == "user").cast("int")).over(w)).filter("g > 0")
    pairs = told.groupBy("conv_id", "g").agg(F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("user_turn"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("assistant_turn"))
    return pairs.filter("assistant_turn IS NOT NULL").select("conv_id", "user_turn", "assistant_turn")


def history_tail(pairs: DataFrame, size: str, most: int, budget: int) -> DataFrame:
    """The newest pairs of each conversation, up to `most` and while their sizes fit the budget."""
    w = Window.partitionBy("conv_id").orderBy(F.col("user_turn").desc())
    told = pairs.withColumn("back", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return told.filter((F.col("back") <= most) & (F.col("used") <= budget))


def compaction(pairs: DataFrame, size: str, most: int, keep: int, budget: int) -> DataFrame:
    """(conv_id, pairs, size, triggered, covered): whether a conversation is compacted and how many of its oldest pairs."""
    w = Window.partitionBy("conv_id").orderBy("user_turn")
    told = pairs.withColumn("n", F.row_number().over(w)).withColumn("prefix", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    totals = told.groupBy("conv_id").agg(F.count("*").alias("pairs"), F.sum(size).alias("size"))
    fit = told.join(totals.select("conv_id", "pairs"), "conv_id").groupBy("conv_id").agg(F.count_if((F.col("n") <= F.col("pairs") - keep) & (F.col("prefix") <= budget)).alias("fits"))
    triggered = (F.col("pairs") > most) | (F.col("size") * 10 >= 8 * budget)
    return totals.join(fit, "conv_id").select("conv_id", "pairs", "size", triggered.alias("triggered"), F.when(triggered, F.col("fits")).otherwise(0).alias("covered"))


def quotas(messages: DataFrame, most: int) -> DataFrame:
    """(conv_id, accepted, refused): messages beyond the quota are refused, none is dropped."""
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return messages.withColumn("p", place).groupBy("conv_id").agg(F.count_if(F.col("p") <= most).alias("accepted"), F.count_if(F.col("p") > most).alias("refused"))
