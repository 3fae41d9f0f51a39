"""Cost log: summaries, price match. usage: stage, model, prompt_tokens, completion_tokens, cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(usage: DataFrame, by: str) -> DataFrame:
    """Calls, tokens and cost for each value of ``by``, dearest first."""
    return (
        usage.groupBy(by)
        .agg(
            F.count("*").alias("calls"),
            F.coalesce(F.sum("prompt_tokens"), F.lit(0).cast("long")).alias("prompt_tokens"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0).cast("long")).alias("completion_tokens"),
            F.round(F.sum("cost"), 4).alias("cost"),
        )
        .orderBy(F.desc("cost"), by)
    )


def total(usage: DataFrame) -> DataFrame:
    """One row, 0 for an empty log."""
    return usage.agg(F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("total_cost"))


def within_limit(usage: DataFrame, limit: float) -> bool:
    """Whether the summed cost is at most ``limit``."""
    return total(usage).first()["total_cost"] <= limit


def price_match(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Each model with the price of the longest prefix that it starts with (null if none). prices is a small table; it has
    as many rows as there are prices, which Spark sees and broadcasts by size."""
    hit = F.col("model").startswith(F.col("prefix"))
    best = models.join(prices, hit, "left").groupBy("model")
    return best.agg(F.max_by("prefix", F.length("prefix")).alias("prefix"), F.max_by("price", F.length("prefix")).alias("price"))
