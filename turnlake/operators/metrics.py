"""Aggregates over scored turns (conv_id, turn, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A score from here on counts as recalled.
GOOD = 4


def conversation_scores(turns: DataFrame, scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each conversation num_turns (all of them), n_scored, mean_score (0 without scores) and scores_by_position.

    by: columns of scores that tell runs apart; conversations without scores appear only without them.
    """
    by = by or []
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("num_turns"))
    own = scores.groupBy(*by, "conv_id").agg(
        F.count("*").alias("n_scored"),
        F.avg("score").alias("mean_score"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "score"))), lambda x: x["score"]).alias("scores_by_position"),
    )
    rows = own.join(whole, "conv_id") if by else whole.join(own, "conv_id", "left")
    empty = F.array().cast(own.schema["scores_by_position"].dataType)
    return rows.select(*by, "conv_id", "num_turns", F.coalesce("n_scored", F.lit(0)).alias("n_scored"), F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("scores_by_position", empty).alias("scores_by_position"))


def run_metrics(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over all scored turns and the share of good ones; 0 without scores."""
    return scores.groupBy(*(by or [])).agg(
        F.count("*").alias("n_scored"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.avg((F.col("score") >= GOOD).cast("double")), F.lit(0.0)).alias("recall_at_4"),
    )
