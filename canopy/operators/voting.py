"""Combining the votes of an ensemble's trees, as plain aggregates.

Input rows: tree_id, instance_id, votes (array), label, drift, accuracy, predicted, depth.  Ties go to the highest class; where
nothing votes, the last class wins.  The drift flag of an instance is whether any tree had one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.exprs import argmax_last

RESULT = "instance_id long, is_correct boolean, drift_detected boolean, avg_depth double"


def ballots(voting: str, n_classes: int) -> list[Column]:
    """What a tree puts in for each class; one plain column a class, so that each is worked out once and within generated code."""
    classes = range(n_classes)
    votes = [F.coalesce(F.get("votes", F.lit(i)), F.lit(0.0)) for i in classes]
    if voting == "soft":
        return votes
    if voting == "weighted":
        return [v * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("accuracy"))) for v in votes]
    return [F.coalesce((F.col("predicted") == i).cast("double"), F.lit(0.0)) for i in classes]


def combine(rows: DataFrame, voting: str, n_classes: int, n_trees: int | None = None) -> DataFrame:
    """instance_id, label, winner, combined (array), drift_detected, avg_depth; for instances that all trees have answered, if told how many."""
    sums = [F.sum(b).alias(f"_v{i}") for i, b in enumerate(ballots(voting, n_classes))]
    out = rows.groupBy("instance_id").agg(F.first("label", ignorenulls=True).alias("label"), F.bool_or("drift").alias("drift_detected"), F.avg("depth").alias("avg_depth"), F.count("*").alias("_n"), *sums)
    if n_trees is not None:
        out = out.where(F.col("_n") == n_trees)
    combined = F.array(*(F.col(f"_v{i}") for i in range(n_classes)))
    return out.select("instance_id", "label", argmax_last(combined).alias("winner"), combined.alias("combined"), "drift_detected", "avg_depth")


def results(combined: DataFrame) -> DataFrame:
    return combined.select("instance_id", F.col("winner").eqNullSafe(F.col("label")).alias("is_correct"), "drift_detected", "avg_depth")


def normalize(votes: DataFrame, key: str, value: str) -> DataFrame:
    """Each row's share of its key's sum; uniform where the sum isn't over 0."""
    total = votes.groupBy(key).agg(F.sum(value).alias("_total"), F.count("*").alias("_n"))
    share = F.when(F.col("_total") > 0, F.col(value) / F.col("_total")).otherwise(F.lit(1.0) / F.col("_n"))
    return votes.join(total, key).withColumn("share", share).drop("_total", "_n")
