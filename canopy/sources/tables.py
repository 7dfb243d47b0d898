"""Instances from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The event types of the table events, in order; they are the classes.
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of id: value, user, hour and the property k; the label is the type's place among the types."""
    types = F.array(*map(F.lit, EVENT_TYPES))
    place = F.array_position(types, F.col("event_type")) - 1
    features = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in (F.col("value"), F.col("user_id"), F.hour("ts"), F.get_json_object("props", "$.k"))]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("instance_id"), F.array(*features).alias("features"), F.when(place >= 0, place.cast("int")).alias("label"))
