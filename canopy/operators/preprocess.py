"""Preparing tables for learning: label dictionaries, ordinals, scaling, one-hot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def label_dictionary(rows: DataFrame, label: str, order: str) -> DataFrame:
    """label, label_id: ids from 0 by first appearance; null labels have none.  The dictionary has one row a class."""
    first = rows.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.min(order).alias("_first"))
    return first.select("label", (F.row_number().over(Window.orderBy("_first", "label")) - 1).alias("label_id"))


def label_encode(rows: DataFrame, column: str) -> DataFrame:
    """value, code: ids from 0 in the order of the values as text."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    return values.select("value", (F.dense_rank().over(Window.orderBy("value")) - 1).alias("code"))


def ordinal(value: Column, categories: list[str]) -> Column:
    """The place of a category; 0 for one that is not known, as for null."""
    found = F.array_position(F.array(*map(F.lit, categories)), F.trim(value)) - 1
    return F.coalesce(F.greatest(found, F.lit(0)), F.lit(0)).cast("double")


def number_or_zero(value: Column) -> Column:
    number = F.trim(value).try_cast("double")
    return F.when(F.isnan(number), F.lit(0.0)).otherwise(F.coalesce(number, F.lit(0.0)))


def min_max_scale(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns moved to 0 to 1, nulls as 0 before; a constant column becomes 0."""
    filled = rows.fillna(0, columns)
    ends = filled.agg(*(f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))))
    out = filled.crossJoin(F.broadcast(ends))  # one row
    for c in columns:
        spread = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(c, F.when(spread > 0, (F.col(c) - F.col(f"_lo_{c}")) / spread).otherwise(F.lit(0.0)))
    return out.select(*rows.columns)


def one_hot(rows: DataFrame, column: str, categories: list[str]) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != column], *(F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)).alias(f"{column}#{v}") for v in categories))
