"""Histograms that merge: bins of about equal weight for every key, from sums only.

Each key's values fall on a grid of `cells` between its smallest and largest value.  Weights by cell and class are sums, so any number of tasks
may count one key.  Running sums over a key's cells, never more than `cells`, then make at most `bins` bins, each of which ends where the running weight
passes a multiple of the total's share.  A bin weighs its share and one cell at most, so ranks told by bins are off by no more than that.

A value that is null or not a number, or a row without a class, isn't counted.  A key of one value has one bin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.exprs import entropy_terms
from canopy.sources.scratch import staged


@dataclass(frozen=True)
class HistogramParams:
    bins: int = 32
    cells: int = 4096


def cells(rows: DataFrame, keys: list[str], value: str, label: str, weight: Column, p: HistogramParams) -> DataFrame:
    """keys, cell, label, weight, sum, low and high: what merges."""
    rows = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & F.col(label).isNotNull())
    rows = rows.select(*keys, F.col(label).alias("label"), F.col(value).cast("double").alias("x"), weight.alias("w"))
    ends = staged(rows.groupBy(*keys).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi")))
    cell = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * p.cells), F.lit(p.cells - 1))).otherwise(F.lit(0))
    rows = rows.join(ends, keys).withColumn("cell", cell)
    return rows.groupBy(*keys, "cell", "label").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("x")).alias("sum"), F.min("x").alias("low"), F.max("x").alias("high"))


def binned(counted: DataFrame, keys: list[str], p: HistogramParams) -> DataFrame:
    """keys, bin (from 0), label, weight, sum, low, high from `cells`."""
    by_cell = counted.groupBy(*keys, "cell").agg(F.sum("weight").alias("_w"))
    upto = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("_w").over(upto), F.lit(0)), F.sum("_w").over(Window.partitionBy(*keys))
    place = F.floor(before.cast("double") * p.bins / total).alias("_place")
    number = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_place")) - 1
    at = by_cell.select(*keys, "cell", place).select(*keys, "cell", number.alias("bin"))
    out = counted.join(at, [*keys, "cell"]).groupBy(*keys, "bin", "label")
    return out.agg(F.sum("weight").alias("weight"), F.sum("sum").alias("sum"), F.min("low").alias("low"), F.max("high").alias("high"))


def histograms(rows: DataFrame, keys: list[str], value: str, label: str, n_classes: int, p: HistogramParams | None = None, weight: Column | None = None) -> DataFrame:
    """keys, bin, low, high, mean and weights (array by class) for each bin; labels are whole numbers below n_classes."""
    p = p or HistogramParams()
    bins = binned(cells(rows, keys, value, label, weight if weight is not None else F.lit(1.0), p), keys, p)
    weights = F.array(*(F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(F.lit(0.0))) for c in range(n_classes)))
    out = bins.groupBy(*keys, "bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("sum") / F.sum("weight")).alias("mean"), weights.alias("weights"))
    return out.select(*keys, F.col("bin").cast("int").alias("bin"), "low", "high", "mean", "weights")


def split_gains(bins: DataFrame, keys: list[str]) -> DataFrame:
    """keys, bin, point, gain: the information gained by a split after each bin but the last, halfway to the next one; from `binned`."""
    key_bins = Window.partitionBy(*keys).orderBy("bin")
    edges = bins.groupBy(*keys, "bin").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    edges = edges.withColumn("point", (F.col("_high") + F.lead("_low").over(key_bins)) / 2).select(*keys, "bin", "point").where("point IS NOT NULL")
    total = bins.groupBy(*keys, "label").agg(F.sum("weight").alias("_all"))
    # Classes that a bin lacks have sums to its left too.
    full = edges.join(total, keys).join(bins.select(*keys, "bin", "label", "weight"), [*keys, "bin", "label"], "left")
    left = F.sum(F.coalesce("weight", F.lit(0.0))).over(Window.partitionBy(*keys, "label").orderBy("bin"))
    sides = full.select(*keys, "bin", "point", F.col("_all").alias("a"), left.alias("l")).withColumn("r", F.col("a") - F.col("l"))
    one = Window.partitionBy(*keys, "bin")
    sides = sides.withColumns({f"n{c}": F.sum(c).over(one) for c in "alr"})
    part = lambda c: F.max(F.col(f"n{c}")) / F.max("na") * F.sum(entropy_terms(F.col(c), F.col(f"n{c}")))
    return sides.groupBy(*keys, "bin").agg(F.max("point").alias("point"), (part("a") - part("l") - part("r")).alias("gain"))


def oracle_cte(rows: str, keys: str, p: HistogramParams) -> str:
    """Common tables of DuckDB up to `bins`, like `binned`; `rows` is a query of keys, x, label and w."""
    same = " AND ".join(f"b.{k.strip()} = c.{k.strip()}" for k in keys.split(","))
    return f"""vals AS (SELECT * FROM ({rows}) WHERE x IS NOT NULL AND NOT isnan(x) AND label IS NOT NULL),
ended AS (SELECT *, min(x) OVER (PARTITION BY {keys}) AS lo, max(x) OVER (PARTITION BY {keys}) AS hi FROM vals),
celled AS (SELECT *, CASE WHEN hi > lo THEN CAST(least(floor((x - lo) / (hi - lo) * {p.cells}), {p.cells - 1}) AS BIGINT) ELSE 0 END AS cell FROM ended),
by_cell AS (SELECT {keys}, cell, sum(w) AS cw FROM celled GROUP BY {keys}, cell),
placed AS (SELECT *, CAST(floor(coalesce(sum(cw) OVER (PARTITION BY {keys} ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * {p.bins} / sum(cw) OVER (PARTITION BY {keys})) AS BIGINT) AS place FROM by_cell),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY {keys} ORDER BY place) - 1 AS bin FROM placed),
bins AS (SELECT c.*, b.bin FROM celled c JOIN numbered b ON {same} AND b.cell = c.cell)"""
