"""Analytics over results: running accuracies, speed-up, Pareto frontier.

Running values over one long stream are made in two steps: sums of blocks of ids, then windows within blocks that start from the
sums of the blocks before, so that no task holds the whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BLOCK = 65_536


def running_sums(rows: DataFrame, order: str, values: dict[str, Column], block: int = BLOCK, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of values over all rows up to each one, all in one pass; `order` holds whole numbers without repeats."""
    own = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumns({f"_own_{n}": v for n, v in values.items()})
    sums = own.groupBy(*by, "_block").agg(*(F.sum(f"_own_{n}").alias(f"_sum_{n}") for n in values))
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_block", *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in values))
    inside = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = own.join(before, [*by, "_block"]).withColumns({n: F.col(f"_before_{n}") + F.sum(f"_own_{n}").over(inside) for n in values})
    return out.drop("_block", *(f"{p}_{n}" for n in values for p in ("_own", "_before")))


def cumulative_accuracy(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds row_number, cumulative_correct and cumulative_accuracy, by instance_id; the first row divides by 1, not by its id 0."""
    out = running_sums(results, "instance_id", {"row_number": F.lit(1).cast("long"), "cumulative_correct": F.col("is_correct").cast("long")}, by=by)
    return out.withColumn("cumulative_accuracy", F.col("cumulative_correct").cast("double") / F.col("row_number"))


def prequential_window(n: int) -> int:
    return max(500, min(n // 100, 10_000))


def prequential_accuracy(results: DataFrame, window: int, block: int = BLOCK) -> DataFrame:
    """Accuracy over the last `window` instances; null until there are so many.

    A block also gets the last `window` rows before it, so that the row to look back to is always in it.
    """
    block = max(block, window)
    home, last = F.floor(F.col("row_number") / block), F.floor((F.col("row_number") + window) / block)
    out = cumulative_accuracy(results).withColumn("_home", home).withColumn("_block", F.explode(F.sequence(F.col("_home"), last)))
    back = F.lag("cumulative_correct", window).over(Window.partitionBy("_block").orderBy("row_number"))
    inside = F.col("cumulative_correct") - F.coalesce(back, F.lit(0))
    out = out.withColumn("prequential_accuracy", F.when(F.col("row_number") >= window, inside.cast("double") / window))
    return out.where("_home = _block").drop("_home", "_block")


def sampled(curve: DataFrame, step: int) -> DataFrame:
    return curve.where((F.col("row_number") - 1) % step == 0)


def drift_epochs(results: DataFrame) -> DataFrame:
    """Adds epoch (drifts before the row) and epoch_accuracy (correct share since the last drift, the row included)."""
    out = running_sums(results, "instance_id", {"_drifts": F.col("drift_detected").cast("long")})
    out = out.withColumn("epoch", F.col("_drifts") - F.col("drift_detected").cast("long")).drop("_drifts")
    out = cumulative_accuracy(out, by=("epoch",))
    return out.withColumnRenamed("cumulative_accuracy", "epoch_accuracy")


def speedup(runs: DataFrame) -> DataFrame:
    """Adds speedup and efficiency (percent), against the run of fewest threads; runs are a short log."""
    first = Window.orderBy("n_threads")
    base_throughput, base_threads = F.first("throughput").over(first), F.first("n_threads").over(first)
    out = runs.withColumn("speedup", F.col("throughput") / base_throughput)
    return out.withColumn("efficiency", F.col("speedup") / (F.col("n_threads") / base_threads) * 100)


def pareto_frontier(runs: DataFrame, by: str) -> DataFrame:
    """The runs of each group whose accuracy exceeds that of all runs of less throughput."""
    earlier = Window.partitionBy(by).orderBy("throughput", "id").rowsBetween(Window.unboundedPreceding, -1)
    return runs.withColumn("_best", F.max("accuracy").over(earlier)).where(F.col("_best").isNull() | (F.col("accuracy") > F.col("_best"))).drop("_best")


def latest_config(runs: DataFrame, config: list[str]) -> DataFrame:
    """All runs with the configuration of the last one, by id."""
    last = runs.agg(F.max_by(F.struct(*config), "id").alias("c")).select("c.*")
    return runs.join(F.broadcast(last), config)  # one row
