"""What runs leave behind, as tables: results, the run log, and benchmark rows by seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators import metrics

RESULTS = "instance_id long, is_correct boolean, drift_detected boolean, avg_depth double"
_COMMON = "id string, n_threads int, time double, n_instances long, throughput double, dataset string, n_trees int, voting string, seed int, ensemble_type string"
#: The run log of each family: what was measured, then the configuration flattened.
LOGS = {
    "ht": f"{_COMMON}, drift_detection boolean, max_bins int, n_min int, delta double, tau double, features_patch double, lambda double, adwin_delta_warning double, adwin_delta_drift double, numeric_estimator string",
    "amf": f"{_COMMON}, step double, dirichlet double, split_pure boolean",
}
#: The columns that make two runs the same but for their threads.
SAME = {
    "ht": ["dataset", "n_trees", "voting", "ensemble_type", "drift_detection", "n_min", "delta", "tau", "features_patch", "lambda", "numeric_estimator"],
    "amf": ["dataset", "n_trees", "voting", "ensemble_type", "step", "dirichlet"],
}
BENCHMARK = "dataset string, throughput double, accuracy double, n_models int, seed int"


def read_log(spark: SparkSession, out_dir: str, family: str) -> DataFrame:
    return spark.read.schema(LOGS[family]).option("header", True).csv(f"{out_dir}/master_log_{family}")


def read_results(spark: SparkSession, out_dir: str) -> DataFrame:
    """Results of all runs below a folder, with each run's id."""
    rows = spark.read.schema(RESULTS).option("header", True).csv(f"{out_dir}/*/accuracy")
    return rows.withColumn("id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/accuracy/[^/]*$", 1))


def runs_with_final_accuracy(spark: SparkSession, out_dir: str, family: str) -> DataFrame:
    """The log with each run's accuracy over all of its instances; runs without results stay, with null."""
    final = read_results(spark, out_dir).groupBy("id").agg(F.avg(F.col("is_correct").cast("double")).alias("final_accuracy"))
    return read_log(spark, out_dir, family).join(final, "id", "left")


def scalability(spark: SparkSession, out_dir: str, family: str) -> DataFrame:
    """Speed-up and efficiency over threads, of the runs with the same configuration as the last one; nulls are equal."""
    log = read_log(spark, out_dir, family)
    told = log.withColumn("_config", F.to_json(F.struct(*SAME[family])))
    return metrics.speedup(metrics.latest_config(told, ["_config"]).drop("_config"))


def append_benchmark(spark: SparkSession, rows: list[tuple], out_dir: str) -> None:
    """Adds rows of BENCHMARK, one for each seed that was run."""
    spark.createDataFrame(rows, BENCHMARK).coalesce(1).write.mode("append").option("header", True).csv(f"{out_dir}/benchmark")


def read_benchmark(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(BENCHMARK).option("header", True).csv(f"{out_dir}/benchmark")
