"""The prequential run as Spark jobs: fan out to trees, learn in order for each tree, combine votes, report."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import asdict, replace
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.operators.batch_trees import BatchRunner
from canopy.operators.estimators import last_maxes
from canopy.operators.trees import Steps
from canopy.operators.voting import RESULT
from canopy.plans.config import EnsembleConfig, HoeffdingConfig
from canopy.sources.arff import read_arff
from canopy.sources.runs import LOGS, append_benchmark

#: Rows that a learner takes: instance_id long, features array<double>, label int (null: unlabelled).
INSTANCE = "instance_id long, features array<double>, label int"
TREE_RESULT = "tree_id int, instance_id long, votes array<double>, label int, drift boolean, accuracy double, predicted int, depth int"
_RESULT_TYPES = pa.schema({"tree_id": pa.int32(), "instance_id": pa.int64(), "votes": pa.list_(pa.float64()), "label": pa.int32(), "drift": pa.bool_(), "accuracy": pa.float64(), "predicted": pa.int32(), "depth": pa.int32()})
_COLUMNS = _RESULT_TYPES.names


#: Instances packed into a row at most, and numbers in them; instances in a partition that sorts them, or in one that votes meet in.
PACKED, PACKED_NUMBERS, SORTED = 16_384, 1_000_000, 250_000


def fan_out(instances: DataFrame, n_trees: int) -> DataFrame:
    """Each instance once for each tree."""
    return instances.select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id"), "instance_id", "features", "label")


def batched(config: EnsembleConfig) -> int:
    """Instances in a pack at most; a batch of a Mondrian tree costs some steps for each level of it, so it takes more at once."""
    return PACKED * (4 if config.algorithm.type == "amf" else 1)


def _parts(n_instances: int) -> int:
    return max(1, -(-n_instances // SORTED))


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all()


def pack(instances: DataFrame, n_features: int, n_instances: int | None = None, most: int | None = None) -> DataFrame:
    """Instances in order of id, many in a row: pack long (their order), rows binary (Arrow: instance_id, label, f0, f1, ...)."""
    most = max(1, min(most or PACKED, PACKED_NUMBERS // (n_features + 2)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, key = [], 0, TaskContext.get().partitionId() << 32

        def row(table: pa.Table) -> pa.RecordBatch:
            nonlocal key
            key += 1
            return pa.RecordBatch.from_pydict({"pack": pa.array([key], pa.int64()), "rows": pa.array([_bytes(table.combine_chunks())], pa.binary())})

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                table = pa.Table.from_batches(held)
                whole = n - n % most
                for at in range(0, whole, most):
                    yield row(table.slice(at, most))
                held, n = table.slice(whole).to_batches(), n - whole
        if n:
            yield row(pa.Table.from_batches(held))

    flat = instances.select("instance_id", "label", *(F.get("features", F.lit(i)).alias(f"f{i}") for i in range(n_features)), "features")
    ranged = flat.repartitionByRange("instance_id") if n_instances is None else flat.repartitionByRange(_parts(n_instances), "instance_id")
    return ranged.sortWithinPartitions("instance_id", "label", "features").drop("features").mapInArrow(run, "pack long, rows binary")


def deal(instances: DataFrame, n_trees: int, n_features: int, n_instances: int | None = None, most: int | None = None) -> DataFrame:
    """Each tree's packed instances (tree_id, pack, rows) in a partition of its own, in order of id."""
    packed = pack(instances, n_features, n_instances, most).select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree_id"), "pack", "rows")
    return packed.repartitionById(n_trees, "tree_id").sortWithinPartitions("tree_id", "pack")


def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table, np.ndarray, list[int | None]]]:
    """Of a partition of `deal`: tree, pack, its table, features and labels."""
    for batch in batches:
        for tree_id, key, rows in zip(batch["tree_id"].to_pylist(), batch["pack"].to_pylist(), batch["rows"], strict=True):
            table = _table(rows)
            xs = [table.column(i).to_numpy() for i in range(2, table.num_columns)]
            yield tree_id, key, table, np.stack(xs, axis=1).astype(float) if xs else np.zeros((table.num_rows, 0)), table["label"].to_pylist()


def result_frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("label", "predicted"):
        out[c] = out[c].astype("Int32")
    return out


def batch_rows(runner: BatchRunner, ids: list[int], xs: np.ndarray, labels: list[int | None]) -> list[tuple]:
    """Rows of TREE_RESULT.  An instance without a label is predicted and not learned."""
    told, accuracy = runner.steps(xs, labels)
    voted = told.predicted >= 0
    votes = [v if ok else [] for v, ok in zip(told.votes.tolist(), voted.tolist(), strict=True)]
    predicted = [p if ok else None for p, ok in zip(told.predicted.tolist(), voted.tolist(), strict=True)]
    return list(zip([runner.tree_id] * len(ids), ids, votes, labels, told.drift.tolist(), accuracy.tolist(), predicted, told.depth.tolist(), strict=True))


def step_rows(runner: BatchRunner, part: pd.DataFrame) -> list[tuple]:
    labels = [None if y is None or y != y else int(y) for y in part["label"].tolist()]
    return batch_rows(runner, part["instance_id"].tolist(), np.array([np.asarray(x, float) for x in part["features"]]), labels)


def learn(instances: DataFrame, config: EnsembleConfig, n_features: int, n_classes: int) -> DataFrame:
    """TREE_RESULT rows.  A tree is one key: its instances are sorted by id and streamed, and only the tree is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner: BatchRunner | None = None
        for tree_id, _, table, xs, labels in dealt(batches):
            if runner is None or runner.tree_id != tree_id:
                runner = BatchRunner(config, tree_id, n_features, n_classes)
            yield pa.RecordBatch.from_pandas(result_frame(batch_rows(runner, table["instance_id"].to_pylist(), xs, labels)), _RESULT_TYPES, preserve_index=False)

    return deal(instances, config.n_trees, n_features).mapInArrow(run, TREE_RESULT)


def ballots(told: Steps, accuracy: np.ndarray, voting: str) -> np.ndarray:
    """What a tree puts in for each class, as `voting.ballots`."""
    if voting == "majority":
        return (told.predicted[:, None] == np.arange(told.votes.shape[1])).astype(float)
    votes = np.where((told.predicted >= 0)[:, None], told.votes, 0.0)
    return votes if voting == "soft" else votes * np.clip(accuracy, 0.0, 1.0)[:, None]


def learn_packed(instances: DataFrame, config: EnsembleConfig, n_features: int, n_classes: int, n_instances: int) -> DataFrame:
    """tree_id, pack and a tree's part in the results of a pack's instances; ids and labels go with the first tree's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runner: BatchRunner | None = None
        for tree_id, key, table, xs, labels in dealt(batches):
            if runner is None or runner.tree_id != tree_id:
                runner = BatchRunner(config, tree_id, n_features, n_classes)
            told, accuracy = runner.steps(xs, labels)
            own = ballots(told, accuracy, config.voting)
            out = {f"v{c}": own[:, c] for c in range(n_classes)} | {"drift": told.drift, "depth": told.depth.astype(np.int32)}
            if tree_id == 0:
                out |= {"instance_id": table["instance_id"], "label": table["label"]}
            made = pa.array([_bytes(pa.table(out))], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([tree_id], pa.int32()), pa.array([key], pa.int64()), made], ["tree_id", "pack", "rows"])

    return deal(instances, config.n_trees, n_features, n_instances, batched(config)).mapInArrow(run, "tree_id int, pack long, rows binary")


def meet(told: DataFrame, n_trees: int, n_classes: int, n_instances: int) -> DataFrame:
    """RESULT rows: a pack's votes of all trees meet in one place, tree by tree, and are added there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree_id, rows in zip(batch["tree_id"].to_pylist(), batch["rows"], strict=True):
                own = _table(rows)
                votes = np.stack([own[f"v{c}"].to_numpy() for c in range(n_classes)], axis=1)
                drift, depth = own["drift"].to_numpy(), own["depth"].to_numpy().astype(np.int64)
                if tree_id == 0:
                    first, sums, drifts, depths = own, votes, drift, depth
                else:
                    sums, drifts, depths = sums + votes, drifts | drift, depths + depth
                if tree_id == n_trees - 1:
                    right = last_maxes(sums) == first["label"].fill_null(-1).to_numpy()
                    columns = [first["instance_id"].combine_chunks(), pa.array(right), pa.array(drifts), pa.array(depths / n_trees)]
                    yield pa.RecordBatch.from_arrays(columns, ["instance_id", "is_correct", "drift_detected", "avg_depth"])

    return told.repartition(_parts(n_instances), "pack").sortWithinPartitions("pack", "tree_id").mapInArrow(run, RESULT)


def shape(instances: DataFrame) -> tuple[int, int, int]:
    """Numbers of features, classes and instances."""
    row = instances.agg(F.max(F.size("features")), F.max("label"), F.count("*")).first()
    return max(0, int(row[0] or 0)), int(-1 if row[1] is None else row[1]) + 1, int(row[2])


def answered(instances: DataFrame, config: EnsembleConfig, n_features: int, n_classes: int, n_instances: int) -> DataFrame:
    return meet(learn_packed(instances, config, n_features, max(1, n_classes), n_instances), config.n_trees, max(1, n_classes), n_instances)


def prequential(instances: DataFrame, config: EnsembleConfig) -> DataFrame:
    """instance_id, is_correct, drift_detected, avg_depth for each instance."""
    return answered(instances, config, *shape(instances))


def run_id(config: EnsembleConfig, now: datetime | None = None) -> str:
    name = config.dataset.split("/")[-1].replace("_", "")
    return f"{name}_{config.algorithm.type}_{config.n_trees}_{config.voting}_{config.seed}_{(now or datetime.now()):%m%d_%H%M%S}"


def resolved(config: EnsembleConfig, n_features: int) -> EnsembleConfig:
    """The configuration with the share of features that a tree really takes."""
    a = config.algorithm
    if not isinstance(a, HoeffdingConfig) or n_features < 1:
        return config
    return replace(config, algorithm=replace(a, features_patch=a.subspace_size(n_features) / n_features))


def log_row(spark: SparkSession, config: EnsembleConfig, own_id: str, seconds: float, n_instances: int) -> DataFrame:
    """The run as a row of its family's log."""
    flat = {k.rstrip("_"): v for k, v in asdict(config.algorithm).items()}
    flat |= {"id": own_id, "n_threads": spark.sparkContext.defaultParallelism, "time": seconds, "n_instances": n_instances, "throughput": n_instances / max(seconds, 1e-9), "ensemble_type": flat.pop("type")}
    flat |= {"dataset": config.dataset, "n_trees": config.n_trees, "voting": config.voting, "seed": config.seed}
    schema = LOGS[family(config)]
    told = ((flat[name], kind) for name, kind in map(str.split, schema.split(", ")))
    return spark.createDataFrame([tuple(float(v) if kind == "double" and v is not None else v for v, kind in told)], schema)


def family(config: EnsembleConfig) -> str:
    return "amf" if config.algorithm.type == "amf" else "ht"


def run(instances: DataFrame, config: EnsembleConfig, out_dir: str) -> DataFrame:
    """Runs, writes results (CSV, in parts), the resolved configuration and a row of the run log; returns that row."""
    spark, own_id = instances.sparkSession, run_id(config)
    n_features, n_classes, n_instances = shape(instances)
    config, began = resolved(config, n_features), time.perf_counter()
    answered(instances, config, n_features, n_classes, n_instances).write.option("header", True).csv(f"{out_dir}/{own_id}/accuracy")
    seconds = time.perf_counter() - began
    spark.createDataFrame([(config.to_json(),)], "value string").coalesce(1).write.text(f"{out_dir}/{own_id}/config")
    log = log_row(spark, config, own_id, seconds, n_instances)
    log.coalesce(1).write.mode("append").option("header", True).csv(f"{out_dir}/master_log_{family(config)}")
    return log


def read_config(spark: SparkSession, path: str) -> EnsembleConfig:
    return EnsembleConfig.from_json(spark.read.text(path, wholetext=True).first()["value"])


def execute(spark: SparkSession, config_path: str, data_dir: str, out_dir: str) -> DataFrame:
    """A whole run from a configuration file: the dataset is the ARFF file of its name."""
    config = read_config(spark, config_path)
    return run(read_arff(spark, f"{data_dir}/{config.dataset}.arff"), config, out_dir)


def run_seeds(instances: DataFrame, config: EnsembleConfig, seeds: list[int], out_dir: str) -> None:
    """Runs once for each seed and adds its throughput and accuracy to the benchmark table."""
    n_features, n_classes, n_instances = shape(instances)
    for seed in seeds:
        began = time.perf_counter()
        accuracy = answered(instances, replace(config, seed=seed), n_features, n_classes, n_instances).agg(F.avg(F.col("is_correct").cast("double"))).first()[0]
        seconds = time.perf_counter() - began
        append_benchmark(instances.sparkSession, [(config.dataset, n_instances / max(seconds, 1e-9), accuracy, config.n_trees, seed)], out_dir)
