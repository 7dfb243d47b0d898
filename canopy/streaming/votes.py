"""Votes that come in any order and in different batches, labels that come later than the votes, and a sink that a restart doesn't double.

The trees' rows of an instance meet in the state store, instances by ranges of ids.  An instance is told once all its trees have answered; one that
waits longer than `patience` is told with the trees there are, marked as incomplete, and its state goes.  What comes later still counts as a new
instance, which will be incomplete in its turn, so no row is lost in silence.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from canopy.operators.voting import ballots
from canopy.plans.config import EnsembleConfig

COMBINED = "instance_id long, label int, winner int, combined array<double>, drift_detected boolean, avg_depth double, n_trees int, complete boolean"
_PARTIAL = "label int, combined array<double>, drift boolean, depth double, n int, since long"
_COLUMNS = [c.split()[0] for c in COMBINED.split(", ")]


class VoteProcessor(StatefulProcessor):
    """Partial sums of votes for each instance of a range of ids, until all trees have answered."""

    def __init__(self, n_trees: int, patience_ms: int) -> None:
        self.n_trees, self.patience = n_trees, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "instance_id long", _PARTIAL)

    def _row(self, instance: int, part: tuple) -> tuple:
        label, combined, drift, depth, n, _ = part
        winner = len(combined) - 1 - int(np.argmax(combined[::-1]))
        return instance, label, winner, list(combined), drift, depth / n, n, n >= self.n_trees

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_COLUMNS)
        out["label"] = out["label"].astype("Int32")
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now, done = timerValues.getCurrentProcessingTimeInMs(), []
        part = pd.concat(list(rows))
        for instance, own in part.groupby("instance_id", sort=True):
            label = own["label"].dropna()
            votes = np.sum(np.stack(own["ballots"].to_list()), axis=0)
            new = (int(label.iloc[0]) if len(label) else None, votes, bool(own["drift"].any()), float(own["depth"].sum()), len(own), now)
            at = (int(instance),)
            if self.waiting.containsKey(at):
                old = self.waiting.getValue(at)
                new = (old[0] if old[0] is not None else new[0], np.asarray(old[1]) + votes, old[2] or new[2], old[3] + new[3], old[4] + new[4], old[5])
            new = (new[0], [float(v) for v in new[1]], *new[2:])
            if new[4] < self.n_trees:
                self.waiting.updateValue(at, new)
                continue
            if self.waiting.containsKey(at):
                self.waiting.removeKey(at)
            done.append(self._row(int(instance), new))
        if self.waiting.exists() and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(now + self.patience)
        yield self._frame(done)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now, late = timerValues.getCurrentProcessingTimeInMs(), []
        for at, part in list(self.waiting.iterator()):
            if part[5] + self.patience <= now:
                late.append(self._row(int(at[0]), tuple(part)))
                self.waiting.removeKey((int(at[0]),))
        if self.waiting.exists():
            self.handle.registerTimer(now + self.patience)
        yield self._frame(late)

    def close(self) -> None:
        pass


def collect_votes(tree_results: DataFrame, config: EnsembleConfig, n_classes: int, patience_ms: int = 600_000, span: int = 256) -> DataFrame:
    """COMBINED rows of a streaming table of TREE_RESULT rows, whose trees may come in different batches.  Needs the RocksDB state store provider."""
    rows = tree_results.select(F.floor(F.col("instance_id") / span).alias("_range"), "instance_id", "label", "drift", "depth", F.array(*ballots(config.voting, n_classes)).alias("ballots"))
    return rows.groupBy("_range").transformWithStateInPandas(VoteProcessor(config.n_trees, patience_ms), COMBINED, "Append", "ProcessingTime")


def with_late_labels(predictions: DataFrame, labels: DataFrame, patience: str) -> DataFrame:
    """Predictions (instance_id, at, winner) with the labels (instance_id, labelled_at, label) that come within `patience` after them; correct is null without one.

    An interval join of two streams: a prediction waits in the state until its label comes or the watermark passes the interval.
    """
    known = labels.withWatermark("labelled_at", patience).select(F.col("instance_id").alias("_id"), "labelled_at", "label")
    at = (F.col("instance_id") == F.col("_id")) & (F.col("labelled_at") >= F.col("at")) & (F.col("labelled_at") <= F.col("at") + F.expr(f"INTERVAL {patience}"))
    rows = predictions.withWatermark("at", patience).join(known, at, "leftOuter").drop("_id")
    return rows.withColumn("correct", F.col("winner") == F.col("label"))


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own number: a batch that runs again after a restart takes the place of what it wrote before."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
