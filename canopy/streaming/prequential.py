"""The prequential run as a stream: a tree is a key whose learner lives in the state store; votes are combined batch by batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from canopy.operators.batch_trees import BatchRunner
from canopy.operators.voting import combine, results
from canopy.plans.config import EnsembleConfig
from canopy.plans.prequential import TREE_RESULT, fan_out, result_frame, step_rows


class TreeProcessor(StatefulProcessor):
    """Test-then-train of one tree; the learner with its random state is kept between batches."""

    def __init__(self, config: EnsembleConfig, n_features: int, n_classes: int) -> None:
        self.config, self.n_features, self.n_classes = config, n_features, n_classes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("runner", T.StructType([T.StructField("pickled", T.BinaryType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("instance_id")  # a group has no order of its own
        runner = pickle.loads(bytes(self.state.get()[0])) if self.state.exists() else BatchRunner(self.config, int(key[0]), self.n_features, self.n_classes)
        out = result_frame(step_rows(runner, part))
        self.state.update((pickle.dumps(runner),))
        yield out

    def close(self) -> None:
        pass


def learn_stream(instances: DataFrame, config: EnsembleConfig, n_features: int, n_classes: int) -> DataFrame:
    """TREE_RESULT rows of a streaming table of instances.  Needs the RocksDB state store provider."""
    keyed = fan_out(instances, config.n_trees).groupBy("tree_id")
    return keyed.transformWithStateInPandas(TreeProcessor(config, n_features, n_classes), TREE_RESULT, "Append", "None")


def vote_stream(tree_results: DataFrame, config: EnsembleConfig, n_classes: int, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Combines each batch's votes and hands them to a sink with the batch's id; a batch holds all trees' rows of its instances."""
    return tree_results.writeStream.foreachBatch(lambda batch, batch_id: sink(results(combine(batch, config.voting, n_classes, config.n_trees)), batch_id))
