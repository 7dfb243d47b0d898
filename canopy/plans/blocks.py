"""The prequential run in blocks: test a block, count it with all tasks, decide splits and drift from the counts, go on to the next.

Each block is a few Spark jobs over its instances; what they leave is the next version of three tables: the nodes of all live trees, the sums of
their leaves, and the windows over each slot's errors.  A warning starts a background tree for the slot, which learns beside the one that votes;
a drift puts it in that one's place (or a fresh tree, if there is none), and the slot's windows and accuracy start anew.  Trees have numbers that are
never used again, so a version is a row of the forest table with its block, tree and slot.

No task holds a tree's stream: a slot's instances may be in any number of tasks, and only partial sums meet.  The driver holds the nodes, up to
`most_nodes`, and a few numbers for each slot and block.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from canopy.operators import block_trees as T
from canopy.operators import windows
from canopy.operators.voting import combine, results
from canopy.plans.config import EnsembleConfig, HoeffdingConfig
from canopy.plans.prequential import shape
from canopy.sources.scratch import scratch_dir, staged


@dataclass(frozen=True)
class BlockParams:
    #: Instances of the first block, about, the factor from one block to the next, and the most of one.
    first: int = 1000
    growth: float = 2.0
    most: int = 20_000_000
    #: Ticks of a block that the windows can tell apart.
    ticks: int = 32
    #: Nodes of live trees, which travel as arrays with their leaves' sums (as text in the plan they were at most 100,000).
    most_nodes: int = 1_000_000
    #: Ranges of ids whose rows are counted to find the blocks' ends.
    ranges: int = 100_000


@dataclass
class _Slot:
    tree: T.BlockTree
    background: T.BlockTree | None = None
    seen: int = 0
    right: int = 0

    @property
    def accuracy(self) -> float:
        return self.right / self.seen if self.seen else 0.0


@dataclass
class BlockRun:
    """What a run leaves: TREE_RESULT rows, versions of the forest, and a row for each slot and block."""

    results: DataFrame
    #: Trees as they stood before a block: the tree, the block, whether it was in the background, and its nodes then.
    versions: list[tuple[T.BlockTree, int, bool, int]]
    slots: DataFrame
    #: Sums of the live leaves, less `origins`; None if there was no block.
    stats: DataFrame | None
    trees: list[T.BlockTree] = field(default_factory=list)

    @property
    def forest(self) -> DataFrame:
        return self.slots.sparkSession.createDataFrame([T.row_of(*v) for v in self.versions], T.FOREST)


def block_ends(instances: DataFrame, p: BlockParams) -> list[tuple[int, int]]:
    """Ranges [low, high) of ids with about as many instances as a block should have; ids may be sparse."""
    low, high = instances.agg(F.min("instance_id"), F.max("instance_id")).first()
    if low is None:
        return []
    step = max(1, -(-(high - low + 1) // p.ranges))
    counts = dict(instances.groupBy(F.floor((F.col("instance_id") - low) / step).alias("at")).count().collect())  # at most `ranges` rows
    out, begin, held, wanted = [], low, 0, float(p.first)
    for at in range(-(-(high - low + 1) // step)):
        held += counts.get(at, 0)
        if held >= wanted:
            out.append((begin, low + (at + 1) * step))
            begin, held, wanted = out[-1][1], 0, min(wanted * p.growth, p.most)
    if held:
        out.append((begin, high + 1))
    return out


def _trees(slots: list[_Slot]) -> Iterator[T.BlockTree]:
    for s in slots:
        yield s.tree
        if s.background is not None:
            yield s.background


def _means(instances: DataFrame, n_features: int) -> list[float]:
    """Whole numbers near the features' means, from which sums are counted."""
    row = instances.agg(*(F.avg(F.get("features", F.lit(i))) for i in range(n_features))).first()
    return [float(np.floor(x)) if x is not None and np.isfinite(x) else 0.0 for x in row]


def _errors(told: DataFrame, begin: int, end: int, first_tick: int, ticks: int) -> DataFrame:
    """slot, tick, n and s (taken instances and errors among them), seen, right and last (largest id) of the trees that vote."""
    tick = F.lit(first_tick) + F.floor((F.col("instance_id") - begin) * ticks / (end - begin))
    taken, wrong = F.col("k") > 0, (F.col("predicted") != F.col("label")).cast("long")
    rows = told.where("NOT background AND label IS NOT NULL").withColumn("tick", tick.cast("long"))
    return rows.groupBy("slot", "tick").agg(F.sum(taken.cast("long")).alias("n"), F.sum(F.when(taken, wrong).otherwise(F.lit(0))).cast("double").alias("s"), F.count("*").alias("seen"), F.sum(1 - wrong).alias("right"), F.max("instance_id").alias("last"))


_BUCKETS = "slot int, kind string, tick long, n long, s double"


def _signals(state: DataFrame, errors: list[Row], now: int, config: HoeffdingConfig) -> tuple[DataFrame, dict[int, set[str]]]:
    """The windows after a block, and by slot which of them found that errors rose.

    A block that teaches a lot makes errors fall at once; windows then forget what was before, but that is no drift.
    Windows are a few hundred numbers a slot, whatever the block, and come to the driver between blocks.
    """
    spark, keys = state.sparkSession, ["slot", "kind"]
    new = spark.createDataFrame([(r["slot"], kind, r["tick"], r["n"], r["s"]) for r in errors if r["n"] for kind in ("drift", "warning")], _BUCKETS)
    buckets = windows.merged(state.unionByName(new).repartition(*keys), keys, now)
    delta = F.when(F.col("kind") == "drift", F.lit(config.adwin_delta_drift)).otherwise(F.lit(config.adwin_delta_warning))
    told = windows.tested(buckets, keys, delta).select(*keys, "rose", "buckets").collect()
    risen: dict[int, set[str]] = {}
    for r in told:
        if r["rose"]:
            risen.setdefault(r["slot"], set()).add(r["kind"])
    return spark.createDataFrame([(r["slot"], r["kind"], *b) for r in told for b in r["buckets"]], _BUCKETS), risen


def learn_blocks(instances: DataFrame, config: EnsembleConfig, p: BlockParams | None = None, ends: list[tuple[int, int]] | None = None, learn_last: bool = True) -> BlockRun:
    """Learns a Hoeffding ensemble block by block; `ends` sets the blocks' ranges of ids.  Without `learn_last` the last block is only tested: results don't need more.

    Instances without a label are predicted and not learned; a feature that is null or missing is counted nowhere and goes high.
    """
    p, a, spark = p or BlockParams(), config.algorithm, instances.sparkSession
    if not isinstance(a, HoeffdingConfig) or a.numeric_estimator != "gaussian":
        raise ValueError("blocks learn Hoeffding trees with the gaussian estimator")
    n_features, n_classes, _ = shape(instances)
    n_classes, folder = max(1, n_classes), scratch_dir(spark)
    ends = block_ends(instances, p) if ends is None else ends
    numbers = iter(range(2**31))
    tree = lambda slot, background=False: T.BlockTree(next(numbers), slot, background, a, n_features, config.seed)
    slots = [_Slot(tree(i)) for i in range(config.n_trees)]
    stats = leaves = origins = None  # leaves: the sums of the live leaves, as sent
    state = spark.createDataFrame([], _BUCKETS)
    versions, log = [], []
    for block, (begin, end) in enumerate(ends):
        rows = instances.where((F.col("instance_id") >= begin) & (F.col("instance_id") < end)).repartition("instance_id")  # a block may lie in few files
        origins = _means(rows, n_features) if origins is None else origins
        live = list(_trees(slots))
        if (n := sum(len(t.nodes) for t in live)) > p.most_nodes:
            raise ValueError(f"{n} nodes are more than the {p.most_nodes} that travel with a plan")
        versions += [(t, block, t.background, len(t.nodes)) for t in live]
        path = f"{folder}/block={block}"
        T.told(rows, live, leaves, origins, a, n_classes, config.seed).write.parquet(path)
        told = T.by_tree(spark.read.parquet(path))
        with ThreadPoolExecutor(1) as other:  # what drift and what splits need are jobs of their own
            watched = other.submit(_watch, told, state, block, (begin, end), a, p)
            learns = learn_last or block + 1 < len(ends)
            stats = staged(T.merge_stats(stats, T.new_stats(told, origins))) if learns else stats
            found = _splits(stats, origins, a, n_classes) if learns else []
            errors, state, risen = watched.result()
        by_number = {t.tree_no: t for t in live}
        for r in found:
            by_number[r["tree_no"]].split(r["node"], r["feature"], r["point"], list(r["low"]), list(r["high"]))
        for i, s in enumerate(slots):
            own, kinds, before = [r for r in errors if r["slot"] == i], risen.get(i, set()), s.accuracy
            s.seen, s.right = s.seen + sum(r["seen"] for r in own), s.right + sum(r["right"] for r in own)
            log.append((block, i, s.tree.tree_no, s.background.tree_no if s.background else None, before, s.accuracy, "warning" in kinds, "drift" in kinds, max((r["last"] for r in own), default=None)))
            if "drift" in kinds:
                grown = s.background or tree(i)
                grown.background = False
                slots[i] = _Slot(grown)
            elif "warning" in kinds and s.background is None:
                s.background = tree(i, True)
        state = state.where(~F.col("slot").isin([i for i, k in risen.items() if "drift" in k]))
        if not learns:
            break
        stats = _alive(stats, slots, a)
        leaves = stats.select("tree_no", "node", "cls", "feature", "n", "s", "ss").toArrow() if block + 1 < len(ends) else None
    slots_schema = "block int, slot int, tree_no int, background_no int, before double, after double, warned boolean, drifted boolean, last long"
    told_slots = spark.createDataFrame(log, slots_schema)
    versions += [(t, len(ends), t.background, len(t.nodes)) for t in _trees(slots)]
    return BlockRun(_results(instances, folder, told_slots, config, bool(ends)), versions, told_slots, stats, list(_trees(slots)))


def _watch(told: DataFrame, state: DataFrame, block: int, ends: tuple[int, int], a: HoeffdingConfig, p: BlockParams) -> tuple[list[Row], DataFrame, dict[int, set[str]]]:
    """A block's errors (at most `ticks` rows a slot), and the windows and signals after it."""
    errors = _errors(told, *ends, block * p.ticks, p.ticks).collect()
    return errors, *(_signals(state, errors, (block + 1) * p.ticks, a) if a.drift_detection else (state, {}))


def _splits(stats: DataFrame, origins: list[float], a: HoeffdingConfig, n_classes: int) -> list[Row]:
    """The splits of leaves that are ready and whose best one is good enough: a row for each of them."""
    found = T.best_splits(T.ready(stats, a), origins, a, n_classes).where("splits")
    return sorted(found.collect(), key=lambda r: (r["tree_no"], r["node"]))


def _alive(stats: DataFrame, slots: list[_Slot], a: HoeffdingConfig) -> DataFrame:
    """The sums without trees that are gone and leaves that have split; leaves whose test failed begin to wait again."""
    nodes = [(t.tree_no, i) for t in _trees(slots) for i, n in enumerate(t.nodes) if n.feature < 0]
    keep = F.broadcast(stats.sparkSession.createDataFrame(nodes, "tree_no int, node int"))  # at most `most_nodes`
    waits = (F.col("feature") < 0) & (F.col("n") >= a.n_min)
    return stats.join(keep, ["tree_no", "node"], "left_semi").withColumn("n", F.when(waits, F.lit(0.0)).otherwise(F.col("n")))


def _results(instances: DataFrame, folder: str, slots: DataFrame, config: EnsembleConfig, any_blocks: bool) -> DataFrame:
    """TREE_RESULT: a slot's drift is told at its block's last learned instance, and its accuracy is that before the block (or after it)."""
    if not any_blocks:
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        return instances.where("false").select(none("tree_id", "int"), "instance_id", none("votes", "array<double>"), "label", F.lit(False).alias("drift"), F.lit(0.0).alias("accuracy"), none("predicted", "int"), none("depth", "int"))
    rows = T.by_tree(instances.sparkSession.read.option("basePath", folder).parquet(folder), "block").where("NOT background")
    told = F.col("before") if config.accuracy_timing == "before" else F.col("after")
    rows = rows.join(F.broadcast(slots), ["block", "slot"])  # one row a slot and block
    return rows.select(F.col("slot").alias("tree_id"), "instance_id", "votes", "label", (F.col("drifted") & F.col("instance_id").eqNullSafe(F.col("last"))).alias("drift"), told.alias("accuracy"), "predicted", "depth")


def prequential_blocks(instances: DataFrame, config: EnsembleConfig, p: BlockParams | None = None, ends: list[tuple[int, int]] | None = None) -> DataFrame:
    """instance_id, is_correct, drift_detected, avg_depth for each instance."""
    n_classes = max(1, shape(instances)[1])
    return results(combine(learn_blocks(instances, config, p, ends, learn_last=False).results, config.voting, n_classes, config.n_trees))
