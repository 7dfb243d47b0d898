"""Hoeffding trees grown by aggregates: what many tasks count of a block of instances becomes splits, and no task learns a tree.

A block's instances walk all live trees as those stood before the block, and are predicted there.  Then, by one aggregate each, leaves get
weights and sums by class and feature, merged with what they had, and sums of how often the majority and naive Bayes were right.  Leaves that have seen
enough are tested: candidate thresholds' gains are aggregates of the leaves' sums, and the best feature must lead the next by the Hoeffding bound.

Differences that come with blocks: a leaf splits at most once a block; the children, which have seen nothing yet, vote in the next block by the class
weights that the split foresaw for them; majority and naive Bayes are compared as the leaf stood before the block.

A tree's nodes are few (a leaf needs `n_min` instances and a block to split) and travel as arrays with their leaves' sums, up to a counted size; instances
walk and vote by arrays of a batch, in a map that shuffles nothing.  The leaves' sums are tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import draws
from canopy.functions import exprs as X
from canopy.plans.config import HoeffdingConfig

#: Sums of a leaf, by class and feature; s and ss are of the value less the feature's origin.  A row of class and feature -1 has, in
#: their places, what the leaf has seen since its last test, and the weights that the majority and naive Bayes got right.
STATS = "tree_no int, node int, cls int, feature int, n double, s double, ss double, low double, high double"
POINTS, LEAST_SIDE, DIGITS = 10, 1.0, 9
_SUBSET_SALT, _BAG_SALT = 101, 7


def _m2() -> Column:
    """Squared deviations from sums; what rounding leaves of none is none."""
    rest = F.col("ss") - F.col("s") * F.col("s") / F.col("n")
    return F.when(rest > 1e-12 * F.col("ss"), rest).otherwise(F.lit(0.0))


@dataclass
class BlockNode:
    depth: int
    #: Features that the leaf counts.
    subspace: tuple[int, ...]
    #: Class weights that a split foresaw, until the leaf has seen instances.
    prior: list[float] | None = None
    feature: int = -1
    threshold: float = 0.0
    low: int = -1
    high: int = -1


@dataclass
class BlockTree:
    tree_no: int
    slot: int
    background: bool
    config: HoeffdingConfig
    n_features: int
    seed: int
    nodes: list[BlockNode] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.nodes:
            self.nodes.append(BlockNode(0, self.subspace(0)))

    def subspace(self, node: int) -> tuple[int, ...]:
        """Random patches draw once for the tree, adaptive forests for each leaf."""
        stream = self.tree_no * 1_000_003 + (node if self.config.type == "arf" else 0)
        return draws.subset(self.n_features, self.config.subspace_size(self.n_features), stream, self.seed + _SUBSET_SALT)

    def split(self, node: int, feature: int, threshold: float, low: list[float], high: list[float]) -> None:
        at, n = self.nodes[node], len(self.nodes)
        at.feature, at.threshold, at.low, at.high = feature, threshold, n, n + 1
        self.nodes += [BlockNode(at.depth + 1, self.subspace(n + i), prior) for i, prior in enumerate((low, high))]

    @property
    def depth(self) -> int:
        return max(n.depth for n in self.nodes)


_NODE = "struct<feature:int,threshold:double,low:int,high:int,depth:int,subspace:array<int>,prior:array<double>>"
FOREST = f"block int, tree_no int, slot int, background boolean, depth int, nodes array<{_NODE}>"


def row_of(tree: BlockTree, block: int, background: bool, size: int) -> tuple:
    """A tree as a row of FOREST, as it stood when it had `size` nodes; a leaf leads to itself."""
    nodes = []
    for i, n in enumerate(tree.nodes[:size]):
        split = n.feature >= 0 and n.low < size  # children come behind all nodes that there were
        nodes.append((n.feature if split else 0, n.threshold if split else 0.0, n.low if split else i, n.high if split else i, n.depth, list(n.subspace), n.prior))
    return block, tree.tree_no, tree.slot, background, max(n[4] for n in nodes), nodes


#: What an instance has at each live tree.
TOLD = "tree_no int, slot int, background boolean, node int, depth int, subspace array<int>, k int, votes array<double>, predicted int, majority_right boolean, bayes_right boolean"


@dataclass
class _Packed:
    """Live trees, and the sums that their leaves vote by, as arrays: some 100 bytes a node, which travel with a task's function."""

    trees: np.ndarray  # tree_no, slot, background, first node
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    below: np.ndarray  # low and high
    depths: np.ndarray
    subspace: np.ndarray
    #: Votes of leaves that have seen nothing.
    empty: np.ndarray
    #: Place of a node's sums, -1 for none.
    place: np.ndarray
    counts: np.ndarray
    mean: np.ndarray
    dev: np.ndarray
    known: np.ndarray
    majority: np.ndarray


def _shares(scores: np.ndarray) -> np.ndarray:
    """As `exprs.scores_to_votes`, by row."""
    positive = np.maximum(scores, 0.0)
    total = positive.sum(axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((total > 0) | np.isnan(total), positive / total, 1.0 / scores.shape[1])


def packed(trees: list[BlockTree], stats: pa.Table | None, origins: list[float], n_classes: int) -> _Packed:
    """`stats` are rows of STATS of live leaves."""
    nodes = [n for t in trees for n in t.nodes]
    first = np.cumsum([0, *(len(t.nodes) for t in trees)])
    own = np.arange(len(nodes))
    start = np.repeat(first[:-1], np.diff(first))
    feature = np.array([n.feature for n in nodes], np.int32)
    below = np.stack([np.where(feature >= 0, start + np.array([getattr(n, side) for n in nodes]), own) for side in ("low", "high")]).astype(np.int32)
    none = np.zeros(n_classes)
    empty = _shares(np.array([none if n.prior is None else n.prior for n in nodes], float).reshape(len(nodes), n_classes))
    subspace = np.array([n.subspace for n in nodes], np.int32).reshape(len(nodes), -1)
    place, width = np.full(len(nodes), -1, np.int32), subspace.shape[1]
    columns = {} if stats is None else {c: stats.column(c).to_numpy() for c in ("tree_no", "node", "cls", "feature", "n", "s", "ss")}
    sums = columns and columns["feature"] >= 0
    offsets = np.zeros(max(t.tree_no for t in trees) + 1, int)
    offsets[[t.tree_no for t in trees]] = first[:-1]
    at = columns and offsets[columns["tree_no"]] + columns["node"]
    leaves = np.unique(at[sums]) if columns else np.zeros(0, int)
    place[leaves] = np.arange(len(leaves))
    counts, majority = np.zeros((len(leaves), n_classes)), np.zeros(len(leaves), bool)
    mean, m2, known = (np.zeros((len(leaves), n_classes, width), kind) for kind in (float, float, bool))
    if columns:
        cls, f, n, s, ss = (columns[c][sums] for c in ("cls", "feature", "n", "s", "ss"))
        row, j = place[at[sums]], (subspace[at[sums]] == f[:, None]).argmax(axis=1)
        np.maximum.at(counts, (row, cls), n)
        rest = ss - s * s / n
        mean[row, cls, j], m2[row, cls, j], known[row, cls, j] = np.array(origins)[f] + s / n, np.where(rest > 1e-12 * ss, rest, 0.0), True
        tallies = ~sums & (place[at] >= 0)
        majority[place[at[tallies]]] = columns["s"][tallies] > columns["ss"][tallies]
    dev = np.sqrt(m2 / np.where(counts > 1, counts - 1, np.inf)[:, :, None])
    told = np.array([(t.tree_no, t.slot, t.background, o) for t, o in zip(trees, first, strict=False)], np.int32).reshape(len(trees), 4)
    depths = np.array([n.depth for n in nodes], np.int32)
    return _Packed(told, int(depths.max()), np.maximum(feature, 0), np.array([n.threshold for n in nodes]), below, depths, subspace, empty, place, counts, mean, dev, known, majority)


def dense(features: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as a matrix of the given width, and where it has null or nothing."""
    length = pc.fill_null(pc.list_value_length(features), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(features)
    row = np.repeat(np.arange(len(features)), length)
    column = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    x, absent = np.zeros((len(features), width)), np.ones((len(features), width), bool)
    use = column < width
    x[row[use], column[use]] = flat.to_numpy(zero_copy_only=False)[use]
    absent[row[use], column[use]] = pc.is_null(flat).to_numpy(zero_copy_only=False)[use]
    x[absent] = np.nan
    return x, absent


def _walk(p: _Packed, x: np.ndarray) -> np.ndarray:
    """Nodes by instance and tree; null and NaN go high."""
    at, row = np.tile(p.trees[:, 3], (len(x), 1)), np.arange(len(x))[:, None]
    for _ in range(p.depth):
        at = p.below[np.where(x[row, p.feature[at]] <= p.threshold[at], 0, 1), at]
    return at


def _naive(p: _Packed, leaf: np.ndarray, own: np.ndarray, x: np.ndarray, absent: np.ndarray) -> np.ndarray:
    """Votes of naive Bayes at leaves; x and absent are of the leaves' own features.  A null value gives no class a score."""
    weight = p.counts[leaf]
    density = np.ones(weight.shape)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore", under="ignore"):
        for j in range(own.shape[1]):
            s, d = p.dev[leaf, :, j], x[:, j, None] - p.mean[leaf, :, j]
            pdf = np.where(s < 1e-10, np.where(np.abs(d) < 1e-10, 1.0, 0.0), np.exp(-d * d / (2.0 * s * s)) / (s * math.sqrt(2 * math.pi)))
            density *= np.where(p.known[leaf, :, j], np.where(weight <= 1, 0.0, np.where(absent[:, j, None], 0.0, pdf)), 1.0)
        return _shares(weight / weight.sum(axis=1, keepdims=True) * density)


def _last_max(votes: np.ndarray) -> np.ndarray:
    return (votes.shape[1] - 1 - votes[:, ::-1].argmax(axis=1)).astype(np.int32)


def told(instances: DataFrame, trees: list[BlockTree], stats: pa.Table | None, origins: list[float], config: HoeffdingConfig, n_classes: int, seed: int) -> DataFrame:
    """instance_id, features, label, t: of each live tree (TOLD) its leaf, votes and prediction, k (how often its slot takes the instance), and whether the
    majority and naive Bayes are right.  A map over the instances, by arrays of a batch."""
    p, width = packed(trees, stats, origins, n_classes), trees[0].n_features
    bounds = np.array(draws.poisson_thresholds(config.lambda_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, features, label = (batch.column(c) for c in ("instance_id", "features", "label"))
            x, absent = dense(features, width)
            at = _walk(p, x)
            n, many = at.shape
            row, at = np.repeat(np.arange(n), many), at.ravel()
            tree, own, place = np.tile(np.arange(many), n), p.subspace[at], p.place[at]
            votes, major, bayes = p.empty[at], np.zeros(n * many, np.int32), np.full(n * many, n_classes - 1, np.int32)
            seen = place >= 0
            if seen.any():
                leaf, r = place[seen], row[seen]
                naive, shares = _naive(p, leaf, own[seen], x[r[:, None], own[seen]], absent[r[:, None], own[seen]]), _shares(p.counts[leaf])
                votes[seen] = np.where(p.majority[leaf][:, None], shares, naive)
                major[seen], bayes[seen] = _last_max(shares), _last_max(naive)
            slot = p.trees[:, 1]
            k = np.searchsorted(bounds, draws.uniform(ids.to_numpy()[:, None], slot[None, :].astype(np.int64), seed + _BAG_SALT).ravel(), side="right")
            unknown = np.repeat(pc.is_null(label).to_numpy(zero_copy_only=False), many)
            wanted = np.repeat(pc.fill_null(label, -1).to_numpy(zero_copy_only=False), many)
            fixed = lambda values: pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], values.ravel())
            fields = {
                "tree_no": p.trees[tree, 0], "slot": slot[tree], "background": p.trees[tree, 2] > 0, "node": (at - p.trees[tree, 3]).astype(np.int32), "depth": p.depths[at], "subspace": fixed(own), "k": k.astype(np.int32),
                "votes": fixed(votes), "predicted": _last_max(votes), "majority_right": pa.array(seen & (major == wanted), mask=unknown), "bayes_right": pa.array(bayes == wanted, mask=unknown),
            }
            own_trees = pa.StructArray.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in fields.values()], list(fields))
            lists = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * many, own_trees)
            yield pa.RecordBatch.from_arrays([ids, features, label, lists], ["instance_id", "features", "label", "t"])

    rows = instances.select(F.col("instance_id").cast("long").alias("instance_id"), F.col("features").cast("array<double>").alias("features"), F.col("label").cast("int").alias("label"))
    return rows.mapInArrow(run, f"instance_id long, features array<double>, label int, t array<struct<{TOLD.replace(' ', ':').replace(',:', ',')}>>")


def by_tree(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each instance and live tree."""
    return rows.select(*more, "instance_id", "features", "label", F.explode("t").alias("t")).select(*more, "instance_id", "features", "label", "t.*")


def learned(told: DataFrame) -> DataFrame:
    return told.where("k > 0 AND label IS NOT NULL")


def new_stats(told: DataFrame, origins: list[float]) -> DataFrame:
    """STATS of a block; a null or missing value counts as nothing."""
    taken = told.where("k > 0 AND label IS NOT NULL").withColumn("k", F.col("k").cast("double"))
    value = F.transform("subspace", lambda f: F.struct(f.alias("feature"), F.get("features", f).alias("x")))
    rows = taken.select("tree_no", "node", F.col("label").alias("cls"), "k", F.explode(value).alias("v"))
    rows = rows.select("tree_no", "node", "cls", F.col("v.feature").alias("feature"), "k", F.col("v.x").alias("x")).where("x IS NOT NULL")
    off = F.col("x") - F.get(F.array(*map(F.lit, origins)), F.col("feature"))
    sums = {"n": F.sum("k"), "s": F.sum(F.col("k") * off), "ss": F.sum(F.col("k") * off * off), "low": F.min("x"), "high": F.max("x")}
    moments = rows.groupBy("tree_no", "node", "cls", "feature").agg(*(c.alias(n) for n, c in sums.items()))
    right = lambda c: F.sum(F.when(F.col(c), F.col("k")).otherwise(F.lit(0.0)))
    tallies = taken.groupBy("tree_no", "node").agg(F.sum("k").alias("n"), right("majority_right").alias("s"), right("bayes_right").alias("ss"))
    none = F.lit(None).cast("double")
    return moments.unionByName(tallies.withColumns({"cls": F.lit(-1), "feature": F.lit(-1), "low": none, "high": none}))


def merge_stats(old: DataFrame | None, new: DataFrame) -> DataFrame:
    if old is None:
        return new
    keys = ("tree_no", "node", "cls", "feature")
    return old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.min("low").alias("low"), F.max("high").alias("high"))


def ready(stats: DataFrame, config: HoeffdingConfig) -> DataFrame:
    """STATS of the leaves that have seen enough since their last test."""
    seen = F.max(F.when(F.col("feature") < 0, F.col("n"))).over(Window.partitionBy("tree_no", "node"))
    return stats.withColumn("_seen", seen).where((F.col("_seen") >= config.n_min) & (F.col("feature") >= 0)).drop("_seen")


def best_splits(stats: DataFrame, origins: list[float], config: HoeffdingConfig, n_classes: int) -> DataFrame:
    """tree_no, node, feature, point, low and high (class weights), lead, bound, splits for each leaf of `ready` that has a split that gains.

    A leaf's rows, a few for each class and feature, are together from `ready` on, so that all of this is one stage.
    """
    leaf, origin = ["tree_no", "node"], F.get(F.array(*map(F.lit, origins)), F.col("feature"))
    one = Window.partitionBy(*leaf, "feature")  # at most one row a class
    rows = stats.withColumns({"_lo": F.min("low").over(one), "_hi": F.max("high").over(one)}).where("_hi > _lo")
    points = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.struct(i.alias("i"), X.split_point(F.col("_lo"), F.col("_hi"), i, POINTS).alias("point")))
    rows = rows.select("*", F.explode(points).alias("p")).select("*", "p.i", "p.point").where("point > _lo AND point < _hi")
    mean, m2 = origin + F.col("s") / F.col("n"), _m2()
    rows = rows.withColumn("l", F.col("n") * X.gaussian_below(F.col("point"), F.col("n"), mean, m2)).withColumn("r", F.greatest(F.col("n") - F.col("l"), F.lit(0.0)))
    part = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(F.lit(0.0)))
    sides = F.sort_array(F.collect_list(F.struct("cls", "l", "r")))
    rows = rows.groupBy(*leaf, "feature", "i", "point").agg(*(F.sum(c).alias(f"_{c}") for c in "nlr"), *(part(c).alias(f"_{c}{c}") for c in "nlr"), sides.alias("sides"))
    entropy = lambda c: F.log2(f"_{c}") - F.col(f"_{c}{c}") / F.col(f"_{c}")
    rows = rows.where(f"_l >= {LEAST_SIDE} AND _r >= {LEAST_SIDE}").withColumn("_own", entropy("n")).where("_own > 1e-12")
    gain = F.col("_own") - F.col("_l") / F.col("_n") * entropy("l") - F.col("_r") / F.col("_n") * entropy("r")
    told = F.struct(F.round(gain, DIGITS).alias("gain"), (-F.col("i")).alias("first"), "point", "sides", F.col("_n").alias("n"))
    by_feature = rows.groupBy(*leaf, "feature").agg(F.max(told).alias("b"))
    ranked = F.sort_array(F.collect_list(F.struct(F.col("b.gain").alias("gain"), (-F.col("feature")).alias("first"), F.col("b").alias("b"))), asc=False)
    top = by_feature.groupBy(*leaf).agg(ranked.alias("t")).select(*leaf, F.get("t", F.lit(0)).alias("x"), F.get("t", F.lit(1))["gain"].alias("second"))
    bound = X.hoeffding_bound(F.lit(config.delta), F.col("x.b.n"))
    side = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.coalesce(F.get(F.filter("x.b.sides", lambda s: s["cls"] == k), F.lit(0))[c], F.lit(0.0)))
    lead = F.col("x.gain") - F.coalesce("second", F.lit(float("-inf")))
    out = top.select(*leaf, (-F.col("x.first")).alias("feature"), F.col("x.b.point").alias("point"), side("l").alias("low"), side("r").alias("high"), lead.alias("lead"), bound.alias("bound"))
    return out.withColumn("splits", (F.col("lead") > F.col("bound")) | (F.col("bound") < config.tau))
