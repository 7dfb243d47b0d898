"""Mondrian trees level by level: boxes and counts of a level's nodes are one aggregate, its splits are drawn from them by column expressions.

A Mondrian tree can be drawn from a whole table at once: a node waits for a time that is exponential in the extents of its box, splits a feature drawn
in proportion to them, at a uniform place within the box.  Nodes have heap numbers (root 1, children 2k and 2k + 1), and draws depend on seed, tree and
node alone, so a lost task draws the same tree again.  Rows walk the splits above, a constant of the plan, down to the open nodes; rows that have reached
a leaf drop out.  A forest of more than `sent_splits` goes on by joins of rows with a level's splits.

How well a node has predicted its instances in order depends on its class counts only (the order of a Polya urn doesn't matter), so its weight is a
closed form and needs no stream.  The rule of the in-order learner is kept: a node doesn't weigh its own first instance, unless that is the tree's first.
Log weights come up and votes go down by a join a level.  The driver holds at most `sent_splits` splits, and no tree is in one task.

Null and non-finite features, and those that a row lacks, count as 0.  Rows without a label are not learned; repeated rows count each; an empty table
gives no nodes.  What differs from learning in order: with `split_pure` off a pure node stays a leaf for good, while in order it may be split later.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from canopy.functions import draws
from canopy.functions.exprs import leaf_probability, log_gamma, log_mean_exp
from canopy.operators.scoring import NODE, leaf_id
from canopy.plans.config import MondrianConfig
from canopy.sources.scratch import staged

KEYS = ["tree_id", "node"]
#: From a level's nodes to the columns feature, threshold, split_time, null for a leaf.
Decide = Callable[[DataFrame], DataFrame]
#: Salts of the three draws, added to the seed.
_WAIT, _FEATURE, _PLACE = 211, 223, 227


@dataclass(frozen=True)
class LevelParams:
    #: Nodes this deep aren't split.
    max_depth: int = 12
    #: Nodes whose time to split is later than this aren't either.
    lifetime: float = math.inf
    #: Splits that go to all tasks with the plan; of a larger forest the later levels are joined, and each of these writes its rows once.
    sent_splits: int = 50_000

    def __post_init__(self) -> None:
        if not 0 <= self.max_depth <= 60 or not self.lifetime > 0:
            raise ValueError("max_depth must be 0 to 60 and lifetime over 0")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def clean(instances: DataFrame, n_features: int) -> DataFrame:
    """instance_id, features of the given number and finite, label."""
    own = F.col("features").cast("array<double>")
    value = lambda i: F.get(own, i)
    features = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.when(F.abs(value(i)) < float("inf"), value(i)).otherwise(0.0)) if n_features else F.array().cast("array<double>")
    return instances.select("instance_id", features.alias("features"), "label")


def drawn(config: MondrianConfig, seed: int, p: LevelParams) -> Decide:
    """Splits by counter-based draws."""
    u = lambda salt: draws.uniform_column("node", "tree_id", seed + salt)

    def decide(nodes: DataFrame) -> DataFrame:
        extents = F.zip_with("high", "low", lambda h, low: h - low)
        nodes = nodes.withColumn("_extents", extents).withColumn("_total", _total(F.col("_extents")))
        may = (F.col("_total") > 0) & (F.col("_total") < float("inf")) & (F.lit(config.split_pure) | (F.array_max("counts") < F.col("n")))
        nodes = nodes.withColumn("split_time", F.when(may, F.col("time") + draws.exponential(u(_WAIT), F.col("_total"))))
        nodes = nodes.withColumn("split_time", F.when(F.col("split_time") <= p.lifetime, F.col("split_time")))
        nodes = nodes.withColumn("feature", F.when(F.col("split_time").isNotNull(), draws.discrete(u(_FEATURE), F.col("_extents"))))
        low, high = F.get("low", F.col("feature")), F.get("high", F.col("feature"))
        place = low + u(_PLACE) * (high - low)
        return nodes.withColumn("threshold", F.when(place < high, place).otherwise(low)).drop("_extents", "_total")

    return decide


def measured(rows: DataFrame, config: MondrianConfig, n_features: int, n_classes: int, first: int | None) -> DataFrame:
    """tree_id, node, time, n, counts, low, high, first, weight for each node that rows have reached; partial aggregates, so hot nodes are no matter."""
    box = [f(F.get("features", F.lit(i))).alias(f"_{name}{i}") for name, f in (("l", F.min), ("h", F.max)) for i in range(n_features)]
    counts = [F.count(F.when(F.col("label") == c, 1)).cast("double").alias(f"_c{c}") for c in range(n_classes)]
    many = lambda name, k: F.array(*(F.col(f"_{name}{i}") for i in range(k))).cast("array<double>")
    out = rows.groupBy(*KEYS).agg(F.max("time").alias("time"), F.count("*").cast("double").alias("n"), F.min("instance_id").alias("first"), *counts, *box)
    out = out.select(*KEYS, "time", "n", many("c", n_classes).alias("counts"), many("l", n_features).alias("low"), many("h", n_features).alias("high"), "first")
    alpha = config.smoothing(n_classes)
    urn = _total(F.transform("counts", lambda c: log_gamma(c + alpha) - math.lgamma(alpha))) - log_gamma(F.col("n") + alpha * n_classes) + math.lgamma(alpha * n_classes)
    own = F.lit(True) if first is None else F.col("first").eqNullSafe(F.lit(first))
    return out.withColumn("weight", config.step * (urn + F.when(own, 0.0).otherwise(math.log(n_classes))))


def descend(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Rows of nodes that are split, in the nodes below."""
    high = F.when(F.get("features", F.col("feature")) <= F.col("threshold"), 0).otherwise(1)
    return rows.drop("time").join(splits, KEYS).select("tree_id", (F.col("node") * 2 + high).alias("node"), F.col("split_time").alias("time"), "instance_id", "features", "label")


@dataclass
class _Sent:
    """Splits so far as a constant: trees of nodes by place, of which those below the last level's splits are open."""

    trees: list[list[dict]]
    places: dict[tuple[int, int], int]
    n: int = 0

    @classmethod
    def roots(cls, n_trees: int) -> _Sent:
        return cls([[cls._leaf(0, 1, 0.0)] for _ in range(n_trees)], {(t, 1): 0 for t in range(n_trees)})

    @staticmethod
    def _leaf(place: int, node: int, time: float) -> dict:
        return {"feature": 0, "threshold": 0.0, "low": place, "high": place, "node": node, "time": time, "open": True}

    def add(self, splits: list[Row]) -> None:
        for (t, _), place in self.places.items():
            self.trees[t][place]["open"] = False
        below = {}
        for r in splits:
            nodes, place = self.trees[r["tree_id"]], self.places[r["tree_id"], r["node"]]
            low = len(nodes)
            nodes[place] |= {"feature": r["feature"], "threshold": r["threshold"], "low": low, "high": low + 1}
            for side in range(2):
                nodes.append(self._leaf(low + side, 2 * r["node"] + side, r["split_time"]))
                below[r["tree_id"], 2 * r["node"] + side] = low + side
        self.places, self.n = below, self.n + len(splits)

    def rows(self, known: DataFrame, depth: int) -> DataFrame:
        """Rows in the open nodes; rows at leaves drop out."""
        node = "struct<feature:int,threshold:double,low:int,high:int,node:bigint,time:double,open:boolean>"
        told = F.from_json(F.lit(json.dumps([{"tree_id": t, "nodes": nodes} for t, nodes in enumerate(self.trees)])), f"array<struct<tree_id:int,nodes:array<{node}>>>")
        walk = F.transform(told, lambda t: F.struct(t["tree_id"].alias("tree_id"), F.get(t["nodes"], leaf_id(F.col("features"), t["nodes"], F.lit(depth))).alias("at")))
        rows = known.select("instance_id", "features", "label", F.explode(F.filter(walk, lambda w: w["at"]["open"])).alias("_w"))
        return rows.select("_w.tree_id", "_w.at.node", "_w.at.time", "instance_id", "features", "label")


def _levels(instances: DataFrame, config: MondrianConfig, n_trees: int, n_features: int, n_classes: int, decide: Decide, p: LevelParams) -> list[DataFrame]:
    known = clean(instances.where(F.col("label").between(0, n_classes - 1)), n_features)
    sent: _Sent | None = _Sent.roots(n_trees)
    rows, levels, first = sent.rows(known, 0), [], None
    for depth in range(p.max_depth + 1):
        nodes = measured(rows, config, n_features, n_classes, first).withColumn("depth", F.lit(depth))
        if depth < p.max_depth:
            nodes = decide(nodes)
        else:
            nodes = nodes.select("*", F.lit(None).cast("double").alias("split_time"), F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold"))
        nodes = staged(nodes)
        levels.append(nodes)
        if depth == p.max_depth:
            break
        if depth == 0 and (root := nodes.select("first").first()) is not None:
            first = root["first"]
        splits = nodes.where("feature IS NOT NULL").select(*KEYS, "feature", "threshold", "split_time")
        some = splits.limit(p.sent_splits - sent.n + 1 if sent else 1).collect()
        if not some:
            break
        if sent and sent.n + len(some) <= p.sent_splits:
            sent.add(some)
            rows = sent.rows(known, depth + 1)
        else:  # from here on rows carry their nodes
            sent, rows = None, staged(descend(rows, splits))
    return levels


def _weighed(levels: list[DataFrame]) -> list[DataFrame]:
    """With log_weight: of a leaf its weight, else the mean of its own and its children's evidence."""
    out: list[DataFrame] = []
    for nodes in reversed(levels):
        if not out:
            told = nodes.withColumn("log_weight", F.col("weight"))
        else:
            below = out[-1].groupBy("tree_id", F.shiftright("node", 1).alias("node")).agg(F.sum("log_weight").alias("_below"))
            mixed = F.when(F.col("feature").isNull(), F.col("weight")).otherwise(log_mean_exp(F.col("weight"), F.col("_below")))
            told = nodes.join(below, KEYS, "left").withColumn("log_weight", mixed).drop("_below")
        out.append(staged(told))
    return out[::-1]


def _voted(levels: list[DataFrame], config: MondrianConfig, n_classes: int) -> list[DataFrame]:
    """With votes, of a node's whole path down to it: at a leaf, those of the tree."""
    alpha, out = config.smoothing(n_classes), []
    for nodes in levels:
        if not out:
            told = nodes.withColumn("_rest", F.lit(1.0)).withColumn("_votes", F.array_repeat(F.lit(0.0), n_classes))
        else:
            told = nodes.withColumn("_up", F.shiftright("node", 1)).join(out[-1].select("tree_id", F.col("node").alias("_up"), F.col("_left").alias("_rest"), F.col("votes").alias("_votes")), ["tree_id", "_up"]).drop("_up")
        own = F.when(F.col("feature").isNull(), 1.0).otherwise(F.exp(F.least(F.lit(0.0), F.col("weight") - F.col("log_weight"))) / 2)
        told = told.withColumn("_own", own)
        votes = F.zip_with("_votes", "counts", lambda v, c: v + F.col("_rest") * F.col("_own") * leaf_probability(c, F.col("n"), F.lit(alpha), F.lit(n_classes)))
        out.append(staged(told.withColumn("votes", votes).withColumn("_left", F.col("_rest") * (1 - F.col("_own"))).drop("_rest", "_votes", "_own")))
    return [nodes.drop("_left") for nodes in out]


def grow(instances: DataFrame, config: MondrianConfig, n_trees: int, n_features: int, n_classes: int, seed: int = 0, p: LevelParams | None = None, decide: Decide | None = None) -> DataFrame:
    """The node table of a forest: tree_id, node, depth, time, n, counts, low, high, feature, threshold, split_time, weight, log_weight, votes.

    `decide` gives the splits of a level (for instance known ones); else they are drawn.
    """
    if n_trees < 1 or n_classes < 1 or not config.smoothing(n_classes) > 0:
        raise ValueError("a forest needs a tree, a class and smoothing over 0")
    p = p or LevelParams()
    levels = _levels(instances, config, n_trees, n_features, n_classes, decide or drawn(config, seed, p), p)
    told = _voted(_weighed(levels), config, n_classes)
    columns = [*KEYS, "depth", "time", "n", "counts", "low", "high", "feature", "threshold", "split_time", "weight", "log_weight", "votes"]
    return reduce(DataFrame.unionByName, (nodes.select(*columns) for nodes in told))


def forest(nodes: DataFrame) -> DataFrame:
    """FOREST of a node table, for `scoring.score_forest`; places follow the nodes' numbers."""
    flat = nodes.select("tree_id", "node", "feature", "threshold", F.col("depth").cast("int").alias("depth"), F.when(F.col("feature").isNull(), F.col("votes")).alias("votes"))
    ids = flat.groupBy("tree_id").agg(F.array_sort(F.collect_list("node")).alias("ids")).select("tree_id", F.posexplode("ids").alias("place", "node"))
    below = ids.select("tree_id", F.shiftright("node", 1).alias("node"), "place").groupBy(*KEYS).agg(F.min("place").cast("int").alias("low"), F.max("place").cast("int").alias("high"))
    told = flat.join(ids, KEYS).join(below, KEYS, "left")
    node = F.struct(F.coalesce("feature", F.lit(0)).alias("feature"), F.coalesce("threshold", F.lit(0.0)).alias("threshold"), *(F.coalesce(side, F.col("place").cast("int")).alias(side) for side in ("low", "high")), "depth", "votes")
    rows = told.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.struct("place", node.alias("at")))).alias("at"))
    return rows.select(F.col("tree_id").cast("int").alias("tree_id"), F.transform("at", lambda a: a["at"]).cast(f"array<{NODE}>").alias("nodes"))


def fit(instances: DataFrame, config: MondrianConfig, n_trees: int, n_features: int, n_classes: int, seed: int = 0, p: LevelParams | None = None) -> DataFrame:
    """FOREST learned by levels."""
    return forest(staged(grow(instances, config, n_trees, n_features, n_classes, seed, p)))


def oracle_cte(source: str, config: MondrianConfig, n_trees: int, n_features: int, n_classes: int, seed: int, p: LevelParams) -> str:
    """The same for DuckDB, from rows of (id, f, label) with f a list: `r<d>` are rows by node, `n<d>` nodes, `w<d>` log weights, `v<d>` votes."""
    alpha, k = config.smoothing(n_classes), n_classes
    u = lambda salt: draws.uniform_sql("node", "tree_id", seed + salt)
    urn = " + ".join(f"lgamma(c[{c + 1}] + {alpha}) - lgamma({alpha}::DOUBLE)" for c in range(k))
    pure = "true" if config.split_pure else "list_max(c) < n"
    life = "'inf'::DOUBLE" if math.isinf(p.lifetime) else repr(p.lifetime)
    out = [f"r0 AS (SELECT CAST(tree_id AS BIGINT) AS tree_id, CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS time, id, f, label FROM ({source}) s, (SELECT unnest(range({n_trees})) AS tree_id) t WHERE label BETWEEN 0 AND {k - 1})", "t0 AS (SELECT min(id) AS first FROM r0)"]
    for d in range(p.max_depth + 1):
        grows = f"{pure} AND total > 0" if d < p.max_depth else "false"
        out += [
            f"x{d} AS (SELECT tree_id, node, i, min(f[i + 1]) AS lo, max(f[i + 1]) AS hi FROM r{d}, (SELECT unnest(range({n_features})) AS i) t GROUP BY ALL)",
            f"e{d} AS (SELECT *, sum(hi - lo) OVER (PARTITION BY tree_id, node ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM x{d})",
            f"b{d} AS (SELECT tree_id, node, max(upto) AS total, list(lo ORDER BY i) AS low, list(hi ORDER BY i) AS high, list(upto ORDER BY i) AS upto FROM e{d} GROUP BY ALL)",
            f"c{d} AS (SELECT tree_id, node, max(time) AS time, CAST(count(*) AS DOUBLE) AS n, min(id) AS first, [{', '.join(f'CAST(count(*) FILTER (label = {c}) AS DOUBLE)' for c in range(k))}] AS c FROM r{d} GROUP BY ALL)",
            f"""m{d} AS (SELECT tree_id, node, time, n, c, low, high, upto, total, {config.step} * ({urn} - lgamma(n + {alpha * k}) + lgamma({alpha * k}::DOUBLE) + CASE WHEN first = (SELECT t0.first FROM t0) THEN 0 ELSE ln({k}::DOUBLE) END) AS weight,
  CASE WHEN {grows} THEN time - ln(1 - {u(_WAIT)}) / total END AS at_ FROM c{d} JOIN b{d} USING (tree_id, node))""",
            f"d{d} AS (SELECT * REPLACE (CASE WHEN at_ <= {life} THEN at_ END AS at_), CASE WHEN at_ <= {life} THEN least(len(list_filter(upto, lambda s: s <= {u(_FEATURE)} * total)), {n_features - 1}) END AS feature FROM m{d})",
            f"p{d} AS (SELECT *, low[feature + 1] + {u(_PLACE)} * (high[feature + 1] - low[feature + 1]) AS place FROM d{d})",
            f"n{d} AS (SELECT *, CASE WHEN place < high[feature + 1] THEN place ELSE low[feature + 1] END AS threshold FROM p{d})",
        ]
        if d < p.max_depth:
            out.append(f"r{d + 1} AS (SELECT tree_id, node * 2 + CASE WHEN f[feature + 1] <= threshold THEN 0 ELSE 1 END AS node, at_ AS time, id, f, label FROM r{d} JOIN (SELECT tree_id, node, feature, threshold, at_ FROM n{d} WHERE feature IS NOT NULL) s USING (tree_id, node))")
    for d in range(p.max_depth, -1, -1):
        below = f"LEFT JOIN (SELECT tree_id, node // 2 AS node, sum(log_weight) AS b FROM w{d + 1} GROUP BY ALL) s USING (tree_id, node)" if d < p.max_depth else ""
        mixed = "CASE WHEN feature IS NULL THEN weight ELSE greatest(weight, b) + ln((1 + exp(least(weight, b) - greatest(weight, b))) / 2) END" if below else "weight"
        out.append(f"w{d} AS (SELECT tree_id, node, {mixed} AS log_weight FROM n{d} {below})")
    for d in range(p.max_depth + 1):
        up = f"JOIN (SELECT tree_id, node AS up, rest * (1 - own) AS rest, votes FROM v{d - 1}) u ON u.tree_id = n.tree_id AND u.up = n.node // 2" if d else f"CROSS JOIN (SELECT CAST(1 AS DOUBLE) AS rest, [{', '.join(['0.0::DOUBLE'] * k)}] AS votes) u"
        own = "CASE WHEN feature IS NULL THEN 1.0::DOUBLE ELSE exp(least(0, weight - log_weight)) / 2 END"
        out.append(f"v{d} AS (SELECT tree_id, node, {d} AS depth, n, feature, threshold, split_time, weight, log_weight, own, rest, [{', '.join(f'votes[{c + 1}] + rest * own * (c[{c + 1}] + {alpha}) / (n + {alpha * k})' for c in range(k))}] AS votes FROM (SELECT n.tree_id, n.node, n.n, n.c, feature, threshold, at_ AS split_time, weight, log_weight, rest, votes, {own} AS own FROM n{d} n JOIN w{d} w ON w.tree_id = n.tree_id AND w.node = n.node {up}) q)")
    out.append("forest AS (" + " UNION ALL ".join(f"SELECT * FROM v{d}" for d in range(p.max_depth + 1)) + ")")
    return ",\n".join(out)
