import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy import queries as Q
from canopy.functions import draws
from canopy.functions.exprs import log_gamma
from canopy.operators import mondrian_levels as M
from canopy.operators import scoring
from canopy.operators.trees import MondrianLearner
from canopy.plans.config import MondrianConfig

SMALL = "/root/testdata/sf0.001"


def data(n, features=5, classes=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 4)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)) % classes
    noise = rng.random(n) < 0.1
    y[noise] = rng.integers(0, classes, noise.sum())
    return x, y


def frame(spark, x, y):
    rows = [(i, None if r is None else [None if v is None else float(v) for v in r], None if c is None else int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "instance_id long, features array<double>, label int")


def table(nodes):
    return {(r["tree_id"], r["node"]): r for r in nodes.collect()}


def cells(learner):
    """Heap numbers and cells of a learned tree."""
    out, todo = {}, [(1, learner.root)]
    while todo:
        number, cell = todo.pop()
        out[number] = cell
        todo += [(2 * number + side, c) for side, c in enumerate(cell.children)]
    return out


@pytest.mark.parametrize("split_pure", [True, False])
def test_equals_the_learner_in_order_on_its_splits(spark, split_pure):
    x, y = data(60)
    config = MondrianConfig(step=0.7, split_pure=split_pure)
    learner = MondrianLearner(config, 5, 3, 1)
    for row, label in zip(x, y, strict=True):
        learner.train(row, int(label), False)
    wanted = cells(learner)
    known = [(0, k, c.feature, float(c.threshold), float(c.children[0].time)) for k, c in wanted.items() if c.children]
    splits = spark.createDataFrame(known, "tree_id int, node long, feature int, threshold double, split_time double")
    nodes = M.grow(frame(spark, x, y), config, 1, 5, 3, p=M.LevelParams(max_depth=40), decide=lambda n: n.join(F.broadcast(splits), M.KEYS, "left"))
    got = table(nodes)
    assert {k for _, k in got} == set(wanted) and len(wanted) > 20
    for k, cell in wanted.items():
        r = got[0, k]
        assert (r["n"], r["counts"]) == (cell.n, cell.counts) and r["low"] == cell.low.tolist() and r["high"] == cell.high.tolist()
        assert r["weight"] == pytest.approx(cell.weight, abs=1e-9) and r["log_weight"] == pytest.approx(cell.log_weight, abs=1e-9)
    scored = scoring.score_forest(M.clean(frame(spark, x, y), 5), M.forest(nodes), 3).collect()
    for r in scored:
        assert r["combined"] == pytest.approx(learner.predict(x[r["instance_id"]])[1].tolist(), abs=1e-9)


def plain(x, y, config, tree, seed, p, classes):
    """The forest's rule in plain loops, from the rows of each node in order."""
    alpha, out = config.smoothing(classes), {}

    def grow(node, rows, depth, time):
        own = x[rows]
        low, high = own.min(axis=0), own.max(axis=0)
        counts, weight = [0] * classes, 0.0
        for at, i in enumerate(rows):
            if at or i == 0:
                weight += config.step * math.log((counts[y[i]] + alpha) / (at + alpha * classes))
            counts[y[i]] += 1
        extents = (high - low).tolist()
        total = sum(extents)
        found = None
        if depth < p.max_depth and total > 0 and (config.split_pure or max(counts) < len(rows)):
            time -= math.log(1 - draws.uniform(node, tree, seed + 211)) / total
            if time <= p.lifetime:
                u, f = draws.uniform(node, tree, seed + 223) * total, 0
                while f < len(extents) - 1 and sum(extents[: f + 1]) <= u:
                    f += 1
                threshold = low[f] + draws.uniform(node, tree, seed + 227) * (high[f] - low[f])
                found = f, threshold
        log_weight = weight
        if found:
            side = x[rows, found[0]] <= found[1]
            below = grow(2 * node, rows[side], depth + 1, time) + grow(2 * node + 1, rows[~side], depth + 1, time)
            log_weight = np.logaddexp(weight, below) - math.log(2)
        out[tree, node] = counts, found, weight, log_weight
        return log_weight

    grow(1, np.arange(len(x)), 0, 0.0)
    return out


@pytest.mark.parametrize(("split_pure", "lifetime", "sent"), [(True, math.inf, 50_000), (False, math.inf, 3), (True, 0.6, 0)])
def test_drawn_trees_equal_plain_loops(spark, split_pure, lifetime, sent):
    """Also where later or all levels' splits are joined and not sent."""
    x, y = data(300, seed=3)
    x[200:220] = x[5]  # repeated rows
    config, p = MondrianConfig(split_pure=split_pure), M.LevelParams(4, lifetime, sent)
    got, wanted = table(M.grow(frame(spark, x, y).repartition(3), config, 2, 5, 3, 17, p)), {}
    for tree in range(2):
        wanted |= plain(x, y, config, tree, 17, p, 3)
    assert got.keys() == wanted.keys() and len(got) > (6 if lifetime < math.inf else 30)
    for k, (counts, found, weight, log_weight) in wanted.items():
        r = got[k]
        assert r["counts"] == counts and (r["feature"], r["weight"], r["log_weight"]) == (found and found[0], pytest.approx(weight, abs=1e-8), pytest.approx(log_weight, abs=1e-8))
        assert sum(r["votes"]) <= 1 + 1e-9 and (found is not None or sum(r["votes"]) == pytest.approx(1))
        if found:
            assert r["threshold"] == pytest.approx(found[1]) and r["low"][found[0]] <= r["threshold"] < r["high"][found[0]]


def test_root_splits_follow_the_mondrian_process(spark):
    """Waiting times have the mean 1 / extents and features go by extents, over many trees."""
    x = np.array([[0.0, 0.0], [1.0, 3.0]])
    roots = [r for r in M.grow(frame(spark, x, [0, 1]), MondrianConfig(), 2000, 2, 2, 5, M.LevelParams(1)).where("node = 1").collect()]
    assert np.mean([r["split_time"] for r in roots]) == pytest.approx(0.25, rel=0.08)
    assert np.mean([r["feature"] for r in roots]) == pytest.approx(0.75, abs=0.03)
    assert np.mean([r["threshold"] / (1 + 2 * r["feature"]) for r in roots]) == pytest.approx(0.5, abs=0.03)


def test_learns_what_the_learner_in_order_learns(spark):
    x, y = data(1500, seed=5)
    config = MondrianConfig(split_pure=True)
    trees = M.fit(frame(spark, x[:1000], y[:1000]), config, 10, 5, 3, 0, M.LevelParams(14))
    told = scoring.score_forest(frame(spark, x, y).where("instance_id >= 1000"), trees, 3).collect()
    ours = np.mean([r["winner"] == r["label"] for r in told])
    learners = [MondrianLearner(config, 5, 3, s) for s in range(10)]
    for one in learners:
        for row, label in zip(x[:1000], y[:1000], strict=True):
            one.train(row, int(label), False)
    theirs = np.mean([int(np.argmax(sum(one.predict(row)[1] for one in learners))) == label for row, label in zip(x[1000:], y[1000:], strict=True)])
    assert ours > 0.7 and abs(ours - theirs) < 0.05


def test_odd_rows(spark):
    nan = float("nan")
    rows = frame(spark, [[1.0, None], [nan, float("inf")], None, [2.0], [2.0], [3.0, 4.0]], [0, 1, 1, None, 0, 7])
    got = table(M.grow(rows, MondrianConfig(split_pure=True), 1, 2, 2, 1, M.LevelParams(3)))
    root = got[0, 1]  # the row without a label and the one of an unknown class aren't learned
    assert (root["n"], root["counts"], root["low"], root["high"]) == (4, [2, 2], [0, 0], [2, 0])
    same = table(M.grow(frame(spark, [[1.0, 1.0]] * 9, [0, 1, 0] * 3), MondrianConfig(), 2, 2, 2))
    assert len(same) == 2 and all(r["feature"] is None and r["votes"] == pytest.approx([6.5 / 10, 3.5 / 10]) for r in same.values())
    wide = table(M.grow(frame(spark, [[-1e308], [1e308]], [0, 1]), MondrianConfig(), 1, 1, 2))
    assert len(wide) == 1  # a box wider than a double's range isn't split
    assert M.grow(rows.limit(0), MondrianConfig(), 2, 2, 2).count() == 0 and M.fit(rows.limit(0), MondrianConfig(), 2, 2, 2).count() == 0
    assert M.grow(rows, MondrianConfig(), 1, 0, 2).count() == 1
    for bad in ({"max_depth": 61}, {"lifetime": 0.0}):
        with pytest.raises(ValueError):
            M.LevelParams(**bad)


def test_log_gamma(spark):
    xs = [0.01, 0.05, 0.5, 1.0, 2.0, 3.7, 50.0, 1e4, 1e9, 1e13]
    got = spark.createDataFrame([(v,) for v in xs], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    for r in got:
        assert r["g"] == pytest.approx(math.lgamma(r["x"]), rel=1e-12, abs=1e-11)


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("events", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for name in ("mondrian_level_nodes", "mondrian_level_events"):
        own = Q.queries()[name](spark, SMALL)
        columns = sorted(own.columns)
        got = sorted(json.dumps([r[c] for c in columns]) for r in own.collect())
        wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.oracle_sql()[name]}) q").fetchall()
        assert got == sorted(json.dumps(list(r)) for r in wanted) and len(got) > 60
