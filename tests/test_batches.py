import math
import tracemalloc

import numpy as np
import pytest

from canopy.operators.batch_trees import BatchRunner, BatchTree
from canopy.operators.estimators import Adwin, DriftDetector
from canopy.operators.trees import TreeRunner
from canopy.plans import prequential as P
from canopy.plans.config import EnsembleConfig, HoeffdingConfig, MondrianConfig

SRP, ARF = (HoeffdingConfig(kind, numeric_estimator="gaussian", adwin_delta_warning=0.05, adwin_delta_drift=0.01) for kind in ("srp", "arf"))


def turning(n=6000):
    """Instances whose labels turn twice; some lack a label, some have odd values, some are alike."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 4)).round(2)
    x[500:520], x[600:603, 1], x[700, 2], x[800:900, 3] = x[100], math.nan, math.inf, 1.0
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.3)
    y[n // 3 : 2 * n // 3] = 3 - y[n // 3 : 2 * n // 3]
    return x, [None if i % 41 == 0 else int(v) for i, v in enumerate(y)]


@pytest.mark.parametrize("algorithm", [SRP, ARF, HoeffdingConfig("arf", drift_detection=False, numeric_estimator="gaussian"), MondrianConfig(), HoeffdingConfig("srp", max_bins=8)])
@pytest.mark.parametrize("timing", ["before", "after"])
def test_batches_equal_instances_in_order(algorithm, timing):
    x, y = turning()
    if algorithm.type == "srp" and algorithm.numeric_estimator == "histogram":
        x, y = x[:400], y[:400]
    config = EnsembleConfig("x", 3, 1, algorithm, "soft", timing)
    one, many = TreeRunner(config, 1, 4, 4), BatchRunner(config, 1, 4, 4)
    with np.errstate(invalid="ignore"):
        wanted = [one.step(i, x[i], y[i]) for i in range(len(x))]
    cuts, got = [0, 1, 2, 40, 1700, 1701, 4000, len(x)], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        got += P.batch_rows(many, list(range(len(x)))[a:b], x[a:b], y[a:b])
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in wanted]
    if algorithm.type == "amf":
        assert all(r[2] == pytest.approx(w[2], abs=1e-12) for r, w in zip(got, wanted, strict=True))
    else:
        assert [r[2] for r in got] == [r[2] for r in wanted]
    if algorithm in (SRP, ARF):
        assert sum(r[4] for r in got) > 1
    assert max(r[7] for r in got) > 2 or len(x) < 1000
    assert many.learner.frozen() == one.learner.frozen()


def test_windows_take_many_at_once():
    values = np.random.default_rng(0).random(4000) < np.repeat([0.2, 0.6, 0.3, 0.3], 1000)
    one, many, told, at = DriftDetector(0.05, 0.01), DriftDetector(0.05, 0.01), [], 0
    wanted = [(i, s) for i, v in enumerate(values) if (s := one.add(float(v)))]
    for part in np.split(values, [7, 8, 900, 2500]):
        while len(part):
            signal, used = many.until(part, True)
            at, part = at + used, part[used:]
            if signal:
                told.append((at - 1, signal))
    assert told == wanted and {s for _, s in told} == {"drift", "warning"}
    assert many.drift.rows == one.drift.rows and many.warning.total == one.warning.total and Adwin.EVERY == 32


def test_a_hoeffding_leaf_takes_few_bytes():
    """As objects, a leaf took more than 2000."""
    rng = np.random.default_rng(0)
    x, y = rng.random((60_000, 4)), rng.integers(0, 5, 60_000)
    tracemalloc.start()
    tree = BatchTree(HoeffdingConfig("arf", numeric_estimator="gaussian"), 4, 5, np.random.default_rng(1))
    for at in range(0, len(x), 10_000):
        tree.run(x[at : at + 10_000], y[at : at + 10_000], np.full(10_000, 6))
    tree.kept = None
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert tree.n_slots > 300 and held / tree.n_slots < 1000


def test_a_tree_sorts_packs_and_keeps_no_votes(spark, monkeypatch):
    """A tree's task took a row an instance into its sort, and an entry an instance into a map of votes."""
    monkeypatch.setattr(P, "PACKED", 100)
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, rng.random(3).tolist(), i % 2) for i in range(1050)], P.INSTANCE).repartition(3)
    dealt = P.deal(rows, 3, 3, 1050).groupBy("tree_id").count().collect()
    assert len(dealt) == 3 and all(r["count"] == 11 for r in dealt)
    plan = P.prequential(rows, EnsembleConfig("x", 3, 0, SRP))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 3 and "Aggregate" not in plan


@pytest.mark.parametrize("algorithm", [SRP, MondrianConfig()])
def test_packs_keep_order_and_odd_rows(spark, monkeypatch, algorithm):
    """The same however packed; ids that occur twice, and null ones, are answered once a row."""
    rng = np.random.default_rng(4)
    data = [(i, rng.normal(size=2).tolist(), int(rng.integers(0, 3))) for i in range(700)]
    data += [(5, [0.0, 0.1], 1), (5, [0.0, 0.1], 1), (2**40, [None, 1.0], None), (2**40 + 1, [0.5], 2), (-3, [1.0, 2.0], 0)]
    rows, config = spark.createDataFrame(data, P.INSTANCE).repartition(5), EnsembleConfig("x", 2, 0, algorithm, "weighted")
    wanted = sorted(P.prequential(rows, config).collect())
    assert [r["instance_id"] for r in wanted] == sorted(r[0] for r in data)
    for most, parts in ((64, 100), (1000, 300)):
        monkeypatch.setattr(P, "PACKED", most)
        monkeypatch.setattr(P, "SORTED", parts)
        assert sorted(P.prequential(rows, config).collect()) == wanted


@pytest.mark.parametrize("algorithm", [SRP, ARF])
def test_no_features_and_one_class(algorithm):
    for width, classes in ((0, 3), (1, 1)):
        config, x, y = EnsembleConfig("x", 1, 0, algorithm), np.ones((90, width)), [i % 2 if classes > 1 else 0 for i in range(90)]
        one, many = TreeRunner(config, 0, width, classes), BatchRunner(config, 0, width, classes)
        assert P.batch_rows(many, list(range(90)), x, y) == [one.step(i, x[i], y[i]) for i in range(90)]
        assert P.batch_rows(many, [], x[:0], []) == []
