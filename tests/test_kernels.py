import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from canopy.operators.estimators import Adwin, GaussianStats, Histogram, entropy, erf, last_max, votes_of
from canopy.operators.trees import HoeffdingTree, MondrianLearner
from canopy.plans.config import EnsembleConfig, HoeffdingConfig, MondrianConfig


def test_entropy_and_erf():
    assert entropy(np.array([5.0, 5])) == pytest.approx(1)
    assert entropy(np.array([9.0, 5])) == pytest.approx(0.940286, abs=1e-6)
    assert erf(np.array([0.5, -1, 2])) == pytest.approx([0.5205, -0.8427007, 0.9953221], abs=1e-6)


def test_gaussian_values():
    g = GaussianStats(1, 1)
    for x, w in ((1, 2), (2, 1), (4, 3)):
        g.update(np.array([float(x)]), 0, w)
    assert g.mean[0, 0] == pytest.approx(2.6666667) and g.m2[0, 0] == pytest.approx(11.3333333)
    assert g.likelihood(np.array([2.0]))[0, 0] == pytest.approx(0.2402361, abs=1e-6)


def test_split_points_are_even():
    g = GaussianStats(1, 2)
    for x in range(12):
        g.update(np.array([float(x)]), x % 2, 1)
    assert g.splits()[1].tolist() == pytest.approx(list(range(1, 11)))


@given(st.lists(st.tuples(st.floats(-100, 100), st.integers(0, 2)), max_size=120))
@settings(max_examples=30, deadline=None)
def test_histogram_keeps_weight_and_order(rows):
    h = Histogram(3, 8)
    for x, y in rows:
        h.update(x, y, 2)
    assert h.by_class.sum() == 2 * len(rows) and len(h.means) <= 8 and (np.diff(h.means) >= 0).all()


@given(st.lists(st.integers(0, 1), max_size=400))
@settings(max_examples=30, deadline=None)
def test_adwin_counts(rows):
    a = Adwin(0.01)
    for x in rows:
        a.add(x)
    assert a.width == sum(len(r) * 2**i for i, r in enumerate(a.rows)) and a.total == sum(map(sum, a.rows))
    assert all(len(r) <= Adwin.ROOM for r in a.rows)


def test_adwin_finds_a_jump_and_stays_still():
    a, b = Adwin(1e-3), Adwin(1e-5)
    assert any([a.add(float(i >= 500)) for i in range(1000)])
    rng = np.random.default_rng(0)
    assert not any([b.add(float(x)) for x in rng.integers(0, 2, 3000)])


def test_votes():
    assert last_max(np.array([0.5, 0.5, 0.1])) == 1 and last_max(np.zeros(3)) == 2
    assert votes_of(np.array([0.0, -1])).tolist() == [0.5, 0.5]


def test_mondrian_boxes_and_times():
    m, rng = MondrianLearner(MondrianConfig(), 2, 2, 1), np.random.default_rng(1)
    assert m.predict(np.zeros(2))[0] is None
    for _ in range(300):
        x = rng.normal(size=2)
        m.train(x, int(x[0] > 0), False)
    stack = [m.root]
    while stack:
        c = stack.pop()
        for k in c.children:
            assert (k.low >= c.low - 1e-12).all() and (k.high <= c.high + 1e-12).all() and k.time >= c.time
            stack.append(k)
    assert m.predict(np.array([1.0, 0]))[1].sum() == pytest.approx(1)


def test_leaves_are_splits_and_one():
    t, rng = HoeffdingTree(HoeffdingConfig("srp", features_patch=1.0, numeric_estimator="gaussian"), 2, 2, np.random.default_rng(0)), np.random.default_rng(2)
    for _ in range(3000):
        x = rng.normal(size=2)
        t.train(x, int(x[0] > 0), 1)
    kinds = [n["kind"] for n in t.nodes()]
    assert kinds.count("leaf") == kinds.count("branch") + 1 > 1
    assert t.predict(np.array([2.0, 0]))[0] == 1


def test_config():
    c = EnsembleConfig.from_json('{"dataset": "a/b_c", "n_trees": 2, "seed": 1, "voting": "Weighted", "algorithm": {"type": "arf", "lambda": 3, "numeric_estimator": "Gaussian"}}')
    assert c.voting == "weighted" and c.algorithm.lambda_ == 3 and '"lambda": 3' in c.to_json()
    assert [HoeffdingConfig(features_patch=p).subspace_size(n) for n, p in ((7, 0.6), (10, 0.6), (25, 0.6), (7, None), (10, None), (25, None))] == [5, 6, 15, 3, 4, 6]
    for bad in ({"lambda_": 0}, {"features_patch": 1.5}, {"type": "x"}):
        with pytest.raises(ValueError):
            HoeffdingConfig(**bad)
    assert MondrianConfig().smoothing(2) == 0.5 and MondrianConfig(dirichlet=0.2).smoothing(2) == 0.2 and math.isclose(MondrianConfig().smoothing(3), 0.01)
