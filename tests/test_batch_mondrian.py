import math

import numpy as np
import pytest

from canopy.operators import batch_mondrian as B
from canopy.operators.trees import MondrianLearner
from canopy.plans.config import MondrianConfig


def cells(learner):
    """All that nodes hold, the low child first."""
    out, todo = [], [learner.root]
    while todo:
        c = todo.pop()
        out.append((c.low.tolist(), c.high.tolist(), c.counts, c.weight, c.log_weight, c.time, c.feature, c.threshold))
        todo += c.children[::-1]
    return out


def in_order(learner, x, labels):
    told = []
    for row, label in zip(x, labels, strict=True):
        predicted, votes, depth = learner.predict(row)
        told.append((-1 if predicted is None else predicted, votes.tolist(), depth))
        if label is not None:
            learner.train(row, label, predicted == label)
    return told


def odd(n, features, classes, seed):
    """Few values, so that instances repeat and nodes are met again; some without a label, some not finite or far away."""
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 12, (n, features)).astype(float), rng.integers(0, classes, n)
    for row, value in zip(rng.integers(0, n, 6), (math.nan, math.inf, -math.inf, 1e308, -1e308, 1e-320), strict=True):
        x[row, 0] = value
    return x, [None if u < 0.1 else int(v) for u, v in zip(rng.random(n), y, strict=True)]


@pytest.mark.parametrize("split_pure", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_batches_of_any_size_equal_the_order(split_pure, seed):
    features, classes = 1 + 3 * seed, 1 + seed
    x, labels = odd(900, features, classes, seed)
    config = MondrianConfig(step=0.7, split_pure=split_pure)
    one, cut = MondrianLearner(config, features, classes, seed), sorted({0, 1, 3, 200 * seed, 500, 501, 900})
    wanted = in_order(one, x, labels)
    for cuts in (cut, [0, 900]):
        many, got = MondrianLearner(config, features, classes, seed), []
        for a, b in zip(cuts, cuts[1:], strict=False):
            told = many.steps(x[a:b], labels[a:b])
            got += zip(told.predicted.tolist(), [[] if p < 0 else v for p, v in zip(told.predicted, told.votes.tolist(), strict=True)], told.depth.tolist(), strict=True)
        assert got == wanted and cells(many) == cells(one) and many.frozen() == one.frozen() and (many.seen, many.right) == (one.seen, one.right)
    assert len(one.feature) > 20 or classes == 1 and not split_pure


def test_many_nodes_keep_apart_in_a_batch():
    rng = np.random.default_rng(0)
    x, y = rng.random((30_000, 3)), rng.integers(0, 4, 30_000)
    whole, halves = (MondrianLearner(MondrianConfig(), 3, 4, 1) for _ in range(2))
    told = [whole.steps(x, y.tolist())]
    parts = [halves.steps(x[a : a + 10_000], y[a : a + 10_000].tolist()) for a in range(0, 30_000, 10_000)]
    assert len(whole.feature) > 2**15 and (told[0].votes[1:] == np.concatenate([p.votes for p in parts])[1:]).all()
    assert whole.frozen() == halves.frozen()


def test_no_instance_is_learned_by_itself(monkeypatch):
    """A path was walked, read and written for each instance, some 40 us and more."""
    walked = []
    path = MondrianLearner._path
    monkeypatch.setattr(MondrianLearner, "_path", lambda self, x: walked.append(x) or path(self, x))
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 30, (5000, 2)).astype(float), rng.integers(0, 3, 5000).tolist()
    learner = MondrianLearner(MondrianConfig(), 2, 3, 0)
    assert len(learner.steps(x, y).votes) == 5000 and len(learner.feature) > 100
    assert len(walked) < 2


def test_draws_and_sums():
    at = np.arange(200_000)
    draws = [B.uniforms(seed, at, depth, salt) for seed, depth, salt in ((0, at % 7, 0), (0, at % 7, 1), (0, at % 7 + 1, 0), (1, at % 7, 0))]
    for d in draws:
        assert 0 < d.min() and d.max() < 1 and d.mean() == pytest.approx(0.5, abs=0.005) and d.var() == pytest.approx(1 / 12, abs=0.002)
    assert np.abs(np.corrcoef([*draws, draws[0][np.r_[1:200_000, 0]]]) - np.eye(5)).max() < 0.01
    rises, ns = B.LogRises(0.05), np.array([0, 1, 2, 1000, 2**20 - 1, 2**20, 2**20 + 1, 36_000_000])
    assert rises(ns) == pytest.approx([math.lgamma(n + 0.05) - math.lgamma(0.05) for n in ns.tolist()], rel=1e-13, abs=1e-10)


def test_splits_are_those_of_the_process():
    """Waiting times have the mean 1 / extents, features go by extents, thresholds are even between."""
    made = []
    for seed in range(3000):
        learner = MondrianLearner(MondrianConfig(split_pure=True), 2, 2, seed)
        learner.steps(np.array([[0.0, 0.0], [1.0, -3.0]]), [0, 1])
        made.append((learner.root.children[0].time, learner.root.feature, abs(learner.root.threshold) / (1 + 2 * learner.root.feature)))
    time, feature, share = np.array(made).T
    assert time.mean() == pytest.approx(0.25, rel=0.08) and feature.mean() == pytest.approx(0.75, abs=0.03) and share.mean() == pytest.approx(0.5, abs=0.03)
