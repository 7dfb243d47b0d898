"""Incremental decision trees and the learners around them: what one key of the keyed stage holds."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np

from canopy.operators import batch_mondrian
from canopy.operators.estimators import STATS, DriftDetector, best_split, last_max, last_maxes, lengthened, votes_of
from canopy.plans.config import EnsembleConfig, HoeffdingConfig, MondrianConfig


@dataclass
class Steps:
    """What a tree tells of a batch of instances, an entry each."""

    votes: np.ndarray  # a row an instance, NaN where the tree doesn't vote
    predicted: np.ndarray  # -1 there
    depth: np.ndarray
    drift: np.ndarray
    accuracy_before: np.ndarray
    accuracy_after: np.ndarray


@dataclass
class FrozenTree:
    """Nodes of a frozen tree, the root first; a leaf leads to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    votes: np.ndarray  # a row a node, of use at leaves
    leaf: np.ndarray
    seen: np.ndarray  # how many instances came to a node, 0 if unknown

    @classmethod
    def of(cls, nodes: list[tuple], n_classes: int) -> FrozenTree:
        feature, threshold, low, high, depth, votes = zip(*nodes, strict=True)
        told = np.array([v if v else [0.0] * n_classes for v in votes], float).reshape(len(nodes), n_classes)
        return cls(*map(np.array, (feature, threshold, low, high, depth)), told, np.array([v is not None for v in votes]), np.zeros(len(nodes)))

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Where rows of features end; `value <= threshold` goes low, everything else high, NaN too."""
        flat, width, at, left = x.ravel(), x.shape[1], np.zeros(len(x), np.int64), np.arange(len(x))
        here, inner = at, self.low != np.arange(len(self.low))
        while len(left):
            left = left[inner[here]]
            here = at[left]
            goes_low = flat[left * width + self.feature[here]] <= self.threshold[here]
            here = np.where(goes_low, self.low[here], self.high[here]).astype(np.int64)
            at[left] = here
        return at


class Learner(Protocol):
    """Test-then-train on one instance at a time."""

    def predict(self, x: np.ndarray) -> tuple[int | None, np.ndarray, int]: ...
    def train(self, x: np.ndarray, label: int, correct: bool) -> bool: ...
    def frozen(self) -> list[tuple]: ...
    @property
    def accuracy(self) -> float: ...


@dataclass
class _Leaf:
    features: np.ndarray
    counts: np.ndarray
    stats: object
    since: float = 0.0
    majority_right: float = 0.0
    bayes_right: float = 0.0


@dataclass
class _Branch:
    feature: int
    threshold: float
    low: object
    high: object


class HoeffdingTree:
    """Leaves vote by majority or naive Bayes, whichever was right more often, and split by the Hoeffding test."""

    def __init__(self, config: HoeffdingConfig, n_features: int, n_classes: int, rng: np.random.Generator) -> None:
        self.c, self.n_features, self.n_classes, self.rng = config, n_features, n_classes, rng
        self.fixed = self._draw() if config.type == "srp" else None
        self.root: _Leaf | _Branch = self._leaf()
        self.told: tuple[_Leaf, np.ndarray, np.ndarray] | None = None

    def _draw(self) -> np.ndarray:
        return np.sort(self.rng.permutation(self.n_features)[: self.c.subspace_size(self.n_features)])

    def _leaf(self) -> _Leaf:
        own = self.fixed if self.fixed is not None else self._draw()
        return _Leaf(own, np.zeros(self.n_classes), STATS[self.c.numeric_estimator](len(own), self.n_classes, self.c.max_bins))

    def _find(self, x: np.ndarray) -> tuple[_Leaf, _Branch | None, int]:
        node, above, depth = self.root, None, 0
        while isinstance(node, _Branch):
            above, node, depth = node, node.low if x[node.feature] <= node.threshold else node.high, depth + 1
        return node, above, depth

    def _bayes(self, leaf: _Leaf, x: np.ndarray) -> np.ndarray:
        """Naive Bayes votes; an instance's votes serve both its prediction and the training on it that follows."""
        if self.told is None or self.told[0] is not leaf or self.told[1] is not x:
            self.told = leaf, x, self._bayes_votes(leaf, x)
        return self.told[2]

    def _bayes_votes(self, leaf: _Leaf, x: np.ndarray) -> np.ndarray:
        n = leaf.counts.sum()
        if not n:
            return np.full(self.n_classes, 1 / self.n_classes)
        return votes_of(leaf.counts / n * leaf.stats.likelihood(x[leaf.features]).prod(axis=0))

    def predict(self, x: np.ndarray) -> tuple[int, np.ndarray, int]:
        leaf, _, depth = self._find(x)
        votes = votes_of(leaf.counts) if leaf.majority_right > leaf.bayes_right else self._bayes(leaf, x)
        return last_max(votes), votes, depth

    def train(self, x: np.ndarray, label: int, k: float) -> None:
        leaf, above, _ = self._find(x)
        if leaf.counts.any():
            leaf.majority_right += k * (last_max(leaf.counts) == label)
        leaf.bayes_right += k * (last_max(self._bayes(leaf, x)) == label)
        self.told = None  # the leaf changes now
        leaf.counts[label] += k
        leaf.stats.update(x[leaf.features], label, k)
        leaf.since += k
        if leaf.since < self.c.n_min:
            return
        leaf.since = 0.0
        if (split := best_split(leaf.stats, leaf.counts, self.c.delta, self.c.tau)) is None:
            return
        made = _Branch(int(leaf.features[split[0]]), split[1], self._leaf(), self._leaf())
        if above is None:
            self.root = made
        elif above.low is leaf:
            above.low = made
        else:
            above.high = made

    def nodes(self) -> list[dict]:
        """The tree as rows, numbered from the root down."""
        out: list[dict] = []

        def walk(node: object) -> int:
            at = len(out)
            if isinstance(node, _Leaf):
                out.append({"node_id": at, "kind": "leaf", "feature": None, "threshold": None, "low": None, "high": None, "counts": node.counts.tolist()})
            else:
                out.append({"node_id": at, "kind": "branch", "feature": node.feature, "threshold": node.threshold, "counts": None})
                out[at] |= {"low": walk(node.low), "high": walk(node.high)}
            return at

        walk(self.root)
        return out


def frozen(root: object, children: Callable[[object], tuple | None], votes: Callable[[list], list[float]]) -> list[tuple]:
    """A tree as nodes of `scoring.NODE`; `children` tells feature, threshold and the two below, `votes` those of a path's leaf."""
    out: list[tuple] = []
    todo: list[tuple[list, int, int]] = [([root], -1, 0)]  # path, parent, side
    while todo:
        path, parent, side = todo.pop()
        at, depth = len(out), len(path) - 1
        if parent >= 0:
            up = out[parent]
            out[parent] = (*up[: 2 + side], at, *up[3 + side :])
        if (below := children(path[-1])) is None:
            out.append((0, 0.0, at, at, depth, votes(path)))
        else:
            feature, threshold, low, high = below
            out.append((feature, threshold, -1, -1, depth, None))
            todo += [([*path, high], at, 1), ([*path, low], at, 0)]
    return out


class HoeffdingLearner:
    """Online bagging around a tree; a background tree grows from a warning on and takes over at a drift."""

    def __init__(self, config: HoeffdingConfig, n_features: int, n_classes: int, seed: int) -> None:
        self.c, self.shape, self.rng = config, (n_features, n_classes), np.random.default_rng(seed)
        self.tree, self.background = self._tree(), None
        self.detector = self._detector() if config.drift_detection else None
        self.seen = self.right = 0

    def _tree(self) -> HoeffdingTree:
        return HoeffdingTree(self.c, *self.shape, np.random.default_rng(self.rng.integers(2**63)))

    def _detector(self) -> DriftDetector:
        return DriftDetector(self.c.adwin_delta_warning, self.c.adwin_delta_drift)

    def predict(self, x: np.ndarray) -> tuple[int, np.ndarray, int]:
        return self.tree.predict(x)

    @property
    def accuracy(self) -> float:
        return self.right / self.seen if self.seen else 0.0

    def frozen(self) -> list[tuple]:
        return frozen(self.tree.root, lambda n: (n.feature, n.threshold, n.low, n.high) if isinstance(n, _Branch) else None, lambda path: votes_of(path[-1].counts).tolist())

    def train(self, x: np.ndarray, label: int, correct: bool) -> bool:
        self.seen, self.right = self.seen + 1, self.right + correct
        k = int(self.rng.poisson(self.c.lambda_))
        if not k:  # neither tree nor detector sees the instance
            return False
        self.tree.train(x, label, k)
        if self.detector is None:
            return False
        if self.background is not None:
            self.background.train(x, label, k)
        signal = self.detector.add(float(not correct))
        if signal == "warning" and self.background is None:
            self.background = self._tree()
        if signal != "drift":
            return False
        self.tree, self.background = self.background or self._tree(), None
        self.detector, self.seen, self.right = self._detector(), 0, 0
        return True


    def steps(self, xs: np.ndarray, labels: list[int | None]) -> Steps:
        """Instances in order, each predicted and then learned."""
        told = []
        for x, label in zip(xs, labels, strict=True):
            (predicted, votes, depth), before = self.predict(x), self.accuracy
            drift = label is not None and self.train(x, label, predicted == label)
            told.append((votes, predicted, depth, drift, before, self.accuracy))
        return Steps(*map(np.array, zip(*told, strict=True))) if told else Steps(np.zeros((0, self.shape[1])), *(np.zeros(0) for _ in range(5)))


class _Cell:
    """A node of a Mondrian tree, to look at: a box with class counts, split or not."""

    def __init__(self, tree: MondrianLearner, at: int) -> None:
        self.tree, self.at, size = tree, at, tree.n_features
        state = tree.state[at]
        self.low, self.high, self.counts = state[:size].copy(), -state[size : 2 * size], state[2 * size :].astype(int).tolist()
        self.n, self.weight, self.log_weight = float(sum(self.counts)), float(tree.weights_of(np.array([at]))[0]), float(tree.log_weight[at])
        self.time, self.feature, self.threshold = float(tree.time[at]), int(tree.feature_[at]), float(tree.threshold[at])

    @property
    def children(self) -> list[_Cell]:
        return [] if self.feature < 0 else [_Cell(self.tree, self.tree.low[self.at]), _Cell(self.tree, self.tree.high[self.at])]


class MondrianLearner:
    """An aggregated Mondrian tree: every node on a path votes, by how well its part of the tree has done.

    Nodes are places in arrays, the root 0, as a tree has more nodes than instances: some 150 bytes each with four features and five classes.
    A node's weight is a closed form of its class counts, and what is drawn belongs to an instance and a place on its path, so that a batch is
    learned by array operations over nodes (`batch_mondrian`) with the results of `predict` and `train` instance by instance.  An instance with
    a feature that is not finite counts in the nodes that it comes to and neither extends nor splits them.
    """

    def __init__(self, config: MondrianConfig, n_features: int, n_classes: int, seed: int) -> None:
        self.c, self.n_features, self.n_classes, self.seed = config, n_features, n_classes, seed
        self.alpha, self.n_nodes, self.stamp = config.smoothing(n_classes), 0, 0
        self.feature_, self.threshold, self.low, self.high, self.time = np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)  # feature -1: a leaf
        self.marks = np.zeros(0, np.int32)
        self.base, self.log_weight = np.zeros(0), np.zeros(0)  # what a weight begins at
        self.state = np.zeros((0, 2 * n_features + n_classes))  # lower corner, upper corner negated, classes
        one = np.eye(n_classes, 1, dtype=np.int64)
        self.leaf_base = -float(self.weights(one, np.ones(1, np.int64), np.zeros(1))[0])  # a new leaf's first instance has no weight
        self.told: tuple[np.ndarray, list[int], list[int]] | None = None
        self.seen = self.right = 0

    @property
    def accuracy(self) -> float:
        return self.right / self.seen if self.seen else 0.0

    @property
    def feature(self) -> np.ndarray:
        return self.feature_[: self.n_nodes]

    @property
    def root(self) -> _Cell | None:
        return _Cell(self, 0) if self.n_nodes else None

    def weights(self, counts: np.ndarray, in_all: np.ndarray, base: np.ndarray) -> np.ndarray:
        return self.c.step * batch_mondrian.log_evidence(counts, in_all, self.alpha) + base

    def weights_of(self, nodes: np.ndarray | list[int]) -> np.ndarray:
        counts = self.state[nodes, 2 * self.n_features :].T.astype(np.int64)
        return self.weights(counts, counts.sum(axis=0), self.base[nodes])

    def own(self, nodes: np.ndarray | list[int]) -> np.ndarray:
        """What nodes that are split keep of a vote."""
        return np.exp(np.minimum(self.weights_of(nodes) - self.log_weight[nodes], 0.0)) / 2

    def add(self, n: int) -> int:
        """Makes leaves; returns the first."""
        at = self.n_nodes
        self.n_nodes += n
        if self.n_nodes > len(self.state):
            room = self.n_nodes + max(16, self.n_nodes // 8)
            for name in ("feature_", "threshold", "low", "high", "time", "marks", "base", "log_weight", "state"):
                setattr(self, name, lengthened(getattr(self, name), room))
        for a in (self.feature_, self.low, self.high):
            a[at : self.n_nodes] = -1
        return at

    def mark(self, nodes: np.ndarray) -> None:
        """Marks the children of nodes, and no others."""
        self.stamp = self.stamp % (2**31 - 2) + 1
        self.marks[self.low[nodes]] = self.marks[self.high[nodes]] = self.stamp

    def marked(self, nodes: np.ndarray) -> np.ndarray:
        return self.marks[nodes] == self.stamp

    def _path(self, x: np.ndarray) -> tuple[list[int], list[int]]:
        """Nodes from the root to the leaf, and those beside them; of an instance's prediction and the training on it that follows."""
        if self.told is not None and self.told[0] is x:
            return self.told[1:]
        path, beside, at = [0], [], 0
        while (f := self.feature_[at]) >= 0:
            ways = int(self.low[at]), int(self.high[at])
            above = bool(x[f] > self.threshold[at])
            at = ways[above]
            beside.append(ways[not above])
            path.append(at)
        self.told = x, path, beside
        return path, beside

    def predict(self, x: np.ndarray) -> tuple[int | None, np.ndarray, int]:
        if not self.n_nodes:
            return None, np.zeros(0), 0
        path, _ = self._path(x)
        own = self.own(path)
        own[-1] = 1.0
        votes, rest = np.zeros(self.n_classes), 1.0
        for counts, part in zip(self.state[path, 2 * self.n_features :], own, strict=True):
            votes = votes + rest * part / (counts.sum() + self.alpha * self.n_classes) * (counts + self.alpha)
            rest *= 1 - part
        return last_max(votes), votes, len(path) - 1

    def levels(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes by depth, and what each of them votes with those above it, a leaf for its tree."""
        at = np.zeros(1 if self.n_nodes else 0, int)
        votes, rest = np.zeros((len(at), self.n_classes)), np.ones(len(at))
        while len(at):
            split, counts = self.feature_[at] >= 0, self.state[at, 2 * self.n_features :]
            own = np.where(split, self.own(at), 1.0)
            votes = votes + (rest * own / (counts.sum(axis=1) + self.alpha * self.n_classes))[:, None] * (counts + self.alpha)
            yield at, votes
            rest, votes, at = np.repeat((rest * (1 - own))[split], 2), np.repeat(votes[split], 2, axis=0), np.stack([self.low[at[split]], self.high[at[split]]], axis=1).ravel()

    def frozen_arrays(self) -> FrozenTree:
        """Nodes by levels, the low child first."""
        if not self.n_nodes:
            return FrozenTree.of([(0, 0.0, 0, 0, 0, [])], self.n_classes)
        at, votes = map(list, zip(*self.levels(), strict=True))
        depth, at, votes = np.repeat(np.arange(len(at), dtype=np.int32), list(map(len, at))), np.concatenate(at), np.concatenate(votes)
        feature, own, leaf = self.feature_[at], np.arange(len(at), dtype=np.int32), self.feature_[at] < 0
        child = (2 * np.cumsum(~leaf) - 1).astype(np.int32)
        low, high = np.where(leaf, own, child), np.where(leaf, own, child + 1)
        return FrozenTree(np.where(leaf, 0, feature), np.where(leaf, 0.0, self.threshold[at]), low, high, depth, votes, leaf, self.state[at, 2 * self.n_features :].sum(axis=1))

    def frozen(self) -> list[tuple]:
        if not self.n_nodes:
            return [(0, 0.0, 0, 0, 0, [])]
        t = self.frozen_arrays()
        votes = [v if leaf else None for v, leaf in zip(t.votes.tolist(), t.leaf.tolist(), strict=True)]
        return list(zip(t.feature.tolist(), t.threshold.tolist(), t.low.tolist(), t.high.tolist(), t.depth.tolist(), votes, strict=True))

    def train(self, x: np.ndarray, label: int, correct: bool) -> bool:
        self.seen, self.right = self.seen + 1, self.right + correct
        size, place = self.n_features, 2 * self.n_features + label
        if not self.n_nodes:
            self.state[self.add(1), : 2 * size] = np.concatenate([x, -x]) if np.isfinite(x).all() else math.inf
        path, beside = self._path(x)
        self.told = None  # the tree changes now
        both, state, made = np.concatenate([x, -x])[None], self.state[path], None
        if np.isfinite(x).all():
            by, total = batch_mondrian.beyond(state[:, : 2 * size], both)
            at, counts = np.full(len(path), self.seen), state[:, 2 * size :]
            children = self.low[path]
            until = np.where(children >= 0, self.time[children], math.inf)
            for i in np.flatnonzero(total > 0).tolist():
                one = slice(i, i + 1)
                if self.c.split_pure or counts[i, label] < counts[i].sum():
                    time = batch_mondrian.waited(self.time[path[i]], batch_mondrian.uniforms(self.seed, at[one], np.array([i]), 0), total[one])
                    if 0 < time[0] < until[i]:
                        first, second = (batch_mondrian.uniforms(self.seed, at[one], np.array([i]), salt) for salt in (1, 2))
                        f, threshold, above = batch_mondrian.cuts(state[one, : 2 * size], both, by[one], first, second)
                        made = self._cut_off(path[i], int(f[0]), float(threshold[0]), bool(above[0]), float(time[0]))
                        self.state[made + 1, : 2 * size], self.state[made + 1, place], self.base[made + 1] = both[0], 1, self.leaf_base
                        path, beside = path[: i + 1], [*beside[:i], made]
                state[i, : 2 * size] = np.minimum(state[i, : 2 * size], both[0])
                if made is not None:
                    break
        state = state[: len(path)]
        state[:, place] += 1
        self.state[path] = state
        weights = self.weights_of(path)
        below = np.zeros(1) if made is not None else weights[-1:]
        if made is None:
            self.log_weight[path[-1]] = weights[-1]
        for i in reversed(range(len(beside))):
            below = batch_mondrian.mean_exp(weights[i : i + 1], below + self.log_weight[beside[i]])
            self.log_weight[path[i]] = below[0]
        return False

    def _cut_off(self, cell: int, feature: int, threshold: float, above: bool, time: float) -> int:
        """Puts what the cell holds into a child beside a new leaf; returns the child, which the leaf follows."""
        old = self.add(2)
        for a in (self.feature_, self.threshold, self.low, self.high, self.base, self.log_weight, self.state):
            a[old] = a[cell]
        self.feature_[cell], self.threshold[cell], self.time[old : old + 2] = feature, threshold, time
        self.low[cell], self.high[cell] = (old, old + 1) if above else (old + 1, old)
        return old

    def steps(self, xs: np.ndarray, labels: list[int | None]) -> Steps:
        """Instances in order, each predicted and then learned."""
        n, known = len(labels), np.array([y is not None for y in labels], bool)
        y = np.array([0 if v is None else v for v in labels], np.int64)
        first = 0 if self.n_nodes else int(known.argmax()) + 1 if known.any() else n  # an empty tree doesn't vote
        if first and known.any():
            self.train(xs[first - 1], int(y[first - 1]), False)
        self.told = None
        votes, depth, predicted = np.full((n, self.n_classes), np.nan), np.zeros(n, np.int32), np.full(n, -1, np.int32)
        accuracy = np.zeros((2, n))  # before and after an instance
        if n > first:
            votes[first:], depth[first:] = batch_mondrian.learn(self, np.ascontiguousarray(xs[first:]), y[first:], known[first:])
            predicted[first:] = last_maxes(votes[first:])
            seen = np.append(self.seen, self.seen + np.cumsum(known[first:]))
            rights = np.append(self.right, self.right + np.cumsum(known[first:] & (predicted[first:] == y[first:])))
            share = np.divide(rights, seen, out=np.zeros(len(seen)), where=seen > 0)
            accuracy[:, first:] = share[:-1], share[1:]
            self.seen, self.right = int(seen[-1]), int(rights[-1])
        return Steps(votes, predicted, depth, np.zeros(n, bool), *accuracy)


LEARNERS = {"srp": HoeffdingLearner, "arf": HoeffdingLearner, "amf": MondrianLearner}


def create_learner(config: EnsembleConfig, tree_id: int, n_features: int, n_classes: int) -> Learner:
    return LEARNERS[config.algorithm.type](config.algorithm, n_features, n_classes, config.seed + tree_id)


class TreeRunner:
    """One tree over its instances in order: predict, compare, train, tell."""

    def __init__(self, config: EnsembleConfig, tree_id: int, n_features: int, n_classes: int) -> None:
        self.config, self.tree_id = config, tree_id
        self.learner = create_learner(config, tree_id, n_features, n_classes)

    def step(self, instance_id: int, x: np.ndarray, label: int | None) -> tuple:
        """A row of TREE_RESULT.  An instance without a label is predicted and not learned."""
        predicted, votes, depth = self.learner.predict(x)
        before, drift = self.learner.accuracy, False
        if label is not None:
            drift = self.learner.train(x, label, predicted == label)
        told = before if self.config.accuracy_timing == "before" else self.learner.accuracy
        return self.tree_id, instance_id, votes.tolist(), label, drift, told, predicted, depth
