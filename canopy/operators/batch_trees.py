"""Hoeffding trees with the gaussian estimator that learn a batch at a time, with the results of learning its instances in order.

Instances of different leaves don't touch each other, so that a batch is learned in rounds: the first instance of each leaf that has any left, then the
second.  A leaf is a row of numbers and a tree some 500 bytes a leaf.  What depends on the order over leaves is kept to it: new leaves' features are drawn by the
time of their splits, and a batch in which a tree's windows tell of a change is taken back and learned again up to there.
"""

from __future__ import annotations

import math

import numpy as np

from canopy.operators.estimators import DriftDetector, GaussianStats, entropy, erf, last_maxes, lengthened
from canopy.operators.trees import Steps, TreeRunner, create_learner, frozen
from canopy.plans.config import EnsembleConfig, HoeffdingConfig


def _deviation(weight: np.ndarray, m2: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(m2, 0) / np.where(weight > 1, weight - 1, np.inf))


def likelihoods(weight: np.ndarray, mean: np.ndarray, m2: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`GaussianStats.likelihood` of a row each."""
    s, d = _deviation(weight, m2), x[:, :, None] - mean
    safe = np.maximum(s, 1e-10)
    density = np.exp(-(d * d) / (2 * safe * safe)) / (safe * math.sqrt(2 * math.pi))
    return np.where(weight <= 1, 0.0, np.where(s < 1e-10, (d == 0).astype(float), density))


def shares(scores: np.ndarray) -> np.ndarray:
    """`votes_of` of each row."""
    positive = np.maximum(scores, 0)
    total = positive.sum(axis=1, keepdims=True)
    return np.divide(positive, total, out=np.full(scores.shape, 1 / scores.shape[1]), where=total > 0)


def best_splits(weight: np.ndarray, mean: np.ndarray, m2: np.ndarray, low: np.ndarray, high: np.ndarray, counts: np.ndarray, delta: float, tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`best_split` of each leaf: whether it has one, its feature's place and threshold."""
    size, n = len(counts), counts.sum(axis=1)
    with np.errstate(all="ignore"):
        span = high - low
        use = np.isfinite(span) & (span > 0)
        points = low[:, :, None] + span[:, :, None] / (GaussianStats.POINTS + 1) * np.arange(1, GaussianStats.POINTS + 1)
        s, d = _deviation(weight, m2)[:, :, None], points[:, :, :, None] - mean[:, :, None]
        below = np.where(s < 1e-10, (d >= 0).astype(float), (1 + erf(d / (np.maximum(s, 1e-10) * math.sqrt(2)))) / 2)
        left = np.where(weight[:, :, None] > 0, below, 0) * weight[:, :, None]
        right = np.maximum(counts[:, None, None] - left, 0)
        n_left, n_right, whole = left.sum(axis=3), right.sum(axis=3), n[:, None, None]
        use = use[:, :, None] & (points > low[:, :, None]) & (points < high[:, :, None]) & (n_left >= GaussianStats.least_side) & (n_right >= GaussianStats.least_side)
        gain = entropy(counts)[:, None, None] - n_left / whole * entropy(left) - n_right / whole * entropy(right)
        gain = np.where(use, gain, -np.inf)
        each = np.arange(size)
        best = gain.reshape(size, -1).argmax(axis=1)  # the first of equals
        feature, point = best // GaussianStats.POINTS, best % GaussianStats.POINTS
        top = gain[each, feature, point]
        gain[each, feature] = -np.inf
        bound = np.sqrt(math.log(1 / delta) / (2 * n))
        found = (n > 0) & (np.count_nonzero(counts, axis=1) > 1) & use.any(axis=(1, 2)) & ((top - gain.reshape(size, -1).max(axis=1) > bound) | (bound < tau))
    return found, feature, points[each, feature, point]


class BatchTree:
    """A Hoeffding tree in arrays: nodes, and a slot of numbers for each leaf."""

    def __init__(self, config: HoeffdingConfig, n_features: int, n_classes: int, rng: np.random.Generator) -> None:
        self.c, self.n_features, self.n_classes, self.rng = config, n_features, n_classes, rng
        self.own = min(n_features, config.subspace_size(n_features))
        self.fixed = self._draw() if config.type == "srp" else None
        self.n_nodes = self.n_slots = 0
        self.feature, self.threshold, self.slot, self.depth = np.zeros(16, np.int32), np.zeros(16), np.zeros(16, np.int32), np.zeros(16, np.int32)
        self.child = np.zeros((16, 2), np.int32)
        cells, f = self.own * n_classes, self.own
        ends = np.cumsum([0, n_classes, cells, cells, cells, f, f, 1, 1, 1])  # counts, weight, mean, m2, low, high, since, right by majority and by Bayes
        self.parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.state, self.patch, self.node = np.zeros((8, ends[-1])), np.zeros((8, f), np.int32), np.zeros(8, np.int32)
        self._fill(self._slot(), self._node(0))
        self.kept: tuple | None = None

    def _draw(self) -> np.ndarray:
        return np.sort(self.rng.permutation(self.n_features)[: self.own])

    def _node(self, depth: int) -> int:
        at = self.n_nodes
        if at == len(self.feature):
            for name in ("feature", "threshold", "slot", "depth", "child"):
                setattr(self, name, lengthened(getattr(self, name), at + max(16, at // 4)))
        self.n_nodes, self.depth[at] = at + 1, depth
        return at

    def _slot(self) -> int:
        at = self.n_slots
        if at == len(self.state):
            for name in ("state", "patch", "node"):
                setattr(self, name, lengthened(getattr(self, name), at + max(8, at // 4)))
        self.n_slots = at + 1
        return at

    def _fill(self, slot: int, node: int) -> None:
        """An empty leaf."""
        self.feature[node], self.slot[node], self.node[slot] = -1, slot, node
        self.state[slot], self.patch[slot] = 0.0, self._draw() if self.fixed is None else self.fixed
        self.state[slot, self.parts[4]], self.state[slot, self.parts[5]] = np.inf, -np.inf

    def _split(self, slot: int, place: int, threshold: float) -> tuple[int, int]:
        """Slots of the two leaves; the low one takes the place of what was split."""
        node, other = int(self.node[slot]), self._slot()
        depth = int(self.depth[node]) + 1
        low, high = self._node(depth), self._node(depth)
        self.feature[node], self.threshold[node], self.child[node] = self.patch[slot, place], threshold, (low, high)
        self._fill(slot, low)
        self._fill(other, high)
        return slot, other

    def find(self, xs: np.ndarray) -> np.ndarray:
        """The slots of instances' leaves."""
        at, going = np.zeros(len(xs), np.int32), np.arange(len(xs))
        while len(going := going[self.feature[at[going]] >= 0]):
            node = at[going]
            at[going] = self.child[node, 1 - (xs[going, self.feature[node]] <= self.threshold[node])]
        return self.slot[at]

    def _bayes(self, state: np.ndarray, x: np.ndarray) -> np.ndarray:
        counts, weight, mean, m2 = (state[:, p] for p in self.parts[:4])
        weight, mean, m2 = (a.reshape(len(state), self.own, self.n_classes) for a in (weight, mean, m2))
        n = counts.sum(axis=1, keepdims=True)
        scores = np.divide(counts, n, out=np.zeros(counts.shape), where=n > 0) * likelihoods(weight, mean, m2, x).prod(axis=1)
        return shares(scores)  # uniform for an empty leaf

    def run(self, xs: np.ndarray, labels: np.ndarray, ks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Votes and depths of instances, each predicted and then learned with its weight (0: not learned)."""
        votes, depths = np.zeros((len(xs), self.n_classes)), np.zeros(len(xs), np.int32)
        slots = self.find(xs)
        order = np.argsort(slots, kind="stable")
        leaf, start = np.unique(slots[order], return_index=True)
        end = np.append(start[1:], len(order))
        self.kept = (leaf, self.state[leaf], self.patch[leaf], self.node[leaf], self.n_nodes, self.n_slots, self.rng.bit_generator.state)
        halted: list[tuple[int, int, int, float, int, int]] = []  # time, slot, feature's place, threshold and what is left of a leaf about to be split
        while len(leaf) or halted:
            if not len(leaf):
                made = self._release(halted, order, xs, ks)
                leaf, start, end = (np.array(a, np.int64) for a in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 3
                continue
            row, state = order[start], self.state.take(leaf, axis=0)
            x = np.take_along_axis(xs[row], self.patch[leaf], axis=1)
            bayes, counts = self._bayes(state, x), state[:, self.parts[0]]
            majority = state[:, -2] > state[:, -1]
            votes[row], depths[row] = np.where(majority[:, None], shares(counts), bayes), self.depth[self.node[leaf]]
            start = start + 1
            learned = np.flatnonzero(ks[row])
            split = self._learn(leaf[learned], state[learned], bayes[learned], x[learned], labels[row[learned]], ks[row[learned]])
            left = start < end
            for i, place, threshold in split:
                g = int(learned[i])
                halted.append((int(row[g]), int(leaf[g]), place, threshold, int(start[g]), int(end[g])))
                left[g] = False
            leaf, start, end = leaf[left], start[left], end[left]
            if halted and self.fixed is not None:
                made = self._release(halted, order, xs, ks)
                if made:
                    leaf, start, end = (np.concatenate([a, np.array(b, np.int64)]) for a, b in zip((leaf, start, end), zip(*made, strict=True), strict=True))
        return votes, depths

    def _learn(self, leaf: np.ndarray, state: np.ndarray, bayes: np.ndarray, x: np.ndarray, label: np.ndarray, k: np.ndarray) -> list[tuple[int, int, float]]:
        """Learns one instance a leaf; returns which leaves are to be split, by which place and threshold."""
        if not len(leaf):
            return []
        each, shape = np.arange(len(leaf)), (len(leaf), self.own, self.n_classes)
        counts, weight, mean, m2, low, high = (state[:, p] for p in self.parts[:6])
        weight, mean, m2 = (a.reshape(shape) for a in (weight, mean, m2))
        state[:, -2] += k * (counts.any(axis=1) & (last_maxes(counts) == label))
        state[:, -1] += k * (last_maxes(bayes) == label)
        counts[each, label] += k
        k_ = k[:, None]
        np.minimum(low, x, out=low)
        np.maximum(high, x, out=high)
        w, m = weight[each, :, label] + k_, mean[each, :, label]
        d = x - m
        m = m + d * k_ / w
        weight[each, :, label], mean[each, :, label] = w, m
        m2[each, :, label] += k_ * d * (x - m)
        state[:, -3] += k
        due = np.flatnonzero(state[:, -3] >= self.c.n_min)
        state[due, -3] = 0.0
        self.state[leaf] = state
        if not len(due) or not self.own:
            return []
        found, place, threshold = best_splits(*(a[due] for a in (weight, mean, m2, low, high, counts)), self.c.delta, self.c.tau)
        return [(int(due[i]), int(place[i]), float(threshold[i])) for i in np.flatnonzero(found)]

    def _release(self, halted: list, order: np.ndarray, xs: np.ndarray, ks: np.ndarray) -> list[tuple[int, int, int]]:
        """Splits leaves by the time of their splits, as far as none that is split now could be split again before; returns the leaves with instances left."""
        halted.sort()
        made, first, done = [], math.inf, 0
        for time, slot, place, threshold, start, end in halted:
            if self.fixed is None and time > first:
                break
            done += 1
            feature = self.patch[slot, place]
            low, high = self._split(slot, place, threshold)
            rest = order[start:end]
            goes_low = xs[rest, feature] <= threshold
            middle = start + int(goes_low.sum())
            order[start:end] = np.concatenate([rest[goes_low], rest[~goes_low]])
            for s, a, b in ((low, start, middle), (high, middle, end)):
                if a < b:
                    made.append((s, a, b))
                    if self.fixed is None:
                        due = int(np.searchsorted(np.cumsum(ks[order[a:b]]), self.c.n_min))
                        first = min(first, int(order[a + due]) if a + due < b else math.inf)
        del halted[:done]
        return made

    def take_back(self) -> None:
        """As it was before the last batch."""
        leaf, state, patch, node, self.n_nodes, self.n_slots, self.rng.bit_generator.state = self.kept
        self.state[leaf], self.patch[leaf], self.node[leaf] = state, patch, node
        self.feature[node], self.slot[node] = -1, leaf


class BatchLearner:
    """`HoeffdingLearner` a batch at a time."""

    def __init__(self, config: HoeffdingConfig, n_features: int, n_classes: int, seed: int) -> None:
        self.c, self.shape, self.rng = config, (n_features, n_classes), np.random.default_rng(seed)
        self.tree, self.background = self._tree(), None
        self.detector = self._detector() if config.drift_detection else None
        self.seen = self.right = 0

    def _tree(self) -> BatchTree:
        return BatchTree(self.c, *self.shape, np.random.default_rng(self.rng.integers(2**63)))

    def _detector(self) -> DriftDetector:
        return DriftDetector(self.c.adwin_delta_warning, self.c.adwin_delta_drift)

    def frozen(self) -> list[tuple]:
        t = self.tree
        return frozen(0, lambda n: None if t.feature[n] < 0 else (int(t.feature[n]), float(t.threshold[n]), *t.child[n].tolist()), lambda path: shares(t.state[t.slot[path[-1:]], t.parts[0]])[0].tolist())

    def _run(self, xs: np.ndarray, labels: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ks = np.zeros(len(xs), np.int64)
        ks[known] = self.rng.poisson(self.c.lambda_, int(known.sum()))
        if self.background is not None:
            used = ks > 0
            self.background.run(xs[used], labels[used], ks[used])
        return *self.tree.run(xs, labels, ks), ks

    def steps(self, xs: np.ndarray, labels: list[int | None]) -> Steps:
        """Instances in order, each predicted and then learned."""
        n, known = len(labels), np.array([y is not None for y in labels], bool)
        y = np.array([0 if v is None else v for v in labels], np.int64)
        out = Steps(np.zeros((n, self.shape[1])), np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n), np.zeros(n))
        at = 0
        while at < n:
            to, drawn = n, self.rng.bit_generator.state
            votes, depth, ks = self._run(xs[at:], y[at:], known[at:])
            predicted = last_maxes(votes)
            learned, signal = np.flatnonzero(ks), None
            if self.detector is not None:
                signal, used = self.detector.until(predicted[learned] != y[at:][learned], self.background is None)
                if signal is not None:
                    to = at + int(learned[used - 1]) + 1
            if to < n:  # what comes after meets another tree, or other draws
                self.rng.bit_generator.state = drawn
                for t in (self.tree, self.background):
                    if t is not None:
                        t.take_back()
                self._run(xs[at:to], y[at:to], known[at:to])
            m, part = to - at, slice(at, to)
            out.votes[part], out.predicted[part], out.depth[part] = votes[:m], predicted[:m], depth[:m]
            seen = np.append(self.seen, self.seen + np.cumsum(known[part]))
            right = np.append(self.right, self.right + np.cumsum(known[part] & (predicted[:m] == y[part])))
            accuracy = np.divide(right, seen, out=np.zeros(m + 1), where=seen > 0)
            out.accuracy_before[part], out.accuracy_after[part] = accuracy[:-1], accuracy[1:]
            self.seen, self.right = int(seen[-1]), int(right[-1])
            if signal == "warning":
                self.background = self._tree()
            elif signal == "drift":
                self.tree, self.background = self.background or self._tree(), None
                self.detector, self.seen, self.right = self._detector(), 0, 0
                out.drift[to - 1], out.accuracy_after[to - 1] = True, 0.0
            at = to
        for t in (self.tree, self.background):
            if t is not None:
                t.kept = None
        return out


class BatchRunner(TreeRunner):
    """`TreeRunner` a batch at a time."""

    def __init__(self, config: EnsembleConfig, tree_id: int, n_features: int, n_classes: int) -> None:
        self.config, self.tree_id, a = config, tree_id, config.algorithm
        arrays = isinstance(a, HoeffdingConfig) and a.numeric_estimator == "gaussian"
        self.learner = BatchLearner(a, n_features, n_classes, config.seed + tree_id) if arrays else create_learner(config, tree_id, n_features, n_classes)

    def steps(self, xs: np.ndarray, labels: list[int | None]) -> tuple[Steps, np.ndarray]:
        """What the tree tells, and the accuracies that weigh its votes."""
        told = self.learner.steps(xs, labels)
        return told, told.accuracy_before if self.config.accuracy_timing == "before" else told.accuracy_after
