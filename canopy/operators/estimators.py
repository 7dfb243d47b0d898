"""Per-leaf statistics of features by class, and the adaptive window; state for the keyed learners, as numpy arrays."""

from __future__ import annotations

import math
from collections import deque

import numpy as np

_ERF = np.array((0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))  # as in functions.exprs


def erf(x: np.ndarray) -> np.ndarray:
    t = 1 / (1 + 0.3275911 * np.abs(x))
    return np.sign(x) * (1 - np.exp(-x * x) * (t * np.polyval(_ERF[::-1], t)))


def entropy(weights: np.ndarray, axis: int = -1) -> np.ndarray:
    total = weights.sum(axis=axis, keepdims=True)
    p = np.divide(weights, total, out=np.zeros_like(weights, float), where=total > 0)
    return -(p * np.log2(p, out=np.zeros_like(p), where=p > 0)).sum(axis=axis)


def votes_of(scores: np.ndarray) -> np.ndarray:
    positive = np.maximum(scores, 0)
    total = positive.sum()
    return positive / total if total > 0 else np.full(len(scores), 1 / len(scores))


def last_max(x: np.ndarray) -> int:
    return len(x) - 1 - int(x[::-1].argmax())


def last_maxes(x: np.ndarray) -> np.ndarray:
    """`last_max` of each row."""
    return x.shape[1] - 1 - x[:, ::-1].argmax(axis=1)


def lengthened(a: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n rows; in place if the memory is its own, as it isn't after unpickling."""
    a = a if a.flags.owndata else a.copy()
    a.resize((n, *a.shape[1:]), refcheck=False)
    return a


class GaussianStats:
    """Weight, mean and squared deviations of every feature and class, and each feature's range."""

    POINTS = 10

    def __init__(self, n_features: int, n_classes: int, _bins: int = 0) -> None:
        self.weight, self.mean, self.m2 = (np.zeros((n_features, n_classes)) for _ in range(3))
        self.low, self.high = np.full(n_features, np.inf), np.full(n_features, -np.inf)

    def update(self, x: np.ndarray, label: int, k: float) -> None:
        self.low, self.high = np.minimum(self.low, x), np.maximum(self.high, x)
        self.weight[:, label] += k
        d = x - self.mean[:, label]
        self.mean[:, label] += d * k / self.weight[:, label]
        self.m2[:, label] += k * d * (x - self.mean[:, label])

    def _deviation(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.m2, 0) / np.where(self.weight > 1, self.weight - 1, np.inf))

    def likelihood(self, x: np.ndarray) -> np.ndarray:
        """Density of each feature's value in each class."""
        s, d = self._deviation(), x[:, None] - self.mean
        safe = np.maximum(s, 1e-10)
        density = np.exp(-(d * d) / (2 * safe * safe)) / (safe * math.sqrt(2 * math.pi))
        return np.where(self.weight <= 1, 0.0, np.where(s < 1e-10, (d == 0).astype(float), density))

    def splits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, thresholds and class weights to the left of candidate splits, in order of feature."""
        span = self.high - self.low
        use = np.flatnonzero(np.isfinite(span) & (span > 0))
        points = self.low[use, None] + span[use, None] / (self.POINTS + 1) * np.arange(1, self.POINTS + 1)
        s = self._deviation()[use][:, None]
        d = points[:, :, None] - self.mean[use][:, None]
        below = np.where(s < 1e-10, (d >= 0).astype(float), (1 + erf(d / (np.maximum(s, 1e-10) * math.sqrt(2)))) / 2)
        left = np.where(self.weight[use][:, None] > 0, below, 0) * self.weight[use][:, None]
        inside = (points > self.low[use, None]) & (points < self.high[use, None])
        return np.repeat(use, self.POINTS)[inside.ravel()], points.ravel()[inside.ravel()], left.reshape(-1, left.shape[2])[inside.ravel()]

    least_side = 1.0


class Histogram:
    """Bins in order of their means, with class weights; the closest two merge when there are too many."""

    def __init__(self, n_classes: int, most: int) -> None:
        self.most, self.means, self.by_class = most, np.zeros(0), np.zeros((0, n_classes))

    def update(self, x: float, label: int, k: float) -> None:
        i = int(np.searchsorted(self.means, x))
        for j in (i, i - 1):
            if 0 <= j < len(self.means) and abs(self.means[j] - x) < 1e-9:
                total = self.by_class[j].sum()
                self.means[j] = (self.means[j] * total + x * k) / (total + k)
                self.by_class[j, label] += k
                return
        row = np.zeros((1, self.by_class.shape[1]))
        row[0, label] = k
        self.means, self.by_class = np.insert(self.means, i, x), np.insert(self.by_class, i, row, axis=0)
        if len(self.means) > self.most:
            j = int(np.argmin(np.diff(self.means)))
            w = self.by_class[j : j + 2].sum(axis=1)
            self.means[j] = (self.means[j : j + 2] * w).sum() / w.sum()
            self.by_class[j] += self.by_class[j + 1]
            self.means, self.by_class = np.delete(self.means, j + 1), np.delete(self.by_class, j + 1, axis=0)

    def nearest(self, x: float) -> int:
        i = int(np.searchsorted(self.means, x))
        return min((j for j in (i - 1, i) if 0 <= j < len(self.means)), key=lambda j: (abs(self.means[j] - x), j))


class HistogramStats:
    least_side = 0.0

    def __init__(self, n_features: int, n_classes: int, bins: int) -> None:
        self.n_classes, self.features = n_classes, [Histogram(n_classes, bins) for _ in range(n_features)]

    def update(self, x: np.ndarray, label: int, k: float) -> None:
        for h, v in zip(self.features, x.tolist(), strict=True):
            h.update(v, label, k)

    def likelihood(self, x: np.ndarray) -> np.ndarray:
        """Share of each class's weight in the bin nearest to the value."""
        out = np.zeros((len(self.features), self.n_classes))
        for f, (h, v) in enumerate(zip(self.features, x.tolist(), strict=True)):
            if len(h.means):
                total = h.by_class.sum(axis=0)
                np.divide(h.by_class[h.nearest(v)], total, out=out[f], where=total > 0)
        return out

    def splits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        features, points, left = [np.zeros(0, int)], [np.zeros(0)], [np.zeros((0, self.n_classes))]
        for f, h in enumerate(self.features):
            if len(h.means) > 1:
                features.append(np.full(len(h.means) - 1, f))
                points.append((h.means[1:] + h.means[:-1]) / 2)
                left.append(np.cumsum(h.by_class, axis=0)[:-1])
        return np.concatenate(features), np.concatenate(points), np.concatenate(left)


STATS = {"gaussian": GaussianStats, "histogram": HistogramStats}


def best_split(stats: GaussianStats | HistogramStats, counts: np.ndarray, delta: float, tau: float) -> tuple[int, float] | None:
    """Feature and threshold, if the best feature's gain leads by the Hoeffding bound or the bound is below tau."""
    n = counts.sum()
    if n <= 0 or np.count_nonzero(counts) < 2:
        return None
    features, points, left = stats.splits()
    right = np.maximum(counts - left, 0)
    n_left, n_right = left.sum(axis=1), right.sum(axis=1)
    use = (n_left >= stats.least_side) & (n_right >= stats.least_side) & (n_left > 0) & (n_right > 0)
    if not use.any():
        return None
    features, points, left, right, n_left, n_right = (x[use] for x in (features, points, left, right, n_left, n_right))
    gain = entropy(counts) - n_left / n * entropy(left) - n_right / n * entropy(right)
    best = int(np.argmax(gain))  # the first of equals
    others = gain[features != features[best]]
    second = float(others.max()) if len(others) else -math.inf
    bound = math.sqrt(math.log(1 / delta) / (2 * n))
    return (int(features[best]), float(points[best])) if gain[best] - second > bound or bound < tau else None


class Adwin:
    """Adaptive window over a stream of numbers: rows of buckets of doubling size; the oldest go when the means of two parts differ."""

    ROOM, EVERY, LEAST_WIDTH, LEAST_SIDE = 5, 32, 10, 6

    def __init__(self, delta: float) -> None:
        self.delta, self.clock, self.width, self.total = delta, 0, 0, 0.0
        self.rows: list[deque[float]] = [deque()]  # sums of buckets of 2^i elements, the oldest first

    def add(self, x: float) -> bool:
        return self.extend([x])

    def extend(self, xs: list[float]) -> bool:
        """Adds numbers of which none but the last may be a clock's EVERY-th, so that there is nothing to test before it."""
        self.clock += len(xs)
        self.width += len(xs)
        self.total += sum(xs)
        self.rows[0].extend(xs)
        for i, row in enumerate(self.rows):
            if len(row) <= self.ROOM:
                break
            if i + 1 == len(self.rows):
                self.rows.append(deque())
            while len(row) > self.ROOM:
                self.rows[i + 1].append(row.popleft() + row.popleft())
        changed = False
        if self.clock % self.EVERY == 0 and self.width > self.LEAST_WIDTH:
            while self._cut():
                while not self.rows[-1]:
                    self.rows.pop()
                self.width -= 2 ** (len(self.rows) - 1)
                self.total -= self.rows[-1].popleft()
                changed = True
        return changed

    def _cut(self) -> bool:
        n0, s0, n = 0, 0.0, self.width
        for i in range(len(self.rows) - 1, -1, -1):
            for s in self.rows[i]:
                n0, s0 = n0 + 2**i, s0 + s
                n1 = n - n0
                if n0 > self.LEAST_SIDE and n1 > self.LEAST_SIDE:
                    bound = (1 / n0 + 1 / n1) * math.log(4 * n * n / self.delta) / 2
                    if (s0 / n0 - (self.total - s0) / n1) ** 2 > bound:
                        return True
        return False

    @property
    def mean(self) -> float:
        return self.total / self.width if self.width else 0.0


class DriftDetector:
    """Two windows over a tree's errors: a sensitive one warns, the other tells of drift."""

    def __init__(self, warning: float, drift: float) -> None:
        self.warning, self.drift = Adwin(warning), Adwin(drift)

    def add(self, error: float) -> str | None:
        drifted, warned = self.drift.add(error), self.warning.add(error)
        return "drift" if drifted else "warning" if warned else None

    def until(self, errors: np.ndarray, warn: bool) -> tuple[str | None, int]:
        """Adds errors up to the first drift, or warning if told so; returns which and how many were added."""
        values, at = errors.astype(float).tolist(), 0
        while at < len(values):
            to = min(len(values), at + Adwin.EVERY - self.drift.clock % Adwin.EVERY)
            drifted, warned = self.drift.extend(values[at:to]), self.warning.extend(values[at:to])
            at = to
            if drifted or warned and warn:
                return "drift" if drifted else "warning", at
        return None, at
