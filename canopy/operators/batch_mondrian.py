"""Mondrian trees a batch at a time, with the results of learning in order.

What a node does with an instance depends on the instances that came to it before, and on nothing below it: its box and counts are running
sums, and it splits where a drawn time falls below all before.  So a batch goes down the tree in rounds, a round for each level of nodes as
the batch leaves them, and a node takes all its instances at once.  Log weights come up by the rounds in reverse, and votes go down again.
"""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from canopy.operators.trees import MondrianLearner

#: What comes to a node: an instance to learn, one to be told of only, and what a split cuts off, which begins a node.
LEARNED, TOLD, BEGUN = 0, 1, 2
_MASK = 2**64 - 1


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniforms(seed: int, at: np.ndarray, depth: np.ndarray, salt: int) -> np.ndarray:
    """Draws between 0 and 1, without either, of an instance (its number among those learned) and a place on its path."""
    h = at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    h = _mixed(_mixed(h) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((salt + 1) * 0x8CB92BA72F3D8DD7 & _MASK))
    return ((h >> np.uint64(12)).astype(float) + 0.5) * 2.0**-52


class LogRises:
    """Sums of log(i + a) for i below n: of a table, or by Stirling's series."""

    MOST = 1 << 20

    def __init__(self, a: float) -> None:
        self.a, self.table = a, np.zeros(1)
        self.last = np.longdouble(0)

    def __call__(self, n: np.ndarray) -> np.ndarray:
        most = int(n.max()) if len(n) else 0
        if most >= len(self.table) and len(self.table) < self.MOST:
            size = len(self.table)
            room = min(self.MOST, max(1024, 2 * most))
            more = np.cumsum(np.concatenate([[self.last], np.log(np.arange(size - 1, room - 1, dtype=np.longdouble) + np.longdouble(self.a))]))
            self.table, self.last = np.concatenate([self.table, more[1:].astype(float)]), more[-1]
        if most < self.MOST:
            return self.table.take(n)
        out = self.table[np.minimum(n, self.MOST - 1)]
        large = n >= self.MOST
        z = n[large] + self.a
        out[large] = (z - 0.5) * np.log(z) - z + (0.5 * math.log(2 * math.pi) - math.lgamma(self.a)) + 1 / (12 * z)
        return out


_RISES: dict[float, LogRises] = {}


def log_evidence(counts: np.ndarray, n: np.ndarray, alpha: float) -> np.ndarray:
    """Of counts, a row a class, the log of the product of what each instance's class was given when it came."""
    one, all_ = (_RISES.setdefault(a, LogRises(a)) for a in (alpha, alpha * len(counts)))
    out = one(counts[0])
    for own in counts[1:]:
        out = out + one(own)
    return out - all_(n)


def mean_exp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high = np.maximum(a, b)
    return high + np.log((1 + np.exp(np.minimum(a, b) - high)) / 2)


def beyond(box: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far instances are outside boxes, by feature and in all."""
    with np.errstate(over="ignore"):
        outside, size = box - both, box.shape[1] // 2
        by = np.maximum(np.maximum(outside[:, :size], outside[:, size:]), 0)
        return by, np.add.reduce(by, axis=1)


def waited(time: np.ndarray, draw: np.ndarray, total: np.ndarray) -> np.ndarray:
    """When instances so far outside would split nodes of a time."""
    with np.errstate(over="ignore"):
        return time - np.log(draw) / total


def cuts(box: np.ndarray, both: np.ndarray, by: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature, threshold and whether the instance is above it, of splits between boxes and the instances outside, by two draws each."""
    size, each = by.shape[1], np.arange(len(by))
    most = by.max(axis=1)[:, None]
    sums = np.cumsum(np.where(np.isinf(by), 1.0, by / most), axis=1)
    f = (sums >= first[:, None] * sums[:, -1:]).argmax(axis=1)
    at, low, high = both[each, f], box[each, f], -box[each, size + f]
    above = at > high
    begin, end = np.where(above, high, at), np.where(above, at, low)
    threshold = begin + (end - begin) * second
    return f, np.where(threshold < end, threshold, begin), above


class _Ranks:
    """Ranks of the instances' values by column, made when first asked for."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.of = values, None

    def smallest(self, rows: np.ndarray, key: np.ndarray) -> np.ndarray:
        """As `_running`, without a start: a later key's ranks are below all before, so that no key meets another."""
        n, width = self.values.shape
        if self.of is None:
            order = np.argsort(self.values, axis=0)
            self.sorted, self.of = np.take_along_axis(self.values, order, axis=0).T.copy(), np.empty((width, n), np.int64)
            for c in range(width):
                self.of[c, order[:, c]] = np.arange(n)
        out, apart = np.empty((len(rows), width)), key * n
        for c in range(width):
            out[:, c] = self.sorted[c].take(np.minimum.accumulate(self.of[c].take(rows) - apart) + apart)
        return out


def _running(values: np.ndarray, key: np.ndarray, start: np.ndarray, ranks: _Ranks | None = None, rows: np.ndarray | None = None) -> np.ndarray:
    """Smallest values so far of those with the same key, which lie together, and of a row of `start` each."""
    shift, longest = 1, int(np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))).max())
    if longest > 16:
        ranks, rows = (ranks, rows) if ranks is not None else (_Ranks(values[:, None]), np.arange(len(values)))
        return np.minimum(ranks.smallest(rows, key).reshape(values.shape), start)
    out = np.minimum(values, start)
    while shift < longest:
        same = np.flatnonzero(key[shift:] == key[:-shift])
        out[same + shift] = np.minimum(out[same + shift], out[same])
        shift *= 2
    return out


def _before(values: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """`values` of the entry before with the same key, else of `start`."""
    out = start.copy()
    same = np.flatnonzero(key[1:] == key[:-1])
    out[same + 1] = values[same]
    return out


class _Round:
    """A level's visits, by node and then by instance, and what the log weights and votes need of them."""

    __slots__ = ("begin", "below_high", "below_low", "counts", "first", "j", "last", "leaf", "leaf_after", "n", "nodes", "src", "told", "weight", "weight_after")


def learn(tree: MondrianLearner, x: np.ndarray, labels: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes and depths of instances, each told of by the tree before it is learned; the tree has a node at least."""
    n, size, classes = len(x), tree.n_features, tree.n_classes
    both, finite = np.concatenate([x, -x], axis=1), np.isfinite(x).all(axis=1)
    all_finite, flat, wide = bool(finite.all()), x.ravel(), 2 * size
    number, ranks = tree.seen + np.cumsum(known), _Ranks(both)
    rounds: list[_Round] = []
    n_visits, visited = 0, np.full(n, -1)  # the last visit of each instance that learned it
    depth = np.full(n, -1, np.int32)
    extras, n_extras = [np.zeros(1)], 1  # log weights that children had before the batch; the first is a new leaf's
    begun_from, begun = tree.n_nodes, np.zeros((0, 2), np.int64)  # of the nodes that splits cut off here, where their children's log weights are

    # A visit is a number: node, instance, kind.
    bits = max(1, (n - 1).bit_length())
    come, waiting = np.arange(n) << 2 | np.where(known, LEARNED, TOLD), None
    while len(come):
        # Visits by node and instance.
        come.sort()
        node, j, kind = come >> bits + 2, come >> 2 & (1 << bits) - 1, come & 3
        m, own_number = len(come), np.arange(len(come))
        is_first = np.empty(m, bool)
        is_first[0] = True
        np.not_equal(node[1:], node[:-1], out=is_first[1:])
        first = np.flatnonzero(is_first)
        last = np.append(first[1:], m) - 1
        seg = np.cumsum(is_first) - 1
        nodes = node[first]
        rows, bases = tree.state[nodes], tree.base[nodes]
        plain = not kind.any()  # all are learned
        learns, is_begun = kind == LEARNED, kind == BEGUN
        learned = own_number if plain else np.flatnonzero(learns)
        told = own_number if plain or not is_begun.any() else np.flatnonzero(~is_begun)
        src = visited[j]
        if not plain:
            src[kind == TOLD] = -1
        visited[j[learned]] = n_visits + learned
        depth[j[told]] += 1

        # Class counts before each visit.
        label = labels[j]
        if not plain:
            label[~learns] = -1
        counts, end_counts = np.empty((classes, m), np.int64), rows[:, wide:].T.astype(np.int64)
        for c in range(classes):
            own = label == c
            sums = np.cumsum(own)
            shift = end_counts[c] - sums[first] + own[first]
            np.subtract(sums, own, out=counts[c])
            counts[c] += shift[seg]
            end_counts[c] = sums[last] + shift
        tree.state[nodes, wide:] = end_counts.T
        in_all = np.add.reduce(counts, axis=0)

        # Instances outside the box; it grows by them, and by none else.
        box = np.ascontiguousarray(rows[:, :wide])
        ways = tree.feature_[nodes], tree.threshold[nodes], tree.low[nodes], tree.high[nodes]
        outer = np.flatnonzero((box.take(seg, axis=0) > both.take(j, axis=0)).ravel()) // max(1, wide)
        split = outer[:0]
        if len(outer):
            outer = outer[np.append(True, outer[1:] != outer[:-1])]
            if not (plain and all_finite):
                outer = outer[learns[outer] & finite[j[outer]]]
        if len(outer):
            key, mine = seg[outer], both[j[outer]]
            grown = _running(mine, key, box[key], ranks, j[outer])
            had = _before(grown, key, box[key])
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            tree.state[nodes[key[ends]], :wide] = grown[ends]
            by, total = beyond(had, mine)
            may = total > 0
            if not tree.c.split_pure:
                may &= counts[label[outer], outer] < in_all[outer]
            may = np.flatnonzero(may)
            if len(may):
                key, outer, had, mine, by = key[may], outer[may], had[may], mine[may], by[may]
                time = waited(tree.time[nodes[key]], uniforms(tree.seed, number[j[outer]], depth[j[outer]], 0), total[may])
                time[time <= 0] = math.inf
                children = ways[2][key]
                until = np.where(children >= 0, tree.time[children], math.inf)
                splits = np.flatnonzero(time < _before(_running(time, key, until), key, until))
                key, split, time, had, mine, by = key[splits], outer[splits], time[splits], had[splits], mine[splits], by[splits]

        # Ways on from each visit, as they were before it.
        way_feature, way_threshold, way_low, way_high = (w.take(seg) for w in ways)
        leaf_after = way_feature < 0
        if len(split):
            at = number[j[split]], depth[j[split]]
            feature, threshold, above = cuts(had, mine, by, *(uniforms(tree.seed, *at, salt) for salt in (1, 2)))
            old = tree.add(2 * len(split)) + 2 * np.arange(len(split))
            new = old + 1
            low, high = np.where(above, old, new), np.where(above, new, old)
            upto = np.full(m, -1)  # the split before each visit, of any node
            upto[split] = np.arange(len(split))
            upto[1:], upto[0] = np.maximum.accumulate(upto)[:-1], -1
            after = np.flatnonzero(upto >= 0)
            after = after[seg[after] == key[upto[after]]]
            by_split = upto[after]
            way_feature[after], way_threshold[after], way_low[after], way_high[after] = feature[by_split], threshold[by_split], low[by_split], high[by_split]
            leaf_after = way_feature < 0
            leaf_after[split] = False
            # What was cut off, the leaf beside it, and the node as its last split leaves it.
            for a, w in zip((tree.feature_, tree.threshold, tree.low, tree.high), (way_feature, way_threshold, way_low, way_high), strict=True):
                a[old] = w[split]
            tree.time[old], tree.time[new], tree.base[old], tree.base[new] = time, time, bases[key], tree.leaf_base
            tree.state[old, :wide], tree.state[old, wide:] = had, counts[:, split].T
            tree.state[new, :wide], tree.state[new, wide + label[split]] = mine, 1
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            for a, w in zip((tree.feature_, tree.threshold, tree.low, tree.high), (feature, threshold, low, high), strict=True):
                a[nodes[key[ends]]] = w[ends]
        leaf = way_feature < 0

        # Where they go.
        on = ~leaf
        if len(told) < m:
            on &= ~is_begun
        on = own_number if on.all() else np.flatnonzero(on)
        jo = j[on]
        goes_high = flat[jo * size + way_feature[on]] > way_threshold[on]
        child = np.where(goes_high, way_high[on], way_low[on])
        next_kind, stays = kind[on], None
        if len(split) or not plain:
            ends_here = np.zeros(m, bool)
            ends_here[split] = True
            next_kind[ends_here[on]] = TOLD
            stays = next_kind == LEARNED

        # After which visits the children's log weights are what they are, of either side: own numbers, or negative ones of extras.
        initial = np.zeros((2, len(nodes)), np.int64)
        was = np.flatnonzero((ways[0] >= 0) & (nodes < begun_from))
        for side in (0, 1):
            extras.append(tree.log_weight[ways[2 + side][was]])
            initial[side, was] = -n_extras - 1 - np.arange(len(was))
            n_extras += len(was)
        if len(told) < m:
            cut_off = np.flatnonzero(is_begun[first])
            initial[:, cut_off] = begun[nodes[cut_off] - begun_from].T
        below = []
        for side in (0, 1):
            went = on[goes_high if side else ~goes_high] if stays is None else on[stays & (goes_high == bool(side))]
            at = np.zeros(m, np.int64)
            at[first] = first
            value = np.empty(m, np.int64)
            value[first] = initial[side]
            at[went], value[went] = went, n_visits + went
            if len(split):
                at[split], value[split] = split, np.where(above == bool(side), -1, n_visits + split)
            below.append(value[np.maximum.accumulate(at)])
        if len(split):
            begun, had = np.zeros((tree.n_nodes - begun_from, 2), np.int64), begun
            begun[: len(had)] = had
            for side in (0, 1):
                begun[old - begun_from, side] = np.where(is_first[split], initial[side, key], below[side][split - 1])

        r = _Round()
        r.begin, r.nodes, r.first, r.last, r.j, r.src, r.told = n_visits, nodes, first, last, j, src, told
        r.counts, r.n, r.leaf, r.leaf_after, r.below_low, r.below_high = counts, in_all, leaf, leaf_after, *below
        r.weight, r.weight_after = tree.weights(counts, in_all, bases[seg]), np.empty(m)
        r.weight_after[:-1] = r.weight[1:]
        r.weight_after[last] = tree.weights(end_counts, np.add.reduce(end_counts, axis=0), bases)
        rounds.append(r)
        n_visits += m

        # A node's visits are complete once the node that now is above it is done.
        tree.mark(nodes[tree.feature_[nodes] >= 0])
        come = (child.astype(np.int64) << bits | jo) << 2 | next_kind
        if len(split):
            come = np.concatenate([come, (old << bits | j[split]) << 2 | BEGUN])
        if waiting is not None:
            come, waiting = np.concatenate([come, waiting]), None
        ready = tree.marked(come >> bits + 2)
        if not ready.all():
            come, waiting = come[ready], come[~ready]

    # Log weights, from below.
    after = np.empty(n_visits + n_extras)
    after[n_visits:] = np.concatenate(extras)[::-1]
    to = np.arange(n_visits + n_extras)
    for r in rounds:
        own = np.flatnonzero(r.src >= 0)
        to[r.src[own]] = r.begin + own
    before = []
    for r in reversed(rounds):
        now = after[r.begin : r.begin + len(r.j)]
        now[:] = r.weight_after
        inside = np.flatnonzero(~r.leaf_after)
        now[inside] = mean_exp(now[inside], after[to[r.below_low[inside]]] + after[to[r.below_high[inside]]])
        prior = np.empty(len(now))
        prior[1:] = now[:-1]
        prior[r.first] = tree.log_weight[r.nodes]
        before.append(prior)
        tree.log_weight[r.nodes] = now[r.last]

    # Votes, from above.
    votes, rest = np.zeros((classes, n)), np.ones(n)
    for r, prior in zip(rounds, reversed(before), strict=True):
        own = np.exp(np.minimum(r.weight - prior, 0.0)) / 2
        own[r.leaf] = 1.0
        j, in_all, counts = r.j, r.n, r.counts
        if len(r.told) < len(j):
            j, in_all, own, counts = j[r.told], in_all[r.told], own[r.told], counts[:, r.told]
        had = rest[j]
        share = had * own / (in_all + tree.alpha * classes)
        for into, count in zip(votes, counts, strict=True):
            into[j] += share * (count + tree.alpha)
        rest[j] = had * (1 - own)
    return np.ascontiguousarray(votes.T), depth
