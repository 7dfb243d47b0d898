"""Benchmark decontamination: every passage of every text queries a BM25 index of test items by block-max WAND.

The index holds, for each term, its items with their BM25 impacts, as shares of the item's score against itself, in blocks with
their largest impact.  A passage is a window of twice the longest item's words, moved on by half its width, so that any copy of an
item lies whole in one.  The largest impacts of a passage's terms are added up for all passages of a batch at once; those that
can't reach the threshold go, and the others are searched by block-max WAND for all items above it.  A hit stands if the passage
holds enough of the five-word shingles of the item's question and of its answer, or of the whole item.  The answer is the item's last
sentence or line; an item of one sentence has none.  An item's threshold is lowered to the least score of a passage that holds enough
of the whole item, so that the search misses none of these.

Words are runs of letters, digits and underscores, in lower case.  Null and empty texts and items match nothing.  Rows are judged
one by one, so repeated rows give repeated results; items that repeat are found each.  Items are indexed in parts of bounded
size, with statistics over all of them, and each part is sent to all tasks in turn.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import named_again, plainly_named, text_slices

TERM = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")


@dataclass(frozen=True)
class DecontaminationParams:
    k1: float = 1.2
    b: float = 0.75
    #: Least BM25 score of a hit, as a share of the item's score against itself; less for items that can score less at enough overlap.
    threshold: float = 0.65
    shingle: int = 5
    overlap: float = 0.8
    block: int = 2
    #: Characters of items in one part of the index, about.
    part_chars: int = 16_000_000


def terms(text: str | None) -> list[str]:
    return TERM.findall(text.lower()) if text else []


def shingles(tokens: list[str], k: int) -> set[tuple[str, ...]]:
    k = min(k, len(tokens))
    return {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)} if k else set()


def question_and_answer(text: str) -> tuple[str, str]:
    pieces = [x for x in _SENTENCE.split(text.strip()) if x]
    return (text, "") if len(pieces) < 2 else (text[: text.rindex(pieces[-1])], pieces[-1])


def most_lost(values: list[float], k: int, lost: int) -> float:
    """The largest sum of words' values that is gone with so many of a text's shingles of k words; a word goes with all that hold it."""
    n = len(values) - k + 1
    best = np.full((k + 1, lost + 1), -np.inf)  # by lost shingles in a row up to here, and lost in all
    best[0, 0] = 0.0
    for s in range(n):
        new = np.full_like(best, -np.inf)
        new[0] = best.max(axis=0)
        new[1:, 1:] = best[:-1, :-1]
        new[k, 1:] = np.maximum(new[k, 1:], best[k, :-1])
        new[min(k, s + 1) :] += values[s]
        best = new
    for i in range(n, len(values)):
        best[n - max(0, i - k + 1) :] += values[i]
    return float(best.max())


class ItemIndex:
    """Postings of some items of about the same length."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_length: float, p: DecontaminationParams) -> None:
        self.p, self.ids = p, [i for i, _ in items]
        tokens = [terms(t) for _, t in items]
        self.stride = max(len(t) for t in tokens)
        halves = [question_and_answer(t) for _, t in items]
        self.wholes = [shingles(t, p.shingle) for t in tokens]
        self.scale: list[float] = []  # of impacts, so that one threshold holds for all items
        self.questions, self.answers = ([shingles(terms(h[k]), p.shingle) for h in halves] for k in (0, 1))
        self.terms: dict[str, int] = {}
        postings: list[list[tuple[int, float]]] = []
        for item, words in enumerate(tokens):
            norm = p.k1 * (1 - p.b + p.b * len(words) / mean_length)
            impacts = {t: math.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * tf * (p.k1 + 1) / (tf + norm) for t, tf in Counter(words).items()}
            own = sum(impacts.values())
            k, times = min(p.shingle, len(words)), Counter(words)
            lost = most_lost([impacts[t] / own / times[t] for t in words], k, int((1 - p.overlap) * (len(words) - k + 1) + 1e-9))
            self.scale.append(max(1.0, p.threshold / max(1e-3, 1 - lost - 1e-9)))
            own /= self.scale[-1]
            for t, x in impacts.items():
                at = self.terms.setdefault(t, len(self.terms))
                if at == len(postings):
                    postings.append([])
                postings[at].append((item, x / own))
        self.items = [[i for i, _ in x] for x in postings]
        self.impacts = [[w for _, w in x] for x in postings]
        self.block_max = [[max(w[k : k + p.block]) for k in range(0, len(w), p.block)] for w in self.impacts]
        self.most = np.array([max(w) for w in self.impacts])
        # The largest impact of each term in each block of items it occurs in, for all terms in a row.
        largest: list[dict[int, float]] = [{} for _ in postings]
        for own, x in zip(largest, postings, strict=True):
            for item, w in x:
                own[item // p.block] = max(w, own.get(item // p.block, 0.0))
        self.n_groups = -(-len(items) // p.block)
        self.group_at = np.cumsum([0, *(len(x) for x in largest)])
        self.group_ids = np.array([g for x in largest for g in x])
        self.group_max = np.array([w for x in largest for w in x.values()])

    def search(self, query: list[int], groups: list[int] | None = None) -> list[tuple[int, float]]:
        """Items whose impacts over the query's terms reach the threshold, by block-max WAND; in some groups of items, sorted, or in all."""
        size, least, found = self.p.block, self.p.threshold - 1e-12, []
        groups = list(range(self.n_groups)) if groups is None else groups
        cursors = self._moved([[self.items[t][0], 0, t] for t in query], groups[0] * size)  # item, place in the postings, term
        while cursors:
            cursors.sort()
            total = 0.0
            for k, (_, _, t) in enumerate(cursors):  # the pivot: the first item that could reach the threshold
                total += self.most[t]
                if total >= least:
                    break
            else:
                return found
            pivot = cursors[k][0]
            while k + 1 < len(cursors) and cursors[k + 1][0] == pivot:
                k += 1
            bound, past = 0.0, cursors[k + 1][0] if k + 1 < len(cursors) else len(self.ids)
            for c in cursors[: k + 1]:  # the blocks that would hold the pivot
                at = bisect_left(self.items[c[2]], pivot, c[1])
                if at < len(self.items[c[2]]):
                    bound += self.block_max[c[2]][at // size]
                    last = min((at // size + 1) * size, len(self.items[c[2]])) - 1
                    past = min(past, self.items[c[2]][last] + 1)
            if bound >= least:
                past = pivot + 1
                score = 0.0
                for c in cursors[: k + 1]:
                    at = bisect_left(self.items[c[2]], pivot, c[1])
                    if at < len(self.items[c[2]]) and self.items[c[2]][at] == pivot:
                        score += self.impacts[c[2]][at]
                if score >= least:
                    found.append((pivot, score))
            past = max(past, pivot + 1)
            g = bisect_left(groups, past // size)
            if g == len(groups):
                return found
            if groups[g] > past // size:  # nothing between can reach the threshold
                cursors = self._moved(cursors, groups[g] * size)
            else:
                cursors = self._moved(cursors[: k + 1], past) + cursors[k + 1 :]
        return found

    def _moved(self, cursors: list[list[int]], item: int) -> list[list[int]]:
        """The cursors at the first item from a given one; those with none go."""
        out = []
        for c in cursors:
            own = self.items[c[2]]
            c[1] = bisect_left(own, item, c[1])
            if c[1] < len(own):
                c[0] = own[c[1]]
                out.append(c)
        return out

    def _reaching(self, could: np.ndarray, blocks: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, list[int]]]:
        """Those passages for which the largest impacts within some groups of items reach the threshold, with these.

        A passage has the terms of two blocks of words, and blocks (sorted) and ids tell the terms of each.
        """
        step = max(1, 4_000_000 // self.n_groups)
        for lo in range(0, len(could), step):
            some = could[lo : lo + step]
            first, last = int(some[0]), int(some[-1])
            for start in range(first, last + 1, step):
                a, b = np.searchsorted(blocks, (start, start + step + 1))
                t = ids[a:b]
                n = self.group_at[t + 1] - self.group_at[t]
                entry = np.repeat(self.group_at[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum())) if len(t) else np.zeros(0, int)
                key = np.repeat(blocks[a:b] - start, n) * self.n_groups + self.group_ids[entry]
                bound = np.bincount(key, self.group_max[entry], (step + 1) * self.n_groups).reshape(-1, self.n_groups)
                together = bound[:-1] + bound[1:]
                reached = together.max(axis=1) >= self.p.threshold - 1e-9
                own = some[(some >= start) & (some < start + step)]
                for w in own[reached[own - start]].tolist():
                    yield w, np.flatnonzero(together[w - start] >= self.p.threshold - 1e-9).tolist()

    def hits(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, float, float, float]]:
        """Text, item, first word of the passage, score, overlap of question and of answer (nan if it has none)."""
        lookup, n_terms, stride = self.terms.get, len(self.terms), self.stride
        keys, base, owner = [], 0, []
        for n, words in enumerate(texts):
            ids = np.array([lookup(t, -1) for t in words], np.int64)
            at = np.flatnonzero(ids >= 0)
            keys.append((base + at // stride) * n_terms + ids[at])
            owner.append((base, n))
            base += len(words) // stride + 2  # an empty block between texts
        if not base:
            return
        keys = np.unique(np.concatenate(keys))
        blocks, ids = keys // n_terms, keys % n_terms
        sums = np.bincount(blocks, self.most[ids], base + 1)
        bases = np.array([b for b, _ in owner])
        could = np.flatnonzero(sums[:-1] + sums[1:] >= self.p.threshold - 1e-9)
        for w, groups in self._reaching(could, blocks, ids):
            lo, hi = np.searchsorted(blocks, (w, w + 2))
            found = self.search(np.unique(ids[lo:hi]).tolist(), groups)
            if not found:
                continue
            n = int(np.searchsorted(bases, w, "right")) - 1
            first = max(0, int(w - bases[n])) * stride
            passage = shingles_of_lengths(texts[n][first : first + 2 * stride])
            for item, score in found:
                q, a = passage(self.questions[item]), passage(self.answers[item])
                if (q >= self.p.overlap and not a < self.p.overlap) or passage(self.wholes[item]) >= self.p.overlap:
                    yield n, item, first, score / self.scale[item], q, a


def shingles_of_lengths(tokens: list[str]):  # noqa: ANN201
    """A function that gives the share of some shingles, all of one length, that occur among the tokens; nan for none."""
    made: dict[int, set] = {}

    def share(wanted: set[tuple[str, ...]]) -> float:
        if not wanted:
            return math.nan
        k = len(next(iter(wanted)))
        if k not in made:
            made[k] = {tuple(tokens[i : i + k]) for i in range(len(tokens) - k + 1)}
        return len(wanted & made[k]) / len(wanted)

    return share


def build_indexes(items: DataFrame, p: DecontaminationParams) -> Iterator[list[ItemIndex]]:
    """Parts of the index of (item_id, text), one by one; in each, an index for each class of length."""
    rows = items.select("item_id", "text").where(F.col("text").rlike(r"(?U)\w"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n_parts = max(1, -(-chars // p.part_chars))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1)
    n_items, total = rows.agg(F.count("*"), F.sum(F.size(words))).first()
    every_df = rows.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").count() if n_parts > 1 else None
    for k in range(n_parts):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == k) if n_parts > 1 else rows
        some = sorted((r["item_id"], r["text"]) for r in part.collect() if terms(r["text"]))
        if not some:
            continue
        df = Counter(t for _, text in some for t in set(terms(text)))
        if every_df is not None:
            own = items.sparkSession.createDataFrame([(t,) for t in df], "term string")
            df.update({r["term"]: r["count"] - df[r["term"]] for r in every_df.join(own, "term").collect()})
        classes: dict[int, list] = {}
        for i, text in some:
            classes.setdefault(max(3, math.ceil(math.log(len(terms(text)), 4))), []).append((i, text))
        yield [ItemIndex(sorted(x, key=lambda y: len(terms(y[1]))), df, n_items, max(1.0, (total or 0) / max(1, n_items)), p) for x in classes.values()]


_HITS = "item_id long, first_word long, bm25 double, question_overlap double, answer_overlap double"


def find_contamination(docs: DataFrame, items: DataFrame, p: DecontaminationParams | None = None) -> DataFrame:
    """doc_id, item_id, first_word, bm25, question_overlap, answer_overlap (null without an answer): a row for each text and item in it.

    Of several passages that hold the item, the row tells of the one with the largest score, the first of equals.
    """
    p = p or DecontaminationParams()
    spark, out = docs.sparkSession, None
    kept = docs.select("doc_id", "text")
    for indexes in build_indexes(items, p):
        sent = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in text_slices(batches, 1):
                texts = [terms(t.as_py()) for t in batch.column(1)]
                best: dict[tuple[int, int, int], tuple] = {}
                for n_index, index in enumerate(sent.value):
                    for n, item, first, score, q, a in index.hits(texts):
                        key = (n, n_index, item)
                        if key not in best or (-score, first) < best[key][:2]:
                            best[key] = (-score, first, index.ids[item], q, None if math.isnan(a) else a)
                if best:
                    at = pa.array([k[0] for k in best], pa.int64())
                    rows = [pa.array([x[2] for x in best.values()], pa.int64()), pa.array([x[1] for x in best.values()], pa.int64()), pa.array([-x[0] for x in best.values()], pa.float64())]
                    rows += [pa.array([x[k] for x in best.values()], pa.float64()) for k in (3, 4)]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *rows], names=["doc_id", "item_id", "first_word", "bm25", "question_overlap", "answer_overlap"])

        found = kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, {_HITS}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return kept.select("doc_id", *(F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _HITS.split(", "))).where(F.lit(False))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, p: DecontaminationParams | None = None) -> DataFrame:
    """The rows in which no item is found; all columns stay."""
    p = p or DecontaminationParams()
    at, rows = docs.columns.index("text"), plainly_named(docs, "text")
    for indexes in build_indexes(items, p):
        sent = docs.sparkSession.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in text_slices(batches, at):
                texts = [terms(t.as_py()) for t in batch.column(at)]
                clean = np.ones(len(texts), bool)
                for index in sent.value:
                    clean[[x[0] for x in index.hits(texts)]] = False
                yield batch.filter(pa.array(clean))

        rows = rows.mapInArrow(run, rows.schema)
    return named_again(rows, docs, "text")
