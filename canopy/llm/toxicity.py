"""Toxicity by weak supervision: many voters, a generative label model over their votes, a linear classifier on its posteriors.

Voters are word lists (fixed ones by kind and language, and words and word beginnings that labelled toxic rows hold far more often
than clean ones, dealt over several voters) and patterns.  A voter says toxic, says clean, or abstains.  The label model is a tree
for either class: each voter's votes have shares that depend on the class and on the votes of the voter it goes along with most
beyond what the classes explain.  These shares, accuracies and correlations alike, are fitted by expectation-maximisation over the votes of
all texts, with labelled rows outside the held fold as anchors.  A logistic model over votes and counts of hits learns the posteriors
of a bounded sample and scores all texts.

Null and empty texts have no hits and get a score as any other.  Of several labels of an id the largest counts, null ones don't.
Without labels the fixed lists and patterns vote alone.  Rows are scored one by one, so repeated rows get repeated results; equal
texts have equal scores.  Of words that tell as much, the one that sorts first is learned.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import fold, small_or_plain, staged, with_row_id

TERM = re.compile(r"\w+")

# Words that voters take as insults, by kind and language.
LISTS = {
    "mind": ("idiot", "idiots", "stupid", "moron", "morons", "fool", "fools", "dumb", "imbecile", "lunatic", "dimwit", "halfwit", "braindead", "retard"),
    "person": ("loser", "losers", "clown", "jerk", "coward", "liar", "creep", "bastard", "scumbag", "freak", "weirdo", "hypocrite"),
    "contempt": ("trash", "scum", "pathetic", "worthless", "disgusting", "filth", "filthy", "vermin", "garbage", "vile", "parasite", "despicable", "subhuman"),
    "rage": ("hate", "hateful", "kill", "destroy", "shut", "burn", "damn", "crap", "sucks"),
    "german": ("dumm", "dummkopf", "trottel", "vollidiot", "arschloch", "abschaum", "dreck", "widerlich", "versager", "feigling"),
    "spanish": ("estúpido", "estúpida", "imbécil", "tonto", "basura", "asqueroso", "escoria", "cobarde", "mentiroso", "inútil"),
    "french": ("stupide", "imbécile", "crétin", "ordure", "dégoûtant", "minable", "lâche", "menteur", "abruti", "racaille"),
}
_ADDRESSED = frozenset(("you", "your", "youre", "dein", "tu", "tus", "usted", "vous", "votre"))


@dataclass(frozen=True)
class ToxicityParams:
    folds: int = 5
    held_fold: int = 0
    #: Words and word beginnings learned, at most, the most telling first.
    learned: int = 600
    prefixes: tuple[int, ...] = (4, 5, 6)
    #: Least number of toxic rows that hold a learned word, whatever the corpus's size.
    least_rows: int = 4
    #: Least odds of a learned word in toxic rows, relative to clean ones.
    least_odds: float = 20.0
    word_voters: int = 4
    prefix_voters: int = 3
    rounds: int = 30
    #: Rows from which the classifier learns, about and at most.
    most_rows: int = 30_000
    #: Prior probability of the class toxic where nothing is labelled.
    prior: float = 0.1


def features(text: str | None, p: ToxicityParams) -> set[str]:
    """Distinct words in lower case, and beginnings of words, marked by a caret."""
    words = set(TERM.findall(text.lower())) if text else set()
    return words | {"^" + w[:k] for w in words for k in p.prefixes if len(w) > k}


def _counted(rows: DataFrame, p: ToxicityParams) -> DataFrame:
    """feature, toxic, clean: in how many texts of (text, toxic) of either class each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def out() -> pa.RecordBatch:
            names = list(counts[0] | counts[1])
            return pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string()), "toxic": pa.array([counts[1][f] for f in names], pa.int64()), "clean": pa.array([counts[0][f] for f in names], pa.int64())})

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[toxic == 1].update(features(text.as_py(), p))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield out()
                    counts[0].clear()
                    counts[1].clear()
        yield out()

    return rows.select("text", "toxic").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(labelled: DataFrame, p: ToxicityParams) -> list[str]:
    """Features that toxic rows of (text, toxic) hold far more often than clean ones, the most telling first."""
    sizes = {r[0]: r[1] for r in labelled.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    told = _counted(labelled, p).where(F.col("toxic") >= p.least_rows).withColumn("odds", odds).where(F.col("odds") >= math.log(p.least_odds))
    return [r["feature"] for r in told.orderBy(F.desc(F.round(F.col("toxic") * F.col("odds"), 9)), "feature").limit(p.learned).collect()]


class Voters:
    """Votes and counts of one text.  Votes: 2 toxic, 1 clean, 0 abstains."""

    def __init__(self, learned: list[str], p: ToxicityParams) -> None:
        self.p = p
        self.word: dict[str, list[int]] = {}
        fixed = len(LISTS)
        for k, lexicon in enumerate(LISTS.values()):
            for w in lexicon:
                self.word.setdefault(w, []).append(k)
        self.prefix: dict[str, list[int]] = {}
        for f in learned:
            if f[0] == "^":
                self.prefix.setdefault(f[1:], []).append(fixed + p.word_voters + zlib.crc32(f.encode()) % p.prefix_voters)
            else:
                self.word.setdefault(f, []).append(fixed + zlib.crc32(f.encode()) % p.word_voters)
        self.lengths = sorted({len(x) for x in self.prefix})

    @property
    def n_lexicons(self) -> int:
        return len(LISTS) + self.p.word_voters + self.p.prefix_voters

    @property
    def n(self) -> int:
        return self.n_lexicons + 6

    def __call__(self, text: str | None) -> tuple[bytes, list[float]]:
        tokens = TERM.findall(text.lower()) if text else []
        votes, hit = bytearray(self.n), {}
        for w, times in Counter(tokens).items():
            said = list(self.word.get(w, ()))
            for k in self.lengths:
                if len(w) > k:
                    said += self.prefix.get(w[:k], ())
            if said:
                hit[w] = times
                for v in said:
                    votes[v] = 2
        kinds, hits = len(hit), sum(hit.values())
        at = self.n_lexicons
        votes[at] = 2 if kinds >= 2 else 0  # several distinct hits
        votes[at + 1] = 1 if kinds == 0 else 0  # no hit at all
        votes[at + 2] = 2 if hits >= 3 and 100 * hits >= len(tokens) else 0  # many hits for its length
        if hit:
            places = [i for i, w in enumerate(tokens) if w in hit]
            votes[at + 3] = 2 if any(a + 1 == b for a, b in zip(places, places[1:], strict=False)) else 0  # one beside the other
            votes[at + 4] = 2 if any(_ADDRESSED.intersection(tokens[max(0, i - 3) : i + 4]) for i in places) else 0  # said to somebody
            votes[at + 5] = 1 if kinds == 1 and 1000 * hits < len(tokens) else 0  # one in very much text
        return bytes(votes), [math.log1p(kinds), math.log1p(hits), 100 * hits / (len(tokens) + 20), float(kinds == 1)]


class LabelModel:
    """Two classes; for each voter, the shares of its three votes by class and by the votes of the voter above it in a tree."""

    def __init__(self, n: int, prior: float) -> None:
        self.prior, self.parent = prior, np.full(n, -1)
        self.shares = np.empty((n, 2, 3, 3))  # voter, class, vote above, vote
        self.shares[:, 0], self.shares[:, 1] = (0.8, 0.17, 0.03), (0.6, 0.05, 0.35)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs, at = np.log(self.shares), np.arange(votes.shape[1])
        above = np.where(self.parent >= 0, votes[:, self.parent], 0)
        told = logs[at, 1, above, votes] - logs[at, 0, above, votes]
        return 1 / (1 + np.exp(-np.clip(math.log(self.prior / (1 - self.prior)) + told.sum(axis=1), -30, 30)))

    def fit(self, votes: np.ndarray, counts: np.ndarray, anchors: np.ndarray, rounds: int, least_bits: float = 1e-4) -> LabelModel:
        """votes: distinct patterns; counts: of texts without a label; anchors: of clean and toxic labelled texts of each."""
        if anchors.sum() > 0 and anchors.sum(axis=0).min() > 0:
            self.prior = float(np.clip(anchors[:, 1].sum() / anchors.sum(), 0.001, 0.999))
            self._learn(votes, anchors[:, 0], anchors[:, 1], math.inf)
        for _ in range(rounds):
            q = self.posterior(votes)
            clean, toxic = counts * (1 - q) + anchors[:, 0], counts * q + anchors[:, 1]
            self._learn(votes, clean, toxic, least_bits)
            self.prior = float(np.clip(toxic.sum() / max(clean.sum() + toxic.sum(), 1e-9), 0.001, 0.999))
        return self

    def _learn(self, votes: np.ndarray, clean: np.ndarray, toxic: np.ndarray, least_bits: float) -> None:
        """The tree of largest information that voters give on each other within the classes, and its shares."""
        n = votes.shape[1]
        said = (votes[:, :, None] == np.arange(3)).reshape(len(votes), 3 * n).astype(float)
        joint = np.stack([(said * w[:, None]).T @ said for w in (clean, toxic)]).reshape(2, n, 3, n, 3).transpose(0, 1, 3, 2, 4)  # class, voter, voter, votes
        p = (joint + 0.05) / (joint + 0.05).sum(axis=(0, 3, 4), keepdims=True)
        y = p.sum(axis=(3, 4), keepdims=True)
        bits = (p * np.log2(p * y / (p.sum(axis=4, keepdims=True) * p.sum(axis=3, keepdims=True)))).sum(axis=(0, 3, 4))
        np.fill_diagonal(bits, 0)
        bits = np.where(bits > least_bits, bits, 0)
        self.parent = np.full(n, -1)
        best, link, inside = np.zeros(n), np.full(n, -1), np.zeros(n, bool)
        for _ in range(n):  # Prim's tree; a voter that goes along with none starts anew
            i = int(np.argmax(np.where(inside, -1.0, best)))
            inside[i], self.parent[i] = True, link[i]
            closer = ~inside & (bits[i] > best)
            best[closer], link[closer] = bits[i][closer], i
        own = joint[:, np.arange(n), np.arange(n)].diagonal(axis1=2, axis2=3)  # class, voter, vote
        for i, above in enumerate(self.parent):
            plain = own[:, i] + 0.5
            plain /= plain.sum(axis=1, keepdims=True)
            table = np.zeros((2, 3, 3)) if above < 0 else joint[:, above, i]
            table = table + 2 * plain[:, None, :]  # what is rare leans on the voter's own shares
            self.shares[i] = table / table.sum(axis=2, keepdims=True)


def inputs(votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.hstack([votes == 2, votes == 1, counts, np.ones((len(votes), 1))]).astype(float)


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 25, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression on labels between 0 and 1, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x / len(x) + decay * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (q - y) / len(x) + decay * w)
    return w


def _voted(rows: DataFrame, learned: list[str], p: ToxicityParams) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(sent.value, p)
        for batch in batches:
            said = [voters(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([v for v, _ in said], pa.binary()), pa.array([c for _, c in said], pa.list_(pa.float64()))], names=["rid", "doc_id", "held_out", "votes", "counts"])

    return rows.select("rid", "doc_id", "held_out", "text").mapInArrow(run, f"rid long, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, votes binary, counts array<double>")


def score_toxicity(docs: DataFrame, labels: DataFrame, p: ToxicityParams | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels are rows of (doc_id, toxic)."""
    p = p or ToxicityParams()
    rows = with_row_id(docs.select("doc_id", "text"), "rid").withColumn("held_out", fold("doc_id", p.folds) == p.held_fold)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = small_or_plain(staged(known), 500_000)
    learned = learn_lexicon(rows.where(~F.col("held_out")).join(known, "doc_id").select("text", "toxic"), p)
    voted = staged(_voted(rows, learned, p))
    anchored = voted.join(known, "doc_id", "left").withColumn("anchor", F.when(~F.col("held_out"), F.col("toxic")))
    patterns = anchored.groupBy("votes").agg(F.count(F.when(F.col("anchor").isNull(), 1)), F.count(F.when(F.col("anchor") == 0, 1)), F.count(F.when(F.col("anchor") == 1, 1))).collect()
    patterns.sort(key=lambda r: bytes(r["votes"]))
    n = Voters([], p).n
    votes = np.array([list(r["votes"]) for r in patterns], int).reshape(-1, n)
    counts = np.array([r[1:] for r in patterns], float).reshape(-1, 3)
    model = LabelModel(n, p.prior).fit(votes, counts[:, 0], counts[:, 1:], p.rounds)
    total = counts.sum()
    # By a hash of id and content, so the same rows however files are split; repeated rows share their hash, hence the limit.
    keyed = voted.select(F.xxhash64("doc_id", "votes", "counts").alias("key"), "votes", "counts")
    share = F.pmod("key", F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = (keyed.where(share < 0.97 * p.most_rows / total) if total > p.most_rows else keyed).orderBy("key", "votes", "counts").limit(p.most_rows).collect()
    own = np.array([list(r["votes"]) for r in some], int).reshape(-1, n)
    weights = fit_linear(inputs(own, np.array([r["counts"] for r in some], float).reshape(-1, 4)), model.posterior(own)) if some else np.zeros(2 * n + 5)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array([list(x) for x in batch.column(2).to_pylist()], int).reshape(-1, n)
            x = inputs(v, np.array(batch.column(3).to_pylist(), float).reshape(-1, 4))
            score = 1 / (1 + np.exp(-np.clip(x @ sent.value, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kept = voted.select("doc_id", "held_out", "votes", "counts")
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
