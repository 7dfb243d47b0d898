"""Quality classification from trusted positives and unlabelled text, by non-negative positive-unlabelled learning.

Each text gives measures of its form: lengths, shares of kinds of characters and words, repetition.  A linear model over them (each
with a clipped standard score and what goes beyond one deviation) minimises the non-negative unbiased risk
`prior * P[loss(+)] + max(0, U[loss(-)] - prior * P[loss(-)])` with the logistic loss; positives are rows labelled 1, unlabelled
rows are all of the corpus outside the held fold.  Rows labelled 0 are not used.  The class prior comes from a classifier of positives
against unlabelled rows: where only positives lie, its odds are 1 to the prior, so the prior is one over the median of the positives' odds.

The fit takes bounded samples (`most_rows` of each kind) of rows outside the held fold; measures and scores are of all rows and whole
texts.  Null and empty texts have measures of 0 and get a score as any other.  Of several labels of an id the smallest counts, null
ones don't.  Without a positive every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import WORD, fold, small_or_plain, staged, with_row_id


@dataclass(frozen=True)
class QualityParams:
    folds: int = 3
    held_fold: int = 1
    #: Positive rows, and unlabelled rows, of the sample for the fit, about and at most.
    most_rows: int = 20_000
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4


MEASURES = (
    "log_words", "log_chars", "word_length", "upper", "digit", "mark", "symbol", "bare_words", "tailed_words", "exclamations",
    "distinct_words", "same_as_last", "seen_lately", "log_lines", "distinct_lines", "short_words", "sentence_length", "top_word", "repeated_triples", "not_ascii",
)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """1 capital, 2 other letter, 3 digit, 4 space, 5 ordinary mark, 6 other; by code point."""
    out = np.full(0x110000, 6, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isupper():
            out[c] = 1
        elif x.isalpha():
            out[c] = 2
        elif x.isdigit():
            out[c] = 3
        elif x.isspace():
            out[c] = 4
    out[[ord(x) for x in ".,;:'\"?!-()"]] = 5
    return out


def measures(text: str | None) -> np.ndarray:
    out = np.zeros(len(MEASURES))
    tokens = WORD.findall(text) if text else []
    if not tokens:
        return out
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kinds = _kinds()[points]
    n = np.bincount(kinds, minlength=7)
    letters, seen, words = n[1] + n[2], max(1, len(points) - n[4]), len(tokens)
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(t, len(ids)) for t in tokens])
    lines = [y for y in text.split("\n") if y]
    lately = np.zeros(words, bool)
    for k in range(1, min(17, words)):
        lately[k:] |= x[k:] == x[:-k]
    if len(ids) < 2_000_000:
        triples = (x[:-2] * len(ids) + x[1:-1]) * len(ids) + x[2:]
    else:  # a product of 64 bits would not hold them: mixed by two odd factors
        triples = (x[:-2] * 0x1E3779B97F4A7C15 + x[1:-1]) * 0x1B873593CC9E2D51 + x[2:]
    ends = np.count_nonzero((points == 46) | (points == 63))
    flat = kinds.view()
    # A word's last character lies before a space or the end of the text.
    last = np.flatnonzero((flat != 4) & np.append(flat[1:] == 4, True))
    out[:] = (
        math.log1p(words), math.log1p(len(points)), min(40.0, seen / words), n[1] / max(1, letters), n[3] / seen, n[5] / seen, n[6] / seen,
        sum(1 for t in ids if not t[0].isalnum() and len(t) == 1) and sum(1 for t in tokens if len(t) == 1 and not t.isalnum()) / words,
        np.count_nonzero(flat[last] == 6) / max(1, len(last)), np.count_nonzero(points == 33) / words,
        len(ids) / words, np.count_nonzero(x[1:] == x[:-1]) / words, np.count_nonzero(lately) / words, math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)),
        sum(1 for t in tokens if len(t) <= 3) / words, math.log1p(words / (ends + 1)), np.bincount(x).max() / words, 1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0, np.count_nonzero(points > 127) / seen,
    )
    return out


def _measured(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [measures(t.as_py()).astype(np.float32) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(m, pa.list_(pa.float32()))], names=["rid", "doc_id", "held_out", "measures"])

    return rows.select("rid", "doc_id", "held_out", "text").mapInArrow(run, f"rid long, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, measures array<float>")


@dataclass
class PuModel:
    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray

    def inputs(self, m: np.ndarray) -> np.ndarray:
        z = np.clip((m - self.mean) / self.deviation, -5, 5)
        return np.hstack([z, np.maximum(z - 1, 0), np.maximum(-z - 1, 0), np.ones((len(m), 1))])

    def score(self, m: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(m) @ self.weights, -35, 35)))


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -35, 35)))


def non_negative_risk(f_p: np.ndarray, f_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk of positives, and that of negatives before it is cut at 0, with the logistic loss."""
    soft = lambda f: np.logaddexp(0, f)
    return prior * float(soft(-f_p).mean()), float(soft(f_u).mean()) - prior * float(soft(f_p).mean())


def _adam(gradient, size: int, p: QualityParams) -> np.ndarray:  # noqa: ANN001
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, p.steps + 1):
        g = gradient(w) + p.decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - p.rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def class_prior(x_p: np.ndarray, x_u: np.ndarray, p: QualityParams) -> float:
    """The share of positives among unlabelled inputs, between 0.05 and 0.95."""
    w = _adam(lambda w: x_p.T @ (_sigmoid(x_p @ w) - 1) / len(x_p) + x_u.T @ _sigmoid(x_u @ w) / len(x_u), x_p.shape[1], p)
    return float(np.clip(1 / np.median(np.exp(np.clip(x_p @ w, -10, 10))), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, p: QualityParams) -> PuModel:
    mean, deviation = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6
    model = PuModel(mean, deviation, np.zeros(0))
    x_p, x_u = model.inputs(positive), model.inputs(unlabelled)
    prior = class_prior(x_p, x_u, p)

    def gradient(w: np.ndarray) -> np.ndarray:
        f_p, f_u = x_p @ w, x_u @ w
        s_p, s_u = _sigmoid(f_p), _sigmoid(f_u)
        up = prior * (x_p.T @ (s_p - 1)) / len(x_p)
        down = x_u.T @ s_u / len(x_u) - prior * (x_p.T @ s_p) / len(x_p)
        return up + down if non_negative_risk(f_p, f_u, prior)[1] >= 0 else -down

    model.weights = _adam(gradient, x_p.shape[1], p)
    return model


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Measures of about `most` rows and no more, chosen by a hash of id and measures and so the same however files are split; all of them if there are no more."""
    n = rows.count()
    rows = rows.select(F.xxhash64("doc_id", "measures").alias("key"), "measures")
    share = F.pmod("key", F.lit(1 << 40)) / F.lit(float(1 << 40))
    some = rows.where(share < 0.97 * most / n) if n > most else rows
    return np.array([r["measures"] for r in some.orderBy("key", "measures").limit(most).collect()], float).reshape(-1, len(MEASURES))


def score_quality(docs: DataFrame, labels: DataFrame, p: QualityParams | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels are rows of (doc_id, quality)."""
    p = p or QualityParams()
    rows = with_row_id(docs.select("doc_id", "text"), "rid").withColumn("held_out", fold("doc_id", p.folds) == p.held_fold)
    measured = staged(_measured(rows))
    known = staged(labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id"))
    learned = measured.where(~F.col("held_out"))
    positive = _sample(learned.join(small_or_plain(known, 500_000), "doc_id", "left_semi"), p.most_rows)
    model = fit(positive, _sample(learned, p.most_rows), p) if len(positive) else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.array(batch.column(2).to_pylist(), float).reshape(-1, len(MEASURES))
            score = sent.value.score(m) if sent.value else np.full(len(m), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kept = measured.select("doc_id", "held_out", "measures")
    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
