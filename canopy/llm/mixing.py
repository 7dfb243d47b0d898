"""Mixing to target weights by iterative proportional fitting, and sampling by calibrated probabilities.

Tokens are summed over cells of source, language and topic.  Raking scales the cells in turn so that each margin meets its
target share, until no factor differs from 1 by more than the tolerance.  A text's weight is its cell's raked tokens over
its cell's tokens, and it is kept with probability `rate * weight` by a hash of its id.  For a sample no weight may pass `1 / rate`:
raking then cuts cells at that in each step, and the steps after make up for the cut in other cells.  A value whose target is more
than all of its tokens gets all, and the others of its dimension share the rest by their targets; `margins` tells which these are.
Up to `small` cells, a checked number, are raked in one numpy array; more are raked by joins.

Targets are shares by value; without any, a margin's target is its own shares raised to `temper` and scaled to 1.  Values that no
target names keep their tempered share of what the named ones leave.  Shares below 0, or over 1 in sum, are an error; a named value
without tokens is warned of, and the shares of the others are scaled to 1.  Margins that can't be met together end after `rounds` as
near as they came, with a warning that tells the largest factor left.

A text's topic is the nearest of `topics` centres of its vector: counts of words of six or more characters, hashed to `buckets`,
damped, scaled to length 1, less the mean of its language (languages beyond the `languages` most frequent share one mean).  The
centres are those of spherical k-means over all texts from fixed random directions.  Texts without such a word share topic -1.
A null source or language is a value of its own.  Null and empty texts have no tokens, weight 1 and so probability `rate`.
Repeated ids share their fate.
"""

from __future__ import annotations

import warnings
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from canopy.llm.common import is_small, named_again, plainly_named, staged, text_slices, tokenise

DIMENSIONS = ("source", "lang", "topic")


@dataclass(frozen=True)
class MixParams:
    topics: int = 8
    #: Size of a text's vector, languages with a mean of their own, and rounds of k-means.
    buckets: int = 256
    languages: int = 64
    topic_rounds: int = 4
    rate: float = 0.8
    #: Powers of the own shares of source, language and topic.
    temper: tuple[float, float, float] = (0.7, 0.7, 0.7)
    #: Target shares by dimension and value; topics are named as text too.
    targets: dict[str, dict[str, float]] = field(default_factory=dict)
    rounds: int = 100
    tolerance: float = 1e-3
    #: Cells, and values of a dimension, up to which their table is sent to all tasks.
    small: int = 100_000
    seed: int = 5


def vectors(column: pa.Array, p: MixParams) -> tuple[np.ndarray, np.ndarray]:
    """For some texts, their hashed word vectors in 127ths, and their numbers of words."""
    found = tokenise(column)
    long = np.asarray(pc.greater_equal(pc.utf8_length(found.words), 6))
    bucket = np.full(len(long), -1)
    bucket[long] = [zlib.crc32(w) % p.buckets for w in found.words.filter(pa.array(long)).cast(pa.binary()).to_pylist()]
    own = bucket[found.ids]
    owner = np.repeat(np.arange(len(found.sizes)), found.sizes)[own >= 0]
    counts = np.bincount(owner * p.buckets + own[own >= 0], minlength=len(found.sizes) * p.buckets).reshape(-1, p.buckets)
    damped = np.sqrt(counts)
    lengths = np.linalg.norm(damped, axis=1, keepdims=True)
    return np.rint(127 * damped / np.maximum(lengths, 1e-9)).astype(np.int8), found.sizes


def _with_vectors(docs: DataFrame, p: MixParams) -> DataFrame:
    """The rows with __mix_n_tokens, __mix_vector and the keys of their source and language."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at, 8_000_000):
            made, sizes = vectors(batch.column(at), p)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), pa.array([v.tobytes() for v in made], pa.binary())], names=[*batch.schema.names, "__mix_n_tokens", "__mix_vector"])

    schema = StructType([*docs.schema.fields, StructField("__mix_n_tokens", LongType()), StructField("__mix_vector", BinaryType())])
    return docs.mapInArrow(run, schema).withColumns({"__mix_k0": _key("source"), "__mix_k1": _key("lang")})


@dataclass(frozen=True)
class TopicModel:
    means: dict[str, np.ndarray]
    other: np.ndarray
    centres: np.ndarray

    def unit(self, raw: list[bytes], langs: list[str]) -> np.ndarray:
        """Vectors less their languages' means, at length 1; zero for texts without a vector."""
        x = np.frombuffer(b"".join(raw), np.int8).reshape(-1, self.centres.shape[1]).astype(np.float32)
        some = x.any(axis=1)
        x = x - np.array([self.means.get(k, self.other) for k in langs], np.float32).reshape(x.shape)
        return np.where(some[:, None], x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6), 0)

    def topics(self, raw: list[bytes], langs: list[str]) -> np.ndarray:
        x = self.unit(raw, langs)
        return np.where(x.any(axis=1), (x @ self.centres.T).argmax(axis=1), -1)


def _summed(rows: DataFrame, one) -> dict:  # noqa: ANN001
    """Sums by key of (key, values) that `one` makes of a batch's vectors and languages; values in fixed point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for key, x in one(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[key] = sums.get(key, 0) + np.rint(np.asarray(x, np.float64) * 2**16).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["key", "x"])

    parts = rows.select("__mix_vector", "__mix_k1").mapInArrow(run, "key string, x array<bigint>").select("key", F.posexplode("x").alias("i", "x"))
    out: dict[str, list] = {}
    for r in parts.groupBy("key", "i").agg(F.sum("x").alias("x")).orderBy("key", "i").collect():
        out.setdefault(r["key"], []).append(r["x"] / 2**16)
    return {k: np.array(x) for k, x in out.items()}


def learn_topics(rows: DataFrame, p: MixParams) -> TopicModel:
    """Means of languages and centres of topics, over all rows with vectors; sums are exact, so the order of rows doesn't matter."""
    most = rows.groupBy("__mix_k1").count().orderBy(F.desc("count"), "__mix_k1").limit(p.languages).collect()
    own = [r[0] for r in most]

    def by_language(raw: list[bytes], langs: list[str]):  # noqa: ANN202
        x = np.frombuffer(b"".join(raw), np.int8).reshape(-1, p.buckets).astype(np.int64)
        some, names = x.any(axis=1), np.array([k if k in own else "" for k in langs], object)
        for k in set(names[some]):
            at = some & (names == k)
            yield k, [*x[at].sum(axis=0), at.sum()]

    sums = _summed(rows, by_language)
    means = {k: x[:-1] / x[-1] for k, x in sums.items()}
    centres = np.random.default_rng(p.seed).normal(size=(p.topics, p.buckets))
    model = TopicModel(means, means.get("", np.zeros(p.buckets)), (centres / np.linalg.norm(centres, axis=1, keepdims=True)).astype(np.float32))
    for _ in range(p.topic_rounds):

        def by_topic(raw: list[bytes], langs: list[str], model=model):  # noqa: ANN001, ANN202
            x = model.unit(raw, langs)
            topics = np.where(x.any(axis=1), (x @ model.centres.T).argmax(axis=1), -1)
            for k in set(topics[topics >= 0].tolist()):
                yield str(k), x[topics == k].sum(axis=0)

        found = _summed(rows, by_topic)
        centres = np.array([found.get(str(k), model.centres[k]) for k in range(p.topics)])
        lengths = np.linalg.norm(centres, axis=1, keepdims=True)
        model = TopicModel(means, model.other, np.where(lengths > 1e-6, centres / np.maximum(lengths, 1e-6), model.centres).astype(np.float32))
    return model


def _with_topics(rows: DataFrame, p: MixParams) -> DataFrame:
    """The staged rows with __mix_topic and its key."""
    sent = rows.sparkSession.sparkContext.broadcast(learn_topics(rows, p))

    @F.pandas_udf("int")
    def topic(vector: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series(sent.value.topics(vector.tolist(), lang.tolist()), dtype="int32")

    return rows.withColumn("__mix_topic", topic("__mix_vector", "__mix_k1")).withColumn("__mix_k2", _key("__mix_topic")).drop("__mix_vector")


def _key(column: str) -> Column:
    """A value as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def _named(dimension: int, p: MixParams) -> dict[str, float]:
    named = {f"={k}": float(v) for k, v in p.targets.get(DIMENSIONS[dimension], {}).items()}
    if any(not 0 <= v <= 1 for v in named.values()) or sum(named.values()) > 1 + 1e-9:
        raise ValueError(f"target shares of {DIMENSIONS[dimension]} must be 0 or more, and 1 or less in sum: {named}")
    return named


def _target_shares(margin: DataFrame, dimension: int, p: MixParams) -> DataFrame:
    """key, tokens, share: the target of each value of a margin (key, tokens)."""
    named = _named(dimension, p)
    power = F.pow(F.col("tokens").cast("double"), F.lit(p.temper[dimension]))
    if not named:
        total = margin.agg(F.sum(power)).first()[0] or 1.0
        return margin.select("key", "tokens", (power / total).alias("share"))
    found = {r[0] for r in margin.where(F.col("key").isin(list(named)) & (F.col("tokens") > 0)).select("key").collect()}
    if missing := sorted(set(named) - found):
        warnings.warn(f"{DIMENSIONS[dimension]}: no tokens for {missing}; the other shares are scaled to 1", stacklevel=2)
    given = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))[F.col("key")]
    rest = max(0.0, 1 - sum(named.values()))
    others = margin.where(given.isNull()).agg(F.sum(power)).first()[0] or 1.0
    shares = margin.select("key", "tokens", F.coalesce(given, power / others * rest).alias("share"))
    total = shares.agg(F.sum("share")).first()[0] or 1.0
    return shares.withColumn("share", F.col("share") / total)


def _margin_shares(cells: DataFrame, dimension: int, p: MixParams) -> DataFrame:
    return _target_shares(cells.groupBy(F.col(f"k{dimension}").alias("key")).agg(F.sum("tokens").alias("tokens")), dimension, p)


def _reachable(margin: DataFrame, most: float) -> DataFrame:
    """key, tokens, target, share: of (key, tokens, share), shares that `most` times the tokens allow; what some can't get goes to the others."""
    tokens, target = margin.agg(F.sum("tokens"), F.sum("share")).first()
    if not tokens:
        return margin.select("key", "tokens", F.col("share").alias("target"), "share")
    limit, scale = F.col("tokens") * (most / tokens), 1.0
    while True:
        full = F.col("share") * scale >= limit
        taken, left = margin.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("share")))).first()
        new = (target - (taken or 0.0)) / left if left else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return margin.select("key", "tokens", F.col("share").alias("target"), F.least(limit, F.col("share") * scale).alias("share"))


def rake(cells: DataFrame, p: MixParams | None = None, most: float | None = None) -> DataFrame:
    """k0, k1, k2, tokens, weight: cells of (k0, k1, k2, tokens), tokens over 0, with raked tokens as a multiple of their own, `most` at most."""
    p = p or MixParams()
    cells = staged(cells.where("tokens > 0").groupBy("k0", "k1", "k2").agg(F.sum("tokens").cast("double").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    margins = []
    for d in range(3):
        margin = staged(_margin_shares(cells, d, p))
        margin = margin if most is None else staged(_reachable(margin, most))
        margin = margin.select("key", "share")
        margins.append((margin, margin.count() <= p.small))
    if is_small(cells, p.small):
        return _rake_array(cells, [m.collect() for m, _ in margins], total, p, most)
    raked, off = cells.withColumn("raked", F.col("tokens")), 0.0
    for _ in range(p.rounds):
        raked = raked.withColumn("off", F.lit(0.0))
        for d, (margin, small) in enumerate(margins):
            sums = raked.groupBy(F.col(f"k{d}").alias("key")).agg(F.sum("raked").alias("now")).join(margin, "key")
            factor = sums.select("key", F.when(F.col("now") > 0, F.col("share") * total / F.col("now")).otherwise(0.0).alias("factor"))
            raked = raked.join(F.broadcast(factor) if small else factor, F.col(f"k{d}") == F.col("key"))
            new = F.col("raked") * F.col("factor")
            new = new if most is None else F.least(new, F.col("tokens") * most)
            raked = raked.select("k0", "k1", "k2", "tokens", new.alias("raked"), F.greatest("off", F.abs(F.col("factor") - 1)).alias("off"))
        raked = staged(raked)
        off = raked.agg(F.max("off")).first()[0] or 0.0
        if off <= p.tolerance:
            break
    _tell(off, p)
    return raked.select("k0", "k1", "k2", "tokens", (F.col("raked") / F.col("tokens")).alias("weight"))


def _tell(off: float, p: MixParams) -> None:
    if off > p.tolerance:
        warnings.warn(f"raking ended after {p.rounds} rounds with a factor that differs from 1 by {off:.3g}", stacklevel=3)


def _rake_array(cells: DataFrame, margins: list[list], total: float, p: MixParams, most: float | None) -> DataFrame:
    """The same rounds over a table of few cells, a checked number, as one array."""
    schema = "k0 string, k1 string, k2 string, tokens double, weight double"
    own = cells.orderBy("k0", "k1", "k2").toPandas()
    if own.empty:
        return cells.sparkSession.createDataFrame([], schema)
    tokens = own["tokens"].to_numpy(float)
    raked, off = tokens.copy(), 0.0
    codes, shares = [], []
    for d, margin in enumerate(margins):
        share = {r["key"]: r["share"] for r in margin}
        code, keys = pd.factorize(own[f"k{d}"])
        codes.append(code)
        shares.append(np.array([share[k] for k in keys]))
    for _ in range(p.rounds):
        off = 0.0
        for code, share in zip(codes, shares, strict=True):
            now = np.bincount(code, raked, len(share))
            factor = np.where(now > 0, share * total / np.maximum(now, 1e-300), 0.0)
            raked = raked * factor[code]
            if most is not None:
                raked = np.minimum(raked, tokens * most)
            off = max(off, float(np.abs(factor - 1).max()))
        if off <= p.tolerance:
            break
    _tell(off, p)
    return cells.sparkSession.createDataFrame(own.assign(weight=raked / tokens)[["k0", "k1", "k2", "tokens", "weight"]], schema)


def _keyed(docs: DataFrame, p: MixParams) -> DataFrame:
    """The rows, staged once, with topic, tokens and the keys of their cells."""
    return _with_topics(staged(_with_vectors(docs, p)), p)


def _slim(docs: DataFrame, p: MixParams) -> DataFrame:
    """The same without the texts."""
    return _with_topics(staged(_with_vectors(docs.select("doc_id", "source", "lang", "text"), p).drop("text")), p)


def mix(docs: DataFrame, p: MixParams | None = None) -> DataFrame:
    """The rows with __mix_topic, __mix_n_tokens, __mix_weight, __mix_probability and __mix_selected."""
    p = p or MixParams()
    return _weighed(_keyed(docs, p), p)


def _weighed(keyed: DataFrame, p: MixParams) -> DataFrame:
    """Weights, probabilities and draws for keyed rows; they are read twice."""
    cells = keyed.groupBy(*(F.col(f"__mix_k{d}").alias(f"k{d}") for d in range(3))).agg(F.sum("__mix_n_tokens").alias("tokens"))
    raked = staged(rake(cells, p, 1 / p.rate).select(F.col("k0").alias("__mix_k0"), F.col("k1").alias("__mix_k1"), F.col("k2").alias("__mix_k2"), F.col("weight").alias("__mix_weight")))
    if raked.count() <= p.small:
        raked = F.broadcast(raked)
    draw = F.pmod(F.xxhash64(F.lit(p.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 53)) / F.lit(float(1 << 53))
    weight = F.when(F.col("__mix_n_tokens") > 0, F.coalesce("__mix_weight", F.lit(1.0))).otherwise(1.0)
    chance = F.least(F.lit(1.0), F.lit(p.rate) * F.col("__mix_weight"))  # more than 1 by rounding only
    return (
        keyed.join(raked, ["__mix_k0", "__mix_k1", "__mix_k2"], "left")
        .withColumn("__mix_weight", weight)
        .withColumn("__mix_probability", chance)
        .withColumn("__mix_selected", draw < F.col("__mix_probability"))
        .drop("__mix_k0", "__mix_k1", "__mix_k2")
    )


def mixed_documents(docs: DataFrame, p: MixParams | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, selected for each row."""
    p = p or MixParams()
    made = _weighed(_slim(docs, p), p)
    return made.select("doc_id", "source", "lang", *(F.col(f"__mix_{c}").alias(c) for c in ("topic", "n_tokens", "weight", "probability", "selected")))


def margins(docs: DataFrame, p: MixParams | None = None) -> DataFrame:
    """dimension, key, tokens, target, reachable, expected: for each value its target share, the share its tokens allow and the kept tokens' expected share.

    A target can't be met at this rate where reachable is less; the rate at which it can is tokens / (all tokens * target).
    """
    p = p or MixParams()
    made = staged(_weighed(_slim(docs, p), p))
    made = made.where("__mix_n_tokens > 0").withColumns({"k0": _key("source"), "k1": _key("lang"), "k2": _key("__mix_topic"), "tokens": F.col("__mix_n_tokens").cast("double")})
    kept, out = F.sum(F.col("tokens") * F.col("__mix_probability")), None
    total = made.agg(kept).first()[0] or 1.0
    for d, name in enumerate(DIMENSIONS):
        expected = made.groupBy(F.col(f"k{d}").alias("key")).agg((kept / total).alias("expected"))
        found = _reachable(staged(_margin_shares(made, d, p)), 1 / p.rate).join(expected, "key")
        found = found.select(F.lit(name).alias("dimension"), "key", "tokens", "target", F.col("share").alias("reachable"), "expected")
        out = found if out is None else out.unionByName(found)
    return out


def sample_documents(docs: DataFrame, p: MixParams | None = None) -> DataFrame:
    """The selected rows; all columns stay."""
    needed = ("doc_id", "source", "lang", "text")
    return named_again(mix(plainly_named(docs, *needed), p).where("__mix_selected"), docs, *needed)
