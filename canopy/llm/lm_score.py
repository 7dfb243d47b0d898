"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

The model predicts word classes: the most frequent words are classes of their own, all other words share classes by their
last two letters.  Two context words give a predicted vector, its product with a class vector plus a bias is the class's
score, and the softmax over all classes normalises it.  Within a shared class a word has its smoothed relative count, so
probabilities over known words and one unknown word in each class sum to 1.

Every training text is counted, and every training text is trained on once: partitions train from the same parameters in
numpy, their results are averaged by Spark, and the next round starts from the average.

Null and empty texts hold the end token only.  With no training rows every count is 0 and scores stay finite.  Rows are
scored one by one, so repeated rows and repeated ids give repeated results; a null id counts as the empty text for the fold.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import binaries, fold, from_binaries, staged, sums_by, text_slices, tokenise

END = "\n"  # never a word, as words hold no white space
#: A text's id has 24 bits for its partition, so many for the chunk in it, and so many for the text, of which each takes 4 bytes of a chunk at least.
CHUNK_BITS, TEXT_BITS = 17, 22


@dataclass(frozen=True)
class LmParams:
    folds: int = 10
    held_fold: int = 0
    #: Words with a class of their own, at most; classes shared by last letters.
    own_classes: int = 512
    shared_classes: int = 128
    #: Words whose counts are sent to all tasks, at most; the counts of the others are joined.
    dictionary: int = 131_072
    #: Bytes of text that are cut into words together, about.
    chunk: int = 16_000_000
    width: int = 24
    noise: int = 64
    batch: int = 4096
    rounds: int = 2
    rate: float = 0.15
    seed: int = 7
    #: Models that are averaged in one group, at most.
    fan_in: int = 64


@dataclass(frozen=True)
class Vocabulary:
    """Dictionary words with counts and classes.  Classes: own words, then shared ones, then the start of a text."""

    words: pa.StringArray
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    n_own: int
    n_shared: int
    n_tokens: int
    n_words: int

    @property
    def start(self) -> int:
        return self.n_own + self.n_shared

    def log_within(self) -> np.ndarray:
        """For each class, log10 of what a count + 0.1 is divided by within it; 0 for a word's own class."""
        out = np.zeros(self.start)
        shared = slice(self.n_own, self.start)
        out[shared] = np.log10(self.class_tokens[shared] + 0.1 * (self.class_words[shared] + 1))
        return out


def shared_class(word: str, n: int) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "replace")) % n


def _chunked(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in text_slices(batches, "text", most_bytes):
        if held and size + batch.column("text").nbytes > most_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += batch.column("text").nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _listed(values: pa.Array) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def split_texts(rows: DataFrame, p: LmParams) -> DataFrame:
    """Texts of (doc_id, held_out, text) as numbers of words, many texts in a row, with the words and their counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << CHUNK_BITS
        for k, batch in enumerate(_chunked(batches, p.chunk)):
            held = batch.column("held_out").to_numpy(zero_copy_only=False)
            found = tokenise(batch.column("text"))
            n = np.bincount(found.ids[np.repeat(~held, found.sizes)], minlength=len(found.words))
            made = {"chunk": [first + k], "doc_id": _listed(batch.column("doc_id")), "held_out": _listed(batch.column("held_out")), "sizes": [found.sizes.astype(np.int32).tobytes()]}
            yield pa.RecordBatch.from_pydict(made | {"ids": [found.ids.tobytes()], "words": _listed(found.words), "n": _listed(pa.array(n, pa.int64()))})

    schema = f"chunk long, doc_id array<{dict(rows.dtypes)['doc_id']}>, held_out array<boolean>, sizes binary, ids binary, words array<string>, n array<bigint>"
    return rows.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def count_tokens(chunks: DataFrame) -> DataFrame:
    """token, n over the training texts of split texts; the end token counts once a text."""
    words = chunks.select(F.inline(F.arrays_zip("words", "n"))).where("n > 0").select(F.col("words").alias("token"), "n")
    ends = chunks.select(F.lit(END).alias("token"), F.size(F.filter("held_out", lambda x: ~x)).cast("long").alias("n")).where("n > 0")
    return words.unionByName(ends).groupBy("token").agg(F.sum("n").alias("n"))


def build_vocabulary(counts: DataFrame, p: LmParams) -> tuple[Vocabulary, float]:
    """Takes the most frequent words into the dictionary, by a least count that keeps it within its size.

    Returns that least count too: words below it are looked up by a join.
    """
    level = F.floor(F.log2("n") * 16)
    by_level = {r[0]: (r[1], r[2]) for r in counts.groupBy(level.alias("level")).agg(F.count("*"), F.sum("n")).collect()}
    n_words, n_tokens = (sum(x[i] for x in by_level.values()) for i in (0, 1))
    taken, least = 0, math.inf
    for k in sorted(by_level, reverse=True):
        taken += by_level[k][0]
        if taken > p.dictionary:
            break
        least = k
    top = counts.where(level >= least).toPandas().sort_values(["n", "token"], ascending=[False, True]) if least < math.inf else None
    tokens, n = (top["token"].tolist(), top["n"].to_numpy(np.int64)) if top is not None else ([], np.zeros(0, np.int64))
    if END not in tokens:  # the end token is always looked up here
        tokens, n = [*tokens, END], np.append(n, sum(r["n"] for r in counts.where(F.col("token") == END).collect()))
    own = [END, *(t for t in tokens if t != END)][: p.own_classes]
    own_id = {t: i for i, t in enumerate(own)}
    classes = np.array([own_id[t] if t in own_id else len(own) + shared_class(t, p.shared_classes) for t in tokens], np.int16)
    class_tokens, class_words = np.zeros(len(own) + p.shared_classes), np.zeros(len(own) + p.shared_classes)
    shared = F.crc32(F.substring("token", -2, 2).cast("binary")) % p.shared_classes
    for c, words, total in counts.where(~F.col("token").isin(own)).groupBy(shared.alias("c")).agg(F.count("*"), F.sum("n")).collect():
        class_words[len(own) + c], class_tokens[len(own) + c] = words, total
    for t, k in zip(tokens, n, strict=True):
        if t in own_id:
            class_tokens[own_id[t]], class_words[own_id[t]] = k, 1
    return Vocabulary(pa.array(tokens, pa.string()), n, classes, class_tokens, class_words, len(own), p.shared_classes, int(n_tokens), int(n_words)), least


_ENCODED_SQL = "rid long, doc_id {}, held_out boolean, n_tokens long, known long, base double, inside double, classes binary, rare array<struct<token:string,tf:long>>"


def encode(chunks: DataFrame, vocabulary: Vocabulary, doc_id_type: str) -> DataFrame:
    """For each text: the classes of its tokens, the sums over its dictionary words, and its other words with their counts in it."""
    sent = chunks.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        log_n, log_inside = np.log10(v.counts + 0.1), v.log_within()
        inside = np.where(v.classes < v.n_own, 0, log_n - log_inside[v.classes])
        divisor, end = math.log10(v.n_tokens + 0.1 * (v.n_words + 1)), pc.index(v.words, END).as_py()
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, ids = (np.frombuffer(batch.column(c)[k].as_buffer(), np.int32) for c in ("sizes", "ids"))
                words = batch.column("words")[k].values
                at = np.asarray(pc.fill_null(pc.index_in(words, value_set=v.words), -1))
                known = at >= 0
                w_classes, w_inside = np.empty(len(at), np.int16), np.empty(len(at))
                w_classes[known], w_inside[known] = v.classes[at[known]], inside[at[known]]
                ends = pc.utf8_slice_codeunits(words.filter(pa.array(~known)), -2).dictionary_encode()
                shared = v.n_own + np.array([shared_class(x, v.n_shared) for x in ends.dictionary.to_pylist()], np.int16)
                w_classes[~known] = shared[np.asarray(ends.indices)]
                w_inside[~known] = -log_inside[w_classes[~known]]
                w_logs = np.where(known, log_n[at], 0.0)
                w_seen = known & (v.counts[at] > 0)
                n_tokens = sizes.astype(np.int64) + 1
                classes = np.insert(w_classes[ids], np.cumsum(sizes), v.classes[end])
                rare = np.flatnonzero(~known[ids])
                keys, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes)[rare] * len(words) + ids[rare], return_counts=True)
                pairs = pa.StructArray.from_arrays([words.take(pa.array(keys % max(1, len(words)))), pa.array(tf, pa.int64())], names=["token", "tf"])
                starts = np.searchsorted(keys, np.arange(len(sizes) + 1) * len(words))
                made = {"rid": (batch.column("chunk")[k].as_py() << TEXT_BITS) + np.arange(len(sizes)), "doc_id": batch.column("doc_id")[k].values, "held_out": batch.column("held_out")[k].values, "n_tokens": n_tokens}
                made |= {"known": sums_by(w_seen[ids], sizes) + int(v.counts[end] > 0), "base": sums_by(w_logs[ids], sizes) + log_n[end] - n_tokens * divisor, "inside": sums_by(w_inside[ids], sizes) + inside[end]}
                yield pa.RecordBatch.from_pydict(made | {"classes": binaries(classes, n_tokens), "rare": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pairs)})

    return chunks.select("chunk", "doc_id", "held_out", "sizes", "ids", "words").mapInArrow(run, _ENCODED_SQL.format(doc_id_type))


@dataclass
class LogBilinear:
    """Class vectors for contexts and targets, a matrix for each context position, a bias for each class."""

    context: np.ndarray
    target: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, class_tokens: np.ndarray, width: int, seed: int) -> LogBilinear:
        rng, n = np.random.default_rng(seed), len(class_tokens)
        share = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
        near = np.eye(width)
        return cls(rng.normal(0, 0.3, (n + 1, width)).astype(np.float32), rng.normal(0, 0.1, (n, width)).astype(np.float32), near.astype(np.float32), near.astype(np.float32), np.log(share).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.near, self.far, self.bias]

    def to_bytes(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.parts()]).astype(np.float32).tobytes()

    def from_flat(self, flat: np.ndarray) -> LogBilinear:
        """A model of this one's shape with the given numbers."""
        ends = np.cumsum([x.size for x in self.parts()])[:-1]
        return LogBilinear(*(x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(flat, ends), self.parts(), strict=True)))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Products of all context and target vectors, for the nearer and the farther word."""
        return self.context @ self.near @ self.target.T, self.context @ self.far @ self.target.T

    def log_norms(self, near_classes: np.ndarray) -> np.ndarray:
        """Log of the softmax's divisor for each of some nearer words with every farther word."""
        near, far = self.tables()
        out = np.empty((len(near_classes), len(far)), np.float32)
        for i, c in enumerate(near_classes):
            scores = far + (near[c] + self.bias)
            top = scores.max(axis=1)
            out[i] = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        return out


def contexts(classes: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearer and farther word of every token of some texts that lie one after the other."""
    near, far = np.full_like(classes, start), np.full_like(classes, start)
    near[1:], far[2:] = classes[:-1], classes[:-2]
    first = np.cumsum(sizes) - sizes
    near[first[sizes > 0]] = far[first[sizes > 0]] = far[first[sizes > 1] + 1] = start
    return near, far


class NceTrainer:
    """AdaGrad on the noise-contrastive loss, with one set of noise classes for a batch."""

    def __init__(self, model: LogBilinear, class_tokens: np.ndarray, p: LmParams, seed: int) -> None:
        self.m, self.p, self.rng = model, p, np.random.default_rng(seed)
        share = (class_tokens + 0.5) / (class_tokens + 0.5).sum()
        self.edges, self.log_noise = np.cumsum(share), np.log(p.noise * share).astype(np.float32)
        self.squares = [np.full(x.shape, 1e-3, np.float32) for x in model.parts()]
        self.seen = 0

    def _step(self, part: int, gradient: np.ndarray) -> None:
        self.squares[part] += gradient * gradient
        self.m.parts()[part][...] -= self.p.rate * gradient / np.sqrt(self.squares[part])

    @staticmethod
    def _sum_by(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        out = np.zeros((n, rows.shape[1]), np.float32)
        out[ids[first]] = np.add.reduceat(rows[order], first, axis=0)
        return out

    def train(self, near: np.ndarray, far: np.ndarray, target: np.ndarray) -> None:
        """One step.  Products with context vectors, and their gradients, are made once for each class and not for each token."""
        m, n, width = self.m, len(self.edges), self.p.width
        noise = np.minimum(np.searchsorted(self.edges, self.rng.random(self.p.noise)), n - 1)
        guess = np.ones((len(target), width + 1), np.float32)  # the last column is for biases
        guess[:, :width] = (m.context @ m.near)[near] + (m.context @ m.far)[far]
        target_table = np.hstack((m.target, m.bias[:, None] - self.log_noise[:, None]))
        q, noise_table = target_table[target], target_table[noise]
        scale = np.float32(1 / len(target))
        with np.errstate(over="ignore"):  # an infinite exponential ends as 0
            g_true = np.einsum("ij,ij->i", guess, q)
            g_true = -scale / (1 + np.exp(g_true))
            g_false = guess @ -noise_table.T
            np.exp(g_false, out=g_false)
        g_false += 1
        np.divide(scale, g_false, out=g_false)
        g_guess = g_true[:, None] * q[:, :width]
        g_guess += g_false @ noise_table[:, :width]
        g_target = self._sum_by(target, g_true[:, None] * guess, n)
        np.add.at(g_target, noise, g_false.T @ guess)
        by_near, by_far = self._sum_by(near, g_guess, n + 1), self._sum_by(far, g_guess, n + 1)
        g_context = by_near @ m.near.T + by_far @ m.far.T
        g_near, g_far = m.context.T @ by_near, m.context.T @ by_far
        for part, gradient in enumerate((g_context, g_target[:, :width], g_near, g_far, g_target[:, width])):
            self._step(part, gradient)
        self.seen += len(target)


def _train_round(encoded: DataFrame, model: LogBilinear, vocabulary: Vocabulary, p: LmParams) -> LogBilinear:
    """Trains a copy in every partition over all its texts and averages the copies by their numbers of tokens."""
    spark = encoded.sparkSession
    sent = spark.sparkContext.broadcast((model, vocabulary.class_tokens, vocabulary.start))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_model, class_tokens, start = sent.value
        own = LogBilinear(*(x.copy() for x in start_model.parts()))
        trainer = NceTrainer(own, class_tokens, p, p.seed)
        for batch in text_slices(batches, 0, 4_000_000):  # about two million tokens
            target, sizes = from_binaries(batch.column(0), "<i2")
            near, far = contexts(target, sizes, start)
            order = trainer.rng.permutation(len(target))
            for i in range(0, len(order), p.batch):
                at = order[i : i + p.batch]
                trainer.train(near[at], far[at], target[at])
        if trainer.seen:
            yield pa.RecordBatch.from_pydict({"model": [own.to_bytes()], "weight": [float(trainer.seen)]})

    def mean(rows):  # noqa: ANN001, ANN202
        weight = rows["weight"].sum()
        flat = sum(np.frombuffer(m, np.float32).astype(np.float64) * w for m, w in zip(rows["model"], rows["weight"], strict=True)) / weight
        return rows.head(1).assign(model=[flat.astype(np.float32).tobytes()], weight=[weight])[["group", "model", "weight"]]

    schema = "model binary, weight double"
    trained = encoded.select("classes").mapInArrow(run, schema).withColumn("group", F.spark_partition_id())
    for _ in range(2):  # groups of bounded size, in levels
        grouped = trained.withColumn("group", F.floor(F.col("group") / p.fan_in)).groupBy("group")
        trained = grouped.applyInPandas(mean, "group long, " + schema)
    rows = trained.collect()
    if not rows:
        return model
    weights = [r["weight"] for r in rows]
    flat = sum(np.frombuffer(r["model"], np.float32).astype(np.float64) * r["weight"] for r in rows) / sum(weights)
    return model.from_flat(flat)


def train_model(encoded: DataFrame, vocabulary: Vocabulary, p: LmParams) -> LogBilinear:
    """Every training text is used once, a share of them in each round."""
    model = LogBilinear.fresh(vocabulary.class_tokens, p.width, p.seed)
    for k in range(p.rounds):
        model = _train_round(encoded.where(F.pmod(F.xxhash64("rid"), F.lit(p.rounds)) == k), model, vocabulary, p)
    return model


def _log_norm_table(docs: DataFrame, model: LogBilinear) -> np.ndarray:
    """The softmax's divisors for all pairs of context classes: one batched matrix product for each nearer class."""
    spark = docs.sparkSession
    sent, n = spark.sparkContext.broadcast(model), len(model.context)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_pydict({"c": ids, "norms": [x.tobytes() for x in sent.value.log_norms(ids)]})

    rows = spark.range(0, n, 1, 12).mapInArrow(run, "c long, norms binary").collect()
    return np.stack([np.frombuffer(r["norms"], np.float32) for r in sorted(rows, key=lambda r: r["c"])])


def _class_scores(encoded: DataFrame, model: LogBilinear, start: int) -> DataFrame:
    """rid, class_score: the log10 probability of each text's classes."""
    sent = encoded.sparkSession.sparkContext.broadcast((model, _log_norm_table(encoded, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, norms = sent.value
        near_t, far_t = m.tables()
        for batch in text_slices(batches, "classes", 4_000_000):
            target, sizes = from_binaries(batch.column("classes"), "<i2")
            near, far = contexts(target, sizes, start)
            scores = sums_by(near_t[near, target] + far_t[far, target] + m.bias[target] - norms[near, far], sizes) / math.log(10)
            kept = [batch.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "known", "base", "inside")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scores, pa.float64())], names=["rid", "doc_id", "held_out", "n_tokens", "known", "base", "inside", "class_score"])

    kept = encoded.select("rid", "doc_id", "held_out", "n_tokens", "known", "base", "inside", "classes")
    return kept.mapInArrow(run, kept.drop("classes").withColumn("class_score", F.lit(0.0)).schema)


def score_documents(docs: DataFrame, p: LmParams | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row; scores are log10 probabilities.

    `base_score` is of a smoothed unigram model, `score` of the log-bilinear model; both learn from rows outside the held fold.
    """
    p = p or LmParams()
    chunks = staged(split_texts(docs.select("doc_id", (fold("doc_id", p.folds) == p.held_fold).alias("held_out"), "text"), p))
    counts = staged(count_tokens(chunks))
    vocabulary, least = build_vocabulary(counts, p)
    encoded = staged(encode(chunks, vocabulary, dict(docs.dtypes)["doc_id"]))
    model = train_model(encoded.where(~F.col("held_out")), vocabulary, p)
    below = counts.where(F.floor(F.log2("n") * 16) < least) if least < math.inf else counts
    rare = encoded.select("rid", F.explode("rare").alias("r")).select("rid", "r.token", "r.tf").join(below, "token", "left")
    n = F.coalesce("n", F.lit(0))
    found = rare.groupBy("rid").agg(F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("more"), F.sum(F.col("tf") * F.log10(n + F.lit(0.1))).alias("logs"))
    logs = F.coalesce("logs", F.lit(0.0))
    return (
        _class_scores(encoded, model, vocabulary.start)
        .join(found, "rid", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(vocabulary.n_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + logs).alias("base_score"),
            (F.col("class_score") + F.col("inside") + logs).alias("score"),
        )
    )
