"""Language identification with hyperdimensional profiles.

Every letter symbol has a random vector of +1 and -1.  An n-gram's vector binds its letters' vectors by products, each rotated
by its place; a text's vector bundles (adds) the vectors of all its n-grams.  A language's prototype bundles the unit vectors of
its training texts, less what all languages have in common, and a text goes to the prototype with the largest cosine.

Symbols: the space, A to Z in one case, and other letters dealt over a fixed number of symbols by code point; everything else
separates words.  A null text or one with no letter gets `und` and score 0, as does every text if nothing can be learned.
Ties go to the language that sorts first.  Rows are judged one by one, so repeated rows and ids give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import fold

UNDETERMINED = "und"


@dataclass(frozen=True)
class LangParams:
    folds: int = 4
    held_fold: int = 2
    size: int = 1024
    other_symbols: int = 21
    seed: int = 11
    #: Sharpness of the softmax over cosines that gives the score.
    sharpness: float = 12.0
    #: Texts of so many distinct n-grams or more are rejected if no prototype's cosine passes the floor.  Random letters stay below 0.11,
    #: and the given documents of that length have 0.16 or more; shorter texts can't be told from either.
    told_from: int = 32
    floor: float = 0.12
    #: Training texts from which a prototype is sure enough to reject what it isn't near to.
    sure_from: int = 50

    @property
    def symbols(self) -> int:
        return 27 + self.other_symbols


@lru_cache(2)
def symbol_table(other: int) -> np.ndarray:
    """A symbol for every code point: 0 for what is no letter, 1 to 26 for a to z, then other letters."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()])
    plain = np.array([ord(chr(c).lower()[0]) for c in letters])
    out[letters] = 27 + plain % other
    ascii_letters = (plain >= 97) & (plain <= 122)
    out[letters[ascii_letters]] = plain[ascii_letters] - 96
    return out


@lru_cache(2)
def letter_vectors(p: LangParams) -> np.ndarray:
    """A vector for each place in a trigram and symbol: the symbol's random vector, rotated by the place."""
    base = np.random.default_rng(p.seed).choice(np.array([-1, 1], np.int8), (p.symbols, p.size))
    return np.stack([np.roll(base, k, axis=1) for k in (2, 1, 0)])


def trigrams(text: str | None, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's letter trigrams and their counts; words are set off by one space symbol."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = symbol_table(p.other_symbols)[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    symbols = np.concatenate(([0], symbols, [0])).astype(np.int32)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    symbols = symbols[keep]
    if len(symbols) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.bincount((symbols[:-2] * p.symbols + symbols[1:-1]) * p.symbols + symbols[2:])
    codes = np.flatnonzero(counts)
    return codes, counts[codes]


def text_vector(text: str | None, p: LangParams) -> np.ndarray | None:
    """The text's bundle, at length 1; None if it has no letter."""
    return bundle(*trigrams(text, p), p)


def bundle(codes: np.ndarray, counts: np.ndarray, p: LangParams) -> np.ndarray | None:
    if not len(codes):
        return None
    first, second, third = letter_vectors(p)
    s = p.symbols
    total = np.zeros(p.size, np.float32)
    for lo in range(0, len(codes), 2048):  # bounds the memory that a text with very many n-grams takes
        c = codes[lo : lo + 2048]
        bound = first[c // (s * s)] * second[c // s % s] * third[c % s]
        total += counts[lo : lo + 2048].astype(np.float32) @ bound.astype(np.float32)
    length = float(np.linalg.norm(total))
    return total / length if length else None


def learn_prototypes(rows: DataFrame, p: LangParams) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their unit prototypes and numbers of texts from rows of (lang, text); tasks bundle what they see, Spark adds the bundles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (v := text_vector(text.as_py(), p)) is not None:
                    # Fixed point, so that sums don't depend on the order of rows.
                    sums.setdefault(lang, np.zeros(p.size + 1, np.int64))[:] += np.rint(np.append(v, 2**-20) * 2**20).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.string()), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    parts = rows.select("lang", "text").mapInArrow(run, "lang string, v array<bigint>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()
    langs = sorted({r["lang"] for r in summed})
    out = np.zeros((len(langs), p.size + 1))
    at = {x: i for i, x in enumerate(langs)}
    for r in summed:
        out[at[r["lang"]], r["i"]] = r["x"]
    texts, out = out[:, -1], out[:, :-1]
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        out -= out.mean(axis=0)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
    return langs, out.astype(np.float32), texts


def classify(docs: DataFrame, learned: tuple[list[str], np.ndarray, np.ndarray], p: LangParams, carried: list[str]) -> DataFrame:
    """The carried columns, lang_pred, score and fits of each row of docs; docs has a column text.

    fits tells whether the text is in a learned language: false without a letter, or below the floor.
    """
    sent = docs.sparkSession.sparkContext.broadcast(learned)
    names = [*carried, "lang_pred", "score", "fits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prototypes, texts = sent.value
        for batch in batches:
            found: list[str] = []
            scores: list[float] = []
            fits: list[bool] = []
            for text in batch.column(batch.num_columns - 1):
                codes, counts = trigrams(text.as_py(), p)
                v = bundle(codes, counts, p) if langs else None
                if v is None:
                    found.append(UNDETERMINED)
                    scores.append(0.0)
                    fits.append(False)
                    continue
                cosines = prototypes @ v
                best = int(cosines.argmax())
                odds = np.exp(p.sharpness * (cosines - cosines[best]))
                found.append(langs[best])
                scores.append(float(1 / odds.sum()))
                fits.append(len(codes) < p.told_from or bool(texts[best] < p.sure_from or cosines[best] >= p.floor))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(scores, pa.float64()), pa.array(fits, pa.bool_())], names=names)

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), "lang_pred string", "score double", "fits boolean"])
    return docs.select(*carried, F.col("text").alias("_scored_text")).mapInArrow(run, schema)


def identify_language(docs: DataFrame, p: LangParams | None = None, carried: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row, or the carried columns in place of the first two.

    Learns from text and non-null lang of rows outside the held fold.
    """
    p = p or LangParams()
    held = fold("doc_id", p.folds) == p.held_fold
    learned = learn_prototypes(docs.where(~held & F.col("lang").isNotNull()), p)
    if carried is not None:
        return classify(docs, learned, p, carried).drop("fits")
    return classify(docs.select("doc_id", held.alias("held_out"), "text"), learned, p, ["doc_id", "held_out"]).drop("fits")


def keep_identified(docs: DataFrame, p: LangParams | None = None) -> DataFrame:
    """The rows whose text is in a learned language: one with a letter and, if it is long enough to tell, a prototype that is near.  All columns stay."""
    p = p or LangParams()
    names = docs.columns
    inner = docs.select(*(F.col("`" + c.replace("`", "``") + "`").alias(f"_c{i}") for i, c in enumerate(names)), F.col("text"))
    held = fold("doc_id", p.folds) == p.held_fold
    learned = learn_prototypes(docs.where(~held & F.col("lang").isNotNull()), p)
    found = classify(inner, learned, p, [f"_c{i}" for i in range(len(names))])
    return found.where("fits").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))
