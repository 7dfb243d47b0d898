"""Secret scanning: three base patterns, and a battery of randomness tests over other long tokens.

A candidate is a maximal run of base64 characters of least length that no base span touches.  Its encoding is the smallest
alphabet that holds it.  Three tests take the token as random over that alphabet: chi-squared uniformity of its symbols (in so many
bins that each expects five), runs above and below the middle, and lag-1 serial correlation; Fisher's method combines them, and a
token that fails is no secret.  For one that passes, uniformity is tested the other way round: natural writing puts a known share of
its symbols, at least, on the alphabet's most natural ones (as many as tell most), and the binomial tail bounds the chance that it puts as few there as
the token does.  Benjamini-Hochberg on these p values over all candidates of the corpus, within classes of length, holds the share of
false discoveries.

Null and empty texts have no spans.  Offsets count code points.  Spans of different base kinds may overlap; spans are in order of
start, then kind.  Rows are scanned one by one, so repeated rows give repeated results (and count as candidates each time).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import named_again, plainly_named, staged, text_slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "hex_upper": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed64": _UPPER + _LOWER + _DIGITS + "+/-_",
}
#: Shares of a to z in natural writing, in thousandths; capitals, digits and signs get small fixed shares.
_NATURAL = dict(zip(_LOWER, (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1), strict=True))


@dataclass(frozen=True)
class SecretParams:
    least_length: int = 20
    #: Least combined p of the battery.
    battery_alpha: float = 0.001
    #: Part of the most natural symbols' share that any natural writing is taken to have.
    natural_slack: float = 0.95
    false_discovery_rate: float = 0.01
    #: First lengths of the classes within which false discoveries are held.
    length_classes: tuple[int, ...] = (20, 32, 48, 96)


@lru_cache(1)
def _token_class() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in ENCODINGS["mixed64"]]] = True
    return out


@lru_cache(32)
def natural_order(alphabet: str, slack: float) -> tuple[dict[str, int], frozenset[str], float]:
    """The places of an alphabet's symbols from the most natural on, the first ones of them that tell most, and the least share of these in natural writing."""
    raw = {c: 0.9 * _NATURAL[c] / 1000 for c in _LOWER} | {c.upper(): 0.045 * _NATURAL[c] / 1000 for c in _LOWER} | dict.fromkeys(_DIGITS, 0.003) | dict.fromkeys("+/-_", 0.005)
    symbols = sorted(alphabet, key=lambda c: (-raw[c], c))
    k, total = len(symbols), sum(raw[c] for c in symbols)
    shares = [slack * sum(raw[c] for c in symbols[:m]) / total for m in range(1, k)]
    m = max(range(1, k), key=lambda m: divergence(m / k, shares[m - 1]) if m / k < shares[m - 1] else 0.0)
    return {c: i for i, c in enumerate(symbols)}, frozenset(symbols[:m]), shares[m - 1]


def divergence(x: float, q: float) -> float:
    """Of a share x from a share q."""
    return (x * math.log(x / q) if x else 0.0) + ((1 - x) * math.log((1 - x) / (1 - q)) if x < 1 else 0.0)


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet that holds a token; None for a number."""
    chars = set(token)
    if chars <= set(_DIGITS):
        return None
    return next((k for k, a in ENCODINGS.items() if chars <= set(a)), None)


def battery(token: str, alphabet: str) -> float:
    """Fisher's combination of the p values of the three tests, for a token that is random over an alphabet."""
    n, k = len(token), len(alphabet)
    at = {c: i for i, c in enumerate(alphabet)}
    x = np.array([at[c] for c in token], float)
    order = natural_order(alphabet, 1.0)[0]
    bins = max(2, min(k, n // 5))
    place = np.array([order[c] for c in token]) * bins // k
    expected = n * np.bincount(np.arange(k) * bins // k) / k
    chi2, df = float(((np.bincount(place, minlength=bins) - expected) ** 2 / expected).sum()), bins - 1
    p_uniform = two_sided(((chi2 / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = x >= k / 2
    n1, n0 = int(high.sum()), int((~high).sum())
    if n1 and n0:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 2 * n1 * n0 / n + 1
        p_runs = two_sided((runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9)))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    spread = float((d * d).sum())
    p_serial = two_sided((float((d[1:] * d[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    half = -sum(math.log(max(p, 1e-300)) for p in (p_uniform, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def evidence(token: str, alphabet: str, slack: float) -> float:
    """Minus the natural log of a bound (Chernoff's) on the chance that natural writing has as few of the most natural symbols."""
    _, first, q = natural_order(alphabet, slack)
    x = sum(c in first for c in token) / len(token)
    return len(token) * divergence(x, q) if x < q else 0.0


def scan(text: str | None, p: SecretParams) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float, float]]]:
    """Base spans as (start, kind, end), and candidates as (start, end, p of the battery, evidence)."""
    if not text:
        return [], []
    spans: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(x in low for x in ("passw", "secret", "token", "api")):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    flags = _token_class()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= min(p.least_length, LEAST_HEX)
    runs = [(int(a), int(b)) for a, b in zip(starts[long], ends[long], strict=True)]
    for a, b in runs:  # a run of hex digits lies within one of these
        spans += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(text[a:b]) if len(m[0]) >= LEAST_HEX]
    candidates = []
    for a, b in runs:
        if b - a < p.least_length or any(s < b and a < e for s, _, e in spans):
            continue
        token = text[a:b]
        if encoding := infer_encoding(token):
            alphabet = ENCODINGS[encoding]
            candidates.append((a, b, battery(token, alphabet), evidence(token, alphabet, p.natural_slack)))
    return sorted(spans), candidates


_CANDIDATE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64()), ("nats", pa.float64())])
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_FOUND_SQL = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, candidates array<struct<start:int,end:int,p:double,nats:double>>"


def _found(docs: DataFrame, carried: list[str], p: SecretParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text in batch.column(batch.num_columns - 1):
                spans, candidates = scan(text.as_py(), p)
                listed = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                kinds = Counter(k for _, k, _ in spans)
                out.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(listed.encode()).hexdigest(), spans, candidates))
            if out:
                n_assign, n_access, n_hex, sha, spans, candidates = zip(*out, strict=True)
                made = [pa.array(n_assign, pa.int64()), pa.array(n_access, pa.int64()), pa.array(n_hex, pa.int64()), pa.array(sha, pa.string())]
                made.append(pa.array([[dict(zip(("start", "kind", "end"), s, strict=True)) for s in x] for x in spans], pa.list_(_SPAN)))
                made.append(pa.array([[dict(zip(("start", "end", "p", "nats"), c, strict=True)) for c in x] for x in candidates], pa.list_(_CANDIDATE)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*carried, "n_assign", "n_access", "n_hex", "base_sha256", "base", "candidates"])

    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in carried), _FOUND_SQL])
    return docs.select(*carried, F.col("text").alias("_scanned_text")).mapInArrow(run, schema)


def _limits(found: DataFrame, p: SecretParams) -> list[float]:
    """For each class of length, the least evidence of a discovery, by Benjamini-Hochberg on evidence in steps of a quarter."""
    c = found.select(F.explode("candidates").alias("c")).select((F.col("c.end") - F.col("c.start")).alias("n"), "c.p", "c.nats")
    k = sum(((F.col("n") >= first).cast("int") for first in p.length_classes[1:]), F.lit(0))
    step = F.when(F.col("p") >= p.battery_alpha, F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), "nats")) * 4)).otherwise(0)
    rows = c.groupBy(k.alias("k"), step.cast("int").alias("step")).count().collect()
    out = []
    for i in range(len(p.length_classes)):
        steps = sorted(((r["step"], r["count"]) for r in rows if r["k"] == i), reverse=True)
        total, seen, limit = sum(n for _, n in steps), 0, math.inf
        for s, n in steps:
            seen += n
            if math.exp(-s / 4) <= p.false_discovery_rate * seen / total:
                limit = s / 4
        out.append(limit)
    return out


def discovery_limits(docs: DataFrame, p: SecretParams | None = None) -> list[float]:
    p = p or SecretParams()
    return _limits(_found(docs.select("text"), [], p), p)


def is_discovery(candidate: tuple[int, int, float, float], limits: list[float], p: SecretParams) -> bool:
    a, b, p_battery, nats = candidate
    k = sum(b - a >= first for first in p.length_classes[1:])
    return p_battery >= p.battery_alpha and math.floor(min(1000.0, max(0.0, nats)) * 4) / 4 >= limits[k] > 0


def scan_documents(docs: DataFrame, p: SecretParams | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random and found (the spans as structs) for each row of (doc_id, text)."""
    p = p or SecretParams()
    found = staged(_found(docs, ["doc_id"], p))
    limits = _limits(found, p)

    def kept(c):  # noqa: ANN001, ANN202
        n = c["end"] - c["start"]
        limit = F.lit(limits[0])
        for first, x in zip(p.length_classes[1:], limits[1:], strict=True):
            limit = F.when(n >= first, F.lit(x)).otherwise(limit)
        return (c["p"] >= p.battery_alpha) & (F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), c["nats"])) * 4) / 4 >= limit) & (limit > 0)

    random = F.transform(F.filter("candidates", kept), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    spans = F.sort_array(F.concat("base", random))
    name = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("found", lambda s: F.concat_ws(":", name[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.withColumn("found", spans).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"), F.size(F.filter("found", lambda s: s["kind"] == 3)).cast("long").alias("n_random"), "found")


def redact(docs: DataFrame, p: SecretParams | None = None, mark: str = "[secret]") -> DataFrame:
    """The rows with each secret's span, overlapping ones together, replaced by a mark in column text; n_chars, if there is one, follows; other columns stay."""
    p = p or SecretParams()
    limits = discovery_limits(docs, p)
    needed = ("text", "n_chars")
    rows = plainly_named(docs, *needed)
    at, fields = rows.columns.index("text"), rows.schema

    def clean(text: str | None) -> str | None:
        spans, candidates = scan(text, p)
        cuts = sorted([(a, b) for a, _, b in spans] + [c[:2] for c in candidates if is_discovery(c, limits, p)])
        if not cuts:
            return text
        out, done = [], 0
        for a, b in cuts:
            if a >= done:
                out += [text[done:a], mark]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, at):
            texts = pa.array([clean(t.as_py()) for t in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    made = rows.mapInArrow(run, fields)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(fields["n_chars"].dataType))
    return named_again(made, docs, *needed)
