"""Near-duplicate detection on SimHash fingerprints with a Gray-order hierarchical index.

Fingerprints that differ in few bits agree on at least one of `distance + 1` segments of their bits.  For each segment, rows that
agree on it meet in one task.  There the fingerprints, rotated so that the segment leads, are sorted by Gray rank; nodes
of eight neighbours factor out the bits that all share, nodes of nodes again, and a search goes down from the top, adds up the
differences found so far and drops whole groups once the segment differs or the sum is too large.

A segment value that very many fingerprints share is not searched so.  Its fingerprints meet by masked patterns instead: two that
differ in at most 2 bits are both within 1 bit of a common pattern, of which each has 65, and at most 65 meet at one.

Null and empty texts have fingerprint zero and are linked like any other.  Equal fingerprints count once in all searches.  A
component's id is the smallest non-null doc_id in it (null if there is none).  Repeated rows are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import small_or_plain, staged, with_row_id, words
from canopy.llm.components import connected_components

BITS = 64
_ONE = np.uint64(1)


@dataclass(frozen=True)
class SimHashParams:
    shingle: int = 3
    seed: int = 42
    #: Bits in which linked fingerprints differ, at most; 0, 1 or 2.
    distance: int = 2
    #: Fingerprints with the same segment, beyond which they meet by masked patterns.
    hot_segment: int = 512
    fanout: int = 8


def fingerprint(text: str | None, p: SimHashParams) -> int:
    """Bits that are set in over half the hashes of a text's word shingles, repeats included."""
    tokens = words(text)
    if not tokens:
        return 0
    encoded = [t.encode("utf-8", "replace") for t in tokens]
    ends = np.cumsum([len(t) + 1 for t in encoded]).tolist()
    line, k = b" ".join(encoded), min(p.shingle, len(tokens))
    starts = [0, *ends[: len(tokens) - k]]
    counts, n, digest, seed = np.zeros(BITS, np.int64), len(starts), xxhash.xxh64_intdigest, p.seed
    for lo in range(0, n, 32_768):
        hashes = np.array([digest(line[a : b - 1], seed) for a, b in zip(starts[lo : lo + 32_768], ends[k - 1 + lo : k - 1 + lo + 32_768], strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, carried: list[str], p: SimHashParams) -> DataFrame:
    """The carried columns and fp, a long that holds the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), p) for t in batch.column(batch.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp)], names=[*carried, "fp"])

    types = dict(docs.dtypes)
    return docs.select(*carried, F.col("text").alias("_hashed_text")).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in carried), "fp long"]))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the order of the Gray code."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return x if bits % BITS == 0 else (x << np.uint64(bits)) | (x >> np.uint64(BITS - bits))


class GrayIndex:
    """Levels of nodes over codes in Gray order; a node holds the bits that its codes share and its parent doesn't hold."""

    def __init__(self, codes: np.ndarray, fanout: int) -> None:
        self.codes, self.fanout = codes, fanout
        patterns, masks = codes, np.full(len(codes), ~np.uint64(0))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            if len(patterns) <= fanout:
                self.levels.append((patterns, masks))
                break
            first = np.arange(0, len(patterns), fanout)
            lead = np.repeat(patterns[first], fanout)[: len(patterns)]
            shared = np.bitwise_and.reduceat(masks & ~(patterns ^ lead), first)
            self.levels.append((patterns, masks & ~np.repeat(shared, fanout)[: len(patterns)]))
            patterns, masks = patterns[first] & shared, shared
        self.levels.reverse()

    def search(self, queries: np.ndarray, distance: int, lead: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Places of queries and codes that agree on all lead bits and differ in so many bits at most."""
        top = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), top), np.tile(np.arange(top), len(queries))
        differences = np.zeros(len(q), np.uint8)
        for k, (patterns, own) in enumerate(self.levels):
            if k:
                below = node[:, None] * self.fanout + np.arange(self.fanout)
                inside = below < len(patterns)
                q, differences, node = (np.repeat(x, self.fanout).reshape(below.shape)[inside] for x in (q, differences, node))
                node = below[inside]
            other = (queries[q] ^ patterns[node]) & own[node]
            differences = differences + np.bitwise_count(other)
            keep = (differences <= distance) & ((other & lead) == 0)
            q, node, differences = q[keep], node[keep], differences[keep]
        return q, node


class Forest:
    """Sets of places, joined by arrays of pairs; the smallest place of a set stands for it."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.parent, b, a)
            while not np.array_equal(up := self.parent[self.parent], self.parent):
                self.parent = up


def segments(p: SimHashParams) -> list[tuple[int, int]]:
    """First bit and number of bits of each segment."""
    n = p.distance + 1
    edges = [round(BITS * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _linked_in_task(p: SimHashParams):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        part = np.concatenate([np.asarray(b.column(0)) for b in rows]) if rows else np.zeros(0, int)
        codes = np.concatenate([np.asarray(b.column(1)) for b in rows]).view(np.uint64) if rows else np.zeros(0, np.uint64)
        for s, (first, width) in enumerate(segments(p)):
            own = rotate(codes[part == s], BITS - first - width)
            if len(own) < 2:
                continue
            own = own[np.argsort(gray_rank(own))]
            index, forest = GrayIndex(own, p.fanout), Forest(len(own))
            lead = ~np.uint64(0) << np.uint64(BITS - width)
            for lo in range(0, len(own), 2048):
                q, found = index.search(own[lo : lo + 2048], p.distance, lead)
                later = found > q + lo
                forest.join(q[later] + lo, found[later])
            child = np.flatnonzero(forest.parent != np.arange(len(own)))
            back = rotate(own, first + width).view(np.int64)
            yield pa.RecordBatch.from_pydict({"a": back[child], "b": back[forest.parent[child]]})

    return run


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.concatenate((np.zeros(1, np.uint64), _ONE << np.arange(BITS, dtype=np.uint64)))
    for batch in batches:
        fp = np.asarray(batch.column(0))
        for lo in range(0, len(fp), 2000):
            some = fp[lo : lo + 2000].view(np.uint64)
            yield pa.RecordBatch.from_pydict({"pattern": (some[:, None] ^ flips).ravel().view(np.int64), "fp": np.repeat(some.view(np.int64), len(flips))})


def link_fingerprints(prints: DataFrame, p: SimHashParams) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) whose components are those of all links; there are few for each fingerprint."""
    parts = [F.struct(F.lit(i).alias("part"), F.expr(f"shiftrightunsigned(fp, {first}) & {(1 << width) - 1}L").alias("segment")) for i, (first, width) in enumerate(segments(p))]
    dealt = prints.select(F.explode(F.array(*parts)).alias("s"), "fp").select("s.part", "s.segment", "fp")
    hot = staged(dealt.groupBy("part", "segment").count().where(F.col("count") > p.hot_segment).select("part", "segment"))
    hot_keys = small_or_plain(hot, 100_000)
    cold = dealt.join(hot_keys, ["part", "segment"], "left_anti").repartition("part", "segment")
    edges = cold.select("part", "fp").mapInArrow(_linked_in_task(p), "a long, b long")
    met = dealt.join(hot_keys, ["part", "segment"], "left_semi").select("fp").distinct()
    at = met.mapInArrow(_patterns, "pattern long, fp long").groupBy("pattern").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    near = at.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b").distinct()
    if p.distance < 2:  # a common pattern allows 2 bits
        near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= p.distance)
    return edges.unionByName(near)


def components(prints: DataFrame, p: SimHashParams) -> DataFrame:
    """fp, component_id, kept for each distinct fp of (row, doc_id, fp): kept is the row of smallest doc_id in its component."""
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first")
    distinct = staged(prints.groupBy("fp").agg(first))
    roots = connected_components(link_fingerprints(distinct.select("fp"), p))
    keyed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = keyed.groupBy("root").agg(F.min("first").alias("best"))
    return keyed.join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("kept"))


def simhash_components(docs: DataFrame, p: SimHashParams | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id for each row."""
    p = p or SimHashParams()
    prints = staged(fingerprints(with_row_id(docs.select("doc_id", "text"), "row"), ["row", "doc_id"], p))
    found = staged(components(prints, p))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, p: SimHashParams | None = None) -> DataFrame:
    """One row of each component, the one of smallest doc_id; all columns stay."""
    p = p or SimHashParams()
    rows = staged(with_row_id(docs, "__canopy_row"))
    prints = staged(fingerprints(rows.select(F.col("__canopy_row").alias("row"), "doc_id", "text"), ["row", "doc_id"], p))
    found = components(prints, p)
    dropped = staged(prints.join(found, "fp").where(F.col("row") != F.col("kept")).select(F.col("row").alias("__canopy_dropped")))
    return rows.join(small_or_plain(dropped, 200_000), F.col("__canopy_row") == F.col("__canopy_dropped"), "left_anti").drop("__canopy_row")
