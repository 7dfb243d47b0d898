"""SimHash near-duplicate removal with verified links: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts with the same set of shingles, among them exact copies and all texts without words, are joined first.  Then SimHash fingerprints
of the sets are linked by the Gray-order index at two bits or fewer, and links whose whole texts are similar enough join components.
Similar pairs differ in up to 11 bits and more, which no index reaches that prunes, so an exact search follows for the links that
fingerprints miss, between texts that are not in one component yet: a prefix filter.  With all shingles in one fixed order, two sets
that are similar enough share one among the first `n - ceil(0.8 n) + 1` of each, at places that leave room for the common shingles they
need.  The order puts shingles that are frequent in a sample last; it decides the cost and not the result.  A pair whose prefixes share
`c` shingles has `c` and the rest of one set in common at most; and two sets differ in as many shingles at least as their parities do in
bits (a bit tells whether a set has an odd number of the shingles that hash to it).  Parities go along with the shingles, so that texts that
share passages only, or are edited copies of one text and too far from each other, are told apart where they meet and make no pair.  Of these meetings
there are as many as the square of the rows of a shingle within the reach of a size; those of a shingle with many rows are dealt out in parts.  What is left is verified.
Before that, texts with the same smallest hash (of three) are held against those among them that have most shingles of the frequent,
which edited copies are most like, so that a large cluster of near copies is mostly one component by then: shingles within one component are left out.
Texts of fewer than five words are one shingle.

Rows get their ids once, in the table that holds their features, and are told apart by these, so repeated rows and ids are one
component each with what equals them.  The row of smallest doc_id stays (a null id counts as the largest), of equals the first written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from canopy.llm.common import from_binaries, named_again, plainly_named, small_or_plain, staged, text_slices, tokenise, with_row_id
from canopy.llm.components import connected_components
from canopy.llm.simhash_dedup import SimHashParams, link_fingerprints

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearCopyParams:
    shingle: int = 5
    similarity: float = 0.8
    #: One row in so many is read for the order of shingles.
    sample: int = 16
    #: Shingles of the sample that are put last, at most.
    frequent: int = 200_000
    #: Parts into which the texts of a smallest hash are dealt.
    salts: int = 16
    #: Hubs of a part in each round.
    hubs: tuple[int, ...] = (1, 4)
    #: Rows of a shingle that meet in one place; more are dealt out in parts, each of which meets each.
    meeting: int = 4096


def shingle_hashes(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text, the distinct hashes of its word shingles, sorted."""
    found = tokenise(column)
    words = np.array([xxhash.xxh64_intdigest(w) for w in found.words.cast(pa.binary()).to_pylist()], np.uint64)
    tokens, out, first = words[found.ids], [], 0
    for n in found.sizes.tolist():
        own, first = tokens[first : first + n], first + n
        own_k = min(k, n)
        made = np.zeros(n - own_k + 1 if n else 0, np.uint64)
        for j in range(own_k):
            made = (made ^ (made >> np.uint64(29))) * _FACTOR + own[j : j + len(made)]
        out.append(np.unique(made))
    return out


def simhash(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 32_768):
        counts += np.unpackbits(hashes[lo : lo + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The smallest of some hashes in each of three orders."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    return np.array([((hashes ^ np.uint64(k)) * _FACTOR).min() for k in (0x5BD1E995, 0x1B873593 << 20, 0x27D4EB2F << 32)], np.uint64).view(np.int64)


def parity(hashes: np.ndarray) -> bytes:
    """1024 bits: whether an odd number of some hashes start with each value of ten bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=1024) % 2 == 1).tobytes()


def parities(column: pa.BinaryArray) -> np.ndarray:
    """A column of parities as a matrix of 16 numbers a row."""
    return from_binaries(column, "<u8")[0].reshape(-1, 16)


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The numbers of bits in which parities differ; their sets differ in as many hashes at least."""
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= least * (len(a) + len(b) - common) - 1e-9


def _frequent(docs: DataFrame, p: NearCopyParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are frequent in a sample, sorted, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            yield pa.RecordBatch.from_pydict({"hash": np.concatenate(shingle_hashes(batch.column(0), p.shingle)).view(np.int64)})

    sampled = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(p.sample)) == 0).select("text").mapInArrow(run, "hash long")
    found = sampled.groupBy("hash").count().where("count > 2").orderBy(F.desc("count"), "hash").limit(p.frequent).toArrow()
    hashes, counts = found.column("hash").to_numpy().view(np.uint64), found.column("count").to_numpy()
    at = np.argsort(hashes)
    return hashes[at], counts[at]


_FEATURES = ("__canopy_set", "__canopy_n", "__canopy_fp", "__canopy_smallest", "__canopy_common", "__canopy_prefix", "__canopy_parity")


def _featured(docs: DataFrame, p: NearCopyParams) -> DataFrame:
    """The rows with an id each, the key and size of their set of shingles, its fingerprint and its prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, p))
    rows = with_row_id(docs, "__canopy_row")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = sent.value
        for batch in text_slices(batches, at):
            sets = shingle_hashes(batch.column(at), p.shingle)
            firsts, common = [], []
            for own in sets:
                weight = np.zeros(len(own), np.int64)
                if len(known):
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    weight = np.where(known[place] == own, counts[place], 0)
                common.append(float(np.count_nonzero(weight)) / max(1, len(own)))
                first = len(own) - math.ceil(p.similarity * len(own) - 1e-9) + 1 if len(own) else 0
                firsts.append(own[np.lexsort((own, weight))[:first]].tobytes())
            made = [pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([simhash(x) for x in sets], pa.int64()), pa.array([smallest(x) for x in sets], pa.list_(pa.int64())), pa.array(common), pa.array(firsts, pa.binary()), pa.array([parity(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *_FEATURES])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL("__canopy_set binary, __canopy_n long, __canopy_fp long, __canopy_smallest array<bigint>, __canopy_common double, __canopy_prefix binary, __canopy_parity binary").fields])
    return staged(rows.mapInArrow(run, schema))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of the prefixes of (row, n, prefix)."""
    for batch in text_slices(batches, 2, 500_000):
        flat, sizes = from_binaries(batch.column(2), "<i8")
        place = np.arange(len(flat), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
        yield pa.RecordBatch.from_pydict({"token": flat, "n": np.repeat(np.asarray(batch.column(1)), sizes), "row": np.repeat(np.asarray(batch.column(0)), sizes), "place": place})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first of them, in pieces that hold all rows of a value; binary ones are parities."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [parities(c) if pa.types.is_binary(c.type) else np.asarray(c) for c in batch.columns]
        if not batch.num_rows:
            continue
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        end = int(np.searchsorted(now[0], now[0][-1]))
        if end:
            yield [c[:end] for c in now]
        held = [c[end:] for c in now]
    if held is not None:
        yield held


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose shingle others have too."""
    for columns in _groups(batches):
        same = columns[0][1:] == columns[0][:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names=["token", "n", "row", "place"])


def least_common(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """The fewest common shingles of sets of these sizes that are similar enough."""
    return np.ceil(similarity / (1 + similarity) * (n_a + n_b) - 1e-9)


def most_apart(n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """The most shingles that are in one only of two sets of these sizes that are similar enough."""
    return n_a + n_b - 2 * least_common(n_a, n_b, similarity)


def _dealt(nodes: DataFrame, p: NearCopyParams) -> DataFrame:
    """Rows (key, n, row, place, root, part) of (token, n, row, place, root): those of a token under one key, or under a key for each two of its parts.

    Tokens within one component are left out.
    """
    sizes = nodes.groupBy("token").agg(F.count("*").alias("rows"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    parts = F.ceil(F.col("rows") / F.lit(p.meeting)).cast("int")
    rows = nodes.join(sizes.select("token", parts.alias("parts")), "token").withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.when(F.col("parts") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("part", "other"), F.greatest("part", "other")))
    # Two parts meet under their own key only, and rows of one part under the key of that part with itself.
    return rows.select(key.alias("key"), "n", "row", "place", "root", F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).alias("part"))


def _pairs(p: NearCopyParams):  # noqa: ANN202
    """Pairs (a, b) of rows of (key, n, row, place, root, part, parity) with different roots whose sizes, places and parities allow similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]

        def taken() -> pa.RecordBatch:
            made = np.sort(np.concatenate(found, axis=1), axis=0)
            del found[1:]
            return pa.RecordBatch.from_pydict({"a": made[0], "b": made[1]})

        for key, n, row, place, root, part, bits in _groups(batches):
            a, d = np.arange(len(key) - 1), 1
            while len(a):
                a = a[a + d < len(key)]
                b = a + d
                # Sizes grow within a key: once they are too far apart they stay so.
                on = (key[a] == key[b]) & (n[a] >= p.similarity * n[b] - 1e-9)
                a, b = a[on], b[on]
                needed = least_common(n[a], n[b], p.similarity)
                could = (root[a] != root[b]) & ((part[a] < 0) | (part[a] != part[b])) & (place[a] <= n[a] - needed) & (place[b] <= n[b] - needed)
                a_could, b_could = a[could], b[could]
                for lo in range(0, len(a_could), 8192):
                    i, j = a_could[lo : lo + 8192], b_could[lo : lo + 8192]
                    near = bits_apart(bits[i], bits[j]) <= most_apart(n[i], n[j], p.similarity)
                    if near.any():
                        found.append(np.stack((row[i[near]], row[j[near]])))
                if len(found) > 64:
                    yield taken()
                d += 1
        yield taken()

    return run


def _could(pairs: DataFrame, reps: DataFrame, p: NearCopyParams) -> DataFrame:
    """The pairs (a, b) whose common shingles, those of their prefixes and one set's rest at most, allow similarity."""
    pairs = staged(pairs.distinct())
    for c in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("row").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "prefix"))), c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 4):
            sizes = [np.asarray(batch.column(c)) for c in (2, 3)]
            both = zip(*([np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(c)] for c in (4, 5)), strict=True)
            common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in both], np.int64)
            rest = np.maximum(*(np.ceil(p.similarity * n - 1e-9) - 1 for n in sizes))
            yield batch.select(["a", "b"]).filter(pa.array(common + rest >= least_common(*sizes, p.similarity)))

    return pairs.select("a", "b", "n_a", "n_b", "prefix_a", "prefix_b").mapInArrow(run, "a long, b long")


def _starred(reps: DataFrame, p: NearCopyParams, seed: int, hubs: int) -> DataFrame:
    """Pairs among rows of (row, n, common, smallest) with the same smallest hash: each with the most common ones of its part, and these with those of all."""
    rows = reps.select("row", "n", "common", F.explode("smallest").alias("token")).withColumn("part", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(p.salts)))
    out = []
    for keys in (("token", "part"), ("token",)):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("common"), "row"))
        best = staged(rows.withColumn("place", place).where(F.col("place") <= hubs).drop("place"))
        near = rows.join(best.select(*keys, F.col("row").alias("hub"), F.col("n").alias("n_hub")), list(keys))
        near = near.where((F.col("row") != F.col("hub")) & (F.least("n", "n_hub") >= F.lit(p.similarity) * F.greatest("n", "n_hub") - 1e-9))
        out.append(near.select(F.least("hub", "row").alias("a"), F.greatest("hub", "row").alias("b")))
        rows = best
    return out[0].unionByName(out[1])


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that known pairs have not put into one component."""
    roots = connected_components(known)
    for c in ("a", "b"):
        pairs = pairs.join(small_or_plain(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), 200_000), c, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, p: NearCopyParams) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar."""
    pairs = staged(pairs.distinct())
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct()
    texts = staged(docs.join(small_or_plain(wanted, 200_000), F.col("row") == F.col("a"), "left_semi").select("row", "text"))
    both = pairs.join(texts.select(F.col("row").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2):
            sets = zip(*(shingle_hashes(batch.column(c), p.shingle) for c in (2, 3)), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y, p.similarity) for x, y in sets], pa.bool_()))

    return staged(both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"))


def _fingerprint_pairs(reps: DataFrame) -> DataFrame:
    """Pairs of rows of (row, fp) whose components are those of all links of two bits or fewer."""
    first = staged(reps.groupBy("fp").agg(F.min("row").alias("first")))
    same = reps.join(first, "fp").where("row <> first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    edges = link_fingerprints(first.select("fp"), SimHashParams())
    for c in ("a", "b"):
        edges = edges.join(first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_row")), c).drop(c)
    return same.unionByName(edges.select(F.least("a_row", "b_row").alias("a"), F.greatest("a_row", "b_row").alias("b")))


def _copies(made: DataFrame, p: NearCopyParams) -> DataFrame:
    """row, kept for featured rows that go: kept is the row of smallest doc_id in the component."""
    made = made.select(F.col("__canopy_row").alias("row"), "doc_id", "text", *(F.col(c).alias(c.removeprefix("__canopy_")) for c in _FEATURES))
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("row"))
    sets = made.groupBy("set").agg(F.min(first).alias("first"))
    rows = staged(made.select("row", "doc_id", "set").join(sets, "set").select("row", "doc_id", F.col("first.row").alias("stands")))
    again = small_or_plain(rows.where("row <> stands").select("row"), 200_000)
    docs, reps = made.select("row", "text"), made.join(again, "row", "left_anti")
    printed = _verified(_fingerprint_pairs(reps.select("row", "fp")), docs, p)
    known = printed
    for seed, hubs in enumerate(p.hubs):
        known = known.unionByName(_verified(_apart(_starred(reps, p, seed, hubs), known), docs, p))
    tokens = reps.select("row", "n", "prefix").mapInArrow(_tokens, "token long, n long, row long, place int")
    met = staged(tokens.repartition("token").sortWithinPartitions("token", "n", "row").mapInArrow(_met, "token long, n long, row long, place int"))
    roots = connected_components(known).select(F.col("node").alias("row"), F.col("root").alias("found"))
    nodes = met.join(small_or_plain(roots, 200_000), "row", "left").select("token", "n", "row", "place", F.coalesce("found", "row").alias("root"))
    dealt = _dealt(staged(nodes), p).join(reps.select("row", "parity"), "row").select("key", "n", "row", "place", "root", "part", "parity")
    pairs = dealt.repartition("key").sortWithinPartitions("key", "n", "row").mapInArrow(_pairs(p), "a long, b long")
    known = known.unionByName(_verified(_could(pairs, reps, p), docs, p))
    roots = connected_components(known).select(F.col("node").alias("stands"), "root")
    rows = rows.join(small_or_plain(roots, 200_000), "stands", "left").select("row", "doc_id", F.coalesce("root", "stands").alias("root"))
    best = rows.groupBy("root").agg(F.min(first).alias("first"))
    return rows.join(best, "root").where(F.col("row") != F.col("first.row")).select("row", F.col("first.row").alias("kept"))


def drop_near_copies(docs: DataFrame, p: NearCopyParams | None = None) -> DataFrame:
    """One row of each component of near copies, the one of smallest doc_id; all columns stay."""
    p = p or NearCopyParams()
    made = _featured(plainly_named(docs, "doc_id", "text"), p)
    dropped = staged(_copies(made, p).select(F.col("row").alias("__canopy_dropped")))
    kept = made.join(small_or_plain(dropped, 200_000), F.col("__canopy_row") == F.col("__canopy_dropped"), "left_anti")
    return named_again(kept, docs, "doc_id", "text")
