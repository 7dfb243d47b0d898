"""Nearest neighbours by largest inner product, as a join of blocks of int8 vectors with error bounds.

Vectors are rounded to int8 with a scale of their own and packed into blocks; only codes, scales and sums of steps are shuffled.  A large
block of queries meets stripes of candidate blocks, each in one task, where tiles of int8 products give every inner product up to a
bound on the rounding error.  A pair survives if its upper bound reaches the k-th best lower bound of its query, first
in its stripe and then over all; the survivors, few for each query, get their vectors by a join and are computed again in double
precision.  Nothing is lost: the result is exact.  Candidates are shuffled once for each block of queries, of about `query_bytes`.

Of equal vectors only the `neighbours + 1` smallest ids can be among a query's nearest, and only they are searched.
A vector that is null, zero or empty, or that holds a null or a value that isn't finite, takes no part, nor does a row with a
null id.  Only vectors of equal length meet.  Rows with a query's own id are no candidates of it; an id that repeats counts once,
with its best product.  Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import small_or_plain, staged


@dataclass(frozen=True)
class AnnParams:
    neighbours: int = 20
    query_every: int = 20
    #: Bytes of codes in a block of queries, in a block of candidates, and in a stripe of these, about.
    query_bytes: int = 4_000_000
    candidate_bytes: int = 262_144
    stripe_bytes: int = 16_000_000
    #: Queries whose products with a block of candidates are held at once.
    tile: int = 512
    #: Tasks over which the tiles of small inputs are spread, by smaller blocks of queries, and the least queries in these.
    tasks: int = 12
    least_queries: int = 256
    #: Bytes of queries' vectors that are sent to all tasks for the last products, at most; beyond that they are joined.
    sent_bytes: int = 16_000_000
    #: Parts into which equal vectors are dealt before the smallest ids of each are taken.
    salts: int = 32


def takes_part(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors in steps of their own scale, the scales, and the sums of absolute steps."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
    steps = np.rint(x / scale[:, None]).astype(np.int8)
    return steps, scale, np.abs(steps.astype(np.int64)).sum(axis=1)


def bounds(queries: tuple, vectors: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products of some quantised vectors with others."""
    (qs, q_scale, q_sum), (cs, c_scale, c_sum) = queries, vectors
    dim = qs.shape[1]
    kind = np.float32 if 127 * 127 * dim < 2**24 else np.float64  # holds sums of int8 products exactly
    near = (qs.astype(kind) @ cs.astype(kind).T).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scale = q_scale[:, None] * c_scale
        error = (0.5 * (q_sum[:, None] + c_sum) + dim / 4 + 1e-6) * scale + 1e-300
        near *= scale
        lower, upper = near - error, near + error
    wide = ~(np.isfinite(lower) & np.isfinite(upper))
    return np.where(wide, -np.inf, lower), np.where(wide, np.inf, upper)


_BLOCK = "block int, dim int, ids binary, plain binary, codes binary, scales binary, sums binary"


def _size(rows: DataFrame) -> tuple[int, int]:
    """Numbers of vectors and of their components."""
    return tuple(x or 0 for x in rows.agg(F.count("*"), F.sum(F.size("embedding"))).first())


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """About n blocks of (vec_id, embedding, plain), dealt evenly, as raw bytes; plain rows may set a floor."""

    def pack(table: pa.Table) -> pa.Table:
        ids, plain, dims = (table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "plain", "dim"))
        flat, ends = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.cumsum(dims)
        out = []
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            steps, scale, sums = quantised(flat[(ends[at] - d)[:, None] + np.arange(d)].astype(float))
            out.append({"block": table.column("block")[0].as_py(), "dim": int(d), "ids": ids[at].tobytes(), "plain": plain[at].astype(np.uint8).tobytes(), "codes": steps.tobytes(), "scales": scale.tobytes(), "sums": sums.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int32()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "plain", "codes", "scales", "sums"))]))

    block = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n)).cast("int")
    return staged(rows.select(block.alias("block"), F.size("embedding").alias("dim"), "vec_id", "embedding", "plain").groupBy("block").applyInArrow(pack, _BLOCK))


def _opened(table: pa.Table, n: int, dim: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Ids, plain marks and quantised vectors of a block."""
    ids, plain, codes, scales, sums = (np.frombuffer(table.column(c)[n].as_buffer(), t) for c, t in (("ids", np.int64), ("plain", np.uint8), ("codes", np.int8), ("scales", float), ("sums", np.int64)))
    return ids, plain.astype(bool), (codes.reshape(-1, dim), scales, sums)


def _survivors(p: AnnParams):  # noqa: ANN202
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        """Pairs of one block of queries and one stripe of candidates that can be among a query's k best there."""
        if not (queries.num_rows and vectors.num_rows):
            return schema.empty_table()
        dim, k = queries.column("dim")[0].as_py(), p.neighbours
        q_ids, _, q = _opened(queries, 0, dim)
        blocks = [_opened(vectors, n, dim) for n in range(vectors.num_rows)]
        out = []
        for lo in range(0, len(q_ids), p.tile):
            own = slice(lo, lo + p.tile)
            best, found = np.full((len(q_ids[own]), k), -np.inf), []
            for ids, plain, v in blocks:
                lower, upper = bounds(tuple(x[own] for x in q), v)
                self_ = q_ids[own][:, None] == ids
                told = np.hstack([best, np.where(plain & ~self_, lower, -np.inf)])
                best = np.partition(told, -k, axis=1)[:, -k:]
                i, j = np.nonzero((upper >= best.min(axis=1)[:, None]) & ~self_)
                found.append((i, ids[j], np.where(plain[j], lower[i, j], -np.inf), upper[i, j]))
            i, j, lower, upper = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = upper >= best.min(axis=1)[i]
            out.append(pa.table([pa.array(q_ids[own][i[keep]]), pa.array(j[keep]), pa.array(lower[keep]), pa.array(upper[keep])], schema=schema))
        return pa.concat_tables(out)

    return run


def _searched(rows: DataFrame, p: AnnParams) -> DataFrame:
    """The distinct (vec_id, embedding), less ids that can't be nearest as smaller ones have equal vectors; plain tells ids that don't repeat."""
    kept = rows.distinct().withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(p.salts)))
    for keys in (("embedding", "part"), ("embedding",)):
        place = F.dense_rank().over(Window.partitionBy(*keys).orderBy("vec_id"))
        kept = kept.withColumn("place", place).where(F.col("place") <= p.neighbours + 1).drop("place")
    kept = staged(kept.drop("part"))
    again = kept.groupBy("vec_id").count().where("count > 1").select("vec_id", F.lit(False).alias("plain"))
    return kept.join(small_or_plain(again, 100_000), "vec_id", "left").select("vec_id", "embedding", F.coalesce("plain", F.lit(True)).alias("plain"))


def nearest(queries: DataFrame, vectors: DataFrame, p: AnnParams | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's nearest, from rows of (vec_id, embedding) on both sides."""
    p = p or AnnParams()
    asked, all_ = (x.where(F.col("vec_id").isNotNull() & takes_part("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding") for x in (queries, vectors))
    asked, all_ = staged(asked.distinct()), staged(_searched(all_, p))
    (n_asked, q_bytes), (_, c_bytes) = _size(asked), _size(all_)
    n_blocks, stripes = (max(1, -(-c_bytes // x)) for x in (p.candidate_bytes, p.stripe_bytes))
    n_queries = max(1, -(-q_bytes // p.query_bytes), min(p.tasks // stripes, n_asked // p.least_queries))
    some, many = _blocks(asked.withColumn("plain", F.lit(True)), n_queries), _blocks(all_, n_blocks)
    left = some.withColumn("q", F.col("block")).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = many.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1)))).withColumn("stripe", F.col("block") % stripes)
    keys = ("dim", "q", "stripe")
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_survivors(p), "query_id long, vec_id long, lower double, upper double")
    by_lower, by_query = Window.partitionBy("query_id").orderBy(F.desc("lower")), Window.partitionBy("query_id")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))  # of an id that repeats
    pairs = pairs.withColumn("place", F.row_number().over(by_lower)).withColumn("floor", F.max(F.when(F.col("place") == p.neighbours, F.col("lower"))).over(by_query))
    pairs = staged(pairs.where(F.col("upper") >= F.coalesce("floor", F.lit(float("-inf")))).select("query_id", "vec_id"))
    own = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    both = pairs.join(all_.select("vec_id", F.col("embedding").alias("e")), "vec_id").join(F.broadcast(own) if 8 * q_bytes <= p.sent_bytes else own, "query_id").where(F.size("e") == F.size("q"))
    product = F.aggregate(F.zip_with("q", "e", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    found = both.select("query_id", "vec_id", product.alias("score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= p.neighbours)


def search_table(vectors: DataFrame, p: AnnParams | None = None) -> DataFrame:
    """Every row whose id is a multiple of `query_every` as a query against all others."""
    p = p or AnnParams()
    return nearest(vectors.where(F.col("vec_id") % p.query_every == 0), vectors, p)


def oracle_sql(p: AnnParams | None = None) -> str:
    p = p or AnnParams()
    return f"""
WITH v AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, max(list_inner_product(a.e, b.e)) AS score FROM v a JOIN v b ON a.vec_id % {p.query_every} = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {p.neighbours}"""
