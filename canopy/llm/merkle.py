"""A Merkle manifest of documents: a tree of digests for each source, and one more over the sources' roots.

A leaf is the SHA-256 of doc_id, source, lang, n_chars and text.  Leaves of a source ascend by doc_id (null first, equal ids by digest),
every 16 consecutive nodes hash to one of the next level until one is left, the source's subroot; subroots, ordered by source (null
first, by UTF-8 bytes), hash to the root likewise.  All of a row's siblings on the way up make its proof, so that it can be checked alone.

Each level is a window over runs of 16: lags and leads of fixed offsets, masked by the row's slot and the run's length, are its
siblings, and the first child of a run hashes its parent.  Levels shrink by 16, and proofs come down them by joins on (tree, run),
so that no key has more than 16 rows, however many a source has.  Rows are numbered within their source by sorted ranges, each of which
starts at the counts of those before it.

Odd rows.  A null column is the byte `-` of the leaf, so null differs from an empty text; a null source is a source of its own.  A null
doc_id comes first in its source.  Repeated rows are leaves of their own, with one digest and proofs of their own.  A lone row is its source's
subroot, and the root if no other source is there; its proof is empty.  An empty table has no rows and no root.  Other columns have no part
in the digests and are not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.llm.common import LOWER_AZ, UPPER_AZ, small_or_plain, staged

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column | None = None) -> Column:
    """A document's digest, if told so with another text than its own."""
    return digest(*(field(text if name == "text" and text is not None else F.col(name)) for name in FIELDS))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def fold(own: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, own, lambda d, s: digest(s["left"], d, s["right"]))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds pos, from 0 in the order within `tree`, and n, the tree's number of rows; written once.

    Ranges of (tree, order) are sorted apart, rows that are equal there may be dealt to several; only counts by range and tree meet.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie")]
    rows = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    made = staged(dealt.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    counts = made.groupBy("tree", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    tree = Window.partitionBy("tree")
    earlier = tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_start"), F.sum("_n").over(tree).alias("n"))
    out = made.join(small_or_plain(staged(starts), 200_000), ["tree", "_range"])
    return out.withColumn("pos", F.col("_at") + F.col("_start")).drop("_range", "_at", "_start")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds run, and the digests of the run's nodes before (left) and after (right), to nodes of (tree, pos, n, digest)."""
    nodes = nodes.withColumn("run", F.floor(F.col("pos") / FANOUT))
    slot, length = F.col("pos") % FANOUT, F.least(F.lit(FANOUT), F.col("n") - F.col("run") * FANOUT)
    runs = Window.partitionBy("tree", "run").orderBy("pos")
    before = [F.when(slot >= k, F.lag("digest", k).over(runs)) for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("digest", k).over(runs)) for k in range(1, FANOUT)]
    return nodes.withColumns({"left": F.concat_ws("", *before), "right": F.concat_ws("", *after)})


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of (tree, pos, n, digest) and all levels above them; a tree ends at the level where it has one node."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = with_siblings(out[-1]).where((F.col("n") > 1) & (F.col("pos") % FANOUT == 0))
        parent = digest(F.col("digest"), F.col("right")).alias("digest")
        out.append(staged(first.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FANOUT).alias("n"), parent)))
        most = -(-most // FANOUT)
    return out


def with_paths(made: list[DataFrame], above: DataFrame) -> DataFrame:
    """Adds top, the tree's last digest, and path, the siblings from a node up, to the nodes of the lowest level.

    `above` has (tree, path) of what lies above whole trees.
    """
    known: DataFrame | None = None  # (tree, run, top, path) of the parents
    for at in range(len(made) - 1, -1, -1):
        ends = made[at].where("n = 1").select("tree", F.col("pos").alias("run"), F.col("digest").alias("top"))
        ends = ends.join(above, "tree").select("tree", "run", "top", "path")
        parents = ends if known is None else known.unionByName(ends)
        own = F.array(F.struct("left", "right"))
        rows = with_siblings(made[at]).join(parents.withColumnRenamed("path", "_path"), ["tree", "run"])
        rows = rows.withColumn("path", F.when(F.col("n") > 1, F.concat(own, "_path")).otherwise(F.col("_path"))).drop("_path", "left", "right", "run")
        if at == 0:
            return rows
        known = staged(rows.select("tree", F.col("pos").alias("run"), "top", "path"))
    raise ValueError("no levels")


def manifest(docs: DataFrame, **extra: Column) -> DataFrame:
    """doc_id, source, position, leaf, path (siblings by level, those of the source's levels first), subroot, root for each document.

    `extra` names more columns to work out from the documents and carry along.
    """
    spark = docs.sparkSession
    # The names of sources as trees: `-` for null sorts before all that start with `:`.
    tree = F.coalesce(F.concat(F.lit(":"), "source"), F.lit("-")).alias("tree")
    rows = docs.select("doc_id", "source", tree, leaf().alias("digest"), *(c.alias(n) for n, c in extra.items()))
    made = levels(numbered(rows, ["doc_id", "digest"]))
    tops = made[0].where("n = 1").select("tree", "digest")
    for nodes in made[1:]:
        tops = tops.unionByName(nodes.where("n = 1").select("tree", "digest"))
    sources = levels(numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]))
    root = sources[-1].select("digest").first()
    named = staged(with_paths(sources, _no_path(spark)).select(F.col("name").alias("tree"), "path"))
    out = with_paths(made, named)
    return out.select("doc_id", "source", F.col("pos").alias("position"), F.col("digest").alias("leaf"), "path", F.col("top").alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root"), *extra)


def _no_path(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("").alias("tree"), F.array().cast(_PATH).alias("path"))


def tampered_leaf() -> Column:
    """The leaf with A to Z lower-cased in the text where 5 divides the id's checksum, else null."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(changed, leaf(F.translate("text", UPPER_AZ, LOWER_AZ)))


def check_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: whether tampering with a fifth of the texts shows."""
    told = manifest(docs, tampered=tampered_leaf())
    folded = fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root")
    out = told.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), folded)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    """The check in DuckDB: levels are unrolled, eight of them for a source, so for up to 16^8 rows; checksums go byte by byte."""
    depth = 8
    fields = lambda text: " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in (*FIELDS[:-1], text))
    crc = "list_reduce(list_prepend(4294967295::BIGINT, [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda a, b: xor(a // 256, t.table_[CAST(xor(a % 256, b) AS INTEGER) + 1]))"
    entry = "list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)"
    lower = f"translate(text, '{UPPER_AZ}', '{LOWER_AZ}')"
    sql = f"""WITH t AS (SELECT list(e ORDER BY i) AS table_ FROM (SELECT i, {entry} AS e FROM (SELECT unnest(range(256)) AS i))),
docs AS (SELECT doc_id, coalesce(':' || source, '-') AS tree, sha256({fields("text")}) AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295::BIGINT) % 5 = 0 THEN sha256({fields(lower)}) END AS changed FROM documents, t),
d0 AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs)"""
    for k in range(depth):  # a tree of one node goes up unchanged
        sql += f""",
d{k + 1} AS (SELECT tree, pos // 16 AS pos, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM d{k} GROUP BY tree, pos // 16)"""
    sql += f""",
s0 AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM d{depth})"""
    for k in range(depth):
        sql += f""",
s{k + 1} AS (SELECT pos // 16 AS pos, (max(n) + 15) // 16 AS n, CASE WHEN max(n) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM s{k} GROUP BY pos // 16)"""
    sides = "coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY {0} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY {0} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r"
    joins, siblings = "", []
    for k in range(depth):
        sql += f", p{k} AS (SELECT tree, pos, n, {sides.format('tree, pos // 16')} FROM d{k}), q{k} AS (SELECT pos, n, {'tree, ' * (k == 0)}{sides.format('pos // 16')} FROM s{k})"
        at = f"d0.pos // {16**k}"
        joins += f" JOIN p{k} ON p{k}.tree = d0.tree AND p{k}.pos = {at}"
        siblings.append(f"p{k}")
    for k in range(depth):
        joins += f" JOIN q{k} ON " + ("q0.tree = d0.tree" if k == 0 else f"q{k}.pos = q0.pos // {16**k}")
        siblings.append(f"q{k}")
    steps = "SELECT d0.doc_id, d0.leaf, d0.tree, coalesce(d0.changed, d0.leaf) AS f_0, " + " || ".join(f"{s}.l || {s}.r" for s in siblings) + " AS proof, " + ", ".join(f"{s}.l AS l_{i}, {s}.r AS r_{i}, {s}.n AS n_{i}" for i, s in enumerate(siblings)) + f" FROM d0{joins}"
    sql += f", f0 AS ({steps})"
    for i in range(len(siblings)):
        sql += f", f{i + 1} AS (SELECT * EXCLUDE (f_0), CASE WHEN n_{i} = 1 THEN f_0 ELSE sha256(l_{i} || f_0 || r_{i}) END AS f_0 FROM f{i})"
    sql += f"""
SELECT f.doc_id, f.leaf, top.digest AS subroot, root.digest AS root, sha256(f.proof) AS proof_sha256, f.f_0 AS folded_root, f.f_0 = root.digest AS verified
FROM f{len(siblings)} f JOIN d{depth} top ON top.tree = f.tree, s{depth} root"""
    return sql
