"""Connected components of a graph held in a table, by rounds of hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import staged


def _lookup(df: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """Replaces a column's nodes by their parents, where they have one."""
    to = parents.select(F.col("node").alias("_node"), F.col("parent").alias("_parent"))
    joined = df.join(to, F.col(column) == F.col("_node"), "left")
    return joined.withColumn(column, F.coalesce("_parent", F.col(column))).drop("_node", "_parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (a, b); root is the smallest node of its component.

    In each round every node hooks to the smallest of itself and its neighbours, chains are shortened, and edges move to the
    parents; edges within one parent go.  What remains shrinks by a factor each round, whatever the components' sizes.
    """
    rest = staged(_ordered(edges))
    found: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).withColumn("parent", F.least("node", "parent")))
        parents = staged(_lookup(_lookup(parents, "parent", parents), "parent", parents))
        # Contraction makes no new nodes: the first round has them all.
        found = staged(_lookup(found, "root", parents)) if found is not None else parents.withColumnRenamed("parent", "root")
        rest = staged(_ordered(_lookup(_lookup(rest, "a", parents), "b", parents)))
    return found if found is not None else rest.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
