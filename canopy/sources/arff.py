"""ARFF as a source and a sink: the header is read on the driver, the rows are parsed by column expressions.

Dense and sparse rows, `%` comments, blank lines, keywords in any case, single-quoted attribute names, and `.gz` by suffix.  Attributes
in braces are categorical, all others numeric; the last one is the label.  A number that can't be read is 0, an unknown category has
ordinal 0, both are null with `missing="null"`, a `?` label is null; labels get ids by first appearance.  Rows with too few columns go, and `corrupt_rows` gives them.
Row ids follow the order of lines within a file and of files by name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopy.operators.preprocess import label_dictionary, number_or_zero, ordinal

_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|\S+)\s+(.*)", re.IGNORECASE)


@dataclass(frozen=True)
class Attribute:
    name: str
    #: None: numeric.
    categories: tuple[str, ...] | None


@dataclass(frozen=True)
class ArffSchema:
    attributes: tuple[Attribute, ...]

    @property
    def features(self) -> tuple[Attribute, ...]:
        return self.attributes[:-1]


def parse_header(lines: list[str]) -> ArffSchema:
    out = []
    for line in map(str.strip, lines):
        if line.lower().startswith("@data"):
            break
        if m := _ATTRIBUTE.match(line):
            kind = m[2].strip()
            categories = tuple(c.strip() for c in kind.strip("{}").split(",")) if kind.startswith("{") else None
            out.append(Attribute(m[1].strip("'"), categories))
    if not out:
        raise ValueError("no @attribute lines before @data")
    return ArffSchema(tuple(out))


def read_header(spark: SparkSession, path: str) -> ArffSchema:
    """The schema of a file, however many attributes it has; only its lines of declarations come to the driver."""
    return parse_header([r["value"] for r in spark.read.text(path).where(F.trim("value").startswith("@")).collect()])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """_file, _block, _at (order within it) and line for each row of data.

    A file's data begin after its line `@data`, or with the first line that isn't a declaration; from there on a line may begin with `@`.
    """
    text = spark.read.text(path).select(F.btrim("value", F.lit(" \t\r\x0b\x0c")).alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    text = text.where((F.col("line") != "") & ~F.col("line").startswith("%"))
    head = F.lower(F.substring("line", 1, 5)) == "@data"
    starts = text.where(~F.col("line").startswith("@") | head).groupBy("_file").agg(F.min(F.struct("_block", F.col("_at"), head.alias("head"))).alias("_start"))
    here, start = F.struct("_block", F.col("_at"), F.lit(False).alias("head")), F.col("_start")
    return text.join(F.broadcast(starts), "_file").where((here > start) | ((here == start) & ~start["head"])).drop("_start")  # one row a file


def _dense(schema: ArffSchema) -> Column:
    return F.transform(F.split("line", ","), lambda c: F.trim(c))


def _sparse(schema: ArffSchema) -> Column:
    """Values of a sparse row by place, "0" where it has none; the label's place has none then."""
    inner = F.regexp_replace("line", r"^\{\s*|\s*\}$", "")
    pairs = F.filter(F.transform(F.split(inner, ","), lambda p: F.split(F.trim(p), r"\s+", 2)), lambda p: F.size(p) == 2)
    places, n = F.transform(pairs, lambda p: p[0].try_cast("int")), len(schema.attributes)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.coalesce(F.get(pairs, F.array_position(places, i).cast("int") - 1)[1], F.when(i == n - 1, F.lit("?")).otherwise(F.lit("0"))))


def _cells(spark: SparkSession, path: str, schema: ArffSchema) -> DataFrame:
    empty = F.array(*([F.lit("0")] * len(schema.features)), F.lit("?"))
    sparse = F.when(F.col("line").rlike(r"\S+\s+\S+"), _sparse(schema)).otherwise(empty)
    return _lines(spark, path).withColumn("cells", F.when(F.col("line").startswith("{"), sparse).otherwise(_dense(schema)))


def corrupt_rows(spark: SparkSession, path: str) -> DataFrame:
    schema = read_header(spark, path)
    return _cells(spark, path, schema).where(F.size("cells") < len(schema.attributes)).select("line")


def read_arff(spark: SparkSession, path: str, missing: str = "zero") -> DataFrame:
    """instance_id, features, label (null where `?`), raw_label.  With `missing="null"` what can't be read is a null feature."""
    if missing not in ("zero", "null"):
        raise ValueError(f"unknown way with missing values {missing!r}")
    schema = read_header(spark, path)
    rows = _cells(spark, path, schema).where(F.size("cells") >= len(schema.attributes))
    values = []
    for i, a in enumerate(schema.features):
        cell = F.element_at("cells", i + 1)
        if missing == "null":
            known = F.array_position(F.lit(list(a.categories)), cell) - 1 if a.categories is not None else cell.try_cast("double")
            values.append(F.when(known >= 0, known.cast("double")) if a.categories is not None else known)
            continue
        values.append(ordinal(cell, list(a.categories)) if a.categories is not None else number_or_zero(cell))
    label = F.element_at("cells", len(schema.attributes))
    rows = rows.select("_file", "_block", F.array(*values).alias("features"), F.when(label != "?", label).alias("raw_label"), F.monotonically_increasing_id().alias("_id"))
    # Dense ids: the rows that are left of a file's block follow each other, after those of the blocks before; the counts have one row a block.
    counts = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    earlier = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_file", "_block", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_before"))
    numbered = rows.join(before, ["_file", "_block"]).select((F.col("_before") + F.col("_id")).alias("instance_id"), "features", "raw_label")
    ids = label_dictionary(numbered, "raw_label", "instance_id")
    return numbered.join(ids, F.col("raw_label") == F.col("label"), "left").select("instance_id", "features", F.col("label_id").cast("int").alias("label"), "raw_label")


def write_arff(instances: DataFrame, path: str, relation: str, names: list[str], n_classes: int) -> None:
    """Header and dense rows as text, in one file and in order of id; for results of a size that one file can hold."""
    header = [f"@relation {relation}", *(f"@attribute '{n}' numeric" for n in names), f"@attribute class {{{','.join(map(str, range(n_classes)))}}}", "@data"]
    head = instances.sparkSession.createDataFrame([(i - len(header), x) for i, x in enumerate(header)], "at long, value string")
    line = F.concat_ws(",", F.transform("features", lambda x: x.cast("string")), F.coalesce(F.col("label").cast("string"), F.lit("?")))
    body = instances.select(F.col("instance_id").alias("at"), line.alias("value"))
    head.unionByName(body).repartition(1).sortWithinPartitions("at").select("value").write.text(path)
