"""Helpers shared by the training-data operators: scratch tables, row identity, tokens and table access."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = re.compile("[^\x20\x09-\x0d]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: str) -> str:
    """Lower-cases A to Z and nothing else."""
    return text.lower() if text.isascii() else text.translate(_LOWER)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower_az(text)) if text else []


@dataclass(frozen=True)
class TokenBatch:
    """The words of some texts: a number for each, the numbers of words of each text, and the distinct words."""

    ids: np.ndarray
    sizes: np.ndarray
    words: pa.StringArray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)


def tokenise(column: pa.Array) -> TokenBatch:
    """The words of a column of texts, A to Z lower-cased, as `words` gives them; null texts have none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    sizes = np.asarray(pc.list_value_length(split), np.int64)
    coded = split.flatten().dictionary_encode()
    ids, found = np.asarray(coded.indices, np.int32), coded.dictionary
    blank = pc.index(found, "").as_py()  # beside white space at either end
    if blank >= 0:
        keep = ids != blank
        owner = np.repeat(np.arange(len(sizes)), sizes)[keep]
        ids, sizes = ids[keep], np.bincount(owner, minlength=len(sizes))
        ids = np.where(ids > blank, ids - 1, ids).astype(np.int32)
        found = pa.concat_arrays([found[:blank], found[blank + 1 :]])
    return TokenBatch(ids, sizes, found)


def sums_by(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive groups of the given sizes, which may be 0."""
    out = np.zeros(len(sizes), np.float64 if values.dtype.kind == "f" else np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], dtype=out.dtype)
    return out


def binaries(flat: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Consecutive groups of an array as raw bytes."""
    ends = np.concatenate(([0], np.cumsum(sizes))) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def from_binaries(column: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column that `binaries` made, and the sizes of its groups."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    width = np.dtype(kind).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, kind, (ends[-1] - ends[0]) // width, ends[0]) if data is not None and ends[-1] > ends[0] else np.zeros(0, kind)
    return flat, np.diff(ends) // width


def give_back() -> None:
    """Returns freed memory to the system; workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str | int, most_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded text, one row at least."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def plainly_named(docs: DataFrame, *needed: str) -> DataFrame:
    """The same rows with plain names for all columns but those needed, so that any names may come in; `named_again` undoes it."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    return docs.select(*(F.col(quoted(c)).alias(c if c in needed else f"_c{i}") for i, c in enumerate(docs.columns)))


def named_again(rows: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    return rows.select(*(F.col(c if c in needed else f"_c{i}").alias(c) for i, c in enumerate(docs.columns)))


def fold(key: str, modulus: int) -> Column:
    """crc32 of a column's text form, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds an id for each row.

    The ids hold within one job only: another job over the same rows may number them otherwise, as its partitions may be others.
    What is joined by them later must be written with them once, by `staged`.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


@lru_cache(1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-canopy-", dir="/tmp")


@lru_cache(8)
def _scratch_root(spark: SparkSession, root: str) -> str:
    """This session's folder below the shared one; it goes when the driver's JVM ends."""
    path = f"{root.rstrip('/')}/canopy-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path(path)
    files = made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(made)
    files.deleteOnExit(made)
    return path


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.  Only a local master, as in tests, may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_dir()
    return f"{_scratch_root(spark, root)}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared scratch folder and reads them again: cuts lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, most_rows: int) -> bool:
    """Whether a table has at most so many rows; reads no more than that many and one."""
    return df.limit(most_rows + 1).count() <= most_rows


def small_or_plain(df: DataFrame, most_rows: int) -> DataFrame:
    """Marks a table for broadcast if its checked row count allows that, else leaves the join to Spark."""
    return F.broadcast(df) if is_small(df, most_rows) else df
