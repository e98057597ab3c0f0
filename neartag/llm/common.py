"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string; every other column is left behind."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_version(docs: DataFrame) -> DataFrame:
    """doc_id, text and version, a hash that tells rows of one doc_id apart."""
    return id_and_text(docs).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))


def chosen(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of documents that ``rows`` (doc_id, version) name (``left_semi``) or do not name (``left_anti``)."""
    marked = docs.withColumn("__version", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = rows.select(F.col("doc_id").alias("__id"), F.col("version").alias("__named")).distinct()
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("__id")) & (F.col("__version") == F.col("__named"))
    return marked.join(named, same, how).select(docs.columns)


def remainder(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


class Memo(dict):
    """A memory of at most ``2 * limit`` results of a function, the older half dropped at once.

    Keys over 64 characters are computed each time, so the memory is bounded in bytes too.
    """

    def __init__(self, function: Callable, limit: int = 200_000) -> None:
        super().__init__()
        self.function, self.limit, self.old = function, limit, {}

    def keep(self, key, value) -> None:
        if len(key) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self.keep(key, value)
        return value


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, which bounds what a task holds as Python objects."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand texts to Python in batches of some megabytes at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def batches_by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables of whole groups with the bounds of each, from batches sorted by ``keys``.

    A group that runs on into the next batch is carried over, so memory holds a batch and
    one group.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> np.ndarray:
        changes = np.zeros(max(len(table) - 1, 0), bool)
        for key in keys:
            column = table[key].to_numpy()
            changes |= column[1:] != column[:-1]
        return np.flatnonzero(changes) + 1

    def whole(table: pa.Table, edges: np.ndarray) -> tuple[pa.Table, list[tuple[int, int]]]:
        starts = np.concatenate(([0], edges))
        return table, list(zip(starts.tolist(), np.append(starts[1:], len(table)).tolist()))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        edges = cut(table := pa.Table.from_batches(held))
        if len(edges):
            last = int(edges[-1])
            yield whole(table.slice(0, last), edges[:-1])
            held = table.slice(last).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield whole(table, cut(table))
