"""A persistent index: Parquet tables that later jobs append to and search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neartag.functions.text import Analyzer
from neartag.operators.index import (
    Index, build_corpus_stats, build_docs, build_term_stats, pin_totals, postings_of)

DOCS = ("corpus string, id long, tags string, doc_len long, "
        "terms array<struct<term: string, tf: long>>")
TERM_STATS = "term string, df long, ttf long, max_tf long, min_len long"
CORPUS_STATS = "n_docs long, sum_ttf long, avgdl double"


def read_index(spark: SparkSession, path: str) -> Index:
    """The stored tables.  Docs are partitioned by corpus, so a corpus filter skips files."""
    def table(name: str, columns: str) -> DataFrame:
        return spark.read.schema(columns).parquet(f"{path}/{name}")
    return pin_totals(Index(table("docs", DOCS), table("term_stats", TERM_STATS),
                            table("corpus_stats", CORPUS_STATS)))


def write_index(df: DataFrame, path: str, analyzer: str | Analyzer = "standard",
                text_col: str = "text", mode: str = "append") -> Index:
    """Add the rows (corpus, id, tags, text) to the index at ``path``.

    ``mode="overwrite"`` replaces the corpora that occur in ``df`` and no others, so a
    failed run can be repeated.  The statistics are then counted anew over all corpora.
    """
    spark = df.sparkSession
    (build_docs(df, analyzer, text_col).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(f"{path}/docs"))
    docs = spark.read.schema(DOCS).parquet(f"{path}/docs")
    # In term order, so that a filter on terms skips files and row groups.
    (build_term_stats(postings_of(docs)).repartitionByRange("term").sortWithinPartitions("term")
     .write.mode("overwrite").parquet(f"{path}/term_stats"))
    build_corpus_stats(docs).write.mode("overwrite").parquet(f"{path}/corpus_stats")
    return read_index(spark, path)


# --- an index of segments ----------------------------------------------------------------
#
# segments/<name>/docs, term_stats, corpus_stats   written once and never changed
# manifest/<version>                               the names of the segments of a version

def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path and the class of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the last published version; 0 for none."""
    fs, make = _files(spark, path)
    folder = make(f"{path}/manifest")
    if not fs.exists(folder):
        return 0
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=0)


def segments_of(spark: SparkSession, path: str, version: int) -> list[str]:
    """The segments of a version, oldest first."""
    if version == 0:
        return []
    return [r.value for r in spark.read.text(f"{path}/manifest/{version:08d}").collect() if r.value]


def publish(spark: SparkSession, path: str, version: int, names: list[str]) -> None:
    """Make a version visible by one rename; an error if someone else has published it meanwhile."""
    fs, make = _files(spark, path)
    target, draft = make(f"{path}/manifest/{version:08d}"), make(f"{path}/manifest/_draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray("\n".join(names).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {version} of the index was published by another job; append again")


def read_segments(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """A version of the index, the last one unless told otherwise.

    The segments of a version never change, so an index that was read stays what it is while
    others are published.  Counts of segments are added, extremes compared: no document is read.
    """
    names = segments_of(spark, path, latest_version(spark, path) if version is None else version)
    if not names:
        raise ValueError(f"no index at {path}")

    def table(name: str, columns: str) -> DataFrame:
        return spark.read.schema(columns).parquet(*[f"{path}/segments/{s}/{name}" for s in names])

    term_stats = table("term_stats", TERM_STATS).groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("ttf").alias("ttf"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
    totals = table("corpus_stats", CORPUS_STATS).agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_ttf").alias("sum_ttf"))
    average = F.when(F.col("sum_ttf") <= 0, F.lit(1.0)).otherwise(F.col("sum_ttf") / F.col("n_docs"))
    return pin_totals(Index(table("docs", DOCS), term_stats, totals.withColumn("avgdl", average)))


def write_segment(docs: DataFrame, path: str, term_stats: DataFrame | None = None) -> str | None:
    """Write docs and their statistics as a new segment; its name, or None if there are none.

    ``term_stats`` of just these docs are counted, unless they are known.
    """
    spark, name = docs.sparkSession, uuid.uuid4().hex
    folder = f"{path}/segments/{name}"
    docs.write.option("compression", "zstd").parquet(f"{folder}/docs")
    written = spark.read.schema(DOCS).parquet(f"{folder}/docs")
    if written.isEmpty():
        fs, make = _files(spark, path)
        fs.delete(make(folder), True)
        return None
    stats = build_term_stats(postings_of(written)) if term_stats is None else term_stats
    stats.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/term_stats")
    build_corpus_stats(written).write.parquet(f"{folder}/corpus_stats")
    return name


def append_segment(df: DataFrame, path: str, analyzer: str | Analyzer = "standard", text_col: str = "text") -> int:
    """Add the rows (corpus, id, tags, text) that the index does not have yet; the version that has them.

    Only new rows are analysed and counted.  Rows whose corpus and id are known are refused, so
    an append that is repeated, or was cut off before it was published, can be run again.  A
    version becomes visible as a whole or not at all.  Ids are unique in ``df``.
    """
    spark = df.sparkSession
    version = latest_version(spark, path)
    names = segments_of(spark, path, version)
    if names:
        known = read_segments(spark, path, version).docs.select("corpus", "id")
        df = df.join(known, ["corpus", "id"], "left_anti")
    name = write_segment(build_docs(df, analyzer, text_col), path)
    if name is None:
        return version
    publish(spark, path, version + 1, [*names, name])
    return version + 1


def merge_segments(spark: SparkSession, path: str) -> int:
    """Put all segments of the last version into one; the version that has it.

    Texts are not needed: docs are copied, and the counts of the segments added.  Files of older
    versions stay for their readers.
    """
    version = latest_version(spark, path)
    if len(segments_of(spark, path, version)) < 2:
        return version
    index = read_segments(spark, path, version)
    name = write_segment(index.docs, path, index.term_stats)
    publish(spark, path, version + 1, [name])
    return version + 1
