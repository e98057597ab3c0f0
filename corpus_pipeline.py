"""A training corpus from raw documents: the stages and their order.

Language ID, line dedup, near-dedup, decontamination, tokens.  A stage reads all rows its
predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neartag.llm import bpe, decontaminate, langid, lines, simhash
from neartag.llm.common import small_batches
from neartag.llm.queries import benchmark_items, vocabulary
from neartag.plans.shipping import ship_package
from neartag.plans.staging import Staging

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def prepare(spark: SparkSession) -> None:
    ship_package(spark)
    small_batches(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; ``lang`` becomes the language found.

    Texts that are null, have no letter, or fit two languages about equally well go.
    """
    prepare(spark)
    model = langid.fit(docs, F.lit(True))
    judged = langid.predict(docs, model, keep=("source", "n_chars"))
    return judged.filter(~F.col("rejected")).withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that several documents share stay in the last of them only."""
    prepare(spark)
    kept = lines.apply_bitmaps(docs.select(*COLUMNS), lines.keep_bitmaps(docs, Staging(spark)))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Near copies are those of operator 5: fingerprints over four-word shingles that differ in at
    most 4 bits.  Of rows equal in doc_id and text, one stays.
    """
    prepare(spark)
    staging = Staging(spark)
    found = simhash.near_duplicates(docs, staging, shingle=4, distance=4)
    # Equal keys throughout, so the texts are shuffled once.
    named = (F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("id"), "version")
    rows = docs.select(*COLUMNS).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.select("*", *named[:2]).join(simhash.representatives(found).select(*named), ["named", "id", "version"])
    one = kept.groupBy("named", "id", "version").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct(*COLUMNS[2:])).alias("rest"))
    return one.select("doc_id", "text", "rest.*").select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    prepare(spark)
    leaks = decontaminate.find_leaks(docs, benchmark_items(spark, sf_dir))
    return decontaminate.drop_leaks(docs.select(*COLUMNS), leaks)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of the decoded text."""
    prepare(spark)
    return bpe.round_trip(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("BPE tokens", encode_tokens),
]

# The stages cannot be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    staging = Staging(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staging.write(docs, f"stage-{number}")
    return docs
