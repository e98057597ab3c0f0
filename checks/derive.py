"""Question tables derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neartag.operators.prepare import append_corpus, with_corpus
from neartag.sources.tables import read_table

RANGE_ROWS = 10_000
ALL_FIELDS = "title || ' ' || body || ' ' || code || ' ' || links"


def _questions(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.split_part("body", F.lit("\n"), F.lit(1)).alias("title"), "body",
                       F.lit("").alias("code"), F.lit("").alias("links"), "tags")


def ranges(rows: DataFrame) -> int:
    """Parts that texts are dealt into before they are analysed: the given files hold one row group each.

    As many for every core; more for many rows, so that what a task holds does not grow with the table.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-rows.count() // (RANGE_ROWS * cores)))


def deal(rows: DataFrame, key: str) -> DataFrame:
    """Rows in parts by the hash of the key; a join by that key then moves no text again."""
    return rows.repartition(ranges(rows), key)


def train(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Documents as tagged questions; ``dealt`` puts them into parts that suit analysis (``deal``)."""
    docs, labels = (read_table(spark, sf_dir, name) for name in ("documents", "labels"))
    if dealt:
        docs = deal(docs, "doc_id")
    mark = F.concat(
        F.when(F.col("quality") == 1, " good").when(F.col("quality") == 0, " bad").otherwise(""),
        F.when(F.col("toxic") == 1, " toxic").when(F.col("toxic") == 0, " clean").otherwise(""))
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.col("text").alias("body"),
        F.concat("lang", F.lit(" "), "source", mark).alias("tags"))
    return with_corpus(_questions(rows), "train")


def test(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Benchmark items as untagged questions."""
    items = read_table(spark, sf_dir, "benchmark")
    rows = (deal(items, "item_id") if dealt else items).select(
        F.col("item_id").alias("id"), F.col("text").alias("body"), F.lit("").alias("tags"))
    return with_corpus(_questions(rows), "test")


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as a third corpus."""
    rows = read_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("body"),
        F.col("role").alias("tags"))
    return with_corpus(_questions(rows), "chat")


def both(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return append_corpus(train(spark, sf_dir, dealt), test(spark, sf_dir, dealt))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.col("html").alias("body"))


def code_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: the text, nested code, code in a link and a link in code."""
    rows = train(spark, sf_dir)
    text, tags, title = (
        F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        for c in ("body", "tags", "title"))
    number = F.col("id").cast("string")
    return rows.select("id", F.concat(
        F.lit("<html><body><p>"), text, F.lit("</p><pre><code>"), tags, F.lit(" <code>"), number, F.lit('</code></code></pre><p>see <a href="/q">'),
        title, F.lit("<code>"), tags, F.lit('</code> here</a> and <code>in <a href="/c">code</a></code></p></body></html>')).alias("body"))


def as_queries(questions: DataFrame, text: str = "body") -> DataFrame:
    return questions.select(F.col("id").alias("query_id"), F.expr(text).alias("text"))


def held_out(questions: DataFrame) -> DataFrame:
    """Every tenth question; the others train."""
    return questions.filter(F.col("id") % 10 == 0)


def kept(questions: DataFrame) -> DataFrame:
    return questions.filter(F.col("id") % 10 != 0)
