"""Postings and term statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neartag.functions.text import Analyzer, get_analyzer
from neartag.operators.tokens import pack_terms, unpack_terms


@dataclass(frozen=True)
class Index:
    """The tables a search needs.

    docs          corpus, id, tags, doc_len, terms  (array of term, tf)
    term_stats    term, df, ttf, max_tf, min_len  (over all corpora)
    corpus_stats  one row: n_docs, sum_ttf, avgdl (over all corpora)

    ``n_docs`` and ``avgdl`` are set once the totals are known on the driver, ``seed`` once one is
    known under which all terms have different keys.

    A document is one row, so a single narrow pass over the texts makes the docs table;
    readers of tags or lengths do not touch the terms column.
    """

    docs: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    n_docs: int | None = None
    avgdl: float | None = None
    seed: int | None = None

    key_columns = ("term",)

    @property
    def postings(self) -> DataFrame:
        """corpus, id, term, tf, doc_len."""
        return postings_of(self.docs)

    @property
    def term_keys(self) -> DataFrame:
        """What a search tells terms apart by."""
        return self.term_stats.select("term")


@dataclass(frozen=True)
class FieldIndex:
    """An index whose terms are counted by field.

    docs          corpus, id, tags, lengths (array of field, doc_len),
                  postings (array of field, term, tf, doc_len of the field)
    field_stats   field, term, df, ttf  (over all corpora)
    field_totals  field, n_docs, sum_ttf, avgdl
    """

    docs: DataFrame
    fields: tuple[str, ...]
    field_stats: DataFrame
    field_totals: DataFrame
    n_docs: int | None = None
    seed: int | None = None

    key_columns = ("field", "term")

    @property
    def term_stats(self) -> DataFrame:
        """term, df, top_field: the field that most documents have the term in."""
        return multi_field_stats(self.field_stats, list(self.fields))

    @property
    def term_keys(self) -> DataFrame:
        return self.field_stats.select("field", "term")

    @property
    def corpus_stats(self) -> DataFrame:
        return self.field_totals.agg(F.max("n_docs").alias("n_docs"))

    def averages(self) -> dict[str, float]:
        """Average length of each field; a row per field comes to the driver."""
        return {r.field: r.avgdl for r in self.field_totals.collect()}


def build_docs(df: DataFrame, analyzer: str | Analyzer = "standard",
               text_col: str = "text") -> DataFrame:
    """The docs table of an index; (corpus, id) is unique.  Nothing is shuffled."""
    tokens = get_analyzer(analyzer)(F.col(text_col))
    return (pack_terms(df, tokens, ("corpus", "id", "tags"))
            .select("corpus", "id", "tags", F.col("n_tokens").alias("doc_len"), "terms"))


def postings_of(docs: DataFrame) -> DataFrame:
    """corpus, id, term, tf, doc_len: one row per document and term."""
    return unpack_terms(docs, ("corpus", "id", "doc_len")).select(
        "corpus", "id", "term", "tf", "doc_len")


def build_term_stats(postings: DataFrame) -> DataFrame:
    """df and ttf of every term, with the extremes that bound its scores."""
    return postings.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("ttf"),
        F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"))


def doc_freq(postings: DataFrame) -> DataFrame:
    """term, df: documents of all corpora that contain the term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def term_totals(postings: DataFrame) -> DataFrame:
    """ttf, term: total frequency of every term, most frequent first."""
    return (postings.groupBy("term").agg(F.sum("tf").alias("ttf"))
            .select("ttf", "term").orderBy(F.desc("ttf"), "term"))


def build_corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, sum_ttf and the average document length (1 if nothing is indexed)."""
    total = F.coalesce(F.sum("doc_len"), F.lit(0))
    return docs.agg(F.count("*").alias("n_docs"), total.alias("sum_ttf")).select(
        "n_docs", "sum_ttf",
        F.when(F.col("sum_ttf") <= 0, F.lit(1.0))
        .otherwise(F.col("sum_ttf") / F.col("n_docs")).alias("avgdl"))


def build_index(df: DataFrame, text_col: str = "text",
                analyzer: str | Analyzer = "standard") -> Index:
    """Index a table with columns corpus, id, tags and a text column."""
    docs = build_docs(df, analyzer, text_col)
    return Index(docs, build_term_stats(postings_of(docs)), build_corpus_stats(docs))


def build_field_docs(df: DataFrame, fields: Sequence[str], analyzer: str | Analyzer = "standard") -> DataFrame:
    """The docs table of a ``FieldIndex``; a narrow job, each field analysed apart."""
    analyze = get_analyzer(analyzer)
    docs = df.select("corpus", "id", "tags", *fields)
    for field in fields:
        docs = pack_terms(docs, analyze(F.col(field)), tuple(docs.columns)).withColumnsRenamed(
            {"n_tokens": f"_len_{field}", "terms": f"_terms_{field}"})

    def entries(field: str) -> Column:
        return F.transform(f"_terms_{field}", lambda t: F.struct(
            F.lit(field).alias("field"), t.term.alias("term"), t.tf.alias("tf"), F.col(f"_len_{field}").alias("doc_len")))

    lengths = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_len_{f}").alias("doc_len")) for f in fields])
    return docs.select("corpus", "id", "tags", lengths.alias("lengths"), F.concat(*map(entries, fields)).alias("postings"))


def field_index(docs: DataFrame, fields: Sequence[str]) -> FieldIndex:
    """Statistics by field of a docs table with fields."""
    postings = docs.select(F.inline("postings"))
    stats = postings.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
    totals = docs.select(F.inline("lengths")).groupBy("field").agg(
        F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("sum_ttf"))
    average = F.when(F.col("sum_ttf") <= 0, F.lit(1.0)).otherwise(F.col("sum_ttf") / F.col("n_docs"))
    return FieldIndex(docs, tuple(fields), stats, totals.withColumn("avgdl", average))


def pin_totals(index: Index | FieldIndex) -> Index | FieldIndex:
    """Read the one row of corpus totals and put it into later plans as literals."""
    if isinstance(index, FieldIndex):
        return replace(index, n_docs=index.corpus_stats.first().n_docs or 0)
    totals = index.corpus_stats.select("n_docs", "sum_ttf", "avgdl").first().asDict()
    row = index.docs.sparkSession.sql(
        "SELECT CAST(:n_docs AS BIGINT) AS n_docs, CAST(:sum_ttf AS BIGINT) AS sum_ttf, "
        "CAST(:avgdl AS DOUBLE) AS avgdl", args=totals)
    return replace(index, corpus_stats=row, n_docs=totals["n_docs"], avgdl=totals["avgdl"])


def multi_field_stats(stats: DataFrame, fields: list[str]) -> DataFrame:
    """term, df, top_field from statistics keyed by (field, term).

    df is the largest over the fields; the top field is the one that reaches it, the
    earlier field on a tie.
    """
    position = F.array_position(F.array(*[F.lit(f) for f in fields]), F.col("field"))
    return stats.filter(F.col("field").isin(fields)).groupBy("term").agg(
        F.max("df").alias("df"),
        F.max_by("field", F.struct(F.col("df"), -position)).alias("top_field"))
