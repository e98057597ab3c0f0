"""Query terms: the most telling words of a text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neartag.functions.scoring import bm25_idf, from_micro, to_micro
from neartag.functions.text import Analyzer, get_analyzer
from neartag.operators.tokens import count_terms, unpack_terms

# A term is frequent if at least one document in this many holds it.  Every document has
# some number d of distinct terms, d on average, so at most FREQUENT_SHARE * d terms are
# frequent however large the corpus is: their statistics are safe to broadcast.
FREQUENT_SHARE = 100
LIMIT_SHARE = 100_000


@dataclass(frozen=True)
class TermParams:
    """Selection settings; 0 or None switches a limit off."""

    max_tokens: int = 0
    min_term_freq: int = 2
    min_doc_freq: int = 5
    max_doc_freq: int | None = None
    max_doc_freq_pct: int | None = None
    min_word_len: int = 0
    max_word_len: int = 0
    stop_words: tuple[str, ...] = ()
    max_query_terms: int = 25
    boost: bool = False
    boost_factor: float = 1.0


# Settings of the one-process search: every term of the text may become a query term.
ANY_TERM = TermParams(min_term_freq=1, min_doc_freq=1)


def is_noise(term: Column, params: TermParams) -> Column:
    """Whether a term is too short, too long or a stop word."""
    noise = F.lit(False)
    if params.min_word_len > 0:
        noise = noise | (F.length(term) < params.min_word_len)
    if params.max_word_len > 0:
        noise = noise | (F.length(term) > params.max_word_len)
    if params.stop_words:
        noise = noise | term.isin(list(params.stop_words))
    return noise


def source_tf(queries: DataFrame, params: TermParams = TermParams(),
              analyzer: str | Analyzer = "standard") -> DataFrame:
    """query_id, term, tf from queries with columns query_id and text.

    The token cap counts analysed tokens before the noise filter.
    """
    tokens = get_analyzer(analyzer)(F.col("text"))
    if params.max_tokens > 0:
        tokens = F.slice(tokens, 1, params.max_tokens)
    return (count_terms(queries, tokens, ("query_id",))
            .filter(~is_noise(F.col("term"), params)))


def indexed_tf(doc_ids: DataFrame, docs: DataFrame,
               params: TermParams = TermParams()) -> DataFrame:
    """query_id, term, tf for documents of the index, given as query_id, corpus, id.

    Stored counts know no token cap.
    """
    wanted = docs.select("corpus", "id", "terms").join(doc_ids, ["corpus", "id"])
    return unpack_terms(wanted, ("query_id",)).filter(~is_noise(F.col("term"), params))


def split_by_frequency(terms: DataFrame, term_stats: DataFrame, n_docs: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of frequent terms with their statistics; the other rows; the statistics for these.

    Rows of frequent terms, about half of all running text, meet a broadcast of bounded
    size and are not shuffled at all; the others meet the rest of the table in a shuffle
    join, in which no term can have more than its share of rows.  A column ``wanted`` of the
    statistics tells which terms a limit keeps; frequent terms that it drops leave before any
    shuffle.  A column ``limit_df`` counts in another corpus, where a term is frequent too if it
    has a ``LIMIT_SHARE``-th of all postings: at most so many terms are.
    """
    frequent = F.col("df") * FREQUENT_SHARE >= n_docs
    if "limit_df" in term_stats.columns:
        total = term_stats.agg(F.coalesce(F.sum("limit_df"), F.lit(0))).scalar()
        frequent = frequent | (F.col("limit_df") * LIMIT_SHARE >= total)
    marked = term_stats if "wanted" in term_stats.columns else term_stats.withColumn("wanted", F.lit(True))
    hot = F.broadcast(marked.filter(frequent))
    looked_up = terms.join(hot, "term", "left")
    new = [c for c in marked.columns if c != "term"]
    found = looked_up.filter("wanted").drop("wanted")
    missed = looked_up.filter(F.col("wanted").isNull()).drop(*new)
    return found, missed, marked.filter(~frequent & F.col("wanted")).drop("wanted")


def with_term_stats(terms: DataFrame, term_stats: DataFrame, n_docs: Column) -> DataFrame:
    """Inner join with per-term statistics that no frequent term can skew, see ``split_by_frequency``."""
    found, missed, rest = split_by_frequency(terms, term_stats, n_docs)
    return found.unionByName(missed.join(rest, "term"))


def select_terms(terms: DataFrame, term_stats: DataFrame, corpus_stats: DataFrame,
                 params: TermParams = TermParams(),
                 threshold_stats: DataFrame | None = None) -> DataFrame:
    """query_id, term, tf, df, idf, score, rank, boost, top_field, max_tf, min_len.

    ``terms`` has query_id, term, tf.  Terms are scored by tf * idf and the best
    ``max_query_terms`` of a query are kept; ties go to the alphabetically first term.
    ``threshold_stats`` (term, df) makes the document-frequency limits look at another
    corpus than the idf does.
    """
    n_docs = corpus_stats.select("n_docs").scalar()
    if params.min_term_freq > 0:
        terms = terms.filter(F.col("tf") >= params.min_term_freq)
    stats = term_stats
    for name, value in (("top_field", F.lit("text")), ("max_tf", F.lit(None).cast("bigint")),
                        ("min_len", F.lit(None).cast("bigint"))):
        if name not in stats.columns:
            stats = stats.withColumn(name, value)
    stats = stats.select("term", "df", "max_tf", "min_len", "top_field")
    if threshold_stats is None:
        stats = stats.withColumn("limit_df", F.col("df"))
    else:
        limits = threshold_stats.select("term", F.col("df").alias("limit_df"))
        stats = (stats.join(limits, "term", "full")
                 .withColumn("df", F.coalesce("df", F.lit(0)))
                 .withColumn("top_field", F.coalesce("top_field", F.lit("text"))))

    wanted = F.col("limit_df") > 0
    if params.min_doc_freq > 0:
        wanted = wanted & (F.col("limit_df") >= params.min_doc_freq)
    if params.max_doc_freq is not None:
        wanted = wanted & (F.col("limit_df") <= params.max_doc_freq)
    if params.max_doc_freq_pct is not None:
        wanted = wanted & (F.col("limit_df") <= F.floor(params.max_doc_freq_pct * n_docs / 100))
    stats = stats.withColumn("wanted", F.coalesce(wanted, F.lit(False)))
    if threshold_stats is None:
        stats = stats.drop("limit_df")

    idf = bm25_idf(F.col("df"), n_docs)
    scored = (with_term_stats(terms, stats, n_docs).drop("limit_df")
              .withColumn("idf", idf)
              .withColumn("micro", to_micro(F.col("tf") * F.col("idf"))))
    best_first = Window.partitionBy("query_id").orderBy(F.desc("micro"), "term")
    ranked = scored.withColumn("rank", F.row_number().over(best_first))
    if params.max_query_terms > 0:
        ranked = ranked.filter(F.col("rank") <= params.max_query_terms)
    boost = F.lit(1.0)
    if params.boost:
        best = F.max("micro").over(Window.partitionBy("query_id"))
        boost = params.boost_factor * F.col("micro") / best
    return ranked.withColumn("boost", boost).select(
        "query_id", "term", "tf", "df", "idf", from_micro(F.col("micro")).alias("score"),
        "rank", "boost", "top_field", "max_tf", "min_len")


def query_terms(queries: DataFrame, term_stats: DataFrame, corpus_stats: DataFrame,
                params: TermParams = TermParams(), analyzer: str | Analyzer = "standard",
                threshold_stats: DataFrame | None = None) -> DataFrame:
    """``select_terms`` for texts: queries with columns query_id and text."""
    return select_terms(source_tf(queries, params, analyzer), term_stats, corpus_stats,
                        params, threshold_stats)


def query_terms_by_id(doc_ids: DataFrame, docs: DataFrame, term_stats: DataFrame,
                      corpus_stats: DataFrame, params: TermParams = TermParams(),
                      threshold_stats: DataFrame | None = None) -> DataFrame:
    """``select_terms`` for documents of the index: query_id, corpus, id."""
    return select_terms(indexed_tf(doc_ids, docs, params), term_stats, corpus_stats,
                        params, threshold_stats)


def interesting_terms(selected: DataFrame) -> DataFrame:
    """query_id, terms: the selected words of each query, best first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "term")))
    return selected.groupBy("query_id").agg(ordered.alias("t")).select(
        "query_id", F.col("t.term").alias("terms"))


def term_details(selected: DataFrame) -> DataFrame:
    """Word, top field, score, idf, df and tf of every selected term."""
    return selected.select("query_id", F.col("term").alias("word"), "top_field", "score",
                           "idf", "df", "tf")


def query_size(selected: DataFrame) -> DataFrame:
    """query_id, n_terms: how many clauses each query has."""
    return selected.groupBy("query_id").agg(F.count("*").alias("n_terms"))
