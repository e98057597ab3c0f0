"""Neighbour search jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neartag.functions.scoring import ScoreParams
from neartag.functions.text import Analyzer
from neartag.operators import blocks as bl
from neartag.operators import neighbors as nn
from neartag.operators.index import (
    FieldIndex, Index, build_corpus_stats, build_docs, build_field_docs, build_term_stats, field_index, pin_totals, postings_of)
from neartag.operators.terms import (
    ANY_TERM, TermParams, indexed_tf, query_terms, select_terms, source_tf)
from neartag.plans.staging import Staging, small_batches

# Blocks of a group that a query has been scored against when its floor rises, most promising first.
ROUNDS = (1, 4, 32)
PART_BAGS = 1024  # a part of the queries is not smaller
WAVE = 8  # one group in so many is searched first
WAVE_BAGS = 4096  # fewer queries search all groups at once


def stage_index(df: DataFrame, staging: Staging, analyzer: str | Analyzer = "standard",
                text_col: str = "text", ranges: int | None = None) -> Index:
    """``build_index`` with every table written once; texts are analysed once.

    Texts are analysed by as many tasks as their table has splits.  ``ranges`` shuffles the rows
    into so many ranges of ids before, for files with fewer splits than there are cores.
    """
    if ranges is not None:
        df = df.repartitionByRange(ranges, "corpus", "id")
    docs = staging.write(build_docs(df, analyzer, text_col), "docs", partition_by="corpus", compression="zstd")
    term_stats = staging.write(build_term_stats(postings_of(docs)), "term_stats")
    return with_seed(pin_totals(Index(docs, term_stats, build_corpus_stats(docs))))


def with_seed(index: Index | FieldIndex) -> Index | FieldIndex:
    """The index with a seed under which its terms have different keys."""
    return index if index.seed is not None else replace(index, seed=bl.key_seed(index.term_keys, index.key_columns))


def stage_field_index(df: DataFrame, fields: Sequence[str], staging: Staging, analyzer: str | Analyzer = "standard",
                      ranges: int | None = None) -> FieldIndex:
    """An index of several text columns, written once."""
    if ranges is not None:
        df = df.repartitionByRange(ranges, "corpus", "id")
    docs = staging.write(build_field_docs(df, fields, analyzer), "field_docs", partition_by="corpus", compression="zstd")
    index = field_index(docs, fields)
    return with_seed(pin_totals(replace(index, field_stats=staging.write(index.field_stats, "field_stats"),
                                        field_totals=staging.write(index.field_totals, "field_totals"))))


def knn_join(queries: DataFrame, index: Index, k: int = 5, corpus: str = "train",
             terms: TermParams = ANY_TERM, score: ScoreParams = ScoreParams(),
             analyzer: str | Analyzer = "standard", exclude_self: bool = False) -> DataFrame:
    """The k nearest documents of each query (query_id, text) with their tags.

    One lazy plan: one shuffle on the term, one on the pair, one on the query.  It
    scores every posting of every query term; ``find_neighbors`` avoids that.
    """
    selected = query_terms(queries, index.term_stats, index.corpus_stats, terms, analyzer)
    scores = nn.score_docs(selected, index, score, corpus)
    found = nn.top_k(scores, k + exclude_self)
    if exclude_self:
        found = nn.drop_self(found, k)
    return nn.fetch_tags(found, index.docs, corpus)


@dataclass(frozen=True)
class Blocks:
    """The documents of an index in blocks, for one scorer; written once, searched often."""

    table: DataFrame
    groups: tuple[int, ...]  # their numbers
    seed: int
    by_field: bool


def stage_blocks(index: Index | FieldIndex, staging: Staging, corpus: str | None = "train",
                 score: ScoreParams = ScoreParams(), shelf: Column | None = None,
                 block_docs: int = bl.BLOCK_DOCS) -> Blocks:
    """Write the blocks of a corpus (None: of all)."""
    small_batches(staging.spark)
    index = with_seed(index)
    # A group is made by one task, so there are no more tasks than full groups or cores.
    counts = index.field_stats if isinstance(index, FieldIndex) else index.term_stats
    full = -(-(counts.agg(F.sum("df")).first()[0] or 0) // bl.GROUP_POSTINGS)
    weighted = bl.weighted_docs(index, score, index.seed, corpus).coalesce(max(full, staging.spark.sparkContext.defaultParallelism))
    table = staging.write(bl.block_table(weighted, shelf, block_docs, params=score), "blocks", compression="zstd")
    rows = table.select("grp").distinct().collect()  # one per some millions of postings
    return Blocks(table, tuple(sorted(r.grp for r in rows)), index.seed, isinstance(index, FieldIndex))


def search_bags(bags: DataFrame, blocks: Blocks, k: int, staging: Staging,
                rounds: tuple[int, ...] = ROUNDS, leave_out: bool = False) -> DataFrame:
    """bag_id, shelf, corpus, id, micro: the k best documents of each bag (bag_id, terms) and shelf.

    Every query goes to every group of blocks once.  There it is scored against its most promising
    blocks first, those whose largest impacts add up to the most.  Its k-th best score so far is its
    floor, which rises from round to round; blocks that cannot reach it are left out, and inside a
    block only documents that can are scored in full.  Many queries search one group in ``WAVE`` first
    and take their floors to the others.  Nothing is lost: a block or document is left
    out by a proven bound.  Only the k best of a group are shuffled; pairs of queries and blocks
    never leave a task.

    With ``leave_out`` a document stays only if it may be among the k best of all shelves but one.
    """
    keys = F.transform("terms", lambda t: bl.term_key(blocks.seed, *([t.field] if blocks.by_field else []), t.term))
    lists = staging.write(bags.select("bag_id", keys.alias("keys"), F.col("terms.weight").alias("weights")), "bag_lists")
    n, cores = lists.count(), staging.spark.sparkContext.defaultParallelism

    def found(asked: DataFrame, groups: tuple[int, ...]) -> DataFrame:
        # Queries are dealt into parts only as far as the groups alone would leave cores idle.
        parts = max(1, min(-(-2 * cores // max(1, len(groups))), -(-n // PART_BAGS)))
        return bl.search_groups(asked, blocks.table, groups, parts, k, rounds)

    first = blocks.groups[::WAVE] if n >= WAVE_BAGS and len(blocks.groups) > 1 else blocks.groups
    others = tuple(sorted({*blocks.groups} - {*first}))
    best = nn.best_of(found(lists, first), k)
    if others:
        best = staging.write(best, "first_best")
        later = found(lists.join(nn.search_floors(best, k, leave_out), "bag_id", "left"), others)
        best = nn.best_of(best.unionByName(later), k)
    best = staging.write(best, "best")
    if leave_out:
        least = nn.search_floors(best, k, True).select("bag_id", "least")
        best = best.join(least, "bag_id").filter(F.col("micro") >= F.col("least")).drop("least")
    return best


def search_selected(selected: DataFrame, index: Index | FieldIndex, k: int, corpus: str | None, score: ScoreParams,
                    staging: Staging, blocks: Blocks | None = None, strategy: str = "blocks",
                    rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """query_id, rank, id (and corpus, if None is given), score of queries given by their selected terms."""
    bags = staging.write(nn.term_bags(selected, index, score), "bags")
    shared = nn.share_bags(bags)
    distinct = nn.distinct_bags(bags, shared)
    if strategy == "direct":
        rows = distinct.select("bag_id", F.inline("terms")).select("bag_id", "term", "df", "weight")
        document = ["id"] if corpus is not None else ["corpus", "id"]
        best = (nn.join_postings(rows, index, corpus).select("bag_id", *document, nn.contribution(index, score).alias("micro"))
                .groupBy("bag_id", *document).agg(F.sum("micro").alias("micro")))
    elif strategy == "blocks":
        blocks = blocks or stage_blocks(index, staging, corpus, score)
        best = search_bags(distinct, blocks, k, staging, rounds).drop("shelf")
        if corpus is not None:
            best = best.drop("corpus")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return shared.join(nn.top_k(best, k, "bag_id"), "bag_id").drop("bag_id")


def find_neighbors(queries: DataFrame, index: Index | FieldIndex, k: int = 5, corpus: str | None = "train",
                   terms: TermParams = ANY_TERM, score: ScoreParams = ScoreParams(),
                   analyzer: str | Analyzer = "standard", exclude_self: bool = False,
                   strategy: str = "blocks", staging: Staging | None = None, blocks: Blocks | None = None,
                   threshold_stats: DataFrame | None = None, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """Same result as ``knn_join``, for large inputs: query_id, rank, id, score, tags.

    Without a ``corpus`` all corpora are searched and rows carry a column corpus.  Queries with
    equal term bags are searched once.  ``blocks`` (``search_bags``) skips what cannot matter;
    ``direct`` scores all postings and serves as its check.  ``blocks`` written before can be
    given.  ``threshold_stats`` (term, df) makes the limits on document frequency look at another
    corpus.  In an index of several fields each term is searched in the field that most
    documents have it in.
    """
    staging = staging or Staging(queries.sparkSession)
    if index.n_docs is None:
        index = pin_totals(index)
    # The counts are read twice, for frequent and for other terms, but made once.
    counts = staging.write(source_tf(queries, terms, analyzer), "query_tf")
    selected = select_terms(counts, index.term_stats, index.corpus_stats, terms, threshold_stats)
    found = search_selected(selected, index, k + exclude_self, corpus, score, staging, blocks, strategy, rounds)
    if exclude_self:
        found = nn.drop_self(found, k)
    return nn.fetch_tags(found, index.docs, corpus)


def find_like(doc_ids: DataFrame, index: Index, k: int = 5, corpus: str | None = "train",
              terms: TermParams = ANY_TERM, score: ScoreParams = ScoreParams(), exclude_self: bool = True,
              strategy: str = "blocks", staging: Staging | None = None, blocks: Blocks | None = None,
              threshold_stats: DataFrame | None = None) -> DataFrame:
    """Neighbours of documents of the index, given as query_id, corpus, id: like ``find_neighbors``.

    The terms come from the docs table; no text is read or analysed.  ``exclude_self`` leaves out
    the document itself, not one of the same id in another corpus.
    """
    staging = staging or Staging(doc_ids.sparkSession)
    if index.n_docs is None:
        index = pin_totals(index)
    counts = staging.write(indexed_tf(doc_ids, index.docs, terms), "query_tf")
    selected = select_terms(counts, index.term_stats, index.corpus_stats, terms, threshold_stats)
    found = search_selected(selected, index, k + exclude_self, corpus, score, staging, blocks, strategy)
    if exclude_self:
        own = doc_ids.select("query_id", F.col("corpus").alias("own_corpus"), F.col("id").alias("own_id"))
        where = F.lit(corpus) if corpus is not None else F.col("corpus")
        itself = (F.col("id") == F.col("own_id")) & (where == F.col("own_corpus"))
        found = nn.drop_self(found.join(own, "query_id"), k, itself).drop("own_corpus", "own_id")
    return nn.fetch_tags(found, index.docs, corpus)
