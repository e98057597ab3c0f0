"""Scoring and ranking of documents for bags of query terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neartag.functions.scoring import ScoreParams, bm25_length_norm, from_micro, term_impact, term_weight, to_micro
from neartag.operators.index import Index

# Rows of a hot key's product that one task makes in ``join_cells``.
CELL_ROWS = 1 << 24
# At most so many keys are split, however large the tables: a cell then grows with the total.
MAX_SPLIT = 10_000


def join_cells(asking: DataFrame, held: DataFrame, on: str, asking_id: str, held_id: str, sizes: DataFrame,
               cell_rows: int = CELL_ROWS) -> DataFrame:
    """Join by a key that many rows of both sides may share.

    ``sizes`` has the key, ``asked`` and ``held``, at least the rows of either side.  A key asked
    for by q rows and held by d makes q * d rows.  It is cut into cells of about ``cell_rows``:
    rows of either side into parts by their id, each repeated once per part of the other side.
    No task gets more than a cell.  Split keys are those with more than a cell, and a cell is at
    least a ``MAX_SPLIT``-th of all rows made, so their list is short and broadcast.
    """
    product = F.col("asked") * F.col("held")
    made = sizes.agg(F.coalesce(F.sum(product), F.lit(0))).scalar()
    cells = product / F.greatest(F.lit(float(cell_rows)), made / float(MAX_SPLIT))
    # The number of cells is shared out so that parts of both sides are about equally long.
    split = F.broadcast(sizes.filter(cells > 1).select(on, "asked", "held", cells.alias("_cells")).withColumn(
        "_held_parts", F.greatest(F.lit(1), F.least(F.col("held"), F.ceil(F.sqrt(F.col("_cells") * F.col("held") / F.col("asked")))).cast("int")))
        .select(on, "_held_parts", F.ceil(F.col("_cells") / F.col("_held_parts")).cast("int").alias("_asking_parts")))
    one = {c: F.coalesce(c, F.lit(1)) for c in ("_held_parts", "_asking_parts")}

    def part(column: str, parts: str) -> Column:
        return F.pmod(F.xxhash64(column), F.col(parts)).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    left = (asking.join(split, on, "left").withColumns(one).withColumn("_asking_part", part(asking_id, "_asking_parts"))
            .withColumn("_held_part", every("_held_parts")).drop("_held_parts", "_asking_parts"))
    right = (held.join(split, on, "left").withColumns(one).withColumn("_held_part", part(held_id, "_held_parts"))
             .withColumn("_asking_part", every("_asking_parts")).drop("_held_parts", "_asking_parts"))
    return left.join(right, [on, "_held_part", "_asking_part"]).drop("_held_part", "_asking_part")


def join_postings(terms: DataFrame, index: Index, corpus: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Join rows (first column a key, term, df, ..) with the postings of their terms; hot terms are split on both sides."""
    postings = index.postings if corpus is None else index.postings.filter(F.col("corpus") == corpus)
    sizes = terms.groupBy("term").agg(F.count("*").alias("asked"), F.max("df").alias("held"))
    return join_cells(terms, postings.withColumnRenamed("tf", "doc_tf"), "term", terms.columns[0], "id", sizes, cell_rows)


def with_weight(selected: DataFrame, index: Index, params: ScoreParams = ScoreParams()) -> DataFrame:
    """Add ``weight``, the document-independent part of each term's score."""
    n_docs = index.corpus_stats.select("n_docs").scalar()
    return selected.withColumn("weight", term_weight(F.col("boost"), F.col("df"), n_docs, params))


def contribution(index: Index, params: ScoreParams) -> Column:
    """Score of one term in one document, in millionths (columns weight, doc_tf, doc_len)."""
    avgdl = index.corpus_stats.select("avgdl").scalar()
    return to_micro(F.col("weight") * term_impact(F.col("doc_tf"), F.col("doc_len"), avgdl, params))


def score_docs(selected: DataFrame, index: Index, params: ScoreParams = ScoreParams(),
               corpus: str | None = None, key: str = "query_id") -> DataFrame:
    """key, id, micro: summed score of every document that holds a query term.

    Statistics cover all corpora; ``corpus`` only restricts the documents.  Without it a
    column corpus tells documents with equal ids apart.
    """
    weighted = with_weight(selected, index, params).select(key, "term", "df", "weight")
    document = ["id"] if corpus is not None else ["corpus", "id"]
    return (join_postings(weighted, index, corpus)
            .select(key, *document, contribution(index, params).alias("micro"))
            .groupBy(key, *document).agg(F.sum("micro").alias("micro")))


def top_k(scores: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """key, rank, id, score: the k best documents of each query, ties by id and corpus.

    The rank filter also runs before the shuffle (window group limit), so a query sends
    k rows per task however many documents it matched.
    """
    document = ["id", "corpus"] if "corpus" in scores.columns else ["id"]
    best_first = Window.partitionBy(key).orderBy(F.desc("micro"), *document)
    return (scores.withColumn("rank", F.row_number().over(best_first))
            .filter(F.col("rank") <= k)
            .select(key, "rank", *document, from_micro(F.col("micro")).alias("score")))


def drop_self(neighbors: DataFrame, k: int, itself: Column | None = None) -> DataFrame:
    """Leave the query itself out of its k + 1 neighbours and renumber the rest.

    ``itself`` tells which row that is; without it, the one whose id is the query's.
    """
    itself = F.col("id") == F.col("query_id") if itself is None else itself
    at_self = F.coalesce(F.max(F.when(itself, F.col("rank"))).over(Window.partitionBy("query_id")), F.lit(k + 2))
    return (neighbors.withColumn("self_rank", at_self)
            .filter(F.col("rank") != F.col("self_rank"))
            .withColumn("rank", F.when(F.col("rank") > F.col("self_rank"), F.col("rank") - 1)
                        .otherwise(F.col("rank")))
            .filter(F.col("rank") <= k).drop("self_rank"))


def fetch_tags(neighbors: DataFrame, docs: DataFrame, corpus: str | None = None) -> DataFrame:
    """Add the tags of each neighbour; only its key and tags are read from docs."""
    if corpus is None:
        tagged = neighbors.join(docs.select("corpus", "id", "tags"), ["corpus", "id"])
    else:
        tagged = neighbors.join(docs.filter(F.col("corpus") == corpus).select("id", "tags"), "id")
    return tagged.select(*neighbors.columns, "tags")


def pack_neighbors(neighbors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and its neighbours in rank order as an array; queries without any stay."""
    packed = neighbors.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", "tags"))).alias("n"))
    return queries.select("query_id").join(packed, "query_id", "left").select(
        "query_id", F.coalesce(F.transform("n", lambda n: F.struct(n.id, n.tags)),
                               F.array().cast("array<struct<id:bigint,tags:string>>"))
        .alias("neighbors"))


def match_terms(pairs: DataFrame, terms: DataFrame, index: Index, corpus: str | None = None,
                key: str = "query_id") -> DataFrame:
    """Look the terms of a key up in given documents: pairs with key and id.

    Adds doc_len and ``matched``, the fields of each term the document holds with its
    doc_tf.  The work grows with the pairs, not with the product of a term's queries and
    documents; a pair stays one row.
    """
    fields = [c for c in terms.columns if c != key]
    wanted = terms.groupBy(key).agg(F.collect_list(F.struct(*fields)).alias("wanted"))
    docs = index.docs if corpus is None else index.docs.filter(F.col("corpus") == corpus)
    # Taken apart before the join, once per document and not once per pair.
    listed = docs.select("id", "doc_len", F.col("terms.term").alias("words"),
                         F.col("terms.tf").alias("counts"))
    found = pairs.join(wanted, key).join(listed, "id")
    # The position is 0 for a term the document lacks, which gives no count.
    with_tf = F.transform("wanted", lambda w: F.struct(
        *[w[f].alias(f) for f in fields],
        F.get("counts", (F.array_position("words", w.term) - 1).cast("int")).alias("doc_tf")))
    return found.select(*pairs.columns, "doc_len", F.filter(
        with_tf, lambda m: m.doc_tf.isNotNull()).alias("matched"))


def explain_scores(selected: DataFrame, index: Index, pairs: DataFrame,
                   params: ScoreParams = ScoreParams(), corpus: str | None = None) -> DataFrame:
    """Per pair (query_id, id) and shared term: every factor of the score."""
    n_docs = index.corpus_stats.select("n_docs").scalar()
    avgdl = index.corpus_stats.select("avgdl").scalar()
    terms = with_weight(selected, index, params).select(
        "query_id", "term", "boost", "df", "idf", "weight")
    norm = bm25_length_norm(F.col("doc_len"), avgdl, params)
    tf_norm = F.col("doc_tf") * (params.k1 + 1.0) / (F.col("doc_tf") + norm)
    matched = match_terms(pairs.select("query_id", "id"), terms, index, corpus)
    return matched.select("query_id", "id", "doc_len", F.inline("matched")).select(
        "query_id", "id", "term", "boost", "idf", "df", n_docs.alias("n_docs"),
        F.col("doc_tf").alias("tf"), F.lit(params.k1).alias("k1"), F.lit(params.b).alias("b"),
        avgdl.alias("avgdl"), "doc_len", tf_norm.alias("tf_norm"),
        from_micro(contribution(index, params)).alias("score"))


# --- bags: the weighted terms of a query, as the search in blocks asks for them ---------

def term_bags(selected: DataFrame, index: Index, params: ScoreParams = ScoreParams()) -> DataFrame:
    """query_id, content, terms (array of field, term, df, weight): the weighted terms of each query and a key of them."""
    fields = F.struct(F.col("top_field").alias("field"), "term", "df", "weight")
    bags = with_weight(selected, index, params).groupBy("query_id").agg(F.array_sort(F.collect_list(fields)).alias("terms"))
    return bags.select("query_id", F.sha2(F.to_json("terms"), 256).alias("content"), "terms")


def share_bags(bags: DataFrame) -> DataFrame:
    """query_id, bag_id: queries with equal content share the smallest query_id of them.

    Copies of a text, however many, are then searched once, and the pairs that the search
    shuffles carry a short key.  The grouping is combined before its shuffle.
    """
    first = bags.groupBy("content").agg(F.min("query_id").alias("bag_id"))
    return bags.select("query_id", "content").join(first, "content").select("query_id", "bag_id")


def distinct_bags(bags: DataFrame, shared: DataFrame) -> DataFrame:
    """bag_id, terms: the terms of each distinct bag."""
    firsts = shared.filter(F.col("query_id") == F.col("bag_id"))
    return bags.join(firsts, "query_id").select("bag_id", "terms")


def best_of(scores: DataFrame, k: int) -> DataFrame:
    """The k best rows (bag_id, shelf, corpus, id, micro) of each bag and shelf."""
    best_first = Window.partitionBy("bag_id", "shelf").orderBy(F.desc("micro"), "id", "corpus")
    return scores.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).drop("rank")


def search_floors(best: DataFrame, k: int, leave_out: bool = False) -> DataFrame:
    """bag_id, least, floors: what a document must reach to be among the k best of its shelf, from ``best_of`` of some documents.

    ``floors`` has the k-th best score of each shelf with so many.  ``least`` holds for all shelves: 0, or with
    ``leave_out`` the smallest k-th best score of all shelves but one.  There as many more are counted as rows
    repeat an id or have none, so that k - 1 documents are left whichever id a query leaves out.
    """
    found = best.groupBy("bag_id").agg(F.sort_array(F.collect_list(F.struct("micro", "shelf", "id")), asc=False).alias("all"))
    found = found.withColumn("more", F.size("all") - F.size(F.array_distinct(F.array_compact("all.id"))))
    shelves = F.array_distinct(F.col("all.shelf"))

    def kth(kept: Column, place: Column) -> Column:
        return F.get(kept, place).micro

    floors = F.transform(shelves, lambda s: F.struct(
        s.alias("shelf"), kth(F.filter("all", lambda x: x.shelf.eqNullSafe(s)), F.lit(k - 1)).alias("floor")))
    outside = F.transform(shelves, lambda s: F.coalesce(
        kth(F.filter("all", lambda x: ~x.shelf.eqNullSafe(s)), k - 1 + F.col("more")), F.lit(0)))
    least = F.array_min(outside) if leave_out else F.lit(0)
    return found.select("bag_id", least.cast("bigint").alias("least"), F.filter(floors, lambda f: f.floor.isNotNull()).alias("floors"))
