"""One Spark query per operator; each takes (spark, sf_dir) and returns a DataFrame.

Every query runs over whole tables.  Doubles are rounded to millionths, because the last
bit of a logarithm differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derive
from neartag.functions import scoring
from neartag.functions.scoring import ScoreParams
from neartag.functions.tags import parse_tags
from neartag.functions.text import EMAIL_PATTERN, URL_PATTERN
from neartag.operators import evaluate, learn, predict, prepare, terms, tokens
from neartag.operators import index as ix
from neartag.operators import neighbors as nn
from neartag.operators.terms import ANY_TERM, TermParams
from neartag.plans import learning, search
from neartag.plans.staging import Staging
from neartag.sources import files, index_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def spread(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.repartitionByRange(derive.ranges(rows), key)


def body_index(questions: DataFrame) -> ix.Index:
    return ix.build_index(questions, "body")


def staged(questions: DataFrame, staging: Staging, text_col: str = "body") -> ix.Index:
    """The index of questions that were dealt into parts before."""
    return search.stage_index(questions, staging, text_col=text_col)


def search_setup(spark: SparkSession, sf_dir: str,
                 params: TermParams = ANY_TERM) -> tuple[DataFrame, DataFrame, ix.Index]:
    """Test questions, their selected terms and the staged index of both corpora."""
    index = staged(derive.both(spark, sf_dir, dealt=True), Staging(spark))
    queries = derive.as_queries(derive.test(spark, sf_dir))
    selected = terms.query_terms(queries, index.term_stats, index.corpus_stats, params)
    return queries, selected, index


def selected_terms(spark: SparkSession, sf_dir: str, params: TermParams) -> DataFrame:
    index = body_index(derive.both(spark, sf_dir, dealt=True))
    queries = derive.as_queries(derive.test(spark, sf_dir))
    return terms.query_terms(queries, index.term_stats, index.corpus_stats, params)


def test_neighbors(spark: SparkSession, sf_dir: str, k: int = 5) -> tuple[DataFrame, DataFrame]:
    questions = derive.both(spark, sf_dir, dealt=True)
    staging = Staging(spark)
    index = staged(questions, staging)
    queries = derive.as_queries(derive.test(spark, sf_dir))
    return queries, search.find_neighbors(queries, index, k, staging=staging)


def held_out_neighbors(spark: SparkSession, sf_dir: str, k: int,
                       staging: Staging) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All questions, the held-out queries, and their neighbours among the others."""
    questions = derive.train(spark, sf_dir, dealt=True).withColumn(
        "corpus", F.when(F.col("id") % 10 == 0, "test").otherwise("train"))
    index = staged(questions, staging)
    queries = derive.as_queries(derive.held_out(questions))
    return questions, queries, search.find_neighbors(queries, index, k, staging=staging)


# --- sources and text preparation ---------------------------------------------------------

@query
def questions_csv_round_trip(spark, sf_dir):
    path = Staging(spark).path + "/questions_csv"
    rows = derive.train(spark, sf_dir).select("id", "title", "body", "tags")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_questions_csv(spark, path)


@query
def questions_csv_blocks(spark, sf_dir):
    staging = Staging(spark)
    path = staging.path + "/questions_csv"
    rows = derive.train(spark, sf_dir).select("id", "title", "body", "tags")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_questions_csv(spark, path, staging)


@query
def test_csv_round_trip(spark, sf_dir):
    path = Staging(spark).path + "/test_csv"
    rows = derive.test(spark, sf_dir).select("id", "title", "body")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_test_csv(spark, path)


@query
def questions_table_round_trip(spark, sf_dir):
    path = Staging(spark).path + "/questions"
    files.write_questions(derive.train(spark, sf_dir), path)
    return files.read_questions(spark, path)


@query
def neighbor_lines_round_trip(spark, sf_dir):
    path = Staging(spark).path + "/neighbors"
    queries, found = test_neighbors(spark, sf_dir)
    files.write_neighbors(nn.pack_neighbors(found, queries), path)
    return files.read_neighbors(spark, path)


@query
def quoted_neighbor_lines(spark, sf_dir):
    """Negative ids, and tags that hold quotes and commas."""
    path = Staging(spark).path + "/quoted"
    rows = derive.train(spark, sf_dir).select((-F.col("id") - 1).alias("query_id"), F.lit(1).alias("rank"), (F.col("id") * -2).alias("id"),
                                              F.concat(F.lit('"'), F.replace("tags", F.lit(" "), F.lit('",""')), F.lit(',1,"x"')).alias("tags"))
    files.write_neighbors(nn.pack_neighbors(rows, rows), path)
    return files.read_neighbors(spark, path)


@query
def predictions_round_trip(spark, sf_dir):
    path = Staging(spark).path + "/predictions"
    files.write_predictions(derive.train(spark, sf_dir), path)
    return files.read_predictions(spark, path)


@query
def score_lines_round_trip(spark, sf_dir):
    path = Staging(spark).path + "/scores"
    tag_scores(spark, sf_dir).select(F.concat(
        F.col("score").cast("string"), F.lit(" "), F.col("id").cast("string"), F.lit("^"), "tag"
    ).alias("value")).write.text(path)
    return files.read_scores(spark, path)


@query
def example_lines_round_trip(spark, sf_dir):
    path = Staging(spark).path + "/examples"
    questions = derive.train(spark, sf_dir)
    labelled = predict.label_candidates(predict.tag_pairs(questions), derive.held_out(questions))
    files.write_examples(predict.make_examples(labelled, tokens.word_bag(questions)), path)
    return spark.read.text(path)


@query
def stored_index_search(spark, sf_dir):
    """Two corpora written one after the other, read back and searched."""
    path = Staging(spark).path + "/index"
    index_store.write_index(derive.train(spark, sf_dir), path, text_col="body")
    index_store.write_index(derive.test(spark, sf_dir), path, text_col="body")
    queries = derive.as_queries(derive.test(spark, sf_dir))
    return search.find_neighbors(queries, index_store.read_index(spark, path))


@query
def segmented_index_search(spark, sf_dir):
    """Both corpora appended in parts, one of them twice, merged, and searched."""
    path = Staging(spark).path + "/segments"
    rows = derive.train(spark, sf_dir, dealt=True)
    for part in (rows.filter("id % 3 = 0"), rows.filter("id % 3 <= 1"), rows.filter("id % 3 = 0"), derive.both(spark, sf_dir, dealt=True)):
        index_store.append_segment(part, path, text_col="body")
    index = index_store.read_segments(spark, path, index_store.merge_segments(spark, path))
    return search.find_neighbors(derive.as_queries(derive.test(spark, sf_dir)), index)


@query
def take_first(spark, sf_dir):
    return prepare.take_first(derive.train(spark, sf_dir), 100).select("id", "title", "tags")


@query
def project_text(spark, sf_dir):
    return prepare.project_text(derive.train(spark, sf_dir), "lower(title) || '!'")


@query
def concat_fields(spark, sf_dir):
    return derive.train(spark, sf_dir).select("id", prepare.concat_fields().alias("text"))


@query
def slice_rows(spark, sf_dir):
    sliced = prepare.slice_rows(derive.train(spark, sf_dir).select("id", "tags"), 300)
    return sliced.select("id", "slice_id")


@query
def clean_code_pages(spark, sf_dir):
    return prepare.clean_html(derive.code_pages(spark, sf_dir))


@query
def clean_html(spark, sf_dir):
    return prepare.clean_html(derive.pages(spark, sf_dir))


@query
def link_text(spark, sf_dir):
    pages = derive.pages(spark, sf_dir)
    return pages.select("id", F.array_join(prepare.link_text(F.col("body")), "\n").alias("links"))


@query
def raw_fields(spark, sf_dir):
    return prepare.raw_fields(derive.pages(spark, sf_dir))


@query
def html_tag_counts(spark, sf_dir):
    return prepare.html_tag_counts(derive.pages(spark, sf_dir))


@query
def tokenize_standard(spark, sf_dir):
    return tokens.tokenize(derive.train(spark, sf_dir), text_col="body")


@query
def url_email_tokens(spark, sf_dir):
    found = tokens.tokenize(derive.train(spark, sf_dir), "url_email", "body")
    kind = F.col("term").rlike(f"^(?:{URL_PATTERN}|{EMAIL_PATTERN})$")
    return found.filter(kind).groupBy("term").agg(F.count("*").alias("n"))


@query
def url_email_porter_totals(spark, sf_dir):
    docs = ix.build_docs(derive.train(spark, sf_dir), "url_email_porter", "body")
    return ix.term_totals(ix.postings_of(docs))


@query
def stem_vocabulary(spark, sf_dir):
    words = tokens.tokenize(derive.train(spark, sf_dir), text_col="body").select("term").distinct()
    return tokens.stem_terms(words.withColumn("word", F.col("term")))


@query
def remove_stop_words(spark, sf_dir):
    listed = (spark.read.parquet(f"{sf_dir}/documents.parquet").select("source").distinct()
              .select(F.col("source").alias("term")))
    common = listed.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet")
                                .select(F.col("lang").alias("term")).distinct())
    found = tokens.tokenize(derive.train(spark, sf_dir), text_col="body")
    left = tokens.remove_stop_words(tokens.remove_stop_words(found, common), ["die", "que", "los"])
    return left.groupBy("term").agg(F.count("*").alias("n"))


@query
def max_token_length(spark, sf_dir):
    found = tokens.tokenize(derive.train(spark, sf_dir), text_col="body")
    return tokens.max_token_length(found, 6).groupBy("id").agg(F.count("*").alias("n"))


@query
def analyzer_by_name(spark, sf_dir):
    docs = ix.build_docs(derive.train(spark, sf_dir), "url_email", "body")
    return docs.select("id", "doc_len")


@query
def word_bag(spark, sf_dir):
    return tokens.word_bag(derive.train(spark, sf_dir, dealt=True))


@query
def parse_tag_strings(spark, sf_dir):
    """Titles are whitespace-separated too, and less regular than tags."""
    rows = derive.train(spark, sf_dir)
    return rows.select("id", F.array_join(parse_tags(F.col("title")), "|").alias("parsed"))


# --- corpus and term statistics -------------------------------------------------------------

@query
def index_docs(spark, sf_dir):
    docs = ix.build_docs(derive.both(spark, sf_dir), text_col="body")
    return docs.select("corpus", "id", "tags", "doc_len")


@query
def index_postings(spark, sf_dir):
    return ix.postings_of(ix.build_docs(derive.both(spark, sf_dir, dealt=True), text_col="body"))


@query
def append_corpus(spark, sf_dir):
    grown = prepare.append_corpus(derive.both(spark, sf_dir), derive.chats(spark, sf_dir))
    postings = ix.postings_of(ix.build_docs(grown, text_col="body"))
    return postings.groupBy("corpus").agg(
        F.count_distinct("id").alias("n_docs"), F.sum("tf").alias("n_tokens"))


@query
def doc_freq(spark, sf_dir):
    return ix.doc_freq(body_index(derive.both(spark, sf_dir, dealt=True)).postings)


@query
def term_totals(spark, sf_dir):
    return ix.term_totals(body_index(derive.both(spark, sf_dir, dealt=True)).postings)


@query
def corpus_stats(spark, sf_dir):
    stats = body_index(derive.both(spark, sf_dir, dealt=True)).corpus_stats
    return stats.select("n_docs", "sum_ttf", r6("avgdl").alias("avgdl"))


@query
def tag_counts(spark, sf_dir):
    return prepare.tag_counts(derive.train(spark, sf_dir))


@query
def tag_counts_keep_empty(spark, sf_dir):
    return prepare.tag_counts(derive.train(spark, sf_dir), "title", keep_empty=True)


@query
def separate_term_stats(spark, sf_dir):
    """Document-frequency limits from the chats, idf from the searched corpora."""
    index = body_index(derive.both(spark, sf_dir, dealt=True))
    limits = body_index(spread(derive.chats(spark, sf_dir))).term_stats
    queries = derive.as_queries(derive.test(spark, sf_dir))
    params = TermParams(min_term_freq=1, min_doc_freq=3, max_doc_freq=200)
    selected = terms.query_terms(queries, index.term_stats, index.corpus_stats, params,
                                 threshold_stats=limits)
    return selected.select("query_id", "term", "rank", "df", "score")


# --- query terms ------------------------------------------------------------------------------

@query
def source_tf(spark, sf_dir):
    """Texts cut after 50 tokens."""
    queries = derive.as_queries(derive.train(spark, sf_dir))
    return terms.source_tf(queries, TermParams(max_tokens=50))


@query
def noise_filter(spark, sf_dir):
    queries = derive.as_queries(derive.train(spark, sf_dir))
    params = TermParams(min_word_len=4, max_word_len=9, stop_words=("with", "dans", "para"))
    return terms.source_tf(queries, params)


@query
def min_term_freq(spark, sf_dir):
    return selected_terms(spark, sf_dir, TermParams(min_term_freq=2, min_doc_freq=1)).select(
        "query_id", "term", "tf", "rank")


@query
def doc_freq_limits(spark, sf_dir):
    params = TermParams(min_term_freq=1, min_doc_freq=5, max_doc_freq=100)
    return selected_terms(spark, sf_dir, params).select("query_id", "term", "df", "rank")


@query
def max_doc_freq_pct(spark, sf_dir):
    params = TermParams(min_term_freq=1, min_doc_freq=1, max_doc_freq_pct=7)
    return selected_terms(spark, sf_dir, params).select("query_id", "term", "df", "rank")


@query
def multi_field_stats(spark, sf_dir):
    rows = derive.train(spark, sf_dir, dealt=True)
    stats = None
    for field in ("title", "body", "tags"):
        part = body_index(rows.withColumn("body", F.col(field))).term_stats.select(
            F.lit(field).alias("field"), "term", "df")
        stats = part if stats is None else stats.unionByName(part)
    return ix.multi_field_stats(stats, ["title", "body", "tags"])


@query
def query_terms(spark, sf_dir):
    """Selection with the defaults of the cluster search."""
    return selected_terms(spark, sf_dir, TermParams()).select(
        "query_id", "term", "tf", "df", r6("idf").alias("idf"), "score", "rank")


@query
def boosted_terms(spark, sf_dir):
    params = TermParams(min_term_freq=1, min_doc_freq=1, boost=True, boost_factor=2.0)
    return selected_terms(spark, sf_dir, params).select(
        "query_id", "term", "rank", r6("boost").alias("boost"))


@query
def interesting_terms(spark, sf_dir):
    found = terms.interesting_terms(selected_terms(spark, sf_dir, ANY_TERM))
    return found.select("query_id", F.array_join("terms", " ").alias("terms"))


@query
def terms_like_documents(spark, sf_dir):
    """Terms of indexed documents, by id, for the whole train corpus."""
    index = body_index(derive.both(spark, sf_dir, dealt=True))
    wanted = derive.train(spark, sf_dir).select(F.col("id").alias("query_id"), "corpus", "id")
    selected = terms.query_terms_by_id(wanted, index.docs, index.term_stats, index.corpus_stats)
    return selected.select("query_id", "term", "tf", "df", "score", "rank")


@query
def term_details(spark, sf_dir):
    details = terms.term_details(selected_terms(spark, sf_dir, ANY_TERM))
    return details.withColumn("idf", r6("idf"))


# --- scoring and neighbours -------------------------------------------------------------------

@query
def bm25_idf(spark, sf_dir):
    index = body_index(derive.both(spark, sf_dir, dealt=True))
    n_docs = index.corpus_stats.select("n_docs").scalar()
    return index.term_stats.select("term", "df", r6(scoring.bm25_idf(F.col("df"), n_docs)).alias("idf"))


@query
def bm25_length_norm(spark, sf_dir):
    index = body_index(derive.both(spark, sf_dir, dealt=True))
    avgdl = index.corpus_stats.select("avgdl").scalar()
    return index.docs.select("corpus", "id", "doc_len", r6(
        scoring.bm25_length_norm(F.col("doc_len"), avgdl)).alias("norm"))


@query
def bm25_term(spark, sf_dir):
    """Score of every posting as if it were asked for once, with other k1 and b."""
    index = body_index(derive.both(spark, sf_dir, dealt=True))
    n_docs, avgdl = (index.corpus_stats.select(c).scalar() for c in ("n_docs", "avgdl"))
    params = ScoreParams(k1=1.6, b=0.5)
    rows = terms.with_term_stats(index.postings, index.term_stats.select("term", "df"), n_docs)
    weight = scoring.term_weight(F.lit(1.0), F.col("df"), n_docs, params)
    impact = scoring.term_impact(F.col("tf"), F.col("doc_len"), avgdl, params)
    return rows.select("corpus", "id", "term", r6(weight * impact).alias("score"))


@query
def score_docs(spark, sf_dir):
    _, selected, index = search_setup(spark, sf_dir)
    scores = nn.score_docs(selected, index)
    return scores.select("query_id", "corpus", "id", scoring.from_micro(F.col("micro")).alias("score"))


@query
def corpus_filter(spark, sf_dir):
    _, selected, index = search_setup(spark, sf_dir)
    return nn.top_k(nn.score_docs(selected, index, corpus="test"), 3)


@query
def top_k(spark, sf_dir):
    _, selected, index = search_setup(spark, sf_dir)
    return nn.top_k(nn.score_docs(selected, index, corpus="train"), 10)


@query
def knn_join(spark, sf_dir):
    """The flagship: five nearest train questions of every test question, all text fields."""
    staging = Staging(spark)
    questions = derive.both(spark, sf_dir, dealt=True).withColumn("text", prepare.concat_fields())
    index = staged(questions, staging, "text")
    queries = derive.as_queries(derive.test(spark, sf_dir), derive.ALL_FIELDS)
    return search.find_neighbors(queries, index, staging=staging)


@query
def knn_join_one_plan(spark, sf_dir):
    """The flagship as one lazy plan."""
    questions = derive.both(spark, sf_dir, dealt=True).withColumn("text", prepare.concat_fields())
    queries = derive.as_queries(derive.test(spark, sf_dir), derive.ALL_FIELDS)
    return search.knn_join(queries, ix.build_index(questions))


@query
def knn_join_pruned(spark, sf_dir):
    """The flagship with small blocks and many rounds."""
    staging = Staging(spark)
    questions = derive.both(spark, sf_dir, dealt=True).withColumn("text", prepare.concat_fields())
    index = staged(questions, staging, "text")
    queries = derive.as_queries(derive.test(spark, sf_dir), derive.ALL_FIELDS)
    blocks = search.stage_blocks(index, staging, block_docs=64)
    return search.find_neighbors(queries, index, staging=staging, blocks=blocks, rounds=(1, 2, 8, 64))


@query
def knn_self_join(spark, sf_dir):
    """Every train question against all the others."""
    staging = Staging(spark)
    questions = derive.train(spark, sf_dir, dealt=True)
    index = staged(questions, staging)
    return search.find_neighbors(derive.as_queries(questions), index, 3, exclude_self=True, staging=staging)


@query
def knn_by_id(spark, sf_dir):
    """The nearest train questions of every stored document of either corpus, without its text."""
    index = staged(derive.both(spark, sf_dir, dealt=True), Staging(spark))
    wanted = index.docs.select((F.col("id") * 2 + F.when(F.col("corpus") == "test", 1).otherwise(0)).alias("query_id"), "corpus", "id")
    return search.find_like(wanted, index, 3)


@query
def knn_all_corpora(spark, sf_dir):
    """The nearest questions of every test question in both corpora, itself included."""
    index = staged(derive.both(spark, sf_dir, dealt=True), Staging(spark))
    return search.find_neighbors(derive.as_queries(derive.test(spark, sf_dir)), index, 7, corpus=None)


@query
def knn_multi_field(spark, sf_dir):
    """Each term is searched in the field, title or body, that most questions have it in."""
    index = search.stage_field_index(derive.both(spark, sf_dir, dealt=True), ["title", "body"], Staging(spark))
    return search.find_neighbors(derive.as_queries(derive.test(spark, sf_dir)), index)


@query
def knn_separate_stats(spark, sf_dir):
    """Neighbours by terms whose document frequency in the chats lies within limits."""
    index = staged(derive.both(spark, sf_dir, dealt=True), Staging(spark))
    limits = body_index(spread(derive.chats(spark, sf_dir))).term_stats
    params = TermParams(min_term_freq=1, min_doc_freq=3, max_doc_freq=200)
    return search.find_neighbors(derive.as_queries(derive.test(spark, sf_dir)), index, terms=params, threshold_stats=limits)


@query
def neighbor_tags(spark, sf_dir):
    queries, found = test_neighbors(spark, sf_dir)
    return files.format_neighbors(nn.pack_neighbors(found, queries))


@query
def query_size(spark, sf_dir):
    return terms.query_size(selected_terms(spark, sf_dir, ANY_TERM))


@query
def tfidf_neighbors(spark, sf_dir):
    _, selected, index = search_setup(spark, sf_dir, TermParams())
    return nn.top_k(nn.score_docs(selected, index, ScoreParams(scorer="tfidf"), "train"), 5)


@query
def explain_scores(spark, sf_dir):
    _, selected, index = search_setup(spark, sf_dir)
    best = nn.top_k(nn.score_docs(selected, index, corpus="train"), 3)
    rows = nn.explain_scores(selected, index, best, corpus="train")
    return rows.withColumns({c: r6(c) for c in ("idf", "avgdl", "tf_norm")})


# --- tag prediction ---------------------------------------------------------------------------

def tag_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every question and each of its tags, some of them positive."""
    rows = predict.tag_pairs(derive.train(spark, sf_dir))
    score = ((F.col("id") * 7 + F.length("tag") * 13) % 20 - 14) / 8
    return rows.select("id", "tag", score.alias("score"))


@query
def candidate_tags(spark, sf_dir):
    _, found = test_neighbors(spark, sf_dir)
    return predict.candidate_tags(found, 3)


@query
def union_predict(spark, sf_dir):
    queries, found = test_neighbors(spark, sf_dir)
    return predict.union_predict(found, queries, 2)


@query
def label_candidates(spark, sf_dir):
    questions, _, found = held_out_neighbors(spark, sf_dir, 5, Staging(spark))
    return predict.label_candidates(predict.candidate_tags(found, 5), derive.held_out(questions))


@query
def format_examples(spark, sf_dir):
    questions, _, found = held_out_neighbors(spark, sf_dir, 3, Staging(spark))
    asked = derive.held_out(questions)
    labelled = predict.label_candidates(predict.candidate_tags(found, 3), asked)
    return predict.format_examples(predict.make_examples(labelled, tokens.word_bag(asked)))


@query
def predict_from_scores(spark, sf_dir):
    return predict.predict_from_scores(tag_scores(spark, sf_dir))


# --- evaluation ---------------------------------------------------------------------------------

@query
def predict_from_odd_scores(spark, sf_dir):
    """Scores that are not numbers or missing; some ids have no other."""
    odd = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).when((F.col("id") + F.length("tag")) % 3 == 0, F.lit(None)).otherwise(F.col("score"))
    return predict.predict_from_scores(tag_scores(spark, sf_dir).withColumn("score", odd))


@query
def repeated_truth(spark, sf_dir):
    """Every id is twice in the truth, with other tags the second time."""
    rows = derive.train(spark, sf_dir).select("id", "tags")
    return evaluate.per_row_scores(rows, rows.unionByName(rows.withColumn("tags", F.concat(F.lit("zz "), "tags")))).select("id", "tp", "n_expected", "missing")


@query
def per_row_scores(spark, sf_dir):
    questions, queries, found = held_out_neighbors(spark, sf_dir, 5, Staging(spark))
    rows = evaluate.per_row_scores(predict.union_predict(found, queries, 2), questions)
    return rows.withColumns({c: r6(c) for c in ("precision", "recall")})


@query
def mean_product_score(spark, sf_dir):
    questions, queries, found = held_out_neighbors(spark, sf_dir, 5, Staging(spark))
    row = evaluate.mean_score(predict.union_predict(found, queries, 1), questions)
    return row.withColumn("mean_score", r6("mean_score"))


@query
def mean_f1_score(spark, sf_dir):
    questions, queries, found = held_out_neighbors(spark, sf_dir, 5, Staging(spark))
    row = evaluate.mean_score(predict.union_predict(found, queries, 1), questions, "f1")
    return row.withColumn("mean_score", r6("mean_score"))


@query
def split_overlap(spark, sf_dir):
    rows = derive.train(spark, sf_dir)
    return evaluate.split_overlap(derive.kept(rows), derive.held_out(rows), "body")


# --- learning -------------------------------------------------------------------------------------

@query
def sample_rows(spark, sf_dir):
    return learn.sample_rows(derive.train(spark, sf_dir).select("id", "title", "tags"))


@query
def bag_of_words(spark, sf_dir):
    return learn.bag_of_words(derive.train(spark, sf_dir))


@query
def binarized_bag(spark, sf_dir):
    return learn.binarize(learn.bag_of_words(derive.train(spark, sf_dir)))


@query
def label_matrix(spark, sf_dir):
    return learn.label_matrix(derive.train(spark, sf_dir))


@query
def ml_knn(spark, sf_dir):
    """Tags of the held-out questions from the ten nearest of the others."""
    staging = Staging(spark)
    questions = derive.train(spark, sf_dir).withColumn(
        "corpus", F.when(F.col("id") % 10 == 0, "test").otherwise("train"))
    questions = staging.write(questions.withColumn("text", F.col("body")), "questions")
    index = staged(spread(questions), staging, "text")
    found = learning.ml_knn_tags(spread(derive.kept(questions)), derive.as_queries(derive.held_out(questions)),
                                 index, staging=staging)
    return found.withColumn("probability", r6("probability"))


@query
def cross_validate_ml_knn(spark, sf_dir):
    questions = derive.train(spark, sf_dir, dealt=True).withColumn("text", F.col("body"))
    staging = Staging(spark)
    index = staged(questions, staging, "text")
    rows = learning.cross_validate_ml_knn(
        questions, index, "train", F.pmod(F.col("id"), F.lit(10)).cast("int"), staging=staging.child("folds"))
    return rows.withColumns({c: r6(c) for c in ("hamming_loss", "subset_accuracy", "micro_f1", "macro_f1")})


@query
def labelset_trees(spark, sf_dir):
    """Votes of decision trees over random label subsets for the held-out questions."""
    rows = spread(derive.train(spark, sf_dir))
    model = learning.fit_labelset_trees(derive.kept(rows))
    return learning.predict_labelsets(model, derive.held_out(rows))
