"""Search against brute force in plain Python."""

import math
import random
import tracemalloc
from collections import Counter
from functools import partial

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartag.functions.scoring import ScoreParams
from neartag.operators import neighbors as nn
from neartag.operators import terms
from neartag.operators import blocks as bl
from neartag.operators.index import build_index, multi_field_stats
from neartag.operators.terms import ANY_TERM, TermParams
from neartag.plans import search
from neartag.plans.staging import Staging
from neartag.sources.index_store import read_index, write_index


def micro(x):
    return int(math.floor(x * 1e6 + 0.5))


def brute_force(docs, queries, k, params=ANY_TERM, score=ScoreParams(), exclude_self=False, boost=None):
    """docs: (corpus, id, text); queries: (id, text).  Texts are lower-case words."""
    bags = {(c, i): Counter(t.split()) for c, i, t in docs}
    df = Counter(w for bag in bags.values() for w in bag)
    n, avgdl = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
    result = {}
    for qid, text in queries:
        tf = Counter(text.split()[:params.max_tokens or None])
        found = [(micro(f * idf[w]), w) for w, f in tf.items()
                 if w in df and f >= params.min_term_freq and df[w] >= params.min_doc_freq]
        found = sorted(found, key=lambda x: (-x[0], x[1]))[:params.max_query_terms]
        top = max((s for s, _ in found), default=0)
        scores = []
        for (corpus, i), bag in bags.items():
            if corpus != "train" or (exclude_self and i == qid):
                continue
            total, hit = 0, False
            for s, w in found:
                if bag[w]:
                    hit = True
                    weight = (params.boost_factor * s / top if params.boost else 1.0) * idf[w] * (score.k1 + 1)
                    norm = score.k1 * (1 - score.b + score.b * sum(bag.values()) / avgdl)
                    total += micro(weight * (bag[w] / (bag[w] + norm)))
            if hit:
                scores.append((-total, i))
        result[qid] = [(i, -s / 1e6) for s, i in sorted(scores)[:k]]
    return result


@pytest.fixture(scope="module")
def corpus():
    """Skewed words; a third of the documents are copies of one text, as are some queries."""
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda n: " ".join(rng.choices(vocab, weights, k=n))
    copied = text(12)
    docs = [("train", i, copied if i % 3 == 0 else text(rng.randint(1, 25))) for i in range(120)]
    docs += [("test", i, text(8)) for i in range(10)]
    queries = [(200 + i, text(rng.randint(1, 10))) for i in range(12)]
    queries += [(300 + i, copied) for i in range(6)] + [(400, "unknown"), (401, "w0"), (402, "w0 w1")]
    return docs, queries


def frames(spark, docs, queries):
    table = spark.createDataFrame([(c, i, t, f"tag{i}") for c, i, t in docs],
                                  "corpus string, id long, text string, tags string")
    return table, spark.createDataFrame(queries, "query_id long, text string")


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.id, r.score))
        assert len(out[r.query_id]) == r["rank"]
        assert r.tags == f"tag{r.id}"
    return out


def without_empty(result):
    return {q: hits for q, hits in result.items() if hits}


@pytest.mark.parametrize("strategy, rounds, block_docs", [
    ("direct", (1,), 1), ("blocks", (1,), 4), ("blocks", (1, 3, 9), 7), ("blocks", (2, 5), 1), ("blocks", search.ROUNDS, bl.BLOCK_DOCS)])
def test_every_strategy_equals_brute_force(spark, corpus, strategy, rounds, block_docs):
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    staging = Staging(spark)
    index = search.stage_index(table, staging)
    blocks = search.stage_blocks(index, staging, block_docs=block_docs)
    found = search.find_neighbors(asked, index, 5, strategy=strategy, rounds=rounds, blocks=blocks, staging=staging)
    assert collected(found) == without_empty(brute_force(docs, queries, 5))


def test_blocks_are_skipped_and_postings_left_out():
    """Scores equal plain sums, and few of the postings of a skewed block are touched."""
    rng = np.random.default_rng(4)
    n, words = 400, 300
    keys = [np.unique(rng.zipf(1.3, 40) % words).astype(np.int64) for _ in range(n)]
    impacts = [rng.random(len(x)) for x in keys]
    block = bl.unpack_block(bl.pack_block(list(range(1000, 1000 + n)), keys, impacts))
    asked = [np.unique(rng.integers(0, words, 20)).astype(np.int64) for _ in range(30)] + [np.array([9999], np.int64), np.zeros(0, np.int64)]
    held = np.bincount(np.concatenate(keys), minlength=10_000)
    weights = [np.log(1 + n / (held[x] + 0.5)) for x in asked]  # rare words weigh more
    plain = np.zeros((len(asked), n), np.int64)
    for q, (own, w) in enumerate(zip(asked, weights)):
        for d in range(n):
            for key, impact in zip(keys[d], impacts[d]):
                if key in own:
                    plain[q, d] += micro(w[list(own).index(key)] * impact)
    k = 3
    kth = np.sort(plain, axis=1)[:, -k]
    counts = np.array([len(x) for x in asked])
    flat, flat_w = np.concatenate(asked), np.concatenate(weights)
    for floors in (np.zeros(len(asked), np.int64), kth):
        query, doc, score, touched = bl.score_requests(block, floors, flat, flat_w, counts, k)
        got = {q: [] for q in range(len(asked))}
        for q, d, s in zip(query.tolist(), doc.tolist(), score.tolist()):
            got[q].append((d, s))
        for q in range(len(asked)):
            best = sorted(((-plain[q, d], d) for d in range(n) if plain[q, d] >= max(floors[q], 1)))[:k]
            assert got[q] == [(d, -s) for s, d in best]
        if floors.any():
            assert touched[0] < 0.5 * everything
        everything = touched[0]


def test_queries_that_share_a_hot_term_are_cut_into_cells(spark):
    sizes = spark.createDataFrame([(1, 40, 60), (2, 1, 9)], "key long, asked long, held long")
    left = spark.range(40).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("a")).unionByName(
        spark.createDataFrame([(2, 7)], "key long, a long"))
    right = spark.range(60).select(F.when(F.col("id") < 51, 1).otherwise(2).cast("long").alias("key"), F.col("id").alias("b"))
    made = nn.join_cells(left, right, "key", "a", "b", sizes, cell_rows=100)
    rows = [(r.key, r.a, r.b) for r in made.collect()]
    assert len(rows) == len(set(rows)) == 40 * 51 + 9
    assert made.groupBy("key").count().count() == 2


def test_one_plan_equals_brute_force(spark, corpus):
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    assert collected(search.knn_join(asked, build_index(table), 4)) == without_empty(brute_force(docs, queries, 4))


def test_a_hot_word_is_split_on_both_sides(spark):
    """One word in every query and document: no task gets more than a few cells of the product."""
    rows = [("train", i, f"hot w{i % 7}", "") for i in range(60)]
    index = build_index(spark.createDataFrame(rows, "corpus string, id long, text string, tags string"))
    asking = spark.range(40).select(F.col("id").alias("bag_id"), F.lit("hot").alias("term"), F.lit(60).cast("bigint").alias("df"), F.lit(1.0).alias("weight"))
    asking = asking.unionByName(asking.withColumns({"term": F.lit("w3"), "df": F.lit(9).cast("bigint")}))
    plain = {(q, t, i) for q in range(40) for i in range(60) for t in ["hot"] + ["w3"] * (i % 7 == 3)}
    split = nn.join_postings(asking, index, "train", cell_rows=100)
    found = [(r.bag_id, r.term, r.id) for r in split.collect()]
    assert set(found) == plain and len(found) == len(plain) == 40 * 60 + 40 * 9
    per_key = nn.join_postings(asking, index, "train", cell_rows=100).groupBy(F.spark_partition_id()).count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert max(r["count"] for r in per_key.collect()) < 0.3 * len(plain)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("strategy", ["direct", "blocks"])
def test_without_self(spark, corpus, strategy):
    docs, _ = corpus
    queries = [(i, t) for c, i, t in docs if c == "train"]
    table, asked = frames(spark, docs, queries)
    index = search.stage_index(table, Staging(spark))
    found = search.find_neighbors(asked, index, 3, exclude_self=True, strategy=strategy)
    assert collected(found) == without_empty(brute_force(docs, queries, 3, exclude_self=True))


def test_boost_and_limits(spark, corpus):
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    params = TermParams(max_tokens=6, min_term_freq=1, min_doc_freq=2, max_query_terms=3, boost=True, boost_factor=2.0)
    score = ScoreParams(k1=1.7, b=0.3)
    index = search.stage_index(table, Staging(spark))
    expected = without_empty(brute_force(docs, queries, 5, params, score))
    for strategy in ("direct", "blocks"):
        found = search.find_neighbors(asked, index, 5, terms=params, score=score, strategy=strategy)
        assert collected(found) == expected


def test_splitting_hot_terms_changes_nothing(spark, corpus):
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    index = build_index(table)
    selected = terms.query_terms(asked, index.term_stats, index.corpus_stats, ANY_TERM).select("query_id", "term", "df")
    whole = nn.join_postings(selected, index, "train")
    split = nn.join_postings(selected, index, "train", cell_rows=7)
    assert whole.exceptAll(split).count() == 0 and split.exceptAll(whole).count() == 0


def test_explained_scores_sum_to_the_score(spark, corpus):
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    index = search.stage_index(table, Staging(spark))
    selected = terms.query_terms(asked, index.term_stats, index.corpus_stats, ANY_TERM)
    best = nn.top_k(nn.score_docs(selected, index, corpus="train"), 3)
    parts = nn.explain_scores(selected, index, best, corpus="train").groupBy("query_id", "id").agg(
        F.round(F.sum("score"), 6).alias("total"))
    assert best.join(parts, ["query_id", "id"], "left").filter(
        "total is null or abs(total - score) > 1e-9").count() == 0


def test_all_corpora_keep_equal_ids_apart(spark, corpus):
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    index = search.stage_index(table, Staging(spark))
    selected = terms.query_terms(asked, index.term_stats, index.corpus_stats, ANY_TERM)
    expected = nn.fetch_tags(nn.top_k(nn.score_docs(selected, index), 7), index.docs)
    for strategy in ("direct", "blocks"):
        found = search.find_neighbors(asked, index, 7, corpus=None, strategy=strategy)
        assert sorted(map(tuple, found.select(expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_search_by_stored_documents(spark, corpus):
    docs, _ = corpus
    table, _ = frames(spark, docs, [(0, "")])
    index = search.stage_index(table, Staging(spark))
    queries = [(1000 * (c == "test") + i, t) for c, i, t in docs]
    wanted = table.select((F.when(F.col("corpus") == "test", 1000).otherwise(0) + F.col("id")).alias("query_id"), "corpus", "id")
    expected = without_empty(brute_force(docs, queries, 4, exclude_self=True))
    assert collected(search.find_like(wanted, index, 4)) == expected
    # Over all corpora only the document itself goes, not the one with its id elsewhere.
    everywhere = search.find_like(wanted, index, 200, corpus=None).filter("query_id = 1003")
    ids = {(r.corpus, r.id) for r in everywhere.collect()}
    assert ("train", 3) in ids and ("test", 3) not in ids


def test_each_term_is_searched_in_its_top_field(spark):
    rows = [("train", 1, "apple apple", "pear x y z", "t1"), ("train", 2, "pear", "apple pear", "t2"), ("train", 3, "plum", "pear apple", "t3"),
            ("test", 4, "pear pear", "apple", "t4"), ("train", 5, "", "", "t5")]
    table = spark.createDataFrame(rows, "corpus string, id long, title string, body string, tags string")
    index = search.stage_field_index(table, ["title", "body"], Staging(spark))
    asked = spark.createDataFrame([(9, "apple pear plum none")], "query_id long, text string")
    got = [(r.id, r.score, r.tags) for r in search.find_neighbors(asked, index, 5).orderBy("rank").collect()]
    # apple: title 1, body 3; pear: title 2, body 3; plum: title 1.
    average = {"title": 6 / 5, "body": 9 / 5}
    df = {"apple": ("body", 3), "pear": ("body", 3), "plum": ("title", 1)}
    scores = {}
    for corpus, i, title, body, _ in rows:
        for word, (field, n) in df.items():
            text = {"title": title, "body": body}[field].split()
            if word in text and corpus == "train":
                weight = math.log(1 + (5 - n + 0.5) / (n + 0.5)) * 2.2
                norm = 1.2 * (0.25 + 0.75 * len(text) / average[field])
                scores[i] = scores.get(i, 0) + micro(weight * (text.count(word) / (text.count(word) + norm)))
    assert got == [(i, s / 1e6, f"t{i}") for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))]


def test_dropped_frequent_words_leave_before_the_shuffle(spark):
    """Rows of a word that a limit drops are not among those that meet by term."""
    rows = [("train", i, f"hot also w{i}", "") for i in range(300)]
    index = build_index(spark.createDataFrame(rows, "corpus string, id long, text string, tags string"))
    stats = index.term_stats.select("term", "df").withColumn("wanted", F.col("df") <= 100)
    found, missed, rest = terms.split_by_frequency(index.postings.select("id", "term"), stats, F.lit(300))
    assert found.count() == 0
    assert {r.term for r in missed.collect()} == {f"w{i}" for i in range(300)} and rest.count() == 300
    # Frequent in the other corpus only.
    limits = stats.select("term", F.lit(1).cast("bigint").alias("df"), F.col("df").alias("limit_df"), F.col("wanted"))
    _, missed, _ = terms.split_by_frequency(index.postings.select("id", "term"), limits, F.lit(300))
    assert missed.filter("term = 'hot'").count() == 0


def test_corpora_share_statistics_but_not_results(spark):
    rows = [("train", 1, "apple pear", "x"), ("test", 1, "apple", "y"), ("test", 2, "apple", "z")]
    table = spark.createDataFrame(rows, "corpus string, id long, text string, tags string")
    asked = spark.createDataFrame([(5, "apple")], "query_id long, text string")
    index = build_index(table)
    assert index.term_stats.filter("term = 'apple'").first().df == 3
    hits = search.knn_join(asked, index).collect()
    assert [(h.id, h.tags) for h in hits] == [(1, "x")]
    selected = terms.query_terms(asked, index.term_stats, index.corpus_stats, ANY_TERM)
    everywhere = nn.fetch_tags(nn.top_k(nn.score_docs(selected, index), 5), index.docs)
    assert {(r.corpus, r.id, r.tags) for r in everywhere.collect()} == {
        ("train", 1, "x"), ("test", 1, "y"), ("test", 2, "z")}


def test_query_without_hits_keeps_its_line(spark):
    table = spark.createDataFrame([("train", 1, "apple", "x y")], "corpus string, id long, text string, tags string")
    asked = spark.createDataFrame([(5, "apple"), (6, "none")], "query_id long, text string")
    packed = nn.pack_neighbors(search.knn_join(asked, build_index(table)), asked)
    assert {r.query_id: [(n.id, n.tags) for n in r.neighbors] for r in packed.collect()} == {5: [(1, "x y")], 6: []}


def test_terms_of_indexed_documents_and_texts_agree(spark, corpus):
    docs, _ = corpus
    table, _ = frames(spark, docs, [(0, "")])
    index = build_index(table)
    train = table.filter("corpus = 'train'")
    by_id = terms.query_terms_by_id(train.select(F.col("id").alias("query_id"), "corpus", "id"), index.docs,
                                    index.term_stats, index.corpus_stats, ANY_TERM)
    by_text = terms.query_terms(train.select(F.col("id").alias("query_id"), "text"), index.term_stats,
                                index.corpus_stats, ANY_TERM)
    columns = ["query_id", "term", "tf", "df", "score", "rank"]
    assert by_id.select(columns).exceptAll(by_text.select(columns)).count() == 0
    assert by_id.count() == by_text.count()


def test_token_cap_counts_noise(spark):
    asked = spark.createDataFrame([(1, "aa bb bb cc dd")], "query_id long, text string")
    got = terms.source_tf(asked, TermParams(max_tokens=4, stop_words=("bb",)))
    assert {r.term: r.tf for r in got.collect()} == {"aa": 1, "cc": 1}


def test_limits_from_another_corpus(spark):
    table = spark.createDataFrame([("train", 1, "a1 b1", ""), ("train", 2, "a1", "")],
                                  "corpus string, id long, text string, tags string")
    other = spark.createDataFrame([("x", 1, "b1 c1", ""), ("x", 2, "b1", "")],
                                  "corpus string, id long, text string, tags string")
    index, limits = build_index(table), build_index(other).term_stats
    asked = spark.createDataFrame([(1, "a1 b1 c1")], "query_id long, text string")
    got = terms.query_terms(asked, index.term_stats, index.corpus_stats,
                            TermParams(min_term_freq=1, min_doc_freq=1), threshold_stats=limits)
    assert {r.term: r.df for r in got.collect()} == {"b1": 1, "c1": 0}


def test_top_field(spark):
    stats = spark.createDataFrame([("title", "a", 3), ("body", "a", 3), ("title", "b", 1), ("body", "b", 2)],
                                  "field string, term string, df long")
    got = {r.term: (r.df, r.top_field) for r in multi_field_stats(stats, ["title", "body"]).collect()}
    assert got == {"a": (3, "title"), "b": (2, "body")}


def test_stored_index(spark, tmp_path, corpus):
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    path = str(tmp_path / "index")
    write_index(table.filter("corpus = 'train'"), path)
    index = write_index(table.filter("corpus = 'test'"), path)
    assert index.n_docs == len(docs)
    assert collected(search.knn_join(asked, read_index(spark, path))) == without_empty(brute_force(docs, queries, 5))
    # Replacing one corpus leaves the other alone and can be repeated.
    assert write_index(table.filter("corpus = 'test'"), path, mode="overwrite").n_docs == len(docs)


def test_empty_index(spark):
    table = spark.createDataFrame([], "corpus string, id long, text string, tags string")
    index = build_index(table)
    assert index.corpus_stats.first().asDict() == {"n_docs": 0, "sum_ttf": 0, "avgdl": 1.0}
    asked = spark.createDataFrame([(1, "a1")], "query_id long, text string")
    assert search.knn_join(asked, index).count() == 0
    assert search.find_neighbors(asked, index).count() == 0


def test_pairs_of_queries_and_blocks_stay_in_their_task(spark, corpus, monkeypatch):
    """What is dealt out are queries per group and blocks per part, however many blocks a group has."""
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    staging, dealt, plain = Staging(spark), [], DataFrame.repartition
    index = search.stage_index(table, staging)
    blocks = search.stage_blocks(index, staging, block_docs=1)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *a: dealt.append(self.count()) or plain(self, *a))
    found = search.find_neighbors(asked, index, 5, blocks=blocks, staging=staging)
    assert sum(dealt) < 6 * (len(docs) + len(queries)) < len(docs) * len(queries) / 2
    assert collected(found) == without_empty(brute_force(docs, queries, 5))


@pytest.mark.parametrize("limits", [{"group_postings": 40}, {"group_keys": 25}, {"group_postings": 1}])
def test_many_groups_equal_brute_force(spark, corpus, monkeypatch, limits):
    docs, queries = corpus
    table, asked = frames(spark, docs, queries)
    staging = Staging(spark)
    index = search.stage_index(table, staging)
    monkeypatch.setattr(bl, "block_table", partial(bl.block_table, **limits))
    monkeypatch.setattr(search, "PART_BAGS", 4)
    blocks = search.stage_blocks(index, staging, block_docs=3)
    assert len(blocks.groups) > 10
    found = search.find_neighbors(asked, index, 5, blocks=blocks, staging=staging)
    assert collected(found) == without_empty(brute_force(docs, queries, 5))


def test_packed_numbers():
    for top in (0, 255, 256, 65_535, 65_536, 1 << 31):
        assert bl.long(bl.short(np.array([0, top])), 2).tolist() == [0, top]
    assert len(bl.long(bl.short(np.zeros(0, np.int64)), 0)) == 0


def test_dense_requests_take_little_memory():
    """Every one of many queries hits every document of the block."""
    n, asked = 512, 10_000
    block = bl.unpack_block(bl.pack_block(list(range(n)), [np.arange(3)] * n, [np.ones(3)] * n))
    tracemalloc.start()
    query, _, score, _ = bl.score_requests(block, np.zeros(asked, np.int64), np.tile(np.arange(3), asked), np.ones(3 * asked), np.full(asked, 3), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(query) == 5 * asked and set(score) == {3_000_000}
    assert peak < 80 << 20
