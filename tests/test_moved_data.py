"""What a job shuffles and writes: texts once, blocks and segments compressed."""

from pathlib import Path

import numpy as np
import pytest

from checks import derive
from neartag.operators import blocks as bl
from neartag.operators import learn, trees
from neartag.plans import learning
from neartag.sources import index_store as store


@pytest.fixture
def tables(spark, tmp_path):
    docs = [(i, f"title {i}\nword{i % 7} common", "de", "web", 20) for i in range(60)] + [(None, "lost", "en", "web", 4), (3, "again", None, "web", 5)]
    made = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
            "labels": ([(i, i % 2, None) for i in range(0, 60, 3)] + [(None, 1, 1)], "doc_id long, quality int, toxic int"),
            "benchmark": ([(1, "word1 common"), (2, None)], "item_id long, text string")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_dealt_texts_are_shuffled_once(spark, tables):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        dealt = derive.both(spark, tables, dealt=True)
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.splitlines() if "Exchange" in line]
        # One for documents, one for their labels, one for the benchmark.
        assert len(exchanges) == 3 and all("hashpartitioning" in line for line in exchanges), plan
        plain = derive.both(spark, tables)
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
        assert dealt.count() == 64
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


@pytest.mark.parametrize("n_docs", [1, 3, 600])
def test_blocks_are_small_and_keep_every_posting(n_docs):
    rng = np.random.default_rng(n_docs)
    vocabulary = rng.integers(-2 ** 63, 2 ** 63 - 1, 3000)
    keys = [rng.choice(vocabulary, rng.integers(0, 300), replace=False) for _ in range(n_docs)]
    impacts = [rng.choice([0.3, 0.5, 0.6], len(k)) / (i + 1) for i, k in enumerate(keys)]
    made = bl.pack_block(list(range(-5, n_docs - 5)), keys, impacts)
    block = bl.unpack_block(made)
    expected = sorted((int(k), i, float(v)) for i, (ks, vs) in enumerate(zip(keys, impacts)) for k, v in zip(ks, vs))
    sizes = block.ends - block.starts
    assert list(zip(np.repeat(block.keys, sizes).tolist(), block.docs.tolist(), block.impacts.tolist())) == expected
    assert block.ids.tolist() == list(range(-5, n_docs - 5))
    largest: dict[int, float] = {}
    for key, _, impact in expected:
        largest[key] = max(impact, largest.get(key, 0.0))
    assert dict(zip(block.keys.tolist(), block.maxima.tolist())) == largest
    if n_docs == 600:
        # A document number and a number of an impact of two bytes each made four bytes a posting.
        assert sum(map(len, made.values())) < 2.2 * len(expected)


def test_a_block_without_postings():
    block = bl.unpack_block(bl.pack_block([7, 8], [np.zeros(0, np.int64)] * 2, [np.zeros(0)] * 2))
    assert block.ids.tolist() == [7, 8] and not len(block.keys) and not len(block.docs) and not len(block.maxima)


def test_merging_adds_the_counts_of_segments(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    rows = [("train", i, f"word{i % 3} common", "t") for i in range(9)]
    for part in (rows[:4], rows[4:]):
        store.append_segment(spark.createDataFrame(part, "corpus string, id long, text string, tags string"), path)
    counted = sorted(map(tuple, store.read_segments(spark, path).term_stats.collect()))

    def recount(_):
        raise AssertionError("the documents were counted again")
    monkeypatch.setattr(store, "build_term_stats", recount)
    store.merge_segments(spark, path)
    assert sorted(map(tuple, store.read_segments(spark, path).term_stats.collect())) == counted
    docs = [p.name for p in Path(path).glob("segments/*/docs/*.parquet")]
    assert docs and all(name.endswith(".zstd.parquet") for name in docs)


@pytest.mark.parametrize("top", [1, 300, 70_000, 1 << 33])
def test_counts_of_trees_are_small_and_kept(top):
    counts = np.zeros(20_000, np.int64)
    counts[::3] = np.arange(1, len(counts[::3]) + 1) % 7 + 1
    counts[-1] = top
    row = trees.packed(2, 5, 1, counts)
    (tree, node, part, total), = trees.added_up([row, trees.packed(2, 5, 3, counts)], len(counts))
    assert (tree, node, part) == (2, 5, 3) and total.tolist() == (2 * counts).tolist()
    # Eight bytes for a key and eight for a count made 16 bytes an entry.
    assert top > 300 or sum(len(row[c][0].as_py()) for c in ("keys", "counts")) < 2 * np.count_nonzero(counts)
    nothing, = trees.added_up([trees.packed(0, 1, 0, np.zeros(8, np.int64))], 8)
    assert nothing[3].tolist() == [0] * 8


def test_texts_are_dealt_once_for_trees(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a b", f"w{i % 3} c", "x y") for i in range(30)], "id long, title string, body string, tags string")
    read, tasks = [], []
    counted = trees.count_level
    monkeypatch.setattr(learn, "bag_of_words", lambda df, *rest, own=learn.bag_of_words: read.append(len(df.inputFiles())) or own(df, *rest))
    monkeypatch.setattr(trees, "count_level", lambda df, *rest: tasks.append(df.rdd.getNumPartitions()) or counted(df, *rest))
    learning.fit_labelset_trees(rows.repartition(50), depth=1)
    assert len(read) == 2 and all(read)  # staged files
    assert max(tasks) <= spark.sparkContext.defaultParallelism
