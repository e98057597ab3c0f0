"""Work that a search leaves out, with the same results: F18."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from neartag.functions import scoring, text
from neartag.functions.scoring import ScoreParams
from neartag.operators import blocks as bl
from neartag.operators import neighbors as nn
from neartag.operators import terms, tokens
from neartag.operators.terms import ANY_TERM
from neartag.plans import search
from neartag.plans.staging import Staging


def test_terms_are_counted_by_batch(spark):
    rows = [(1, "b a b É z a b"), (2, None), (3, ""), (4, "the"), (4, "z 名 \U00010400 é a"), (None, "a")]
    packed = tokens.pack_terms(spark.createDataFrame(rows, "id long, text string"), text.standard(F.col("text")), ("id",))
    assert packed.schema.simpleString() == "struct<id:bigint,n_tokens:bigint,terms:array<struct<term:string,tf:bigint>>>"
    got = [(r.id, r.n_tokens, [tuple(t) for t in r.terms]) for r in packed.collect()]
    # In the order of UTF-8 bytes, as sort_array gives it.
    assert sorted(got, key=repr) == sorted([
        (1, 5, [("b", 3), ("z", 1), ("é", 1)]), (2, 0, []), (3, 0, []), (4, 0, []),
        (4, 4, [("z", 1), ("é", 1), ("名", 1), ("\U00010428", 1)]), (None, 0, [])], key=repr)
    # Words are compared in no expression of the row: the plan sorts no arrays.
    assert "sort_array" not in packed._jdf.queryExecution().optimizedPlan().toString()


def test_counts_of_lists():
    lists = pa.array([["b", "a", "b"], None, [], ["c", None, "a", None]], pa.list_(pa.string()))
    assert tokens.count_lists(lists).to_pylist() == [
        [{"term": "a", "tf": 1}, {"term": "b", "tf": 2}], None, [],
        [{"term": None, "tf": 2}, {"term": "a", "tf": 1}, {"term": "c", "tf": 1}]]
    assert tokens.count_lists(lists.slice(2, 1)).to_pylist() == [[]]
    assert tokens.count_lists(lists.slice(0, 0)).to_pylist() == []


@pytest.mark.parametrize("params", [ScoreParams(), ScoreParams(k1=1.7, b=0.3), ScoreParams(norms=False), ScoreParams(scorer="tfidf"), ScoreParams(scorer="tfidf", norms=False)])
def test_impacts_in_tasks_are_those_of_the_column(spark, params):
    rows = spark.range(3000).select((F.col("id") % 37 + 1).alias("tf"), (F.col("id") * 7 % 991 + 40).alias("doc_len"))
    found = rows.select("tf", scoring.term_impact(F.col("tf"), F.col("doc_len"), F.lit(123.456), params).alias("impact"),
                        scoring.length_part(F.col("doc_len"), F.lit(123.456), params).alias("part")).toPandas()
    made = scoring.impact_of(found["tf"].to_numpy(), found["part"].to_numpy(), params)
    assert made.tolist() == found["impact"].astype(float).tolist()


def block_of(seed, n=60, words=500):
    rng = np.random.default_rng(seed)
    keys = [rng.permutation(np.unique(rng.integers(-words, words, 30) ** 3)) for _ in range(n)]
    return bl.pack_block(list(range(n)), keys, [rng.choice([0.2, 0.4, 0.5], len(k)) for k in keys])


def test_only_wanted_keys_are_unpacked():
    made = block_of(1)
    whole = bl.unpack_block(made)
    for wanted in (whole.keys[::7], np.concatenate((whole.keys[:5] - 1, whole.keys[:5], [2 ** 62])), np.array([2 ** 61]), np.zeros(0, np.int64)):
        wanted = np.unique(wanted)
        part = bl.unpack_block(made, wanted)
        at = np.flatnonzero(np.isin(whole.keys, wanted))
        assert part.keys.tolist() == whole.keys[at].tolist() and part.maxima.tolist() == whole.maxima[at].tolist()
        assert part.ids.tolist() == whole.ids.tolist()
        postings = np.concatenate([np.arange(whole.starts[a], whole.ends[a]) for a in at] or [np.zeros(0, int)]).astype(int)
        assert part.docs.tolist() == whole.docs[postings].tolist() and part.impacts.tolist() == whole.impacts[postings].tolist()
        numbers = np.repeat(np.arange(len(at)), part.ends - part.starts)
        assert part.places.tolist() == (numbers * len(part.ids) + part.docs).tolist()


def test_first_and_later_queries_of_a_group_find_the_same(monkeypatch):
    rows = [block_of(seed) | {"corpus": "train", "shelf": 0, "block": seed} for seed in range(9)]
    asked = np.unique(np.concatenate([bl.unpack_block(r).keys for r in rows]))[3::40]
    keys, weights, counts = np.concatenate((asked, asked[::-2])), np.linspace(1, 2, len(asked) + len(asked[::-2])), np.array([len(asked), len(asked[::-2])])
    unpacked = []
    plain = bl.unpack_block
    monkeypatch.setattr(bl, "unpack_block", lambda row, wanted=None: unpacked.append(wanted is None) or plain(row, wanted))
    shelf = bl.Shelf(rows)
    first = shelf.search(keys, weights, counts, 4, (1, 3))
    assert sum(unpacked) == 1  # the block of blocks, which holds their terms only
    unpacked.clear()
    later = shelf.search(keys, weights, counts, 4, (1, 3))
    assert sum(unpacked) == len(rows) + 1
    unpacked.clear()
    assert [x.tolist() for x in first] == [x.tolist() for x in later] == [x.tolist() for x in shelf.search(keys, weights, counts, 4, (1, 3))]
    assert sum(unpacked) == 0 and len(first[0]) == 8


def test_floors_of_earlier_groups_leave_the_same_result(spark, monkeypatch):
    """Many queries search some groups first; small blocks, two shelves of which one has no number."""
    rng = np.random.default_rng(7)
    rows = [("train", i, " ".join(f"w{x}" for x in rng.zipf(1.4, 12) % 40), "") for i in range(160)]
    index = search.stage_index(spark.createDataFrame(rows, "corpus string, id long, text string, tags string"), Staging(spark))
    shelf = F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("int")
    weighted = bl.weighted_docs(index, ScoreParams(), index.seed, "train").repartition(3, "id")
    table = Staging(spark).write(bl.block_table(weighted, shelf, 8, group_postings=100), "blocks")
    groups = tuple(sorted(r.grp for r in table.select("grp").distinct().collect()))
    blocks = search.Blocks(table, groups, index.seed, False)
    asked = spark.createDataFrame([(r[1], r[2]) for r in rows], "query_id long, text string")
    bags = nn.term_bags(terms.query_terms(asked, index.term_stats, index.corpus_stats, ANY_TERM), index).withColumnRenamed("query_id", "bag_id")
    plain = [tuple(r) for r in search.search_bags(bags, blocks, 4, Staging(spark)).collect()]
    monkeypatch.setattr(search, "WAVE_BAGS", 1)
    monkeypatch.setattr(bl, "FEW", 0)
    sent = []
    own = bl.search_groups
    monkeypatch.setattr(bl, "search_groups", lambda lists, table, groups, *rest: sent.append((lists.columns, groups)) or own(lists, table, groups, *rest))
    assert len(groups) > search.WAVE
    waves = [tuple(r) for r in search.search_bags(bags, blocks, 4, Staging(spark)).collect()]
    assert sorted(waves, key=repr) == sorted(plain, key=repr)
    (_, first), (columns, later) = sent
    assert {"least", "floors"} <= set(columns) and sorted(first + later) == list(groups) and len(first) < len(later)
    # Left out is only what is not among the best of all shelves but one.
    out = [tuple(r) for r in search.search_bags(bags, blocks, 4, Staging(spark), leave_out=True).collect()]
    assert set(out) < set(plain)
    for bag in {r[0] for r in plain}:
        for without in (None, 1, 2):
            best = [sorted((-m, i) for b, s, _, i, m in found if b == bag and s != without)[:4] for found in (plain, out)]
            assert best[0] == best[1]


def test_repeated_ids_lower_the_floor_of_all_shelves_but_one(spark):
    rows = [(1, 0, 7, 90), (1, 0, 7, 90), (1, 0, 10, 50), (1, 1, 11, 40), (1, 1, 21, 30), (1, 2, 2, 20),
            (2, 0, 7, 5), (3, 0, 10, 9), (3, 1, 1, 8), (3, 1, 11, 7), (3, 0, 20, 6), (3, None, None, 10)]
    best = spark.createDataFrame([(b, s, "train", i, m) for b, s, i, m in rows], "bag_id long, shelf int, corpus string, id long, micro long")
    found = {r.bag_id: (r.least, sorted(map(tuple, r.floors), key=repr)) for r in nn.search_floors(best, 2, True).collect()}
    # One row repeats an id, so the third best counts: 20 without shelf 0, 50 without the others.
    assert found == {1: (20, [(0, 90), (1, 30)]), 2: (0, []), 3: (6, [(0, 6), (1, 7)])}
    found = {r.bag_id: r.least for r in nn.search_floors(best, 2).collect()}
    assert found == {1: 0, 2: 0, 3: 0}


def test_joined_blocks_are_one_block():
    parts = [bl.unpack_block(block_of(seed, n)) for seed, n in ((1, 20), (3, 33))]
    joined = bl.join_blocks(parts)
    sizes = joined.ends - joined.starts
    found = set(zip(np.repeat(joined.keys, sizes).tolist(), joined.docs.tolist(), joined.impacts.tolist()))
    expected, before = set(), 0
    for b in parts:
        expected |= set(zip(np.repeat(b.keys, b.ends - b.starts).tolist(), (b.docs + before).tolist(), b.impacts.tolist()))
        before += len(b.ids)
    assert found == expected and len(joined.docs) == len(expected) and len(joined.ids) == 53
    slots, table = joined.frequent
    for term in np.flatnonzero(slots >= 0).tolist():
        row = table.reshape(-1, 53)[slots[term]]
        held = joined.docs[joined.starts[term]:joined.ends[term]]
        assert np.flatnonzero(row).tolist() == held.tolist() and row[held].tolist() == list(range(1, len(held) + 1))
