"""Top-k search, SimHash near-dedup and decontamination."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neartag.llm import decontaminate as dc
from neartag.llm import simhash, topk
from neartag.llm.queries import ORACLE
from neartag.plans.staging import Staging

from .helpers import documents, nothing, odd_documents, prose


# --- top-k -------------------------------------------------------------------------------

def brute_top(rows, k):
    usable = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(len(v) for _, v in usable)
    padded = [(i, np.pad(v, (0, width - len(v)))) for i, v in usable]
    out = []
    for q, v in padded:
        if q % 5 == 0:
            best = sorted((-int(v @ w), i) for i, w in padded if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block, group, leads", [(16, 7, 1), (256, 256, 4)])
def test_top_k(spark, block, group, leads):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(5, 8))
    rows = [(i, (centers[i % 5] + rng.normal(size=8) * 0.2).tolist()) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 260)]  # ties
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (305, [1.0, -2.0]), (310, [0.0] * 8), (None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, label int")
    got = topk.top_k(frame, F.col("vec_id") % 5 == 0, 20, block=block, group=group, leads=leads)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, 20)


def test_top_k_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") >= 0, 3).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema), F.col("vec_id") == 0, 3).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 64 * 128)]


def test_blocks_are_skipped(spark):
    rng = np.random.default_rng(4)
    centers = np.eye(8) * 10
    rows = [(i, (centers[i % 8] + rng.normal(size=8) * 0.1).tolist()) for i in range(2000)]
    staging = Staging(spark)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    topk.top_k(frame, F.col("vec_id") % 100 == 0, 5, staging=staging, block=32, group=64).count()
    read = lambda name: spark.read.parquet(f"{staging.path}/{name}")
    floors = {(r.group, r.query): r.floor for r in topk.ranked(read("first"), 5).filter("rank = 5").select("group", "query", F.col("score").alias("floor")).collect()}
    blocks = read("blocks").collect()
    high, low = (np.array([r[c] for r in blocks]) for c in ("high", "low"))
    known = [(r.group, r["values"]) for r in read("groups").collect()]
    bounds = {(g, q): np.maximum(v, 0) @ high.T + np.minimum(v, 0) @ low.T for g, values in known for q, v in enumerate(np.array(values))}
    assert set(floors) == set(bounds)
    wanted = sum(int((bound >= floors[key]).sum()) for key, bound in bounds.items())
    assert wanted < 0.4 * len(bounds) * len(blocks)


def test_blocks_stop_below_a_rising_floor(spark):
    """One superblock of two blocks: the second is not looked at, as the first gives a higher floor."""
    schema = f"group long, super long, wanted {topk.WANTED}"
    pairs = [(0, 0, [(0, 0, 900, topk.LOWEST), (0, 1, 50, topk.LOWEST)])]
    groups = spark.createDataFrame([(0, [7], [[10]])], "group long, ids array<long>, values array<array<long>>")

    def found(second):
        forward = [np.array([[90], [80]], "<i8").tobytes(), np.array([[second]], "<i8").tobytes()]
        supers = spark.createDataFrame([(0, [(0, [1, 2], bytearray(forward[0])), (1, [3], bytearray(forward[1]))])],
                                       "super long, members array<struct<block: long, ids: array<long>, forward: binary>>")
        got = topk.score_pairs(spark.createDataFrame(pairs, schema), supers, groups, 1, 2).collect()
        return sorted((r.query_id, r.vec_id, r.score) for r in got)

    assert found(5) == [(7, 1, 900), (7, 2, 800)]
    # A value that contradicts its bound shows that the block was left out.
    assert found(1000) == [(7, 1, 900), (7, 2, 800)]


# --- SimHash -----------------------------------------------------------------------------

def roots(ids, linked):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5, 6, 8])
def test_pairs_within_the_distance_meet_at_an_anchor(distance):
    rng = np.random.default_rng(distance)
    one = rng.integers(-2 ** 63, 2 ** 63 - 1, 400, dtype=np.int64)
    other = one.copy()
    for i in range(len(other)):
        for bit in rng.choice(64, int(rng.integers(0, distance + 1)), replace=False):
            other[i] = int(other[i]) ^ (-(1 << 63) if bit == 63 else 1 << int(bit))
    homes, visits = collections.defaultdict(set), collections.defaultdict(set)
    for rows, keys, home in simhash.anchors(one, distance):
        for i, key, at_home in zip(rows.tolist(), keys.tolist(), home.tolist()):
            if at_home:
                homes[i].add(key)
    for rows, keys, _ in simhash.anchors(other, distance):
        for i, key in zip(rows.tolist(), keys.tolist()):
            visits[i].add(key)
    assert all(homes[i] & visits[i] for i in range(len(one)))


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_links_keep_every_component(spark, block):
    rng = np.random.default_rng(9)
    base = rng.integers(-2 ** 63, 2 ** 63 - 1, 40, dtype=np.int64).tolist()
    fps = set(base)
    for _ in range(160):  # chains and a dense group
        fp = int(rng.choice(list(fps))) if rng.random() < 0.5 else base[0]
        for bit in rng.choice(63, int(rng.integers(1, 5)), replace=False):
            fp ^= 1 << int(bit)
        fps.add(fp)
    ids = sorted(fps)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 4]
    frame = spark.createDataFrame([(i, i) for i in ids], "fp long, node long")
    edges = simhash.links(frame, 4, block=block)
    assert edges.count() <= len(linked)
    got = {r.node: r.root for r in simhash.components(edges, Staging(spark)).collect()}
    assert {i: got.get(i, i) for i in ids} == roots(ids, linked)


def test_components_of_a_path(spark):
    order = list(range(60))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "u long, v long")
    got = simhash.components(edges, Staging(spark)).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(1, 60)]
    assert simhash.components(edges.limit(0), Staging(spark)).count() == 0


def brute_near(rows, shingle, distance):
    fps = {}
    for i, t in rows:
        fps[i] = simhash.fingerprint(simhash.shingle_hashes(t or "", shingle))
    ids = [i for i, _ in rows if i is not None]
    linked = [(a, b) for a in ids for b in ids if a < b and ((fps[a] ^ fps[b]) & (2 ** 64 - 1)).bit_count() <= distance]
    return fps, roots(ids, linked)


def test_near_duplicates(spark):
    rng = random.Random(11)
    texts = [prose(rng, rng.randrange(30, 200)) for _ in range(40)]
    for i in range(60):
        words = texts[i % 8].split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts + texts[:5] + [None, "", "two words", "two words"])]
    fps, expected = brute_near(rows, 4, 4)
    got = simhash.near_duplicates(documents(spark, rows), Staging(spark)).collect()
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == {i: (fps[i], expected[i]) for i, _ in rows}
    assert fps[rows[-4][0]] == 0 and simhash.fingerprint(np.array([2 ** 64 - 1], np.uint64)) == -1


def test_near_duplicates_odd(spark):
    docs = odd_documents(spark)
    found = simhash.near_duplicates(docs, Staging(spark))
    got = found.collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.doc_id in (0, 1, 2)} == {0}
    assert all(r.component_id is None for r in got if r.doc_id is None)
    # One row of each group: of the empty texts that of id 0, not the one without an id.
    stay = [r.doc_id for r in simhash.representatives(found).collect()]
    assert stay.count(0) == 1 and not {1, 2} & set(stay) and stay.count(4) == 1 and stay.count(None) == 1
    assert simhash.near_duplicates(nothing(spark), Staging(spark)).count() == 0


# --- decontamination ---------------------------------------------------------------------

def brute_leaks(rows, items):
    out = set()
    for doc_id, text in rows:
        own = dc.words_of(text)
        for item_id, question, answer in items:
            shares = []
            for part in (question, answer):
                wanted = dc.shingles(dc.words_of(part))
                if wanted:
                    size = min(5, len(dc.words_of(part)))
                    have = {b" ".join(own[i:i + size]) for i in range(len(own) - size + 1)}
                    shares.append(len(wanted & have) / len(wanted))
            if shares and min(shares) >= 0.8:
                out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("shard_bytes", [dc.SHARD_BYTES, 400])
def test_leaks(spark, shard_bytes):
    rng = random.Random(4)
    names = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(names, k=rng.randrange(3, 150))), None) for i in range(30)]
    items += [(50, " ".join(rng.choices(names, k=30)), " ".join(rng.choices(names, k=9))), (51, None, None), (52, "", "")]
    rows = []
    for i in range(80):
        filler = [rng.choice(names) for _ in range(rng.randrange(0, 300))]
        _, question, answer = rng.choice(items[:31])
        words = f"{question} {answer or ''}".split()
        if i % 4 == 1:
            words[len(words) // 2] = "other"
        if i % 4 == 2:
            words = words[:len(words) // 2]
        at = rng.randrange(len(filler) + 1)
        rows.append((i, " ".join(filler[:at] + [w.upper() + "," for w in words] + filler[at:])))
    rows += [(100, None), (101, ""), (102, items[30][1]), (None, items[0][1])]
    frame = spark.createDataFrame(items, "item_id long, question string, answer string")
    got = dc.find_leaks(documents(spark, rows), frame, shard_bytes=shard_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(rows, items)
    kept = dc.drop_leaks(documents(spark, rows), dc.find_leaks(documents(spark, rows), frame))
    leaked = {d for d, _ in brute_leaks(rows, items) if d is not None}
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(i for i, _ in rows if i is not None and i not in leaked)


def test_items_with_gaps_equal_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(17)
    names = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(names, k=rng.choice((8, 20, 60, 90, 200))))) for i in range(60)]
    rows = []
    for i in range(240):
        words, gaps = items[i % 60][1].split(), rng.randrange(0, 5)
        cuts = sorted(rng.sample(range(1, len(words)), min(gaps, len(words) - 1)))
        parts = [words[a:b] for a, b in zip([0, *cuts], [*cuts, len(words)])]
        text = [w for part in parts for w in [*part, *(f"x{rng.randrange(9999)}" for _ in range(rng.randrange(70, 200)))]]
        rows.append((i, " ".join(text)))
    con = duckdb.connect()
    for name, key, values in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", values)
    expected = {(d, i): overlap for d, i, overlap in con.execute(ORACLE["op6_decontaminate"]).fetchall()}
    index = dc.ItemIndex([dc.Item(i, text, None) for i, text in items])
    got = {(d, i): overlap for d, text in rows for i, overlap in index.leaks(dc.words_of(text))}
    assert got == expected and len(expected) > 100
    long_answers = dc.ItemIndex([dc.Item(i, items[i][1], items[i + 1][1]) for i in range(0, 60, 2)])
    both = [(f"{items[i + 1][1]} {'other ' * 200} {items[i][1]}", i) for i in range(0, 60, 2)]
    assert all((i, 1.0) in long_answers.leaks(dc.words_of(text)) for text, i in both)


def test_bounds_grow_with_the_postings_only():
    items = [dc.Item(i, " ".join(f"w{40 * i + j}" for j in range(40)), None) for i in range(1500)]
    index = dc.ItemIndex(items)
    assert len(index.terms) * index.n_blocks > 20_000_000
    assert len(index.bounds) == len(index.blocks) == 60_000 and index.retrieve(dc.words_of(items[7].question)) == {7}


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(8)
    names = [f"w{i}" for i in range(60)]
    items = [dc.Item(i, " ".join(rng.choices(names, k=20)), None) for i in range(40)]
    index = dc.ItemIndex(items, 4)
    values = {}
    for term, blocks in enumerate(index.postings):
        for at, weights in blocks.values():
            for piece, weight in zip(at, weights):
                values[piece, term] = weight
    for _ in range(50):
        words = [w.encode() for w in rng.choices(names, k=40)]
        terms = {index.terms[w] for w in words if w in index.terms}
        exact = {p for p in range(40) if sum(values.get((p, t), 0) for t in terms) >= 0.4}
        assert index.retrieve(words, 0.4) == {index.owner[p] for p in exact}


def test_leaks_odd(spark):
    items = spark.createDataFrame([(1, "a negative id and ümlauts", None)], "item_id long, question string, answer string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(odd_documents(spark), items).collect()} == {(-5, 1)}
    assert dc.find_leaks(nothing(spark), items).count() == 0
    assert dc.find_leaks(odd_documents(spark), items.limit(0)).count() == 0
