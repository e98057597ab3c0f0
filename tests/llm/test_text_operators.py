"""BPE, token files and line dedup."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from neartag.llm import bpe, lines, rans
from neartag.llm.common import Memo
from neartag.llm.queries import vocabulary
from neartag.plans.staging import Staging

from .helpers import documents, nothing, odd_documents, prose

tokenizers = pytest.importorskip("tokenizers")
ODD_TEXTS = ["", " ", "a  b", "Σ ΑΣ ΑΣ's İx", "It's don't WE'LL", "x<|endoftext|>y <|startoftext|> z", "é ́b c\x1cd\x85e\n\n f",
             "１２３ ½ 42", "日本語 👩‍👩‍👧 ok", "a" * 3000, "ſ K Å ǅ Ⱥ", "ﬁ ﷺ", " \t\x0b", "end \n", "  x  y"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    letters = [chr(c) for c in [*range(0, 0x250), *range(0x300, 0x400), 0x2028, 0x3000, 0x1100, 0x1161, 0xac00]]
    return ODD_TEXTS + ["".join(rng.choices(letters, k=50)) for _ in range(300)] + [prose(rng, 200) for _ in range(5)]


def test_merge_skips_stale_entries():
    # 0 1 0 1 1: pair (0, 1) -> 2 at rank 0, pair (1, 1) -> 3 at rank 1 is stale after it.
    size = 10
    merges = {0 * size + 1: 0 * size + 2, 1 * size + 1: 1 * size + 3, 2 * size + 2: 2 * size + 4}
    assert bpe.merge_symbols([0, 1, 0, 1, 1], dict(merges), size) == [4, 1]
    assert bpe.merge_symbols([1, 1, 1], dict(merges), size) == [3, 1]
    assert bpe.merge_symbols([5], dict(merges), size) == [5]


def test_bpe_equals_the_library(texts):
    path = vocabulary("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Bpe.load(path)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, repr(text)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_tables(spark):
    path = vocabulary("word_bpe_49k.json")
    docs = odd_documents(spark)
    encoded = bpe.encode(docs, path)
    assert encoded.count() == docs.count()
    by_text = {r.doc_id: r for r in encoded.collect()}
    assert by_text[0].ids == [] and by_text[1].n_tokens == 0
    both = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, path).collect()}
    decoded = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in bpe.decode(encoded, path).collect()}
    assert {(i, d) for i, _, d in both} == decoded
    assert bpe.round_trip(nothing(spark), path).count() == 0


def test_memo_is_bounded():
    memo = Memo(str.upper, 10)
    for i in range(1000):
        assert memo[f"k{i % 37}"] == f"K{i % 37}"
    assert len(memo) + len(memo.old) <= 20
    assert memo["x" * 100] == "X" * 100 and "x" * 100 not in memo


@pytest.mark.parametrize("n", [1, 7, 64, 65, 5000])
def test_rans_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.05, n), 499).astype(np.uint32)
    coder = rans.Coder(rans.quantize(np.bincount(ids, minlength=500)))
    payload, marks = coder.encode(ids, lanes=16, every=256)
    assert (coder.decode(payload, marks, n, 16, 256) == ids).all()
    points = len(marks) // (8 * 17)
    for i in range(points):
        part = coder.decode(payload, marks, n, 16, 256, i, i + 1)
        assert (part == ids[i * 256:(i + 1) * 256]).all()


def test_quantize():
    freq = rans.quantize(np.array([0, 1, 10 ** 9, 3]), 10)
    assert freq.sum() == 1024 and freq[0] == 0 and (freq[[1, 3]] >= 1).all()
    assert rans.quantize(np.zeros(3, int)).sum() == 0
    with pytest.raises(ValueError):
        rans.quantize(np.ones(9, int), 3)


def test_token_files(spark, texts):
    path = vocabulary("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    docs = documents(spark, [(i * 3, t) for i, t in enumerate(texts)] + [(7, None)])
    target = f"{Staging(spark).path}/tokens"
    rans.write_tokens(docs, target, path, end_id=0, lanes=32, block_tokens=500, every=128)
    found = {r.doc_id: r for r in rans.read_tokens(spark, target).collect()}
    start = 0
    for doc_id, text in sorted([(i * 3, t) for i, t in enumerate(texts)] + [(7, "")]):
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [0], "<u4")
        row = found.pop(doc_id)
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    assert not found
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in rans.read_ids(spark, target).collect()}
    assert ids[0].tolist() == [0]


def test_token_files_odd(spark):
    path = vocabulary("byte_bpe_50k.json")
    for docs in (odd_documents(spark), nothing(spark)):
        target = f"{Staging(spark).path}/tokens"
        rans.write_tokens(docs, target, path)
        rows = rans.read_tokens(spark, target).orderBy("start").collect()
        assert len(rows) == docs.count()
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
        assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))


def test_damaged_block_is_refused(spark):
    target = f"{Staging(spark).path}/tokens"
    rans.write_tokens(documents(spark, ["some words here"]), target, vocabulary("byte_bpe_50k.json"))
    blocks = spark.read.parquet(f"{target}/blocks").withColumn("crc32", F.col("crc32") + 1)
    blocks.write.parquet(f"{target}-damaged/blocks")
    spark.read.parquet(f"{target}/table").write.parquet(f"{target}-damaged/table")
    with pytest.raises(Exception, match="damaged"):
        rans.read_tokens(spark, f"{target}-damaged").collect()


def brute_lines(rows, min_chars=20, min_docs=3):
    space = " \t\n\x0b\x0c\r"
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    holders = collections.defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(space).translate(fold)
            if len(key) >= min_chars and doc_id is not None:
                holders[key].add(doc_id)
    out = []
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = []
        for line in split:
            who = holders.get(line.strip(space).translate(fold), ())
            if doc_id is None or len(who) < min_docs or doc_id == max(who):
                kept.append(line)
        out.append((doc_id, "\n".join(kept), len(split), len(split) - len(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rng = random.Random(1)
    pool = [prose(rng, 6) for _ in range(30)] + ["short line", "É" * 20, "é" * 19, "  Padded line of some length\t", "padded LINE of some length"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    rows += [(i, "a line that a third of all rows share\n" + prose(rng, 9)) for i in range(200, 260)]
    rows += [(5, rows[5][1]), (6, "another text with the id 6\n" + rows[6][1]), (None, pool[0]), (300, None), (301, ""), (-4, pool[1] + "\n" + pool[1])]
    docs = documents(spark, rows)
    got = lines.apply_bitmaps(docs.select("doc_id", "text"), lines.keep_bitmaps(docs, Staging(spark)))
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute_lines(rows)


def test_line_dedup_odd(spark):
    docs = odd_documents(spark)
    got = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs, Staging(spark)))
    assert got.count() == docs.count() and set(docs.columns) <= set(got.columns)
    assert [r.n_dropped for r in got.collect()] == [0] * docs.count()
    empty = nothing(spark)
    assert lines.apply_bitmaps(empty, lines.keep_bitmaps(empty, Staging(spark))).count() == 0
