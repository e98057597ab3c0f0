"""Spelling variants against plain comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from neartag.llm import spelling
from neartag.plans.staging import Staging

from .helpers import documents, nothing, odd_documents

LATIN = "abcdefghijklmnopqrstuvwxyzàéüßÿ"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(counts):
    out = {}
    for w, n in counts.items():
        near = [v for v in counts if one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= 10 * n else None
        out[w] = [form, n, len(near), None if form is None else counts[form]]
    for w in out:
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w].append(root)
    return out


def brute_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            total[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def misspelt(rng, word):
    at, char = rng.randrange(len(word)), rng.choice(LATIN)
    return rng.choice([word[:at] + word[at + 1:], word[:at] + char + word[at:], word[:at] + char + word[at + 1:], word])


def vocabulary(rng):
    words = {}
    for _ in range(120):
        word = "".join(rng.choice(LATIN) for _ in range(rng.choice([7, 8, 9, 10, 15, 48, 60])))
        n = rng.choice([2, 5, 30, 400, 5000])
        for _ in range(rng.randrange(12)):  # chains of misspellings
            words[word] = max(n, 1)
            word, n = misspelt(rng, word), n // rng.choice([1, 9, 10, 11])
    words |= {"aaaaaaa" + "a" * i: 10 ** i for i in range(6)}  # a chain, each word near two others
    words |= {"x" * 300: 3, "x" * 301: 40, "x" * 299 + "y": 2}
    return {w: n for w, n in words.items() if w}


def as_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def by_word(frame):
    return {r.word: [r.form, r.n, r.n_near, r.form_n, r.root] for r in frame.collect()}


def test_variants_equal_all_pairs(spark):
    counts = vocabulary(random.Random(8))
    expected = brute_variants(counts)
    assert sum(v[0] is not None for v in expected.values()) > 30
    assert any(expected[v[0]][0] is not None for v in expected.values() if v[0] is not None)
    words = as_table(spark, counts)
    assert by_word(spelling.variants(words, Staging(spark))) == expected
    # Keys cut into blocks give the same.
    assert by_word(spelling.variants(words, Staging(spark), block=2)) == expected


def test_one_hot_key(spark):
    rng = random.Random(9)
    counts = {f"prefix{a}{b}{c}suffix": rng.randrange(1, 2000) for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"}
    assert by_word(spelling.variants(as_table(spark, counts), Staging(spark), block=64)) == brute_variants(counts)


def test_pairs_by_prefix_and_suffix():
    rng = random.Random(10)
    words = ["".join(rng.choice("ab") for _ in range(rng.choice([7, 8]))) for _ in range(60)]
    words = sorted(set(words), key=lambda w: (len(w), w))
    found = set()
    for length in (7, 8, 9):
        own = [w for w in words if len(w) in (length - 1, length)]
        for segment in range(int(spelling.segments_of(length))):
            n = len(own)
            a, b = spelling.near_pairs(own, np.full(n, length), np.full(n, segment), np.zeros(n, int), np.zeros(n, int), np.zeros(n, bool))
            pairs = {frozenset((own[x], own[y])) for x, y in zip(a.tolist(), b.tolist())}
            assert not pairs & found  # each pair at one segment of one length
            found |= pairs
    assert found == {frozenset((v, w)) for v in words for w in words if one_edit(v, w)}


def test_words_of_documents(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice(LATIN + "ABC") for _ in range(rng.randrange(5, 11))) for _ in range(60)]
    rows = [(i, " ".join(misspelt(rng, rng.choice(base)) if rng.random() < 0.05 else rng.choice(base) for _ in range(200))) for i in range(60)]
    rows += [(None, rows[0][1]), (3, rows[3][1]), (7, None), (8, "")]
    counts = brute_counts(rows)
    assert len(counts) > 40
    got = spelling.spelling_variants(documents(spark, rows), Staging(spark))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert by_word(got) == brute_variants(counts)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert by_word(spelling.spelling_variants(docs, Staging(spark))) == brute_variants(brute_counts(rows))
    assert spelling.spelling_variants(nothing(spark), Staging(spark)).count() == 0
