"""Benchmark decontamination by BM25 retrieval with block-max bounds (operator 6).

The question and the answer of each test item are parts, and go into an inverted index with
BM25 impacts.  Every training document is a query of all its distinct words.  Impacts are
divided by the score a part gets from its own text.  Parts lie in blocks; the largest impact of
each term in each block bounds what a document can score there.  Blocks whose bound stays below
the thresholds of their parts are skipped; the others are searched by WAND: a pivot is the first
part that the summed bounds allow, and cursors skip to it.  All items above the threshold are
retrieved, none is ranked away.  An item counts as leaked if enough of the five-word shingles of
its question, and of its answer if it has one, occur in the document, wherever they stand.

The threshold of a part is proven.  If at most k of its shingles may be missing, a missing word
takes all shingles that hold it along, and a shingle holds at most five words, so the counts of
shingles of the missing words sum to at most 5 k.  The threshold is one less the largest weight
of words within that sum, so no part that the overlap check accepts is lost.

Words are runs of characters other than ASCII punctuation and white space, in lower case.
Null or empty texts and items have no words and match nothing; items of fewer than five
words match by all their words in a row.  Documents of repeated ids are judged row by row, told
apart by ``version`` (a hash of the text), and may give equal rows; rows with a null doc_id are
judged too.  Repeated items each give
rows.  Either table may be empty.  Other columns are left alone.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartag.llm.common import chosen, slices, with_version

SHINGLE = 5
SIMILARITY = 0.8
ITEMS_PER_BLOCK = 4
SHARD_BYTES = 4 << 20  # text of items per index; more items are searched in more passes
K1, B = 1.2, 0.75
PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN).split()


def shingles(words: list[bytes], size: int = SHINGLE) -> set[bytes]:
    """Runs of ``size`` words; of all words if there are fewer."""
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*[words[i:] for i in range(size)])))


def least_weight(words: list[bytes], weights: dict[bytes, float], similarity: float) -> float:
    """A bound from below of the weight of a part's words in a text that holds ``similarity`` of its shingles."""
    runs = shingles(words)
    missing = len(runs) - math.ceil(similarity * len(runs) - 1e-9)
    holding = Counter(word for run in runs for word in set(run.split()))
    room, lost = SHINGLE * missing, 0.0
    # Words by weight for each shingle they take along; the last one counts in part.
    for word in sorted(holding, key=lambda w: -weights[w] / holding[w]):
        if holding[word] <= missing:
            taken = min(1.0, room / holding[word])
            room -= taken * holding[word]
            lost += taken * weights[word]
            if room <= 0:
                break
    return max(1.0 - lost - 1e-6, 1e-9)  # one shingle at least is there, so some weight is


@dataclass(frozen=True)
class Item:
    item_id: int
    question: str | None
    answer: str | None


class ItemIndex:
    """Postings of item parts in blocks, with the bounds of each term in each block that holds it."""

    def __init__(self, items: list[Item], per_block: int = ITEMS_PER_BLOCK, similarity: float = SIMILARITY) -> None:
        self.items = items
        self.similarity = similarity
        pieces = [(i, words) for i, item in enumerate(items)
                  for words in (words_of(item.question), words_of(item.answer)) if words]
        counts = [Counter(piece) for _, piece in pieces]
        lengths = [len(piece) for _, piece in pieces]
        average = sum(lengths) / len(lengths) if lengths else 1.0
        df = Counter(term for c in counts for term in c)
        self.terms = {term: t for t, term in enumerate(sorted(df))}
        self.owner = [i for i, _ in pieces]
        self.parts = Counter(self.owner)
        self.per_block = per_block
        self.n_blocks = -(-len(pieces) // per_block)
        self.postings: list[dict[int, tuple[list[int], list[float]]]] = [{} for _ in self.terms]
        self.thresholds = np.zeros(len(pieces))
        for piece, found in enumerate(counts):
            impact = {t: math.log(1 + (len(pieces) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1)
                      / (tf + K1 * (1 - B + B * lengths[piece] / average)) for t, tf in found.items()}
            own, block = sum(impact.values()), piece // per_block
            for term, value in impact.items():
                at, values = self.postings[self.terms[term]].setdefault(block, ([], []))
                at.append(piece)
                values.append(value / own)
            self.thresholds[piece] = least_weight(pieces[piece][1], {t: v / own for t, v in impact.items()}, similarity)
        # The bounds of term t are those from starts[t] to starts[t + 1].
        self.starts = np.cumsum([0, *map(len, self.postings)])
        self.blocks = np.array([b for found in self.postings for b in found], np.int64)
        self.bounds = np.array([max(values) for found in self.postings for _, values in found.values()], np.float64)
        self.questions = [shingles(words_of(item.question)) for item in items]
        self.answers = [shingles(words_of(item.answer)) for item in items]

    def retrieve(self, words: list[bytes], threshold: float | None = None) -> set[int]:
        """Positions of the items of which the document gives every part its threshold, or the one given."""
        if not self.n_blocks:
            return set()
        least = self.thresholds if threshold is None else np.full(len(self.owner), threshold)
        numbers = np.array(sorted(self.terms[w] for w in set(words) if w in self.terms), np.int64)
        sizes = self.starts[numbers + 1] - self.starts[numbers]
        at = np.repeat(self.starts[numbers] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        terms, blocks = np.repeat(numbers, sizes), self.blocks[at]
        reach = np.bincount(blocks, self.bounds[at], self.n_blocks)
        lowest = np.minimum.reduceat(least, np.arange(0, len(least), self.per_block))
        wanted = (reach >= lowest * 0.999)[blocks]
        terms, blocks = terms[wanted], blocks[wanted]
        order = np.argsort(blocks, kind="stable")
        terms, blocks = terms[order], blocks[order]
        edges = np.flatnonzero(np.diff(blocks, prepend=-1, append=-1))
        found: Counter[int] = Counter()
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            block = int(blocks[low])
            found.update(self.owner[p] for p, score in self.wand(terms[low:high].tolist(), block, float(lowest[block])) if score >= least[p])
        return {i for i, n in found.items() if n == self.parts[i]}

    def wand(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """Parts of a block that the terms give the threshold or more, and their scores."""
        bounds = {term: max(self.postings[term][block][1]) for term in terms}
        # Piece under the cursor, term number, position in its list.
        cursors = [(self.postings[term][block][0][0], term, 0) for term in terms]
        heapq.heapify(cursors)
        found = []
        while cursors:
            # The pivot is the first piece at which the bounds of the cursors up to it suffice.
            passed, reach = [], 0.0
            while cursors and reach < threshold * 0.999:
                passed.append(heapq.heappop(cursors))
                reach += bounds[passed[-1][1]]
            if reach < threshold * 0.999:
                return found
            pivot = passed[-1][0]
            while cursors and cursors[0][0] == pivot:
                passed.append(heapq.heappop(cursors))
            score = 0.0
            for _, term, at in passed:
                pieces, values = self.postings[term][block]
                while at < len(pieces) and pieces[at] < pivot:
                    at += 1
                if at < len(pieces) and pieces[at] == pivot:
                    score += values[at]
                    at += 1
                if at < len(pieces):
                    heapq.heappush(cursors, (pieces[at], term, at))
            if score >= threshold:
                found.append((pivot, score))
        return found

    def leaks(self, words: list[bytes], threshold: float | None = None) -> list[tuple[int, float]]:
        """(item_id, overlap) of the items the document holds."""
        candidates = self.retrieve(words, threshold)
        if not candidates:
            return []
        own: dict[int, set[bytes]] = {}

        def share(wanted: set[bytes]) -> float:
            size = min(SHINGLE, len(next(iter(wanted)).split()))
            if size not in own:
                own[size] = {b" ".join(words[i:i + size]) for i in range(len(words) - size + 1)}
            return len(wanted & own[size]) / len(wanted)

        out = []
        for i in sorted(candidates):
            shares = [share(part) for part in (self.questions[i], self.answers[i]) if part]
            if shares and min(shares) >= self.similarity:
                out.append((self.items[i].item_id, min(shares)))
        return out


def indexes(items: DataFrame, shard_bytes: int = SHARD_BYTES, similarity: float = SIMILARITY) -> Iterator[ItemIndex]:
    """Indexes of all items (item_id, question, answer), each over a bounded amount of text.

    The driver holds one shard at a time.  One item may be larger than a shard.
    """
    sized = items.select("item_id", "question", "answer", (F.octet_length(F.coalesce("question", F.lit("")))
                         + F.octet_length(F.coalesce("answer", F.lit("")))).alias("bytes"))
    total = sized.agg(F.sum("bytes")).first()[0] or 0
    shards = 1 + total // shard_bytes
    shard = F.pmod(F.xxhash64("item_id", "question"), F.lit(shards))
    for number in range(shards):
        rows = sized.filter(shard == number).select("item_id", "question", "answer").collect()
        yield ItemIndex([Item(*r) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.question or ""))], similarity=similarity)


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, threshold: float | None = None,
               shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, version, item_id, overlap for every document (doc_id, text) that holds an item."""
    spark = docs.sparkSession

    def pass_over(index: ItemIndex) -> DataFrame:
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in slices(batches):
                found = [(doc_id, version, item_id, overlap)
                         for doc_id, version, text in zip(batch["doc_id"].to_pylist(), batch["version"].to_pylist(), batch["text"])
                         for item_id, overlap in own.leaks(words_of(text.as_py()), threshold)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                    ["doc_id", "version", "item_id", "overlap"])

        return with_version(docs).mapInArrow(run, "doc_id long, version long, item_id long, overlap double")

    out = None
    for index in indexes(items, shard_bytes, similarity):
        part = pass_over(index)
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The rows of documents without a leak, with all columns; each row is judged by its own text."""
    return chosen(docs, leaks, "left_anti")
