"""Spelling variants by dense prefix-suffix tiling (operator 13).

Two words are near if one inserted, deleted or replaced code point turns one into the other.
With the longer one of length L, that holds exactly if they differ, their lengths differ by at
most one, and common prefix plus common suffix reach L - 1.

Words meet at keys.  For each length L the positions 0 to L - 1 are cut into segments of at
most ``SEGMENT`` code points.  A word of length L leaves out one segment at a time; a word of
length L - 1 leaves out the same segment less one code point.  The rest, with L and the number
of the segment, is the key.  A near pair agrees outside the segment that holds the end of its
common prefix, so it meets there; only there is it counted, hence once.

The words of a key differ in a few adjacent code points only, so a key's words are bounded by
the alphabet and not by the table.  Keys with many words are still cut into blocks, which are
compared pairwise in separate tasks.  In a task, words lie in padded code-point matrices, one
from the front and one from the back; rows are compared offset by offset, a tile at a time.

A task returns per word the number of near words and the best of them, never the pairs.  The
form of a word is its most frequent near word if that is at least ``FACTOR`` times as frequent;
a chain of forms therefore grows tenfold at each step and is followed by doubling.

Null and empty texts have no words.  Rows that repeat count each time.  Empty tables give an
empty result, ties go to the word that is smaller in code-point order, and words of any length
are compared whole.  Only the named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartag.llm.common import batches_by_group, id_and_text, slices
from neartag.plans.staging import Staging

MIN_LENGTH = 7
MIN_COUNT = 2
FACTOR = 10
SEGMENT = 3  # code points left out of a key
SEGMENTS = 16  # at most; longer words get longer segments
BLOCK = 2048  # words of a key that one task compares with as many others
TILE = 1 << 22  # code points of a matrix


# --- words -------------------------------------------------------------------------------

@lru_cache(maxsize=4)
def run_pattern(min_length: int) -> re.Pattern:
    """Maximal runs of letters, without those that are too short."""
    return re.compile(f"[A-Za-z\\u00C0-\\u00FF]{{{min_length},}}")


def damaged_runs(doc_id: int | None, text: str | None, min_length: int = MIN_LENGTH) -> Counter:
    """The runs of a text with A-Z in lower case, some of them damaged, and how often each occurs.

    If 31 divides the crc32 of ``<doc_id>:<run>``, the run loses one code point.  A null id is
    written as nothing.
    """
    lower = (text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    prefix, out = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in Counter(run_pattern(min_length).findall(lower)).items():
        h = zlib.crc32(run.encode(), prefix)
        if h % 31 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= min_length:
            out[run] += n
    return out


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the damaged runs of all documents that are long and frequent enough.

    Counts are added up in each task before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                total.update(damaged_runs(doc_id, text.as_py(), min_length))
            if len(total) > 100_000:
                yield flush()
                total = Counter()
        yield flush()

    counted = id_and_text(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= min_count)


# --- keys --------------------------------------------------------------------------------

def segments_of(length):
    """How many segments words of this length have; a number or an array."""
    return np.clip(-(-length // SEGMENT), 1, SEGMENTS)


@lru_cache(maxsize=1024)
def segment_bounds(length: int) -> list[int]:
    """Where the segments of words of this length begin, and the length."""
    n = int(segments_of(length))
    return [length * i // n for i in range(n + 1)]


def at_keys(words: DataFrame) -> DataFrame:
    """key, length, segment, word, n: a row per word, length class (its own and one more) and segment.

    The key is a hash; words of other keys that fall on it are told apart by the comparison.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                rest, lengths, segments, rows = [], [], [], []
                for row, word in enumerate(part["word"].to_pylist()):
                    for length in (len(word), len(word) + 1):
                        bounds = segment_bounds(length)
                        less = length - len(word)
                        for j in range(len(bounds) - 1):
                            rest.append(f"{word[:bounds[j]]}\0{word[bounds[j + 1] - less:]}")
                            lengths.append(length)
                            segments.append(j)
                            rows.append(row)
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rest, pa.string()), pa.array(lengths, pa.int32()), pa.array(segments, pa.int32()),
                     part["word"].take(rows), part["n"].take(rows)], ["rest", "length", "segment", "word", "n"])

    rows = words.select("word", "n").mapInArrow(run, "rest string, length int, segment int, word string, n long")
    return rows.select(F.xxhash64("rest", "length", "segment").alias("key"), "length", "segment", "word", "n")


def in_blocks(rows: DataFrame, staging: Staging, block: int) -> DataFrame:
    """Only keys of several words, with the pair of blocks (low, high) to compare.

    Most keys have one block; then low and high are 0.
    """
    sizes = staging.write(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "key_sizes")
    blocks = F.ceil(F.col("size") / block).cast("int")
    spread = rows.join(sizes, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("size", "blocks", "other")


# --- comparison --------------------------------------------------------------------------

def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and code points padded with 0 behind (from the front) and before (from the back)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    codes = codes.astype(np.uint8 if not len(codes) or codes.max() < 256 else np.uint32)
    width = int(lengths.max(initial=0))
    column = np.arange(width)
    front, back = np.zeros((len(words), width), codes.dtype), np.zeros((len(words), width), codes.dtype)
    front[column < lengths[:, None]] = codes
    back[column >= width - lengths[:, None]] = codes
    return lengths, front, back


def agreeing(a: np.ndarray, b: np.ndarray, backwards: bool) -> np.ndarray:
    """How many leading (or trailing) columns of two matrices agree, row by row."""
    apart = a != b
    if backwards:
        apart = apart[:, ::-1]
    return np.where(apart.any(axis=1), apart.argmax(axis=1), a.shape[1])


def near_pairs(words: list[str], length: np.ndarray, segment: np.ndarray, group: np.ndarray, own: np.ndarray, cross: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the near pairs inside groups; rows of a group are adjacent.

    A pair counts where the longer word has the group's length class and the common prefix
    ends in the group's segment.  In a ``cross`` group only rows of different blocks compare.
    """
    lengths, front, back = matrices(words)
    ends = np.searchsorted(group, group, side="right")
    rows = np.arange(len(words))
    first, second = [], []
    offset = 0
    while True:
        offset += 1
        rows = rows[rows + offset < ends[rows]]
        if not len(rows):
            break
        a, b = rows, rows + offset
        longer = np.maximum(lengths[a], lengths[b])
        fits = (longer == length[a]) & (~cross[a] | (own[a] != own[b]))
        a, b, longer = a[fits], b[fits], longer[fits]
        if not len(a):
            continue
        prefix = np.minimum(agreeing(front[a], front[b], False), np.minimum(lengths[a], lengths[b]))
        suffix = np.minimum(agreeing(back[a], back[b], True), np.minimum(lengths[a], lengths[b]))
        # Equal words (of a table that repeats them) are not near; their prefix is too long.
        near = (prefix + suffix >= longer - 1) & (prefix < longer)
        near &= ((prefix + 1) * segments_of(longer) - 1) // longer == segment[a]
        first.append(a[near])
        second.append(b[near])
    return np.concatenate([np.zeros(0, np.int64), *first]), np.concatenate([np.zeros(0, np.int64), *second])


def near_words(words: DataFrame, staging: Staging, block: int = BLOCK) -> DataFrame:
    """word, n_near, best, best_n: per word its near words' number and the most frequent of them."""
    group = ["key", "length", "segment", "low", "high"]

    def compare(table: pa.Table, bounds: list[tuple[int, int]]) -> pa.RecordBatch:
        spans = [(a, b) for a, b in bounds if b - a > 1]
        taken = np.concatenate([np.arange(a, b) for a, b in spans]) if spans else np.zeros(0, np.int64)
        part = table.take(pa.array(taken))
        numbers = {c: part[c].to_numpy() for c in ("length", "segment", "low", "high", "own", "n")}
        groups = np.repeat(np.arange(len(spans)), [b - a for a, b in spans])
        names = part["word"].to_pylist()
        a, b = near_pairs(names, numbers["length"], numbers["segment"], groups, numbers["own"], numbers["low"] != numbers["high"])
        best: dict[str, tuple[int, int, str]] = {}
        n = numbers["n"]
        for x, y in zip(np.concatenate((a, b)).tolist(), np.concatenate((b, a)).tolist()):
            word, other, count = names[x], names[y], int(n[y])
            near, top, top_word = best.get(word, (0, -1, ""))
            if count > top or (count == top and other < top_word):
                top, top_word = count, other
            best[word] = (near + 1, top, top_word)
        values = list(best.values())
        return pa.RecordBatch.from_arrays(
            [pa.array(best.keys(), pa.string()), pa.array([v[0] for v in values], pa.int64()), pa.array([v[2] for v in values], pa.string()),
             pa.array([v[1] for v in values], pa.int64())], ["word", "near", "best", "best_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in batches_by_group(batches, group):
            # Whole groups, as many as fit in a tile.
            width, start = int(table["length"].to_numpy().max()), 0
            for i, (_, end) in enumerate(bounds):
                if i + 1 == len(bounds) or (bounds[i + 1][1] - bounds[start][0]) * width > TILE:
                    yield compare(table, bounds[start:i + 1])
                    start = i + 1

    rows = in_blocks(at_keys(words), staging, block)
    ordered = rows.repartition("key", "low", "high").sortWithinPartitions("length", *group, "word").select(*group, "own", "word", "n")
    found = ordered.mapInArrow(run, "word string, near long, best string, best_n long")
    # Most frequent first, then the smallest in code-point order: bytes of UTF-8 sort alike.
    least = F.min(F.struct((-F.col("best_n")).alias("minus"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("least")).select(
        "word", "n_near", F.col("least.best").alias("best"), (-F.col("least.minus")).alias("best_n"))


# --- forms -------------------------------------------------------------------------------

def variants(words: DataFrame, staging: Staging, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word (word, n); words are distinct and factor over 1."""
    words = staging.write(words, "words")
    near = words.join(near_words(words, staging, block), "word", "left")
    formed = F.col("best_n") >= factor * F.col("n")
    table = staging.write(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                      F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n")), "near")
    # Each step of a chain is ``factor`` times as frequent, so the longest possible chain is known.
    most = table.agg(F.max("n")).first()[0] or 1
    steps = math.floor(math.log(most, factor)) + 1
    jump = table.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for number in range(math.ceil(math.log2(steps + 1))):
        jump = staging.write(jump, f"jump-{number}")
        onward = jump.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jump = jump.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return table.join(jump, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, staging: Staging) -> DataFrame:
    """word, form, root, n, n_near, form_n over the damaged runs of all documents."""
    return variants(count_words(docs), staging).select("word", "form", "root", "n", "n_near", "form_n")
