"""Decision trees over binary features, many at once and level by level.

Every tree tells the patterns of one set of labels apart: bit i of a pattern says whether a row
has label i of the set.  All trees see the same rows.  A level is one job: each task counts, for
the rows it reads, the patterns of every (tree, node, feature), the counts of a node are added up
by tree and node, and its best feature is chosen by the Gini index.

Rules are fixed, so that a tree does not depend on partitions: scores are compared in millionths,
ties go to the smaller feature, a node is split only if its score rises, and a leaf predicts its
most frequent pattern, the smaller of equals.  Node 1 is the root; rows with the feature go from
node i to 2 i + 1, the others to 2 i.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neartag.operators.blocks import long, short, squeeze, unsqueeze
from neartag.plans.staging import small_batches

LEAF = -1
TEXTS = 256  # texts a task takes apart at once
ROWS = 2048  # rows a task takes at once
HELD = 1 << 24  # counts that a task holds
PARTS = 64  # sums of counts that one task adds up at most, per tree and node


@dataclass
class Forest:
    """Trees as arrays: per tree and node the feature it asks for (or LEAF) and the pattern it predicts."""

    labelsets: list[tuple[str, ...]]
    words: list[str]
    depth: int
    features: np.ndarray = field(default=None)
    patterns: np.ndarray = field(default=None)

    def __post_init__(self) -> None:
        shape = (len(self.labelsets), 2 << self.depth)
        if self.features is None:
            self.features, self.patterns = np.full(shape, LEAF, np.int64), np.zeros(shape, np.int64)


def encode_rows(df: DataFrame, words: Sequence[str], labels: Column, tokens: Column) -> DataFrame:
    """id, labels (array), features (ascending numbers of the words a row has); a narrow job."""
    small_batches(df.sparkSession)
    number = {word: i for i, word in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from encode_batch(batch, number)

    rows = df.select(F.col("id").cast("bigint").alias("id"), labels.alias("labels"), tokens.alias("words"))
    return rows.mapInArrow(run, "id long, labels array<string>, features array<int>")


def encode_batch(batch: pa.RecordBatch, number: dict[str, int], size: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with the numbers of their words, few texts at a time."""
    for start in range(0, batch.num_rows, size):
        piece = batch.slice(start, size)
        found = [sorted({number[w] for w in own or () if w in number}) for own in piece["words"].to_pylist()]
        yield pa.RecordBatch.from_arrays([piece["id"], piece["labels"], pa.array(found, pa.list_(pa.int32()))], ["id", "labels", "features"])


class Rows:
    """A batch of encoded rows."""

    def __init__(self, features: pa.ListArray, n_words: int) -> None:
        self.counts = np.diff(features.offsets.to_numpy())
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.feature = features.flatten().to_numpy().astype(np.int64)
        self.places = self.row * n_words + self.feature  # ascending
        self.n_words = n_words

    def has(self, feature: np.ndarray) -> np.ndarray:
        """Whether each row has the feature asked of it."""
        wanted = np.arange(len(self.counts)) * self.n_words + feature
        at = np.searchsorted(self.places, wanted)
        return (at < len(self.places)) & (self.places[np.minimum(at, len(self.places) - 1)] == wanted) if len(self.places) else np.zeros(len(wanted), bool)

    def nodes(self, forest: Forest, tree: int) -> np.ndarray:
        """The node each row reaches: the deepest one made so far."""
        node = np.ones(len(self.counts), np.int64)
        for _ in range(forest.depth):
            asked = forest.features[tree][node]
            node = np.where(asked == LEAF, node, 2 * node + self.has(np.maximum(asked, 0)))
        return node


def row_patterns(labels: list[list[str] | None], labelsets: list[tuple[str, ...]]) -> np.ndarray:
    """Pattern of each row for each set of labels."""
    names = sorted({label for own in labelsets for label in own})
    number = {label: i for i, label in enumerate(names)}
    has = np.zeros((len(labels), len(names)), np.int64)
    for row, own in enumerate(labels):
        for label in own or ():
            if label in number:
                has[row, number[label]] = 1
    return np.stack([sum(has[:, number[label]] << bit for bit, label in enumerate(own)) for own in labelsets], axis=1)


def count_level(rows: DataFrame, forest: Forest, level: int) -> DataFrame:
    """tree, node, part, keys, counts: how often each key occurs among the rows at nodes of a level.

    A key is (feature + 1) * patterns + pattern, and feature -1 stands for all rows of a node; the
    last level needs nothing else.  A task adds its counts up in arrays, one per tree and node, and
    hands them on when they take ``HELD`` numbers.
    """
    n_words, size = len(forest.words), patterns_of(forest)
    low, high = 1 << level, 2 << level
    width = (n_words + 1) * size if level < forest.depth else size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId() % PARTS, {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (tree, node), counts in held.items():
                yield packed(tree, node, part, counts)
            held.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                piece = batch.slice(start, ROWS)
                own, patterns = Rows(piece["features"], n_words), row_patterns(piece["labels"].to_pylist(), forest.labelsets)
                for tree in range(len(forest.labelsets)):
                    node, pattern = own.nodes(forest, tree), patterns[:, tree]
                    for at in np.unique(node[(node >= low) & (node < high)]).tolist():
                        here = node == at
                        keys = pattern[here]
                        if level < forest.depth:
                            inside = here[own.row]
                            keys = np.concatenate((keys, (own.feature[inside] + 1) * size + pattern[own.row[inside]]))
                        counts = np.bincount(keys, minlength=width)
                        held[tree, at] = held[tree, at] + counts if (tree, at) in held else counts
                    if len(held) * width > HELD:
                        yield from flush()
        yield from flush()

    return rows.select("labels", "features").mapInArrow(run, COUNTED)


COUNTED = "tree int, node int, part int, keys binary, counts binary"


def packed(tree: int, node: int, part: int, counts: np.ndarray) -> pa.RecordBatch:
    """Keys as differences; numbers as narrow as they can be, compressed."""
    keys = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array([tree], pa.int32()), pa.array([node], pa.int32()), pa.array([part], pa.int32()),
         pa.array([squeeze(shortest(np.diff(keys, prepend=0)), len(keys))], pa.binary()),
         pa.array([squeeze(shortest(counts[keys]), len(keys))], pa.binary())],
        ["tree", "node", "part", "keys", "counts"])


def shortest(values: np.ndarray) -> bytes:
    """As ``short``, also for numbers of more than four bytes."""
    return short(values) if not len(values) or values.max() < 1 << 32 else values.astype("<u8").tobytes()


def unpacked(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a row that ``packed`` made."""
    keys, counts = (long(*unsqueeze(batch[c][i].as_py())) for c in ("keys", "counts"))
    return np.cumsum(keys), counts


def added_up(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """tree, node, part and the sum of the counts of consecutive rows of one tree and node."""
    current, total = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            tree, node, part = (batch[c][i].as_py() for c in ("tree", "node", "part"))
            if (tree, node) != current:
                if current is not None:
                    yield *current, last, total
                current, total = (tree, node), np.zeros(width, np.int64)
            last = part
            keys, counts = unpacked(batch, i)
            total[keys] += counts
    if current is not None:
        yield *current, last, total


def purity(counts: np.ndarray) -> np.ndarray:
    """Sum of squared counts over their sum, row by row: the larger, the purer; 0 for none."""
    total = counts.sum(axis=-1)
    return np.divide((counts * counts).sum(axis=-1), total, out=np.zeros(total.shape), where=total > 0)


def best_split(counts: np.ndarray) -> tuple[int, int]:
    """Pattern and feature (or LEAF) of a node from its counts: rows are all rows, then those with each feature."""
    all_rows, present = counts[0], counts[1:]
    absent = all_rows - present
    score = np.floor((purity(present) + purity(absent)) * 1e6 + 0.5)
    useful = (present.sum(axis=1) > 0) & (absent.sum(axis=1) > 0) & (score > np.floor(purity(all_rows) * 1e6 + 0.5))
    feature = int(np.argmax(np.where(useful, score, -1.0))) if useful.any() else LEAF
    return int(np.argmax(all_rows)), feature


def choose_splits(counted: DataFrame, size: int, width: int) -> DataFrame:
    """tree, node, pattern (most frequent), feature (or LEAF): a row per node.

    Counts are added up in two steps, so that no task gets those of all tasks.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, node, part, total in added_up(batches, width):
            yield packed(tree, node, part, total)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, node, _, total in added_up(batches, width):
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int32()) for x in (tree, node, *best_split(total.reshape(-1, size)))], ["tree", "node", "pattern", "feature"])

    some = counted.repartition("tree", "node", "part").sortWithinPartitions("tree", "node", "part").mapInArrow(add, COUNTED)
    return some.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(choose, "tree int, node int, pattern int, feature int")


def patterns_of(forest: Forest) -> int:
    return 1 << max(map(len, forest.labelsets), default=0)


def grow(rows: DataFrame, forest: Forest) -> Forest:
    """Grow all trees; one job per level.

    The driver gets a row per node: at most 2 ** level of each tree.  The rows are read by as many tasks as there
    are cores: each hands on counts of its own, so their number tells what is shuffled, not the number of rows.
    """
    small_batches(rows.sparkSession)  # rows of counts are wide
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    size = patterns_of(forest)
    for level in range(forest.depth + 1):
        width = (len(forest.words) + 1) * size if level < forest.depth else size
        for r in choose_splits(count_level(rows, forest, level), size, width).collect():
            forest.patterns[r.tree, r.node], forest.features[r.tree, r.node] = r.pattern, r.feature
    return forest


def vote(rows: DataFrame, forest: Forest) -> DataFrame:
    """id, tag, yes, n: how many of a label's trees predict it; labels without a vote are left out."""
    names = sorted({label for own in forest.labelsets for label in own})
    number = {label: i for i, label in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                own = Rows(part["features"], len(forest.words))
                yes, n = np.zeros((part.num_rows, len(names)), np.int64), np.zeros(len(names), np.int64)
                for tree, labelset in enumerate(forest.labelsets):
                    pattern = forest.patterns[tree][own.nodes(forest, tree)]
                    for bit, label in enumerate(labelset):
                        yes[:, number[label]] += pattern >> bit & 1
                        n[number[label]] += 1
                row, label = np.nonzero(yes)
                yield pa.RecordBatch.from_arrays(
                    [part["id"].take(pa.array(row)), pa.array(names, pa.string()).take(pa.array(label)), pa.array(yes[row, label]), pa.array(n[label])],
                    ["id", "tag", "yes", "n"])

    return rows.select("id", "features").mapInArrow(run, "id long, tag string, yes long, n long")
