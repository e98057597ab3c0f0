"""Quality classifier: an additive model with pairwise interactions (operator 9).

Each text becomes a row of numbers, and each number a bin.  Cyclic boosting visits one
feature after the other; a shallow tree over the bins of that feature alone is fitted to the
residuals, shrunk, and added to the feature's lookup table.  Pairs of features that explain
most of what is left get tables of their own in the same way.  A score is the logistic
function of the sum of the bins' entries: array look-ups, no trees.

The model is fitted on at most ``FIT_ROWS`` labelled documents (smallest hash of the id);
scoring reads every text whole.  Null and empty texts get the bins of zero words.  A label
counts as 1 if the mean of the labels of its doc_id is at least 0.5; null labels are left
out.  Rows that share a doc_id are scored each.  With no labelled rows every score is 0.5.
An empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neartag.llm.common import id_and_text, slices

FIT_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS = 120
PAIR_ROUNDS = 60
RATE = 0.15
LEAVES = 3  # of a shallow tree
PRIOR = 5.0  # rows of zero residual added to each leaf
FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "repeated_neighbours", "top_word", "upper", "digits", "symbols",
    "non_ascii", "end_marks", "lines_per_word", "distinct_lines", "line_length", "compressed", "pipes", "capital_words", "long_words")
MARKS = re.compile(rb"[.,;:?!]")
UPPER, DIGIT = (bytes(range(a, b)) for a, b in ((65, 91), (48, 58)))
SYMBOL = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?!'-")


def measures(text: str) -> list[float]:
    """The features of one text, all of them over the whole text."""
    data = text.encode("utf-8", "surrogatepass")
    size, words = max(1, len(data)), data.split()
    n = max(1, len(words))
    lines = data.split(b"\n")
    counts: dict[bytes, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    without = {name: size - len(data.translate(None, drop)) for name, drop in (("upper", UPPER), ("digit", DIGIT), ("symbol", SYMBOL))}
    letters = len(text)
    return [
        float(np.log1p(len(data))), float(np.log1p(len(words))), len(data) / n, len(counts) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, max(counts.values(), default=0) / n,
        (without["upper"] if data else 0) / size, (without["digit"] if data else 0) / size, (without["symbol"] if data else 0) / size,
        (len(data) - letters) / size, len(MARKS.findall(data)) / n, len(lines) / n, len(set(lines)) / len(lines), len(data) / len(lines),
        len(zlib.compress(data, 1)) / size, data.count(b"|") / n, sum(map(bytes.isupper, words)) / n, sum(len(w) > 15 for w in words) / n]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x (array of double) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [measures(t.as_py() or "") for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "x"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, x array<double>")


# --- model -------------------------------------------------------------------------------

@dataclass(frozen=True)
class Additive:
    """Bin edges per feature, a table per feature, and tables of pairs of coarser bins."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]  # coarse bin of each bin
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)], axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """One look-up per table and an addition; the scores of all rows at once."""
        at = self.bins(x)
        total = np.full(len(x), self.bias)
        for i, table in enumerate(self.tables):
            total += table[at[:, i]]
        for i, j, table in self.pairs:
            total += table[self.coarse[i][at[:, i]], self.coarse[j][at[:, j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int) -> np.ndarray:
    """The value of each bin in the best tree of so many leaves over ordered bins."""
    bounds = [(0, len(gradient))]
    while len(bounds) < leaves:
        best = None
        for k, (a, b) in enumerate(bounds):
            if b - a < 2:
                continue
            g, w = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
            right_g, right_w = g[-1] - g[:-1], w[-1] - w[:-1]
            gain = g[:-1] ** 2 / (w[:-1] + PRIOR) + right_g ** 2 / (right_w + PRIOR) - g[-1] ** 2 / (w[-1] + PRIOR)
            at = int(np.argmax(gain))
            if best is None or gain[at] > best[0]:
                best = (float(gain[at]), k, a + at + 1)
        if best is None or best[0] <= 1e-12:
            break
        _, k, at = best
        a, b = bounds[k]
        bounds[k:k + 1] = [(a, at), (at, b)]
    out = np.zeros(len(gradient))
    for a, b in bounds:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + PRIOR)
    return out


def grid_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The best tree of four leaves over a grid: one cut per side, the second in each half."""
    def summed(a: np.ndarray) -> np.ndarray:
        return np.pad(a, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)

    g, w = summed(gradient), summed(weight)

    def part(s: np.ndarray, r0, r1, c0, c1):
        return s[r1, c1] - s[r0, c1] - s[r1, c0] + s[r0, c0]

    rows, columns = gradient.shape
    best = (0.0, None)
    for r in range(1, rows):
        cells = []
        for r0, r1 in ((0, r), (r, rows)):
            options = []
            for c in range(1, columns):
                options.append((sum(part(g, r0, r1, a, b) ** 2 / (part(w, r0, r1, a, b) + PRIOR) for a, b in ((0, c), (c, columns))), c))
            cells.append((r0, r1, *max(options, key=lambda o: o[0])))
        gain = sum(c[2] for c in cells)
        if gain > best[0]:
            best = (gain, cells)
    out = np.zeros(gradient.shape)
    for r0, r1, _, c in best[1] or []:
        for a, b in ((0, c), (c, columns)):
            out[r0:r1, a:b] = part(g, r0, r1, a, b) / (part(w, r0, r1, a, b) + PRIOR)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS) -> Additive:
    """Cyclic boosting of tables of single features, then of the most telling pairs."""
    if not len(y):
        return Additive(0.0, [np.zeros(0) for _ in FEATURES], [np.zeros(1) for _ in FEATURES], [np.zeros(1, int) for _ in FEATURES], [])
    steps = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, i], steps)) for i in range(x.shape[1])]
    at = np.stack([np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    total = np.full(len(y), bias)
    tables = [np.zeros(len(e) + 1) for e in edges]

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, table in enumerate(tables):
            r, h = residual()
            step = RATE * shallow_tree(np.bincount(at[:, i], r, len(table)), np.bincount(at[:, i], h, len(table)), LEAVES)
            table += step
            total += step[at[:, i]]

    coarse = [np.arange(len(t)) * PAIR_BINS // len(t) for t in tables]
    low = np.stack([c[at[:, i]] for i, c in enumerate(coarse)], axis=1)
    r, h = residual()

    def grids(i: int, j: int, r: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell, shape = low[:, i] * PAIR_BINS + low[:, j], (PAIR_BINS, PAIR_BINS)
        return np.bincount(cell, r, PAIR_BINS ** 2).reshape(shape), np.bincount(cell, h, PAIR_BINS ** 2).reshape(shape)

    gains = []
    for i in range(len(tables)):
        for j in range(i):
            g, w = grids(i, j, r, h)
            gains.append((float((g ** 2 / (w + PRIOR)).sum()), j, i))
    chosen = [(i, j, np.zeros((PAIR_BINS, PAIR_BINS))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            r, h = residual()
            step = RATE * grid_tree(*grids(i, j, r, h))
            table += step
            total += step[low[:, i], low[:, j]]
    return Additive(bias, edges, tables, coarse, chosen)


# --- jobs --------------------------------------------------------------------------------

def fit_documents(docs: DataFrame, labels: DataFrame, learn_from: Column, fit_rows: int = FIT_ROWS) -> Additive:
    """The model from documents (doc_id, text) and labels (doc_id, quality) where ``learn_from`` holds.

    The driver gets the features of at most ``fit_rows`` documents; the sample of ids that
    is broadcast has the same bound.
    """
    marked = (labels.filter(learn_from & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = id_and_text(docs).join(F.broadcast(sample), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    found = features(rows).join(F.broadcast(sample), "doc_id").orderBy("doc_id").select("x", "label").collect()
    return fit(np.array([r.x for r in found], float).reshape(-1, len(FEATURES)), np.array([r.label for r in found], float))


def score(docs: DataFrame, model: Additive) -> DataFrame:
    """doc_id, score (0 to 1), predicted of every row; only the text is judged."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([measures(t.as_py() or "") for t in batch["text"]], float).reshape(-1, len(FEATURES))
            scores = model.scores(x)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
