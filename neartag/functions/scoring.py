"""Term weights and document scores as Column expressions.

Sums of doubles depend on their order, and a last-bit change swaps tied neighbours.
Scores are therefore summed as whole millionths (``to_micro``), which makes every
ranking reproducible whatever the partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MICRO = 1_000_000


@dataclass(frozen=True)
class ScoreParams:
    """Scoring settings; ``norms=False`` leaves document lengths out."""

    k1: float = 1.2
    b: float = 0.75
    norms: bool = True
    scorer: str = "bm25"


def to_micro(value: Column) -> Column:
    return F.round(value * float(MICRO)).cast("bigint")


def from_micro(value: Column) -> Column:
    return value.cast("double") / float(MICRO)


def bm25_idf(df: Column, n_docs: Column) -> Column:
    """ln(1 + (n - df + 0.5) / (df + 0.5))."""
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def bm25_length_norm(doc_len: Column, avgdl: Column, params: ScoreParams = ScoreParams()) -> Column:
    """k1 * ((1 - b) + b * len / avgdl), or k1 without norms."""
    if not params.norms:
        return F.lit(params.k1)
    return params.k1 * ((1.0 - params.b) + params.b * doc_len / avgdl)


def term_weight(boost: Column, df: Column, n_docs: Column,
                params: ScoreParams = ScoreParams()) -> Column:
    """The part of a term's score that is the same for every document."""
    if params.scorer == "bm25":
        return boost * bm25_idf(df, n_docs) * (params.k1 + 1.0)
    if params.scorer == "tfidf":
        return boost * F.log(1.0 + n_docs / df)
    raise ValueError(f"unknown scorer {params.scorer!r}")


def length_part(doc_len: Column, avgdl: Column, params: ScoreParams = ScoreParams()) -> Column:
    """What of a term's impact (``impact_of``) depends on the length of the document alone."""
    if params.scorer == "bm25":
        return bm25_length_norm(doc_len, avgdl, params).cast("double")
    if params.scorer == "tfidf":
        return doc_len.cast("double") if params.norms else F.lit(1.0)
    raise ValueError(f"unknown scorer {params.scorer!r}")


def impact_of(tf: Column | np.ndarray, part: Column | np.ndarray, params: ScoreParams = ScoreParams()) -> Column | np.ndarray:
    """The impact of a frequency, given the ``length_part``; arrays give the same doubles as columns."""
    return tf / (tf + part) if params.scorer == "bm25" else tf / part


def term_impact(tf: Column, doc_len: Column, avgdl: Column,
                params: ScoreParams = ScoreParams()) -> Column:
    """The part of a term's score that depends on the document.

    It grows with ``tf`` and shrinks with ``doc_len``, so the largest frequency and the
    shortest document of a term bound it from above.
    """
    return impact_of(tf, length_part(doc_len, avgdl, params), params)
