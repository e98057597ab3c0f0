"""Token tables: one row per token, in text order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neartag.functions.stem import stem_array
from neartag.functions.text import Analyzer, get_analyzer
from neartag.plans.staging import small_batches


def tokenize(df: DataFrame, analyzer: str | Analyzer = "standard", text_col: str = "text",
             keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """keys, pos, term: the analysed tokens of every text; pos counts from 0."""
    tokens = get_analyzer(analyzer)(F.col(text_col))
    return (df.select(*keys, F.posexplode_outer(tokens).alias("pos", "term"))
            .filter(F.col("term").isNotNull()))


def pack_terms(df: DataFrame, tokens: Column, keep: tuple[str | Column, ...]) -> DataFrame:
    """keep, n_tokens, terms: each row's terms with their counts in order of term, as an array of structs.

    A row is a whole text, so counting needs no shuffle.  Texts are counted in Arrow batches of
    bounded size: a batch numbers its different words once, and only numbers are sorted.
    """
    small_batches(df.sparkSession)
    rows = df.select(*keep, tokens.alias("_t"))
    *kept, held = rows.schema.fields
    term = T.StructType([T.StructField("term", held.dataType.elementType), T.StructField("tf", T.LongType())])
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("terms", T.ArrayType(term))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, lists = batch.columns
            yield pa.RecordBatch.from_arrays([*own, pc.list_value_length(lists).cast(pa.int64()), count_lists(lists)], schema.names)

    return rows.mapInArrow(run, schema)


def count_lists(lists: pa.ListArray) -> pa.ListArray:
    """The different values of each list in ascending order, with their counts; null stays null."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    coded = lists.flatten().dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    # One number per token: its row, then the place of its word among the words of the batch.
    place = np.repeat(np.arange(len(lists)) * len(order), sizes) + rank[coded.indices.to_numpy()]
    place.sort()
    first = np.flatnonzero(np.diff(place, prepend=-1))
    counts = np.diff(first, append=len(place))
    row, word = np.divmod(place[first], max(1, len(order)))
    ends = np.cumsum(np.bincount(row, minlength=len(lists)))
    terms = coded.dictionary.take(pa.array(order[word]))
    entries = pa.StructArray.from_arrays([terms, pa.array(counts, pa.int64())], ["term", "tf"])
    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
    return pa.ListArray.from_arrays(offsets, entries, mask=lists.is_null() if lists.null_count else None)


def unpack_terms(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """keep, term, tf: one row per entry of the terms array."""
    # Outer, because a plain explode would add a filter that evaluates the array again.
    return df.select(*keep, F.inline_outer("terms")).filter(F.col("term").isNotNull())


def count_terms(df: DataFrame, tokens: Column, keys: tuple[str, ...]) -> DataFrame:
    """keys, term, tf: how often each row holds each term."""
    return unpack_terms(pack_terms(df, tokens, keys), keys)


def remove_stop_words(tokens: DataFrame, words: Iterable[str] | DataFrame) -> DataFrame:
    """Leave out stop words, given as a list or as a DataFrame with a ``term`` column."""
    if isinstance(words, DataFrame):
        # No broadcast hint: the optimizer broadcasts the list only if its size allows.
        return tokens.join(words.select("term").distinct(), "term", "left_anti").select(tokens.columns)
    listed = list(words)
    return tokens.filter(~F.col("term").isin(listed)) if listed else tokens


def max_token_length(tokens: DataFrame, n: int) -> DataFrame:
    """Drop (not cut) tokens longer than ``n``."""
    return tokens.filter(F.length("term") <= n)


def stem_terms(tokens: DataFrame) -> DataFrame:
    """Replace every term by its Porter stem."""
    return tokens.withColumn("term", stem_array(F.array("term"))[0])


def word_bag(df: DataFrame, fields: Iterable[str] = ("body", "title"),
             analyzer: str | Analyzer = "standard", key: str = "id") -> DataFrame:
    """key, term, n: word counts of several fields added together.

    The fields of a row are analysed apart and their token arrays joined in the row.
    """
    analyze = get_analyzer(analyzer)
    tokens = F.concat(*[analyze(F.col(f)) for f in fields])
    return count_terms(df, tokens, (key,)).withColumnRenamed("tf", "n")
