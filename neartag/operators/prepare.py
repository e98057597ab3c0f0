"""Question tables: text fields, HTML cleaning, row order and tag counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from neartag.functions.html import split_page
from neartag.plans.staging import Staging, small_batches

PAGES = 256  # pages that a worker takes at once

# Comments, and the text of scripts and styles, hold no tags of their own.
NOT_MARKUP = (r"(?is)<!--.*?(?:-->|\z)"
              r"|(<script\b[^>]*>).*?(?:</script\s*>|\z)"
              r"|(<style\b[^>]*>).*?(?:</style\s*>|\z)")
START_TAG = r"<([a-zA-Z][a-zA-Z0-9]*)"
LINK_TEXT = r"(?is)<a\b[^>]*>([^<]*)</a>"


def concat_fields(title: Column | str = "title", body: Column | str = "body",
                  code: Column | str = "code", links: Column | str = "links") -> Column:
    """The four text fields separated by blanks; null if any of them is null."""
    space = F.lit(" ")
    return F.concat(title, space, body, space, code, space, links)


def project_text(df: DataFrame, text_expr: str) -> DataFrame:
    """id, text and tags, where text is any SQL expression over the question columns."""
    return df.selectExpr("id", f"{text_expr} AS text", "tags")


def with_corpus(df: DataFrame, name: str) -> DataFrame:
    """Label the rows with the corpus they belong to."""
    return df.withColumn("corpus", F.lit(name))


def append_corpus(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both corpora in one table; columns are matched by name."""
    return first.unionByName(second)


def first_by_id(df: DataFrame, order: list[str], keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per key: the first in the given order (map-side combined)."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    picked = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c)
                           for c in df.columns])


def raw_fields(df: DataFrame) -> DataFrame:
    """Leave the body as it is; code and links are empty."""
    return df.withColumns({"code": F.lit(""), "links": F.lit("")})


def clean_html(df: DataFrame, html_col: str = "body") -> DataFrame:
    """Split ``html_col`` into body, code and links.

    The page column is replaced; all other columns are kept.  Pages stream through the
    workers in Arrow batches, each page whole.
    """
    small_batches(df.sparkSession)
    keep = [f for f in df.schema.fields if f.name not in {html_col, "body", "code", "links"}]
    schema = T.StructType(keep + [T.StructField(p, T.StringType()) for p in PAGE_PARTS])
    names = [f.name for f in keep]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from split_pages(batch, names, html_col)

    return df.select(*names, html_col).mapInArrow(split, schema)


PAGE_PARTS = ["body", "code", "links"]


def split_pages(batch: pa.RecordBatch, names: list[str], html_col: str, size: int = PAGES) -> Iterator[pa.RecordBatch]:
    """The columns of a batch and the parts of its pages, few pages at a time."""
    for start in range(0, batch.num_rows, size):
        piece = batch.slice(start, size)
        found = list(zip(*map(split_page, piece[html_col].to_pylist())))
        yield pa.RecordBatch.from_arrays(
            [*(piece[n] for n in names), *(pa.array(part, pa.string()) for part in found)], [*names, *PAGE_PARTS])


def link_text(html: Column) -> Column:
    """Text of the links of a well-formed page as an array, without leaving the JVM."""
    return F.regexp_extract_all(html, F.lit(LINK_TEXT), F.lit(1))


def html_tag_counts(df: DataFrame, html_col: str = "body") -> DataFrame:
    """How often each start tag is written, sorted by tag."""
    markup = F.regexp_replace(F.col(html_col), NOT_MARKUP, "$1$2")
    tags = F.regexp_extract_all(markup, F.lit(START_TAG), F.lit(1))
    return (df.select(F.explode_outer(tags).alias("tag"))
            .filter(F.col("tag").isNotNull())
            .groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))
            .orderBy("tag"))


def tag_counts(df: DataFrame, tags_col: str = "tags", keep_empty: bool = False) -> DataFrame:
    """Count per tag, rarest first.  Tags are split on every single blank, so doubled
    blanks make empty tags; they are counted only on request."""
    tags = df.select(F.explode(F.split(F.col(tags_col), r"\s")).alias("tag"))
    if not keep_empty:
        tags = tags.filter(F.col("tag") != "")
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy("n", "tag")


def number_rows(df: DataFrame, key: str | list[Column], staging: Staging | None = None) -> DataFrame:
    """Add ``row_number``, the 0-based position in the order of any orderable key or keys.

    No global window: rows are range-partitioned by the key and written once in that order;
    a row's number is its place in its range plus the sizes of the earlier ranges.  Rows with
    equal keys are numbered one after the other.
    """
    staging = (staging or Staging(df.sparkSession)).child("numbered")
    keys = [key] if isinstance(key, str) else key
    marked = (df.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .withColumn("_mark", F.monotonically_increasing_id()))
    # The mark holds the number of the range above 33 bits that count its rows.
    rows = staging.write(marked, "rows").withColumn("_range", F.shiftright("_mark", 33))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row per range, so neither the window nor the broadcast grows with the rows of a range.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    return (rows.join(F.broadcast(offsets), "_range")
            .withColumn("row_number", F.col("_before") + place).drop("_range", "_mark", "_before"))


def slice_rows(df: DataFrame, size: int = 10_000, order_by: str = "id") -> DataFrame:
    """Add ``slice_id``: consecutive runs of ``size`` rows in key order."""
    return (number_rows(df, order_by)
            .withColumn("slice_id", F.floor(F.col("row_number") / size).cast("bigint"))
            .drop("row_number"))


def nth_key(keys: DataFrame, n: int, few: int = 10_000) -> tuple[object, int]:
    """The n-th smallest value (nulls first) of a one-column table ``k``, and how many are smaller.

    The keys are dealt into ranges, and the range that holds the n-th is dealt again, until few
    keys or one value are left.  Only counts and ends of ranges come to the driver.
    """
    before, seen = 0, None
    # A number, so that small ranges are not put together again.
    parts = max(2, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    while True:
        ends = (keys.repartitionByRange(parts, "k").groupBy(F.spark_partition_id().alias("part")).agg(
            F.count("*").alias("n"), F.min("k").alias("low"), F.max("k").alias("high"), F.count_if(F.col("k").isNull()).alias("nulls")))
        rows = sorted(ends.collect(), key=lambda r: r.part)
        if sum(r.nulls for r in rows) >= n - before:
            return None, before
        # Without nulls the ranges follow each other.
        before, held = before + sum(r.nulls for r in rows), [r for r in rows if r.n > r.nulls]
        for r in held:
            if before + r.n - r.nulls >= n:
                break
            before += r.n - r.nulls
        keys = keys.filter(F.col("k").between(F.lit(r.low), F.lit(r.high)))
        if r.low == r.high:
            return r.low, before
        if r.n - r.nulls <= few:
            found = sorted(x.k for x in keys.select("k").collect())
            value = found[n - before - 1]
            return value, before + found.index(value)
        if (r.low, r.high) == seen:  # the ranges drawn did not part the keys: part them at the smallest
            least = keys.filter(F.col("k") == F.lit(r.low)).count()
            if before + least >= n:
                return r.low, before
            before, keys = before + least, keys.filter(F.col("k") > F.lit(r.low))
        seen = (r.low, r.high)


def take_first(df: DataFrame, n: int, order_by: str = "id") -> DataFrame:
    """The first ``n`` rows in key order; 0 means all rows.

    The n-th key is found over the keys alone; the rows then come from one scan that filters by
    it.  Of the rows with just that key, as many as are missing are taken, those with the
    smallest hash of the whole row.
    """
    if n <= 0:
        return df
    keys = df.select(F.col(order_by).alias("k"))
    if keys.count() <= n:
        return df
    value, before = nth_key(keys, n)
    key = F.col(order_by)
    if value is None:
        first, last = F.lit(False), key.isNull()
    else:
        first, last = key.isNull() | (key < F.lit(value)), key == F.lit(value)
    ties = df.filter(last)
    if ties.count() > n - before:
        # Rows equal in everything are alike, so any of them will do.
        hashed = ties.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        mark, smaller = nth_key(hashed.select(F.col("_hash").alias("k")), n - before)
        equal = hashed.filter(F.col("_hash") == mark).limit(n - before - smaller)
        ties = hashed.filter(F.col("_hash") < mark).unionByName(equal).drop("_hash")
    return df.filter(first).unionByName(ties)
