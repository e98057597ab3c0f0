"""Line dedup with keep bitmaps (operator 4).

A line's key is the line without ASCII white space at both ends, A-Z in lower case.  A key
that is long enough and occurs in enough documents loses all its lines except those of the
largest doc_id that holds it.

The 128-bit hashes of the keys are range-partitioned and sorted by hash, document (largest
first) and position.  A streaming pass over each partition sees the keeper of a key first
and emits the lines of the others.  The ranges also look at the document, so a key that a
third of all documents share lies in many partitions; a key that may go on in a neighbour
partition is settled by one small aggregation afterwards.  What comes out is a compressed
bitmap per document, never text.

Null and empty texts are one empty line.  Rows with a null doc_id keep all lines and count
for nothing.  Rows that share a doc_id count as one document; each keeps or loses its own
lines (repeated rows alike).  An empty table gives an empty result; other columns are left
alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartag.llm.common import batches_by_group, slices, with_version
from neartag.plans.staging import Staging

MIN_CHARS = 20  # code points of a key
MIN_DOCS = 3
SPACE = b" \t\n\x0b\x0c\r"
FIELDS = [("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("version", pa.int64()),
          ("n_lines", pa.int32()), ("positions", pa.list_(pa.int32()))]
COLUMNS = "h1 long, h2 long, doc_id long, version long, n_lines int, positions array<int>"


def line_hashes(text: str, min_chars: int = MIN_CHARS) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and the positions of each long enough key by its hash."""
    found: dict[bytes, list[int]] = {}
    # Lower-casing bytes touches A-Z only.
    lines = text.encode("utf-8", "surrogatepass").lower().split(b"\n")
    for position, line in enumerate(lines):
        key = line.strip(SPACE)
        n = len(key)
        if n >= min_chars and (n >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
            found.setdefault(xxhash.xxh3_128_digest(key), []).append(position)
    return len(lines), found


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, doc_id, version, n_lines, positions: one row per document and key.

    ``version`` is a hash of the text, which tells rows with the same doc_id apart.
    """
    schema = pa.schema(FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            digests, rows, counts, positions = [], [], [], []
            for row, text in enumerate(batch["text"]):
                n, found = line_hashes(text.as_py() or "", min_chars)
                digests += found.keys()
                positions += found.values()
                rows += [row] * len(found)
                counts += [n] * len(found)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            index = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch["doc_id"].take(index), batch["version"].take(index),
                 pa.array(counts, pa.int32()), pa.array(positions, FIELDS[5][1])], schema=schema)

    return with_version(docs).filter("doc_id IS NOT NULL").select("doc_id", "version", "text").mapInArrow(run, COLUMNS)


def first_occurrences(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``keys`` that lose their lines, and those of keys not settled yet (``open``).

    Each task reads its range in order.  Rows of a key come with the largest doc_id first.
    The first and the last key of a range may go on in a neighbour range and stay open.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for table, bounds in runs(batches):
            # A key is known to end in this range only once another one follows it.
            if held is not None:
                yield from emit(held, [(0, len(held))], first)
                first = False
            if len(bounds) > 1:
                last = bounds[-1][0]
                yield from emit(table.slice(0, last), bounds[:-1], first)
                first = False
                held = table.slice(last)
            else:
                held = table
        if held is not None:
            yield from emit(held, [(0, len(held))], True)

    def runs(batches):
        return batches_by_group(batches, ["h1", "h2"])

    def emit(table: pa.Table, bounds: list[tuple[int, int]], first: bool) -> Iterator[pa.RecordBatch]:
        ids = table["doc_id"].to_numpy()
        starts = np.array([a for a, _ in bounds])
        ends = np.array([b for _, b in bounds])
        new_doc = np.ones(len(ids), np.int64)
        new_doc[1:] = ids[1:] != ids[:-1]
        new_doc[starts] = 1
        docs = np.add.reduceat(new_doc, starts)
        per_row = np.repeat(np.arange(len(starts)), ends - starts)
        lost = (docs >= min_docs)[per_row] & (ids < ids[starts][per_row])
        is_open = np.zeros(len(ids), bool)
        if first:
            is_open[:ends[0]] = True
            lost[:ends[0]] = True
        if lost.any():
            chosen = np.flatnonzero(lost)
            out = table.take(pa.array(chosen)).append_column("open", pa.array(is_open[chosen]))
            yield from out.combine_chunks().to_batches()

    order = [F.col("h1"), F.col("h2"), F.desc("doc_id"), F.col("version")]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.mapInArrow(run, f"{COLUMNS}, open boolean")


def lost_lines(docs: DataFrame, staging: Staging, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, version, n_lines, positions of the lines that go, from any number of rows."""
    rows = staging.write(first_occurrences(line_keys(docs, min_chars), min_docs), "lost")
    still_open = rows.filter("open")
    # At most two keys per range are open, so this table has at most two rows per task.
    per_doc = still_open.select("h1", "h2", "doc_id").distinct()
    totals = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")) \
        .filter(F.col("n_docs") >= min_docs)
    settled = still_open.join(F.broadcast(totals), ["h1", "h2"]).filter(F.col("doc_id") < F.col("keeper"))
    wanted = ["doc_id", "version", "n_lines", "positions"]
    return rows.filter("NOT open").select(*wanted).unionByName(settled.select(*wanted))


def keep_bitmaps(docs: DataFrame, staging: Staging, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, version, n_lines, n_dropped, keep: a compressed bitmap of the lines that stay.

    Documents without a row keep every line.  Bit i % 8 of byte i / 8 stands for line i.
    """
    grouped = lost_lines(docs, staging, min_chars, min_docs).groupBy("doc_id", "version").agg(
        F.max("n_lines").alias("n_lines"), F.flatten(F.collect_list("positions")).alias("positions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, dropped = [], []
            for n, positions in zip(batch["n_lines"].to_pylist(), batch["positions"]):
                keep = np.ones(n, bool)
                keep[positions.values.to_numpy()] = False
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes()))
                dropped.append(int(n - keep.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["version"], batch["n_lines"], pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
                ["doc_id", "version", "n_lines", "n_dropped", "keep"])

    return grouped.select("doc_id", "version", "n_lines", "positions").mapInArrow(
        run, "doc_id long, version long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Every row of documents with its kept lines: doc_id, text, n_lines, n_dropped.

    Columns of ``docs`` other than doc_id and text stay, in front.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = with_version(docs) if not others else docs.select(
        F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = rows.join(bitmaps.select("doc_id", "version", "keep"), ["doc_id", "version"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, counts, dropped = [], [], []
            for text, keep in zip(batch["text"], batch["keep"]):
                lines = (text.as_py() or "").split("\n")
                counts.append(len(lines))
                if keep.is_valid:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8), bitorder="little")
                    lines = [line for line, kept in zip(lines, bits.tolist()) if kept]
                dropped.append(counts[-1] - len(lines))
                texts.append("\n".join(lines))
            columns = {"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string()),
                       "n_lines": pa.array(counts, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            if others:
                columns = {"others": batch["others"]} | columns
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kind = "doc_id long, text string, n_lines long, n_dropped long"
    if not others:
        return joined.select("doc_id", "text", "keep").mapInArrow(run, kind)
    fields = rows.schema["others"].dataType.simpleString()
    out = joined.select("others", "doc_id", "text", "keep").mapInArrow(run, f"others {fields}, {kind}")
    return out.select("others.*", "doc_id", "text", "n_lines", "n_dropped")
