"""Token-id files coded with a static range asymmetric numeral system (operator 3).

A token file is a folder with two Parquet tables: ``table`` holds one frequency per token
id, shared by all blocks; ``blocks`` holds the coded blocks in order.  A block covers whole
documents.  Token i belongs to lane i % lanes, and the lanes are coded side by side by
array operations.  Blocks are independent, so they are written and read in parallel; inside
a block, checkpoints (lane states and word position) let a reader start in the middle.
Every block has a crc32 of its ids, which the reader checks.

Null texts count as empty; each document ends with the end id, so none is empty.  Rows are
ordered by doc_id (null first), then text; repeated rows stay.  Only doc_id and text are
read.  An empty table gives an empty file set and an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neartag.llm.bpe import OTHER, byte_letters, latin_pattern
from neartag.llm.common import Memo, id_and_text
from neartag.plans.staging import Staging

PRECISION = 20  # frequencies add up to 2 ** PRECISION
LOW = np.uint64(1 << 31)  # states stay in [2 ** 31, 2 ** 63)
LANES = 2048
BLOCK_TOKENS = 1 << 18  # a block is closed after this many tokens
CHECKPOINT_TOKENS = 1 << 17


# --- coder ---------------------------------------------------------------------------

def quantize(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Frequencies that add up to 2 ** precision, at least 1 for every token that occurs."""
    total = 1 << precision
    if not counts.sum():
        return np.zeros(len(counts), np.int64)
    present = counts > 0
    if present.sum() > total:
        raise ValueError("more different tokens than the precision can hold")
    spare = total - int(present.sum())
    exact = counts / counts.sum() * spare
    freq = np.floor(exact).astype(np.int64) + present
    rest = total - int(freq.sum())
    order = np.lexsort((np.arange(len(counts)), np.floor(exact) - exact))
    freq[order[present[order]][:rest]] += 1
    freq[int(np.argmax(counts))] += total - int(freq.sum())
    return freq


class Coder:
    """Encodes and decodes arrays of ids under one frequency table."""

    def __init__(self, freq: np.ndarray, precision: int = PRECISION) -> None:
        self.bits = np.uint64(precision)
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lanes: int = LANES, every: int = CHECKPOINT_TOKENS) -> tuple[bytes, bytes]:
        """Payload (32-bit words) and checkpoints: per checkpoint a word position and the states."""
        thirty_two = np.uint64(32)
        limit_bits = np.uint64(63) - self.bits
        freq, start = self.freq[ids], self.start[ids]
        state = np.full(lanes, LOW, np.uint64)
        steps = -(-len(ids) // lanes)
        gap = max(1, every // lanes)
        words, points, n_words = [], [], 0
        for step in range(steps - 1, -1, -1):
            f, c = freq[step * lanes:(step + 1) * lanes], start[step * lanes:(step + 1) * lanes]
            x = state[:len(f)]
            full = x >= (f << limit_bits)
            if full.any():
                out = x[full]
                words.append(out.astype(np.uint32))
                n_words += len(out)
                x[full] = out >> thirty_two
            quotient = x // f
            x[:] = (quotient << self.bits) + (x - quotient * f) + c
            if step % gap == 0:
                points.append((n_words, state.copy()))
        payload = b"".join(w.astype("<u4").tobytes() for w in reversed(words))
        # Positions are counted from the front, where decoding begins.
        marks = b"".join(np.uint64(n_words - at).astype("<u8").tobytes() + s.astype("<u8").tobytes() for at, s in reversed(points))
        return payload, marks

    def decode(self, payload: bytes, marks: bytes, n: int, lanes: int = LANES, every: int = CHECKPOINT_TOKENS,
               first: int = 0, last: int | None = None) -> np.ndarray:
        """The ids from checkpoint ``first`` up to checkpoint ``last`` (None: the end)."""
        thirty_two, mask = np.uint64(32), np.uint64((1 << int(self.bits)) - 1)
        words = np.frombuffer(payload, "<u4").astype(np.uint64)
        size = 8 * (lanes + 1)
        gap = max(1, every // lanes)
        point = np.frombuffer(marks, "<u8", lanes + 1, first * size)
        at, state = int(point[0]), point[1:].astype(np.uint64)
        begin, end = first * gap * lanes, n if last is None else min(n, last * gap * lanes)
        out = np.empty(end - begin, np.uint32)
        for low in range(begin, end, lanes):
            x = state[:min(lanes, end - low)]
            slot = x & mask
            ids = self.symbol[slot]
            out[low - begin:low - begin + len(x)] = ids
            x[:] = self.freq[ids] * (x >> self.bits) + slot - self.start[ids]
            few = x < LOW
            need = int(np.count_nonzero(few))
            if need:
                x[few] = (x[few] << thirty_two) | words[at:at + need]
                at += need
        return out


@lru_cache(maxsize=2)
def coder_of(table: bytes) -> Coder:
    return Coder(np.frombuffer(table, "<i8"))


# --- ids of documents ------------------------------------------------------------------

class Tokens:
    """Ids of texts by the tokenizers library, with a memory of words.

    Texts are cut into words by the pattern of byte-level vocabularies, and the library's model
    sees each word once for as long as it is remembered.
    """

    # Fixed value: the word pattern of byte-level vocabularies.
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype(id_kind(self.tokenizer.get_vocab_size()))
        self.word = regex.compile(self.WORD.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.latin = latin_pattern(self.WORD)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.words = Memo(self.encode_word, 400_000)

    def ids(self, text: str) -> bytes:
        """A whole text by the library's own cutting."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode_word(self, word: str) -> bytes:
        """One word by the library's model, which takes bytes as letters."""
        letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(letters)], self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        # A text with a special token is left to the library.
        if any(s in text for s in self.special):
            return self.ids(text)
        cut = (self.latin if OTHER.search(text) is None else self.word).findall(text)
        return b"".join(map(self.words.__getitem__, cut))


def id_kind(vocabulary_size: int) -> str:
    """The narrowest little-endian type of an id."""
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def token_blocks(docs: DataFrame, path: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Uncoded blocks of consecutive documents in ascending doc_id order.

    part, block, start (tokens of the part before the block), n_tokens, width (bytes of an
    id), doc_ids, lengths, ids.  The range partitioning also looks at a hash of the text, so
    an id that many rows share is spread.
    """
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        width = tokens.kind.itemsize
        end = np.array([end_id], tokens.kind).tobytes()
        part, block, start = TaskContext.get().partitionId(), 0, 0
        doc_ids, pieces, held = [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{
                "part": part, "block": block, "start": start, "n_tokens": held, "width": width, "doc_ids": doc_ids,
                "lengths": [len(p) // width for p in pieces], "ids": b"".join(pieces)}], schema)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                doc_ids.append(doc_id)
                pieces.append(tokens.encode(text.as_py() or "") + end)
                held += len(pieces[-1]) // width
                if held >= block_tokens:
                    yield close()
                    doc_ids, pieces, block, start, held = [], [], block + 1, start + held, 0
        if doc_ids:
            yield close()

    keyed = id_and_text(docs).withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return ordered.mapInArrow(
        run, "part int, block int, start long, n_tokens long, width int, doc_ids array<long>, lengths array<long>, ids binary")


def plain_ids(ids: pa.Scalar, width: int) -> np.ndarray:
    """The ids of a block as 32-bit numbers."""
    return np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")


def token_counts(blocks: DataFrame) -> DataFrame:
    """id, n over all blocks: counted in each task before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for ids, width in chain.from_iterable(zip(batch["ids"], batch["width"].to_pylist()) for batch in batches):
            counts = np.bincount(np.frombuffer(ids.as_buffer(), f"<u{width}"))
            if len(counts) > len(total):
                total = np.pad(total, (0, len(counts) - len(total)))
            total[:len(counts)] += counts
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return blocks.select("ids", "width").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- files -----------------------------------------------------------------------------

def write_tokens(docs: DataFrame, target: str, path: str, end_id: int = 0, lanes: int = LANES,
                 block_tokens: int = BLOCK_TOKENS, every: int = CHECKPOINT_TOKENS) -> None:
    """Encode every text with the vocabulary at ``path`` and write a token file to ``target``.

    The driver holds the frequency table (one number per token of the vocabulary) and the
    token total of each partition.
    """
    spark = docs.sparkSession
    staging = Staging(spark)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")  # the shuffled texts are not needed once the blocks are written
    try:
        blocks = staging.write(token_blocks(docs, path, end_id, block_tokens), "ids", compression="zstd")
    finally:
        spark.conf.set(cleanup, before)
    found = token_counts(blocks).collect()
    counts = np.zeros(max((r.id for r in found), default=-1) + 1, np.int64)
    for r in found:
        counts[r.id] = r.n
    freq = quantize(counts)
    table = freq.astype("<i8").tobytes()
    spark.createDataFrame(pa.table({"id": np.arange(len(freq)), "freq": freq}).to_pandas(), "id long, freq long") \
        .coalesce(1).write.parquet(f"{target}/table")
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per partition meets in this window, whatever the number of documents.
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("lanes", pa.int32()),
                        ("every", pa.int32()), ("marks", pa.binary()), ("payload", pa.binary()), ("crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(table)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = plain_ids(row["ids"][0], row["width"][0].as_py())
                payload, marks = coder.encode(ids, lanes, every)
                made = [[lanes], [every], [marks], [payload], [zlib.crc32(ids)]]
                yield pa.RecordBatch.from_arrays(
                    [row[c] for c in schema.names[:6]] + [pa.array(v, schema.field(c).type) for c, v in zip(schema.names[6:], made)],
                    schema=schema)

    placed = blocks.join(F.broadcast(offsets), "part").select(
        "part", "block", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "doc_ids", "lengths", "ids", "width")
    placed.mapInArrow(run, "part int, block int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, "
                           "lanes int, every int, marks binary, payload binary, crc32 long").write.parquet(f"{target}/blocks")
    staging.close()


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in a token file, decoded from it.

    ``start`` counts the ids of all documents before it.  A block whose ids do not match its
    checksum raises an error.
    """
    return decode_blocks(spark, target, False)


def read_ids(spark: SparkSession, target: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit, binary) of each document."""
    return decode_blocks(spark, target, True)


def decode_blocks(spark: SparkSession, target: str, with_ids: bool) -> DataFrame:
    rows = spark.read.schema("id long, freq long").parquet(f"{target}/table").collect()
    freq = np.zeros(len(rows), "<i8")
    for r in rows:
        freq[r.id] = r.freq
    table = freq.tobytes()
    last = ("ids", pa.binary(), "binary") if with_ids else ("ids_crc32", pa.int64(), "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(table)
        for row in chain.from_iterable(batch.to_pylist() for batch in batches):
            n, lanes, every = row["n_tokens"], row["lanes"], row["every"]
            points = len(row["marks"]) // (8 * (lanes + 1))
            # One piece per checkpoint; a reader of one document could start at the nearest.
            ids = np.concatenate([coder.decode(row["payload"], row["marks"], n, lanes, every, i, i + 1 if i + 1 < points else None)
                                  for i in range(points)]).astype("<u4")
            if zlib.crc32(ids) != row["crc32"]:
                raise ValueError(f"block {row['part']}/{row['block']} is damaged")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            parts = [ids[end - n:end] for end, n in zip(ends.tolist(), lengths.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths),
                 pa.array([p.tobytes() if with_ids else zlib.crc32(p) for p in parts], last[1])],
                ["doc_id", "start", "n_tokens", last[0]])

    blocks = spark.read.schema("part int, block int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, "
                               "lanes int, every int, marks binary, payload binary, crc32 long").parquet(f"{target}/blocks")
    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last[0]} {last[2]}")
