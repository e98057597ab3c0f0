"""Postings in blocks of documents, and exact scoring that skips what cannot win.

A block holds consecutive documents of the docs table as one row: their ids and, per term, the
documents that hold it with their impacts.  Terms are 64-bit keys, so neither index nor search
moves words; impacts are numbers into their document's list of different ones.  A block is written
and shuffled as compressed differences.  Consecutive blocks make a group of bounded size.  A task gets one group and some of the
queries, which stream past it: a query goes to each group once, whatever the number of blocks.

The largest impacts of a query's terms in a block bound what any of its documents can score.
Inside a group a query is scored against its most promising blocks first, and blocks that
cannot reach its k-th best score so far (its floor) are left out.  A query may bring a floor from
groups searched before.

``score_requests`` scores many queries against one block with array operations.  Given the
floors, frequent terms whose bounds together stay below them are optional: only postings of the others
make candidates, and the optional terms are looked up for the candidates still in the race,
those with the largest bounds first.  The bounds of a group's blocks come from a block of
blocks in the same form, with the largest impacts of each block as those of a document.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neartag.functions.scoring import MICRO, ScoreParams, impact_of, length_part
from neartag.operators.index import FieldIndex, Index

BLOCK_DOCS = 512
BLOCK_POSTINGS = 1 << 20  # a block of long documents closes earlier
GROUP_POSTINGS = 1 << 23  # postings of a group
GROUP_KEYS = 1 << 21  # largest impacts of a group
CELLS = 1 << 17  # query-document cells, and postings, that are held at once
ASKED = 1 << 19  # pairs of a query and a block of its group that are bounded at once
ALL = 1 << 30
PIECE_DOCS = 1 << 13  # documents of blocks that are joined when many queries follow
FEW = 1024  # queries for which a group is not unpacked as a whole
FREQUENT = 32  # a term in one document of so many has a row in the table of a block
TABLE = 1 << 23  # cells of such a table
SPARSE = 8  # postings are sorted if there are so many times fewer than cells
CHUNKS = 64  # of the documents of a block

BLOCK_ARRAYS = ("ids", "keys", "sizes", "gaps", "codes", "levels", "values")
BLOCK_ROW = "grp long, block long, shelf int, corpus string, n_docs int, " + ", ".join(f"{name} binary" for name in BLOCK_ARRAYS)

FLOORS = "array<struct<shelf:int,floor:bigint>>"


def term_key(seed: int, *parts: Column) -> Column:
    """A number for a term, or for a field and a term."""
    return F.xxhash64(F.lit(seed), *parts)


def key_seed(terms: DataFrame, columns: tuple[str, ...]) -> int:
    """The first seed under which no two terms (rows of these columns) have the same key."""
    seed = 0
    while True:
        key = term_key(seed, *map(F.col, columns))
        row = terms.agg(F.count("*").alias("n"), F.count_distinct(key).alias("distinct")).first()
        if row.n == row["distinct"]:
            return seed
        seed += 1


def weighted_docs(index: Index | FieldIndex, params: ScoreParams, seed: int, corpus: str | None = None) -> DataFrame:
    """corpus, id, keys, counts, parts: the documents of an index (of one corpus) as they go into blocks.

    ``counts`` are the frequencies of the terms, ``parts`` the ``length_part`` of each, or one for all.
    """
    docs = index.docs if corpus is None else index.docs.filter(F.col("corpus") == corpus)
    if isinstance(index, FieldIndex):
        average = F.create_map(*[F.lit(x) for pair in index.averages().items() for x in pair])
        return docs.select("corpus", "id", F.transform("postings", lambda p: term_key(seed, p.field, p.term)).alias("keys"), F.col("postings.tf").alias("counts"), F.transform(
            "postings", lambda p: length_part(p.doc_len, F.element_at(average, p.field), params)).alias("parts"))
    avgdl = index.corpus_stats.select("avgdl").scalar()
    return docs.select("corpus", "id", F.transform("terms.term", lambda t: term_key(seed, t)).alias("keys"), F.col("terms.tf").alias("counts"),
                       F.array(length_part(F.col("doc_len"), avgdl, params)).alias("parts"))


def block_table(weighted: DataFrame, shelf: Column | None = None, block_docs: int = BLOCK_DOCS,
                block_postings: int = BLOCK_POSTINGS, group_postings: int = GROUP_POSTINGS, group_keys: int = GROUP_KEYS,
                params: ScoreParams = ScoreParams()) -> DataFrame:
    """One row per block (see BLOCK_ROW) of documents (``weighted_docs`` for the same scorer), without a shuffle.

    ``shelf`` (an int computed from corpus and id; 0 if not given) sorts documents into sets that
    are searched apart; a block is of one corpus and shelf, a group may hold several.  The table
    has to be written before use, as the numbers of blocks and groups depend on the task that makes them.
    """
    rows = weighted.select("corpus", (F.lit(0) if shelf is None else shelf).cast("int").alias("shelf"), "id", "keys", "counts", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        seq, group, group_size, group_maxima = 0, 0, 0, 0
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        where, size = None, 0

        def close() -> pa.RecordBatch:
            nonlocal seq, size, group, group_size, group_maxima
            made = pack_block([h[0] for h in held], [h[1] for h in held], [h[2] for h in held])
            n_keys = packed_length(made["keys"])
            if group_size and (group_size + size > group_postings or group_maxima + n_keys > group_keys):
                group, group_size, group_maxima = group + 1, 0, 0
            row = {"grp": first | group, "block": first | seq, "shelf": where[1], "corpus": where[0], "n_docs": len(held)} | made
            held.clear()
            group_size, group_maxima = group_size + size, group_maxima + n_keys
            seq, size = seq + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in BLOCK_TYPES], [n for n, _ in BLOCK_TYPES])

        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("corpus", "shelf", "id")]
            for i, (corpus, own_shelf, doc) in enumerate(zip(*columns)):
                if held and ((corpus, own_shelf) != where or len(held) >= block_docs or size >= block_postings):
                    yield close()
                where = (corpus, own_shelf)
                keys = batch["keys"][i].values.to_numpy()
                held.append((doc, keys, impact_of(batch["counts"][i].values.to_numpy(), batch["parts"][i].values.to_numpy(), params)))
                size += len(keys)
        if held:
            yield close()

    ordered = rows if shelf is None else rows.sortWithinPartitions("corpus", "shelf", "id")
    return ordered.mapInArrow(run, BLOCK_ROW)


BLOCK_TYPES = [("grp", pa.int64()), ("block", pa.int64()), ("shelf", pa.int32()), ("corpus", pa.string()), ("n_docs", pa.int32())] + [
    (name, pa.binary()) for name in BLOCK_ARRAYS]


def short(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes."""
    top = int(values.max()) if len(values) else 0
    return values.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def packed_numbers(packed: bytes, n: int) -> np.ndarray:
    """``n`` numbers that ``short`` packed, as narrow as they are."""
    return np.frombuffer(packed, f"<u{len(packed) // n}") if n else np.zeros(0, np.int64)


def long(packed: bytes, n: int) -> np.ndarray:
    """``n`` numbers that ``short`` packed."""
    return packed_numbers(packed, n).astype(np.int64)


HEAD = struct.Struct("<IB")


def squeeze(raw: bytes, n: int) -> bytes:
    """``n`` numbers of equal width, compressed: first the lowest bytes of all, then the next, as these are alike."""
    if not n:
        return HEAD.pack(0, 0)
    width = len(raw) // n
    return HEAD.pack(n, width) + pa.compress(turned(raw, n, width), codec="zstd", asbytes=True)


def unsqueeze(packed: bytes) -> tuple[bytes, int]:
    """The bytes and the number of numbers that ``squeeze`` packed."""
    n, width = HEAD.unpack_from(packed)
    if not n:
        return b"", 0
    return turned(pa.decompress(packed[HEAD.size:], n * width, codec="zstd", asbytes=True), width, n), n


def turned(raw: bytes, rows: int, columns: int) -> bytes:
    """A table of bytes, column by column."""
    if rows == 1 or columns == 1:
        return raw
    table, out = np.frombuffer(raw, "u1").reshape(rows, columns), np.empty((columns, rows), "u1")
    # The shorter side is the loop, so that each copy is long.
    for i in range(min(rows, columns)):
        if columns <= rows:
            out[i] = table[:, i]
        else:
            out[:, i] = table[i]
    return out.tobytes()


def packed_length(packed: bytes) -> int:
    return HEAD.unpack_from(packed)[0]


def number_impacts(impacts: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's list of different impacts, one after the other; how long each is; every impact's number in its list."""
    order = np.argsort(impacts, kind="stable")
    order = order[np.argsort(doc[order].astype(np.min_scalar_type(n)), kind="stable")]
    sorted_doc, sorted_impacts = doc[order], impacts[order]
    new = np.ones(len(order), bool)
    new[1:] = (sorted_doc[1:] != sorted_doc[:-1]) | (sorted_impacts[1:] != sorted_impacts[:-1])
    levels = np.bincount(sorted_doc[new], minlength=n)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1 - (np.cumsum(levels) - levels)[sorted_doc]
    return sorted_impacts[new], levels, code


def pack_block(ids: list[int], keys: list[np.ndarray], impacts: list[np.ndarray]) -> dict[str, bytes]:
    """The arrays of a block as bytes: postings in order of key, then document."""
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), [len(k) for k in keys])
    key = np.concatenate(keys)
    values, levels, code = number_impacts(np.concatenate(impacts), doc, len(ids))
    order = np.argsort(key, kind="stable")  # documents ascend
    key, doc, code = key[order], doc[order], code[order]
    names, first = np.unique(key, return_index=True)
    sizes = np.diff(np.append(first, len(key)))
    gaps = np.diff(doc, prepend=0)
    gaps[first] = doc[first]
    steps = np.diff(names.astype("<i8").view("<u8"), prepend=np.zeros(1, "<u8"))  # modulo 2 ** 64
    packed = {"ids": np.array(ids, "<i8").tobytes(), "keys": steps.astype("<u8").tobytes(), "values": values.astype("<f8").tobytes(),
              "sizes": short(sizes), "gaps": short(gaps), "codes": short(code), "levels": short(levels)}
    counts = {"ids": len(ids), "keys": len(names), "values": len(values), "sizes": len(sizes), "gaps": len(gaps), "codes": len(code), "levels": len(levels)}
    return {name: squeeze(raw, counts[name]) for name, raw in packed.items()}


# --- one block --------------------------------------------------------------------------

@dataclass(frozen=True)
class Block:
    ids: np.ndarray
    keys: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    maxima: np.ndarray

    @cached_property
    def places(self) -> np.ndarray:
        """Key number * documents + document of each posting, ascending."""
        return np.repeat(np.arange(len(self.keys)), self.ends - self.starts) * len(self.ids) + self.docs

    @cached_property
    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Each term's row in a table, or -1 for a rare one; the table: which posting of the term a document has, from 1 on, or 0."""
        n, sizes = max(1, len(self.ids)), self.ends - self.starts
        rows = np.flatnonzero(sizes * FREQUENT >= n)
        most = max(1, TABLE // n)
        if len(rows) > most:
            rows = np.sort(rows[np.argsort(-sizes[rows], kind="stable")[:most]])
        slots = np.full(len(self.keys), -1)
        slots[rows] = np.arange(len(rows))
        table = np.zeros(len(rows) * n, np.uint16 if n < 1 << 16 else np.uint32)
        own = sizes[rows]
        table[np.repeat(np.arange(len(rows)) * n, own) + self.docs[np.repeat(self.starts[rows], own) + within(own)]] = within(own) + 1
        return slots, table

    def match(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at, -1)


def unpack_block(row: dict[str, bytes], wanted: np.ndarray | None = None) -> Block:
    """The block, or what it holds of the ``wanted`` keys (ascending, different)."""
    raw = {name: unsqueeze(row[name]) for name in BLOCK_ARRAYS}
    ids, values = np.frombuffer(raw["ids"][0], "<i8"), np.frombuffer(raw["values"][0], "<f8")
    keys = np.cumsum(np.frombuffer(raw["keys"][0], "<u8"), dtype="<u8").view("<i8")
    sizes, levels = long(*raw["sizes"]), long(*raw["levels"])
    if wanted is None:
        gaps, codes = long(*raw["gaps"]), long(*raw["codes"])
    else:
        at = np.searchsorted(keys, wanted)
        inside = at < len(keys)
        at = at[inside][keys[at[inside]] == wanted[inside]]
        first, keys, sizes = (np.cumsum(sizes) - sizes)[at], keys[at], sizes[at]
        posting = np.repeat(first, sizes) + within(sizes)
        gaps, codes = (packed_numbers(*raw[name])[posting].astype(np.int64) for name in ("gaps", "codes"))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    run = np.cumsum(gaps)
    docs = run - np.repeat(run[starts] - gaps[starts], sizes)
    impacts = values[(np.cumsum(levels) - levels)[docs] + codes]
    maxima = np.maximum.reduceat(impacts, starts) if len(starts) else impacts
    return Block(ids, keys, starts, ends, docs.astype(np.int32), impacts, maxima)


def join_blocks(blocks: list[Block]) -> Block:
    """The documents of all blocks, one after the other, as one block."""
    if len(blocks) == 1:
        return blocks[0]
    before = np.cumsum([0] + [len(b.ids) for b in blocks])
    key, number = np.concatenate([b.keys for b in blocks]), np.repeat(np.arange(len(blocks)), [len(b.keys) for b in blocks])
    sizes, skipped = np.concatenate([b.ends - b.starts for b in blocks]), np.cumsum([0] + [len(b.docs) for b in blocks])
    start = np.concatenate([b.starts for b in blocks]) + skipped[number]
    order = np.argsort(key, kind="stable")  # blocks ascend
    posting = np.repeat(start[order], sizes[order]) + within(sizes[order])
    docs = np.concatenate([b.docs + np.int32(first) for b, first in zip(blocks, before)])[posting]
    impacts = np.concatenate([b.impacts for b in blocks])[posting]
    names, first = np.unique(key[order], return_index=True)
    ends = np.cumsum(np.add.reduceat(sizes[order], first)) if len(names) else np.zeros(0, np.int64)
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1]))[:len(names)]
    maxima = np.maximum.reduceat(impacts, starts) if len(names) else impacts
    return Block(np.concatenate([b.ids for b in blocks]), names, starts, ends, docs, impacts, maxima)


def to_micro(values: np.ndarray) -> np.ndarray:
    """Whole millionths, halves up, as the column expression rounds them."""
    return np.floor(values * float(MICRO) + 0.5).astype(np.int64)


def upper_micro(values: np.ndarray) -> np.ndarray:
    """No rounded product is above this."""
    return np.ceil(values * float(MICRO)).astype(np.int64) + 1


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count in turn."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def score_requests(block: Block, floors: np.ndarray, keys: np.ndarray, weights: np.ndarray, counts: np.ndarray,
                   k: int, bounds: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """Per query its k best documents that reach its floor: query, document and score in millionths.

    With ``bounds`` each term's share is rounded up, so that a sum of largest impacts is above any
    score.  ``keys`` and ``weights`` are the terms of all queries, ``counts`` how many each has.  The last
    value tells how many postings were scored and how many look-ups made.
    """
    return score_matched(block, floors, block.match(keys), weights, counts, k, bounds)


def score_matched(block: Block, floors: np.ndarray, at: np.ndarray, weights: np.ndarray, counts: np.ndarray,
                  k: int, bounds: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
    """``score_requests`` for terms given by their numbers in the block, -1 for one that it does not hold.

    Only terms with a row in the table of frequent terms are ever optional, so that a look-up reads one number.
    """
    n = len(block.ids)
    rounded = upper_micro if bounds else to_micro
    query = np.repeat(np.arange(len(counts)), counts)
    known = np.flatnonzero(at >= 0)
    query, at, weights = query[known], at[known], weights[known]
    bound = upper_micro(weights * block.maxima[at])
    first = np.searchsorted(query, np.arange(len(counts) + 1))
    slots = table = None
    if floors.any():
        slots, table = block.frequent
        rare = slots[at] < 0
    else:
        rare = np.ones(len(at), bool)
    # Frequent terms first, the weakest of them before the others.
    order = np.lexsort((bound, rare, query))
    at, weights, bound, rare = at[order], weights[order], bound[order], rare[order]
    # Bounds summed within each query.
    total = np.concatenate(([0], np.cumsum(bound)))
    reach = total[1:] - total[first[query]]
    optional = (reach < floors[query]) & ~rare
    many = first[1:] > first[:-1]
    last = first[:-1] + np.add.reduceat(np.append(optional, False).astype(np.int64), first[:-1]) * many
    rest = total[last] - total[first[:-1]]
    lengths = np.where(optional, 0, (block.ends - block.starts)[at])
    starts = block.starts[at]
    rows = None if slots is None else slots[at] * n
    ending = np.zeros(len(at), bool)  # the last term that is looked up
    ending[first[:-1][many]] = True
    found: list[tuple[np.ndarray, ...]] = []
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    looked = 0

    def finish() -> None:
        """Look the optional terms of the candidates up, as long as these are in the race."""
        nonlocal looked
        who, doc, score, floor = (np.concatenate(x) for x in zip(*found))
        found.clear()
        slack, term = score + rest[who] - floor, last[who] - 1  # what a score may lose on its way to the floor
        more = term >= first[who]
        done = [tuple(x[~more] for x in (who, doc, slack, floor))]
        who, doc, slack, floor, term = (x[more] for x in (who, doc, slack, floor, term))
        while len(who):
            looked += len(who)
            place = table[rows[term] + doc]
            slack -= bound[term]
            has = np.flatnonzero(place)
            own = term[has]
            slack[has] += rounded(weights[own] * block.impacts[starts[own] + place[has] - 1])
            open_, end = slack >= 0, ending[term]
            ended = np.flatnonzero(open_ & end)
            if len(ended):
                done.append(tuple(x[ended] for x in (who, doc, slack, floor)))
            open_ = np.flatnonzero(open_ & ~end)
            who, doc, slack, floor, term = (x[open_] for x in (who, doc, slack, floor, term))
            term -= 1
        who, doc, slack, floor = (np.concatenate(x) for x in zip(*done))
        score = slack + floor
        order = np.lexsort((block.ids[doc], -score, who))
        who, doc, score = who[order], doc[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < k
        out.append((who[best], doc[best], score[best]))

    # Queries are taken together as long as cells and postings stay few; their candidates as long as these do.
    work = np.add.reduceat(np.append(lengths, 0), first[:-1]) * many
    cuts = np.cumsum(np.maximum(work, np.minimum(n, SPARSE * work))) // CELLS
    edges = np.concatenate(([0], np.flatnonzero(np.diff(cuts)) + 1, [len(counts)])).tolist()
    for low, high in zip(edges, edges[1:]):
        span = slice(first[low], first[high])
        used = lengths[span]
        posting = np.repeat(starts[span] - (np.cumsum(used) - used), used)
        posting += np.arange(len(posting))
        cell = np.repeat((query[span] - low) * n, used)
        cell += block.docs[posting]
        gain = rounded(np.repeat(weights[span], used) * block.impacts[posting])
        cell, score, floor = add_cells(cell, gain, high - low, n, floors[low:high], rest[low:high], k)
        who = cell // max(n, 1)
        found.append((who + low, cell - who * n, score, floor[who]))
        if high == len(counts) or sum(len(x[0]) for x in found) > CELLS // 2:
            finish()
    return (*(np.concatenate([o[i] for o in out]) for i in range(3)), (int(lengths.sum()), looked))


def add_cells(cell: np.ndarray, gain: np.ndarray, rows: int, n: int, floors: np.ndarray, rest: np.ndarray,
              k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (query * n + document) whose summed gains can still reach the floor of their query; the sums; the floors.

    Few postings are sorted, many are added up in an array of all cells.  There the best documents of ``CHUNKS``
    chunks tell a floor: as many different documents as the k best of these have at least their sums.
    """
    if len(cell) * SPARSE < rows * n and (not len(gain) or 0 <= gain.min() and gain.max() < 1 << 26):
        packed = cell << 26 | gain
        packed.sort()
        cell = packed >> 26
        new = np.flatnonzero(np.diff(cell, prepend=-1))
        cell = cell[new]
        score = np.add.reduceat(packed & (1 << 26) - 1, new) if len(new) else packed
        found = np.flatnonzero(score >= (floors - rest)[cell // n])
        return cell[found], score[found], floors
    summed = np.bincount(cell, gain, minlength=rows * n)  # whole numbers below 2 ** 53
    if k <= CHUNKS // 2 and n >= CHUNKS:
        wide = n // CHUNKS
        tops = summed.reshape(rows, n)[:, :wide * CHUNKS].reshape(rows, CHUNKS, wide).max(axis=2)
        floors = np.maximum(floors, np.partition(tops, CHUNKS - k, axis=1)[:, CHUNKS - k].astype(np.int64))
    least = floors - rest
    found = np.flatnonzero(summed.reshape(rows, n) >= np.maximum(least, 1)[:, None])
    if (least <= 0).any() and not gain.all():  # documents whose terms add nothing count as found
        hit = np.unique(cell[gain == 0])
        found = np.union1d(found, hit[(summed[hit] == 0) & (least[hit // n] <= 0)])
    return found, summed[found].astype(np.int64), floors


# --- one group --------------------------------------------------------------------------

@dataclass(frozen=True)
class Piece:
    """Blocks that are scored together, and the number of each document's block."""

    block: Block
    rows: np.ndarray


class Shelf:
    """The blocks of a group that are searched together: packed, with the block of blocks that bounds them.

    The first queries, if they are few, unpack of each block their own terms only; otherwise all blocks are
    unpacked, once, and up to ``PIECE_DOCS`` documents of them are joined.
    """

    def __init__(self, rows: list[dict]) -> None:
        self.rows = rows
        self.searches, self.whole = 0, None

    def pieces(self) -> tuple[list[Piece], Block]:
        """All blocks, joined, and what bounds them."""
        if self.whole is None:
            made: list[Piece] = []
            held: list[int] = []
            docs = 0
            for number, row in enumerate(self.rows):
                n = packed_length(row["ids"])
                if held and docs + n > PIECE_DOCS:
                    made.append(self.piece(held))
                    held, docs = [], 0
                held.append(number)
                docs += n
            made.append(self.piece(held))
            self.whole = made, bound_blocks([piece.block for piece in made])
        return self.whole

    def piece(self, numbers: list[int], wanted: np.ndarray | None = None) -> Piece:
        blocks = [unpack_block(self.rows[i], wanted) for i in numbers]
        return Piece(join_blocks(blocks), np.repeat(numbers, [len(b.ids) for b in blocks]))

    def search(self, keys: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int, rounds: tuple[int, ...],
               floors: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """Per query its k best documents (that reach its floor): query, number of the block, id, score in millionths.

        ``rounds`` are the numbers of blocks that a query has been scored against when its floor
        rises; it then rises whenever they double.
        """
        n = len(counts)
        floors, first = np.zeros(n, np.int64) if floors is None else floors.copy(), np.cumsum(counts) - counts
        wanted, asked = np.unique(keys, return_inverse=True)
        self.searches += 1
        if self.searches == 1 and n <= FEW:
            held, top = None, bound_blocks([unpack_block(row, wanted) for row in self.rows])
        else:
            held, top = self.pieces()
        query, block, bound, _ = score_matched(top, np.zeros(n, np.int64), top.match(wanted)[asked], weights, counts, ALL, bounds=True)
        place = np.arange(len(query)) - np.searchsorted(query, query)
        most = int(place.max()) + 1 if len(place) else 0
        best = (np.zeros(0, np.int64),) * 4
        low, later = 0, iter(rounds)
        while low < most:
            high = max(next(later, 2 * low), low + 1)
            open_ = np.flatnonzero((place >= low) & (place < high) & (bound >= floors[query]))
            open_ = open_[np.argsort(block[open_], kind="stable")]
            edges = np.flatnonzero(np.diff(block[open_], prepend=-1, append=len(top.ids))).tolist()
            found = [best]
            for start, end in zip(edges, edges[1:]):
                number, own = int(block[open_[start]]), query[open_[start:end]]
                term = np.repeat(first[own], counts[own]) + within(counts[own])
                piece = self.piece([number], wanted) if held is None else held[number]
                at = piece.block.match(wanted)[asked[term]]
                who, doc, score, _ = score_matched(piece.block, floors[own], at, weights[term], counts[own], k)
                found.append((own[who], piece.rows[doc], piece.block.ids[doc], score))
            best = self.k_best([np.concatenate(x) for x in zip(*found)], k)
            ends = np.searchsorted(best[0], np.arange(n), "right")
            full = np.flatnonzero(np.bincount(best[0], minlength=n) >= k)
            floors[full] = np.maximum(floors[full], best[3][ends[full] - 1])
            low = high
        return best

    def k_best(self, found: list[np.ndarray], k: int) -> tuple[np.ndarray, ...]:
        query, number, ids, score = found
        names = sorted({r["corpus"] for r in self.rows}, key=lambda name: (name is not None, name or ""))
        corpus = np.array([names.index(r["corpus"]) for r in self.rows])[number]
        order = np.lexsort((corpus, ids, -score, query))
        query = query[order]
        order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
        return tuple(x[order] for x in found)


def bound_blocks(blocks: list[Block]) -> Block:
    """A block whose documents are blocks, with their largest impacts."""
    return unpack_block(pack_block(list(range(len(blocks))), [b.keys for b in blocks], [b.maxima for b in blocks]))


# --- jobs --------------------------------------------------------------------------------

def floors_of(piece: pa.RecordBatch, shelf: int | None) -> np.ndarray:
    """The floor of each query of a batch in a shelf: ``least``, or what ``floors`` has for the shelf if that is more."""
    least, floors = pc.fill_null(piece["least"], 0).to_numpy(zero_copy_only=False).copy(), piece["floors"]
    own = np.repeat(np.arange(len(floors)), pc.fill_null(pc.list_value_length(floors), 0).to_numpy(zero_copy_only=False))
    entries = floors.flatten()
    numbers = entries.field("shelf")
    here = pc.is_null(numbers) if shelf is None else pc.fill_null(pc.equal(numbers, shelf), False)
    here = np.flatnonzero(here.to_numpy(zero_copy_only=False))
    np.maximum.at(least, own[here], entries.field("floor").to_numpy(zero_copy_only=False)[here])
    return least


def search_groups(lists: DataFrame, blocks: DataFrame, groups: tuple[int, ...], parts: int, k: int, rounds: tuple[int, ...]) -> DataFrame:
    """bag_id, shelf, corpus, id, micro: the k best documents of each query (bag_id, keys, weights) in each group and shelf.

    A query may have floors (``least`` and ``floors``, see ``floors_of``): documents below them are left out.
    A task gets cells of one group and one of ``parts`` parts of the queries: block rows first,
    then the queries, which stream past them.
    """
    part = F.pmod(F.xxhash64("bag_id"), F.lit(parts)).cast("int")
    data = F.struct("block", "shelf", "corpus", *BLOCK_ARRAYS)
    if "floors" not in lists.columns:
        lists = lists.withColumns({"least": F.lit(0).cast("bigint"), "floors": F.array().cast(FLOORS)})
    held = blocks.filter(F.col("grp").isin(list(groups))).select("grp", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.col("block").alias("bag_id"), data.alias("data"))
    asked = lists.select(F.explode(F.array(*map(F.lit, groups)).cast("array<bigint>")).alias("grp"), part.alias("part"), "bag_id",
                         F.col("keys").alias("q_keys"), "weights", "least", "floors")
    rows = held.withColumn("kind", F.lit(0)).unionByName(asked.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # A task per cell.
    number = F.array_position(F.array(*map(F.lit, groups)).cast("array<bigint>"), F.col("grp")).cast("int") - 1
    ordered = rows.repartitionById(max(1, len(groups) * parts), number * parts + F.col("part")).sortWithinPartitions("grp", "part", "kind", "bag_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, shelves = None, [], None
        for batch in batches:
            kind, cells = batch["kind"].to_numpy(), list(zip(batch["grp"].to_pylist(), batch["part"].to_pylist()))
            low = 0
            while low < batch.num_rows:
                if cells[low] != cell:
                    cell, held, shelves = cells[low], [], None
                if kind[low] == 0:
                    held.append(batch["data"][low].as_py())
                    low += 1
                    continue
                if shelves is None:
                    numbers = sorted({r["shelf"] for r in held}, key=lambda number: (number is not None, number))
                    shelves = [(number, Shelf([r for r in held if r["shelf"] == number])) for number in numbers]
                high = low + 1
                while high < batch.num_rows and high - low < max(1, ASKED // len(held)) and kind[high] == 1 and cells[high] == cell:
                    high += 1
                piece = batch.slice(low, high - low)
                keys, weights = piece["q_keys"], piece["weights"]
                counts = np.diff(keys.offsets.to_numpy()).astype(np.int64)
                for number, shelf in shelves:
                    query, block, ids, score = shelf.search(
                        keys.flatten().to_numpy(), weights.flatten().to_numpy(), counts, k, rounds, floors_of(piece, number))
                    names = pa.array([r["corpus"] for r in shelf.rows], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [piece["bag_id"].take(pa.array(query)), pa.array([number], pa.int32()).take(pa.array(np.zeros(len(query), np.int64))),
                         names.take(pa.array(block)), pa.array(ids), pa.array(score)], ["bag_id", "shelf", "corpus", "id", "micro"])
                low = high

    return ordered.mapInArrow(run, "bag_id long, shelf int, corpus string, id long, micro long")
