"""Exact top-k search by inner product, a block of documents at a time (operator 1).

Vectors are whole numbers.  Each dimension is a term; documents lie in blocks, and a block
keeps its largest and smallest value per term and the values themselves (its forward index).
A query orders the blocks by the score that these extremes allow.  The best blocks of all are
scored first; their k-th best score is the floor of the query.  Blocks whose bound reaches the
floor are then scored by superblock (16 neighbouring blocks), in the order of their bounds: the
floor rises after each block, and a query stops where the bounds fall below it.

Blocks are ranges of an order in which similar vectors are near each other: by the nearest
of a few sampled vectors, then by id.  The sample only affects how many blocks are skipped.
Queries are grouped, so bounds and scores are matrix products; a group meets the summaries
of all blocks, but only those blocks it has to score.

Vectors that are null, or hold a null or non-finite component, take no part, as queries or
as candidates.  Shorter vectors count as padded with zeros.  Rows with a null id take no
part.  Rows that repeat an id are separate candidates, except that a query never finds its
own id; a query id that repeats is asked once per row.  Ties go to the smaller id.  Empty
tables give empty results; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from neartag.plans.staging import Staging

BLOCK = 256  # documents of a block
GROUP = 256  # queries of a group
CHUNK = 1024  # block summaries of a row
LEADS = 4  # blocks that set the floor
SUPER = 4  # a superblock is 2 ** SUPER consecutive blocks
CELL = 64  # groups that meet a row of summaries in one key
LOWEST = -(1 << 63)
WANTED = "array<struct<query: int, block: long, bound: long, floor: long>>"
CENTERS = 64  # sampled vectors that order the documents


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """id and values (array of long, floor of scale times each component) of usable vectors."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(usable).select(F.col(id_col).cast("bigint").alias("id"), F.transform(x, lambda v: F.floor(v * scale)).alias("values"))


def matrix(values: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of whole numbers, padded with zeros to ``width``."""
    lengths = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy()
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles while every sum is below 2 ** 53, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0 ** 53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(np.int64) @ b.astype(np.int64).T


def blocks_of(vectors: DataFrame, width: int, block: int = BLOCK, centers: int = CENTERS) -> DataFrame:
    """block, ids, high, low, forward (row-major 64-bit): ranges of similar documents."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(centers).select("values").collect()
    middle = np.zeros((len(sample), width), np.int64)
    for i, row in enumerate(sample):
        middle[i, :len(row[0])] = row[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nearest by squared distance: |c| ** 2 / 2 - <v, c>.
        half = (middle.astype(np.float64) ** 2).sum(axis=1) / 2
        for batch in batches:
            near = np.argmin(half[None, :] - product(matrix(batch["values"], width), middle), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), batch["id"], batch["values"]], ["near", "id", "values"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part = 0, TaskContext.get().partitionId()
        held = None
        def close(rows: pa.Table) -> pa.RecordBatch:
            values = matrix(rows["values"].combine_chunks(), width)
            cells = [[(part << 32) + number], [rows["id"].to_pylist()], [values.max(axis=0).tolist()], [values.min(axis=0).tolist()],
                     [values.astype("<i8").tobytes()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], ["block", "ids", "high", "low", "forward"])
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            while len(held) >= block:
                yield close(held.slice(0, block))
                held, number = held.slice(block), number + 1
        if held is not None and len(held):
            yield close(held)

    placed = vectors.select("id", "values").mapInArrow(place, "near int, id long, values array<long>")
    ordered = placed.repartitionByRange("near", "id").sortWithinPartitions("near", "id")
    return ordered.select("id", "values").mapInArrow(cut, "block long, ids array<long>, high array<long>, low array<long>, forward binary")


def query_groups(queries: DataFrame, size: int = GROUP) -> DataFrame:
    """group, ids, values (list of arrays): queries dealt out evenly, a bounded number a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                rows = batch.slice(low, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + number]), pa.array([rows["id"].to_pylist()], pa.list_(pa.int64())),
                     pa.array([rows["values"].to_pylist()], pa.list_(pa.list_(pa.int64())))], ["group", "ids", "values"])
                number += 1

    # One task per so many queries; sorted so that a repeated run makes the same groups.
    return queries.select("id", "values").mapInArrow(run, "group long, ids array<long>, values array<array<long>>")


def rows_of(values: pa.Scalar, width: int) -> np.ndarray:
    return matrix(values.values, width)


def super_of(block: Column | str) -> Column:
    """The superblock of a block; blocks of a task are numbered in their order."""
    return F.shiftright(block, SUPER)


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0,
          staging: Staging | None = None, block: int = BLOCK, group: int = GROUP, leads: int = LEADS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query, itself left out."""
    staging = staging or Staging(vectors.sparkSession)
    usable = staging.write(quantized(vectors, id_col, vector_col, scale), "vectors")
    width = usable.agg(F.max(F.size("values"))).first()[0] or 0
    blocks = staging.write(blocks_of(usable, width, block), "blocks")
    supers = staging.write(blocks.groupBy(super_of("block").alias("super")).agg(
        F.collect_list(F.struct("block", "ids", "forward")).alias("members")), "supers")
    asked = usable.withColumnRenamed("id", id_col).filter(is_query).withColumnRenamed(id_col, "id")
    groups = staging.write(query_groups(asked.repartitionByRange("id").sortWithinPartitions("id"), group), "groups")

    # The stated query set against all blocks: each group meets the summaries of all blocks, a
    # thousand in a row.  A key has a bounded number of groups.
    chunks, cells = 1 + blocks.count() // CHUNK, 1 + groups.count() // CELL
    summaries = (blocks.select("block", "high", "low").withColumn("chunk", F.pmod(F.xxhash64(super_of("block")), F.lit(chunks)).cast("int"))
                 .groupBy("chunk").agg(F.collect_list("block").alias("blocks"), F.collect_list("high").alias("highs"), F.collect_list("low").alias("lows"))
                 .withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))))

    def met(asking: DataFrame) -> DataFrame:
        placed = asking.withColumn("cell", F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int"))
        return placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(summaries, ["chunk", "cell"])

    best = Window.partitionBy("group", "query").orderBy(F.desc("bound"), "block")
    lead = (met(groups).select("group", "values", "blocks", "highs", "lows").mapInArrow(
        best_blocks(width, leads), "group long, query int, block long, bound long")
        .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= leads).drop("place"))
    lead = staging.write(lead, "lead")
    pair = F.struct("query", "block", "bound", F.lit(LOWEST).alias("floor"))
    first = staging.write(score_pairs(lead.groupBy("group", super_of("block").alias("super")).agg(F.collect_list(pair).alias("wanted")),
                                      supers, groups, width, k), "first")

    # Bounds are computed again, as all of them would be queries x blocks; only what reaches the
    # floors is written.
    floors = ranked(first, k).filter(F.col("rank") == k).select("group", "query", F.col("score").alias("floor"))
    known = (lead.groupBy("group", "query").agg(F.collect_list("block").alias("done")).join(floors, ["group", "query"], "left")
             .groupBy("group").agg(F.collect_list(F.struct("query", F.coalesce("floor", F.lit(LOWEST)).alias("floor"), "done")).alias("known")))
    rest = met(groups.join(known, "group")).select("group", "values", "known", "blocks", "highs", "lows").mapInArrow(
        open_blocks(width), f"group long, super long, wanted {WANTED}")
    second = score_pairs(rest, supers, groups, width, k)
    return ranked(first.unionByName(second), k).select("query_id", "rank", "vec_id", "score")


def bounds_of(batch: pa.RecordBatch, i: int, width: int) -> np.ndarray:
    """The largest score that each query of a group can have in each block."""
    asked, high, low = (rows_of(batch[c][i], width) for c in ("values", "highs", "lows"))
    # A positive weight meets the largest value of a term, a negative one the smallest.
    return (product(np.maximum(asked, 0), high) + product(np.minimum(asked, 0), low)).astype(np.int64)


def best_blocks(width: int, leads: int):
    """Rows of a group with block summaries to the blocks with the largest bounds of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bound, numbers = bounds_of(batch, i, width), batch["blocks"][i].values.to_numpy()
                by_number = np.argsort(numbers)
                numbers, bound = numbers[by_number], bound[:, by_number]
                order = np.argsort(-bound, axis=1, kind="stable")[:, :leads]
                query = np.repeat(np.arange(len(bound), dtype=np.int32), order.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(query), batch["group"][i].as_py())), pa.array(query), pa.array(numbers[order].ravel()),
                     pa.array(np.take_along_axis(bound, order, axis=1).ravel())], ["group", "query", "block", "bound"])
    return run


def open_blocks(width: int):
    """Rows of a group with block summaries to the blocks, by superblock, that reach the floor of a
    query and were not scored yet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bound, numbers = bounds_of(batch, i, width), batch["blocks"][i].values.to_numpy()
                known = batch["known"][i].values
                query = known.field("query").to_numpy()
                floor = np.full(len(bound), LOWEST)
                floor[query] = known.field("floor").to_numpy()
                wanted = bound >= floor[:, None]
                lists = known.field("done")
                row, done = np.repeat(query, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
                by_number = np.argsort(numbers)
                column = by_number[np.searchsorted(numbers, done, sorter=by_number).clip(max=len(numbers) - 1)]
                here = numbers[column] == done
                wanted[row[here], column[here]] = False
                q, b = np.nonzero(wanted)
                over = numbers[b] >> SUPER
                order = np.argsort(over, kind="stable")
                q, b, over = q[order], b[order], over[order]
                supers, starts = np.unique(over, return_index=True)
                cells = pa.StructArray.from_arrays(
                    [pa.array(q.astype(np.int32)), pa.array(numbers[b]), pa.array(bound[q, b]), pa.array(floor[q])], ["query", "block", "bound", "floor"])
                offsets = pa.array(np.append(starts, len(q)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(supers), batch["group"][i].as_py())), pa.array(supers), pa.ListArray.from_arrays(offsets, cells)],
                    ["group", "super", "wanted"])
    return run


def ranked(scores: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("group", "query").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def first_k(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, sorted, with their places."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < k
    return query[kept], ids[kept], scores[kept], place[kept]


def score_pairs(wanted: DataFrame, supers: DataFrame, groups: DataFrame, width: int, k: int) -> DataFrame:
    """group, query, query_id, vec_id, score of the k best of each query in a superblock.

    Each query takes its blocks (group, super, wanted) in the order of their bounds, and stops at
    the first that is below its floor, which rises from block to block.  The queries of a group
    that take the same block at once meet it in one product.
    """
    joined = wanted.join(groups.select("group", F.col("ids").alias("query_ids"), F.col("values").alias("queries")), "group").join(supers, "super")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch["members"][i].values
                place = {number: at for at, number in enumerate(members.field("block").to_pylist())}
                pairs = batch["wanted"][i].values
                at, number, bound, floor = (pairs.field(c).to_numpy() for c in ("query", "block", "bound", "floor"))
                order = np.lexsort((number, -bound, at))
                at, number, bound, floor = at[order], number[order], bound[order], floor[order]
                step = np.arange(len(at)) - np.searchsorted(at, at)
                query_ids, queries = batch["query_ids"][i].values.to_numpy(), rows_of(batch["queries"][i], width)
                floors = np.full(len(query_ids), LOWEST)
                floors[at] = floor
                found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                for turn in range(int(step.max(initial=-1)) + 1):
                    rows = np.flatnonzero((step == turn) & (bound >= floors[at]))
                    if not len(rows):
                        break  # bounds fall and floors rise, so no query has an open block left
                    parts = [found]
                    for block in np.unique(number[rows]).tolist():
                        who = at[rows[number[rows] == block]]
                        ids = members.field("ids")[place[block]].values.to_numpy()
                        scores = product(queries[who], np.frombuffer(members.field("forward")[place[block]].as_py(), "<i8").reshape(-1, width))
                        q, d = np.nonzero((query_ids[who][:, None] != ids[None, :]) & (scores >= floors[who][:, None]))
                        parts.append((who[q], ids[d], scores[q, d].astype(np.int64)))
                    *found, rank = first_k(*(np.concatenate(column) for column in zip(*parts)), k)
                    last = rank == k - 1
                    floors[found[0][last]] = np.maximum(floors[found[0][last]], found[2][last])
                query, ids, scores = found
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(query), batch["group"][i].as_py())), pa.array(query.astype(np.int32)), pa.array(query_ids[query]),
                     pa.array(ids), pa.array(scores)], ["group", "query", "query_id", "vec_id", "score"])

    return joined.select("group", "wanted", "query_ids", "queries", "members").mapInArrow(
        run, "group long, query int, query_id long, vec_id long, score long")
