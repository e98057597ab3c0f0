"""Sharding by a k-d tree over document metadata (operator 10), with DataFrame functions only.

The tree splits all documents into shards of nearly equal bytes.  A node with m shards to
make splits its documents at a weighted median (m // 2 shards to the left) along its widest
dimension, until a node is one shard of the target size.  Medians are found for all nodes of
a level at once: bytes are summed by slices of the coordinate, the slice that holds the cut
is sliced again, and so on until what is left of it is less than a small part of a shard or
a single document.  Sums are combined before the shuffle, so a value that a third of
all documents share costs a row per task.

A coordinate is a dimension, then a hash of the text, then the doc_id.  Equal texts so lie
next to each other and in one shard, unless a cut has to go through their group to keep the
sizes near equal; a group larger than a shard is split.

Dimensions are scaled to 0..2 ** 31 - 1 over the whole table.  A null dimension counts as the
smallest value, null texts have only the fixed bytes, null ids come first.  Repeated rows are
rows of their own.  Empty tables give empty results; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from neartag.plans.staging import Staging

OVERHEAD = 8  # bytes a document takes besides its text
SLICES = 4096
TOLERANCE = 0.001  # of a shard: what a cut may be off
SCALE = (1 << 31) - 1


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the columns of the tree: text hash and dimensions d0, d1, d2.

    The dimensions are properties of the text: the logarithm of its bytes, its bytes per character
    and its share of white space, so that copies have equal ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bytes_ = F.octet_length(text).cast("bigint")
    chars = F.length(text)
    spaces = chars - F.length(F.translate(text, " \n\t", ""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (bytes_ + OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 32).alias("text_hash"), F.log1p(bytes_).alias("d0"),
        F.when(chars > 0, bytes_ / chars).otherwise(F.lit(1.0)).alias("d1"),
        F.when(chars > 0, spaces / chars).otherwise(F.lit(0.0)).alias("d2"))


def scaled(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Dimensions as whole numbers from 0 to 2 ** 31 - 1."""
    ends = rows.agg(*[f(d).alias(f"{n}_{d}") for d in dimensions for n, f in (("lo", F.min), ("hi", F.max))]).first().asDict()

    def scale(d: str) -> Column:
        low, high = ends[f"lo_{d}"], ends[f"hi_{d}"]
        if low is None or high == low:
            return F.lit(0).cast("bigint")
        return F.coalesce(F.floor((F.col(d) - low) * (SCALE / (high - low))), F.lit(0)).cast("bigint")

    return rows.select(*[c for c in rows.columns if c not in dimensions], *[scale(d).alias(d) for d in dimensions])


def small_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A few rows as a table of literals; ``columns`` is a DDL schema."""
    fields = [c.strip().split(" ", 1) for c in columns.split("; ")]
    cells = ", ".join("(" + ", ".join("NULL" if v is None else str(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    return spark.sql(f"SELECT * FROM VALUES {cells} AS t({names})").select(*[F.col(n).cast(t).alias(n) for n, t in fields])


def chosen(dimensions: list[str]) -> Column:
    """The value of a row in the dimension its node splits along."""
    out = F.col(dimensions[0])
    for i, d in enumerate(dimensions[1:], 1):
        out = F.when(F.col("axis") == i, F.col(d)).otherwise(out)
    return out


def id_place() -> Column:
    """The doc_id moved up so that negative ids have a place in order, after null at 0."""
    return F.coalesce(F.col("doc_id").cast("decimal(20,0)") + F.expr("CAST('9223372036854775809' AS DECIMAL(20,0))"),
                      F.lit(0)).cast("decimal(20,0)")


def cuts_of_level(rows: DataFrame, nodes: list[tuple[int, int]], dimensions: list[str], slack: float) -> dict[int, tuple[int, int, int]]:
    """Per node: axis, and the first coordinate (position, id) right of the cut.

    ``rows`` has node, size, text_hash, doc_id and the dimensions; ``nodes`` are those to
    split, with the number of shards each makes.  At most SLICES numbers per node are kept.
    """
    spark = rows.sparkSession
    wanted = dict(nodes)
    # A side of the split with n of m shards gets n / m of the bytes.
    stats = rows.filter(F.col("node").isin(list(wanted))).groupBy("node").agg(
        F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(f"w{i}") for i, d in enumerate(dimensions)]).collect()
    state = {}
    for r in stats:
        widths = [r[f"w{i}"] for i in range(len(dimensions))]
        left = wanted[r.node] // 2
        state[r.node] = {"axis": widths.index(max(widths)), "goal": r.bytes * left / wanted[r.node], "before": 0,
                         "low": 0, "width": 1 << 63, "key": None, "done": False}
    for node, m in nodes:
        state.setdefault(node, {"axis": 0, "done": True, "cut": (0, 0)})
    # First by position (dimension and text hash, 63 bits), then by doc_id inside one position.
    while any(not s["done"] for s in state.values()):
        asked = [(n, s["axis"], s["key"], s["low"], max(1, s["width"] // SLICES)) for n, s in state.items() if not s["done"]]
        frame = small_table(spark, "node long; axis int; key decimal(20,0); low decimal(20,0); step decimal(20,0)", asked)
        joined = rows.join(F.broadcast(frame), "node")
        position = chosen(dimensions) * (1 << 32) + F.col("text_hash")
        by_id = id_place()
        place = F.when(F.col("key").isNull(), position.cast("decimal(20,0)")).when(position == F.col("key").cast("bigint"), by_id)
        slices = joined.select("node", "size", F.floor((place - F.col("low")) / F.col("step")).cast("bigint").alias("slice")) \
            .filter(F.col("slice").between(0, 2 * SLICES)).groupBy("node", "slice").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
        order = Window.partitionBy("node").orderBy("slice")
        reach = slices.withColumn("upto", F.sum("bytes").over(order))
        goals = small_table(spark, "node long; goal double", [(n, float(s["goal"] - s["before"])) for n, s in state.items() if not s["done"]])
        hit = (reach.join(F.broadcast(goals), "node").filter(F.col("upto") >= F.col("goal"))
               .groupBy("node").agg(F.min(F.struct("slice", "bytes", "n", "upto")).alias("s")).select("node", "s.*").collect())
        for r in hit:
            s = state[r.node]
            step = max(1, s["width"] // SLICES)
            start = s["low"] + r.slice * step
            over = s["before"] + r.upto - s["goal"]
            under = s["goal"] - (s["before"] + r.upto - r.bytes)
            if min(over, under) <= slack or r.n == 1 or (step == 1 and s["key"] is not None):
                # The cut goes to the nearer end of the slice.
                edge = start + step if over <= under else start
                s["cut"] = (edge, 0) if s["key"] is None else (s["key"], edge)
                s["done"] = True
            elif step == 1:
                s |= {"key": start, "low": 0, "width": 1 << 64, "before": s["before"] + r.upto - r.bytes}
            else:
                s |= {"low": start, "width": step, "before": s["before"] + r.upto - r.bytes}
        lacking = {n for n, s in state.items() if not s["done"]} - {r.node for r in hit}
        for n in lacking:  # rounding left the goal beyond the last row
            state[n] |= {"cut": (1 << 63, 0), "done": True}
    return {n: (s["axis"], *s["cut"]) for n, s in state.items()}


def kd_shards(rows: DataFrame, shards: int, dimensions: list[str], staging: Staging, tolerance: float = TOLERANCE) -> DataFrame:
    """``rows`` (doc_id, size, text_hash, dimensions and others) with the column shard.

    The tree has at most shards - 1 cuts, which the driver holds; a level costs a few passes
    over the narrow rows, and the texts are not touched again.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / max(1, shards)
    # node -> (first shard, number of shards); a node is named by its first shard.
    nodes = {0: shards}
    placed = rows.withColumn("node", F.lit(0).cast("bigint"))
    level = 0
    while any(m > 1 for m in nodes.values()):
        level += 1
        split = [(n, m) for n, m in nodes.items() if m > 1]
        cuts = cuts_of_level(placed, split, dimensions, slack)
        frame = small_table(rows.sparkSession, "node long; axis int; key decimal(20,0); cut_id decimal(20,0); right long",
                            [(n, axis, key, doc_id, n + nodes[n] // 2) for n, (axis, key, doc_id) in cuts.items()])
        position = (chosen(dimensions) * (1 << 32) + F.col("text_hash")).cast("decimal(20,0)")
        by_id = id_place()
        beyond = (position > F.col("key")) | ((position == F.col("key")) & (by_id >= F.col("cut_id")))
        placed = placed.join(F.broadcast(frame), "node", "left").withColumn(
            "node", F.when(F.col("right").isNotNull() & beyond, F.col("right")).otherwise(F.col("node"))).select(placed.columns)
        placed = staging.write(placed, f"level-{level}")
        nodes = {k: v for n, m in nodes.items() for k, v in (((n, m // 2), (n + m // 2, m - m // 2)) if m > 1 else ((n, m),))}
    return placed.withColumnRenamed("node", "shard")


def with_slots(rows: DataFrame, staging: Staging) -> DataFrame:
    """Add slot: the place of a row in its shard, from 0 without gaps, in order of doc_id.

    Rows are range-partitioned by shard and id, so a shard may lie in several tasks; a row's
    slot is its place in the task plus what earlier tasks hold of the shard.
    """
    inside = F.lit((1 << 33) - 1)
    ordered = rows.repartitionByRange("shard", "doc_id", "text_crc32").sortWithinPartitions("shard", "doc_id", "text_crc32")
    marked = staging.write(ordered.withColumn("mark", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("mark", 33))
    # One row per task and shard.
    counts = marked.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("mark").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    slot = F.col("mark").bitwiseAND(inside) - F.col("first").bitwiseAND(inside) + F.col("offset")
    return marked.join(offsets, ["shard", "part"]).withColumn("slot", slot).drop("mark", "part", "first", "offset")


def shard_documents(docs: DataFrame, shards: int, staging: Staging) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of documents (doc_id, text)."""
    dimensions = ["d0", "d1", "d2"]
    rows = staging.write(scaled(staging.write(sized(docs), "sized"), dimensions), "scaled")
    placed = kd_shards(rows, shards, dimensions, staging).select(
        "doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"))
    return with_slots(placed, staging)
