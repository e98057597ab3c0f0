"""SimHash near-dedup by anchor points of a covering code (operator 5).

The 64 bits of a fingerprint are three segments: two of 23 bits and one of 18.  Two
fingerprints that differ in at most T bits differ little in at least one segment: the
segments' thresholds are chosen so that their sum plus two is T, and a pair can exceed all
of them only with more than T differing bits.

The anchors of a 23-bit segment are the 4,096 words of the binary Golay code, whose covering
radius is 3: every word has a home anchor within 3 bits.  The 18-bit segment uses the code of
all words, with radius 0, or the 2,048 words of the Hamming code over 15 of its bits, with
radius 1, if it has to allow differing bits.  A fingerprint goes to every anchor within covering radius plus
threshold of its segment, so it meets each fingerprint that it may link to at the other's
home anchor, where whole fingerprints are compared.

Copies collapse to one fingerprint first.  An anchor with very many fingerprints is split
into blocks, and blocks are compared pairwise in separate tasks.  A task returns a spanning
forest of the links it finds, not every pair.  Components come from star contraction over
the distributed links.

Null and empty texts have fingerprint zero and link like any other.  Rows with a null doc_id
get a fingerprint and a group but no component_id.  Rows that share a doc_id are all returned,
told apart by ``version`` (a hash of the text); the component of each is that of its own
fingerprint.  An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neartag.llm.common import batches_by_group, slices, with_version
from neartag.plans.staging import Staging

SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit and width
BLOCK = 1 << 16  # fingerprints of an anchor that one task compares


# --- fingerprints ------------------------------------------------------------------------

def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words (fewer words: of all), A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in shingles), np.uint64, max(1, len(words) - size + 1))


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits as a signed number; a bit is set if more than half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[low:low + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, version and fp (longs) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [fingerprint(shingle_hashes(t.as_py() or "", shingle)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["version"], pa.array(made, pa.int64())], ["doc_id", "version", "fp"])

    return with_version(docs).mapInArrow(run, "doc_id long, version long, fp long")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- anchors -----------------------------------------------------------------------------

def thresholds(distance: int) -> list[int]:
    """Per segment the differing bits it has to allow; -1 leaves the segment out."""
    if distance < 2:
        return [0 if i <= distance else -1 for i in range(3)]
    last = (distance - 2) // 3
    return [(distance - 1 - last) // 2, (distance - 2 - last) // 2, last]


@dataclass(frozen=True)
class Code:
    """A perfect cyclic code: every word of ``width`` bits is within ``radius`` of one code word."""

    width: int
    generator: int  # a polynomial
    radius: int

    @property
    def checks(self) -> int:
        return self.generator.bit_length() - 1

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        """Remainder modulo the generator polynomial."""
        rest = words.copy()
        for bit in range(self.width - 1, self.checks - 1, -1):
            rest = np.where(rest >> bit & 1, rest ^ (self.generator << (bit - self.checks)), rest)
        return rest


GOLAY = Code(23, 0xC75, 3)
HAMMING = Code(15, 0x13, 1)


@lru_cache(maxsize=16)
def code_lists(code: Code, allow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per syndrome: the coset leader, and the bounds and list of the code words that lie
    within radius + ``allow`` of it."""
    messages = np.arange(1 << (code.width - code.checks), dtype=np.int64) << code.checks
    words = messages | code.syndrome(messages)
    errors = np.array([sum(1 << b for b in bits) for n in range(code.radius + 1) for bits in combinations(range(code.width), n)], np.int64)
    leaders = np.zeros(1 << code.checks, np.int64)
    leaders[code.syndrome(errors)] = errors
    inside = np.bitwise_count(words[None, :] ^ leaders[:, None]) <= code.radius + allow
    return leaders, np.concatenate(([0], np.cumsum(inside.sum(axis=1)))), words[np.nonzero(inside)[1]]


def anchors(fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per segment: rows, anchor keys, and whether the anchor is the row's home."""
    rows = np.arange(len(fps))
    bits = fps.view(np.uint64)
    for number, ((first, width), allow) in enumerate(zip(SEGMENTS, thresholds(distance))):
        if allow < 0:
            continue
        code = GOLAY if width == GOLAY.width else HAMMING
        own = width if allow == 0 and code is HAMMING else code.width
        part = ((bits >> np.uint64(first)) & np.uint64((1 << own) - 1)).astype(np.int64)
        base = number << 24
        if own != code.width:  # the code of all words
            yield rows, base | part, np.ones(len(fps), bool)
            continue
        leaders, bounds, members = code_lists(code, allow)
        rest = code.syndrome(part)
        counts = bounds[rest + 1] - bounds[rest]
        row = np.repeat(rows, counts)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        home = (part ^ leaders[rest])[row]
        word = home ^ members[bounds[rest][row] + offset]
        yield row, base | (word >> code.checks), word == home


def at_anchors(distinct: DataFrame, distance: int) -> DataFrame:
    """key, home, fp: a row per fingerprint and anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):  # bounds what is replicated at once
                part = batch.slice(low, 256)
                for rows, keys, home in anchors(part["fp"].to_numpy(), distance):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.astype(np.int32)), pa.array(home), part["fp"].take(pa.array(rows))], ["key", "home", "fp"])

    return distinct.select("fp").mapInArrow(run, "key int, home boolean, fp long")


def in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Add low and high: the pair of blocks to compare; a row of block b goes to every pair with b.

    There are at most 2 ** 18 + 2 * 2 ** 12 keys, so the list of the heavy ones is small
    whatever the number of rows.
    """
    heavy = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter(F.col("blocks") > 1)
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    spread = rows.join(F.broadcast(heavy), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
        .withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("blocks", "other")


def links_in_group(group: dict[str, np.ndarray], distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between homes and other members of one group.

    A link that joins two trees already joined is not returned, so a dense group gives no
    more links than it has members.
    """
    found = []
    fp, own = group["fp"], group["own"]
    tree = np.arange(len(fp))
    bits = fp.view(np.uint64)
    apart = group["low"][0] != group["high"][0]
    for x in np.flatnonzero(group["home"]).tolist():
        near = (np.bitwise_count(bits ^ bits[x]) <= distance) & (tree != tree[x])
        if apart:
            near &= own != own[x]
        at = np.flatnonzero(near)
        if len(at):
            trees, first = np.unique(tree[at], return_index=True)
            found += [(int(fp[x]), int(fp[y])) for y in at[first]]
            tree[np.isin(tree, trees)] = tree[x]
    return found


def links(distinct: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """u, v: links between distinct fingerprints (fp).

    Every component of the full link graph is a component of the links returned.
    """
    group = ["key", "low", "high"]
    columns = [*group, "fp", "home", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in batches_by_group(batches, group):
            arrays = {c: table[c].to_numpy() for c in columns}
            found = []
            for a, b in bounds:
                if b - a > 1:
                    found += links_in_group({k: c[a:b] for k, c in arrays.items()}, distance)
            ends = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], ["u", "v"])

    rows = in_blocks(at_anchors(distinct, distance), block)
    ordered = rows.repartition(*group).sortWithinPartitions(*group)
    return ordered.mapInArrow(run, "u long, v long").filter("u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


# --- components --------------------------------------------------------------------------

def components(edges: DataFrame, staging: Staging) -> DataFrame:
    """node, root: the smallest node each linked node reaches, by alternating star contraction.

    ``edges`` has u < v.  Each round is staged; rounds grow with the logarithm of the size.
    """
    edges = staging.write(edges, "star-0")
    number = 0
    while True:
        number += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").filter("u <> v").distinct()
        # Now every v > u; each v keeps its smallest u and hands the others to it.
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v").select(F.inline(F.array(
            F.struct(F.col("m").alias("u"), F.col("v").alias("v")),
            F.struct(F.col("m").alias("u"), F.col("u").alias("v"))))).filter("u <> v").distinct()
        after = staging.write(small, f"star-{number}")
        # Done when it is a forest of stars: no v is also a u, and each v has one u.
        wrong = after.select("v").intersect(after.select(F.col("u").alias("v")))
        twice = after.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select("v")
        edges = after
        if wrong.unionByName(twice).isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, staging: Staging, shingle: int = 4, distance: int = 4) -> DataFrame:
    """doc_id, version, fp, group, component_id of every row of documents.

    Fingerprints link at ``distance`` or fewer differing bits.  ``group`` is the smallest
    fingerprint of the component, ``component_id`` the smallest doc_id in it.
    """
    rows = staging.write(fingerprints(docs, shingle), "fingerprints")
    firsts = staging.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    stars = components(links(firsts.select("fp"), distance), staging)
    rooted = firsts.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("group").agg(F.min("first").alias("component_id"))
    named = staging.write(rooted.join(smallest, "group").select("fp", "group", "component_id"), "components")
    return rows.join(named, "fp").select(
        "doc_id", "version", "fp", "group", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(found: DataFrame) -> DataFrame:
    """doc_id, version of the row that stays of each group: the smallest doc_id, null last, then version."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("least")
    return found.groupBy("group").agg(least).select("least.doc_id", "least.version")
