"""Repair of conversation structure by bidirectional Dijkstra (operator 12).

The turns of a conversation are its rows (conv_id, turn, role, text) in order of turn, null
first; rows of one turn lie in order of a hash of role and text, equal rows side by side.  Null
roles and texts count as one space.  A conversation of null conv_id is one like any other.

A row has at most one fault: ``blank`` (no character but white space), else ``duplicate`` (role
and text stood in an earlier row), else ``truncated`` (the last character that is no white space
is none of ``.!?``).  Edits make the initials of the roles read ``(s?(ua)+)?``:

    K  keep a row, cost 0          R  give it the role user or assistant, cost 3
    D  delete it, cost 4           I  insert an empty text of user or assistant, cost 3

Blank and duplicate rows have to go; a truncated row that stays adds 3.  The edit lattice has a
node per number of rows read and state of that pattern.  Two heaps search it, from the start and
from the accepting end.  They stop once no path as cheap as the best one can be left, so every
crossing of equal cost is finished, and the least audit (the letters in order) of them is taken.
Cost and audit of a prefix follow from its letters alone, so of two prefixes as cheap to one node
neither continues the other, and the least one stays the least whatever follows.

Turns are range-partitioned and sorted, and cut into chunks of at most ``CHUNK_ROWS`` rows.  A
conversation that is one chunk inside its partition is repaired there.  The others, however
long, are put together from chunks: their duplicates come from a grouping by digest, each chunk is searched between all pairs of states in parallel, and one pass over the
chunks of a conversation picks the states at their borders.  It holds about ten bytes a row;
the audit, which is one value, takes one of them.  Texts do not pass through it.

An empty table gives an empty result.  Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neartag.plans.staging import Staging

CHUNK_ROWS = 64
CHUNK_CHARS = 1 << 16
BATCH_CHARS = 1 << 22
WHITE = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
# States of the pattern: nothing yet, s read, u read, a read.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = ("u", "u", "a", "u")  # what may be inserted or renamed to in a state
BEFORE = tuple([(s, i) for s in range(4) for i, t in STEP[s].items() if t == state] for state in range(4))
ACCEPTING = (0, 3)
LEGAL = {"su", "ua", "au"}


# --- the lattice of one chunk ------------------------------------------------------------

def symbol(initial: str, fault: str) -> str:
    """A row as a letter: its initial (x: no valid one), a capital if truncated, ``-`` if it has to go."""
    if fault in ("blank", "duplicate"):
        return "-"
    initial = initial if initial in ("s", "u", "a") else "x"
    return initial.upper() if fault == "truncated" else initial


def row_edits(letter: str, state: int) -> list[tuple[int, int, str]]:
    """cost, new state and edit of every way to deal with a row in a state."""
    edits = [(4, state, "D")]
    if letter != "-":
        extra, initial = 3 * letter.isupper(), letter.lower()
        if initial in STEP[state]:
            edits.append((extra, STEP[state][initial], "K"))
        edits.append((3 + extra, STEP[state][NEXT[state]], "R"))
    return edits


# Edits by letter: from a state onward, and into a state from the states before it.
ONWARD = {letter: [row_edits(letter, s) for s in range(4)] for letter in "suaxSUAX-"}
BACKWARD = {letter: [[(c, s, e) for s in range(4) for c, t, e in ways[s] if t == state] for state in range(4)]
            for letter, ways in ONWARD.items()}
INSERTED_FROM = tuple([s for s, initial in BEFORE[state] if initial == NEXT[s]] for state in range(4))


def cheapest(rows: str, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest edits of ``rows`` from a state to one of the goals.

    Heaps are ordered by cost and progress, as only keeping is free and it reads a row: a node
    has its least audit when it is taken.
    """
    n = len(rows)
    labels = ({(0, start): (0, "")}, {(n, goal): (0, "") for goal in goals})
    heaps = ([(0, 0, start)], [(0, 0, goal) for goal in goals])
    done: tuple[set, set] = (set(), set())
    best: tuple[int, str] | None = None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = int(heaps[1][0][0] < heaps[0][0][0])
        _, progress, state = heapq.heappop(heaps[side])
        at = n - progress if side else progress
        if (at, state) in done[side]:
            continue
        done[side].add((at, state))
        cost, audit = labels[side][at, state]
        if side:
            ways = [(c, at - 1, s, e) for c, s, e in BACKWARD[rows[at - 1]][state]] if at else []
            ways += [(3, at, s, "I") for s in INSERTED_FROM[state]]
        else:
            ways = [(c, at + 1, s, e) for c, s, e in ONWARD[rows[at]][state]] if at < n else []
            ways.append((3, at, STEP[state][NEXT[state]], "I"))
        for more, to, new, edit in ways:
            label = (cost + more, edit + audit if side else audit + edit)
            node = (to, new)
            if node not in labels[side] or label < labels[side][node]:
                labels[side][node] = label
                heapq.heappush(heaps[side], (label[0], n - to if side else to, new))
        # Where the searches meet: at the node itself or at one it has just reached.
        for node in [(at, state), *((to, new) for _, to, new, _ in ways)]:
            if node in labels[0] and node in labels[1]:
                (ahead, first), (behind, last) = labels[0][node], labels[1][node]
                if best is None or (ahead + behind, first + last) < best:
                    best = (ahead + behind, first + last)
    return best


@lru_cache(maxsize=100_000)
def remembered(rows: str) -> tuple[int, str]:
    return cheapest(rows, 0, ACCEPTING)


def repair_of(rows: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return remembered(rows) if len(rows) <= 24 else cheapest(rows, 0, ACCEPTING)


def joined(chunks: list[dict[tuple[int, int], tuple[int, str]]]) -> tuple[int, str]:
    """Cost and audit of a conversation from the cheapest edits of its chunks between states.

    Costs to the end come first.  Then only states on a cheapest path are followed; of their
    audits only those that continue each other can still be least, and what they share is put
    aside, so strings stay short.
    """
    to_end: list[dict[int, int]] = [dict.fromkeys(ACCEPTING, 0)]
    for matrix in reversed(chunks):
        costs: dict[int, int] = {}
        for (p, q), (cost, _) in matrix.items():
            if q in to_end[-1]:
                costs[p] = min(costs.get(p, 1 << 62), cost + to_end[-1][q])
        to_end.append(costs)
    to_end.reverse()
    total, shared = to_end[0][0], []
    ahead: dict[int, tuple[int, str]] = {0: (0, "")}
    for matrix, rest in zip(chunks, to_end[1:]):
        after: dict[int, tuple[int, str]] = {}
        for (p, q), (cost, audit) in matrix.items():
            if p in ahead and q in rest and ahead[p][0] + cost + rest[q] == total:
                label = (ahead[p][0] + cost, ahead[p][1] + audit)
                after[q] = min(after.get(q, label), label)
        least = min(audit for _, audit in after.values())
        ahead = {q: label for q, label in after.items() if label[1].startswith(least)}
        shared.append(least)
        ahead = {q: (cost, audit[len(least):]) for q, (cost, audit) in ahead.items()}
    return total, "".join(shared) + min(audit for _, audit in ahead.values())


def edited(roles: list[str], texts: list[str], audit: str, start: int, system: bool) -> list[dict]:
    """The repaired rows that an audit makes of a chunk; ``start`` rows of the conversation precede them.

    ``system`` tells whether the repaired conversation begins with s; then every role follows
    from the number of rows before it.
    """
    out, row = [], 0
    for edit in audit:
        name = NAMES["ua"[(start + len(out) - system) % 2]]
        if edit == "I":
            out.append({"role": name, "text": "", "edit": edit})
            continue
        if edit != "D":
            out.append({"role": roles[row] if edit == "K" else name, "text": texts[row], "edit": edit})
        row += 1
    return out


def begins_with_s(rows: str, audit: str) -> bool:
    """Whether the first row that an audit leaves is a kept one of initial s."""
    row = 0
    for edit in audit:
        if edit != "D":
            return edit == "K" and rows[row] in "sS"
        row += 1
    return False


# --- chunks ------------------------------------------------------------------------------

CHUNK = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("alone", pa.bool_()), ("rows", pa.string()), ("initials", pa.list_(pa.string())),
    ("min_turn", pa.int64()), ("max_turn", pa.int64()), ("n_turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("digests", pa.list_(pa.binary())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
CHUNK_SQL = ("conv_id long, part int, seq long, alone boolean, rows string, initials array<string>, min_turn long, max_turn long, n_turns long, "
             "blank long, duplicate long, digests array<binary>, roles array<string>, texts array<string>")
NO_TURN = object()


class Chunk:
    """Consecutive rows of one conversation."""

    def __init__(self) -> None:
        self.turns, self.roles, self.texts, self.chars = [], [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    def full(self) -> bool:
        return len(self.turns) >= CHUNK_ROWS or self.chars >= CHUNK_CHARS

    def row(self, conv_id: int | None, part: int, seq: int, alone: bool) -> dict:
        seen, digests, letters, counts = set(), [], [], {"blank": 0, "duplicate": 0}
        for role, text in zip(self.roles, self.texts):
            bare = text.strip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            # A digest of conversation, role and text for each row that is the first of its kind in the chunk.
            key = f"{conv_id}:{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")
            digests.append(None if alone or fault in counts else hashlib.blake2b(key, digest_size=16).digest())
            if fault in counts:
                counts[fault] += 1
            seen.add((role, text))
            letters.append(symbol(role[:1], fault))
        known = [t for t in self.turns if t is not None]
        return {"conv_id": conv_id, "part": part, "seq": seq, "alone": alone, "rows": "".join(letters),
                "initials": [r[:1] if r[:1] in ("s", "u", "a") else "" for r in self.roles],
                "min_turn": min(known, default=None), "max_turn": max(known, default=None), "n_turns": len(set(known)), **counts,
                "digests": digests, "roles": self.roles, "texts": self.texts}


def cut(turns: DataFrame, staging: Staging) -> DataFrame:
    """One row per chunk; (part, seq) names it and orders the chunks of a conversation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, chars = TaskContext.get().partitionId(), 0, [], 0
        current, chunk, alone = NO_TURN, Chunk(), False  # the first conversation may have begun elsewhere

        def close(whole: bool) -> None:
            nonlocal seq, chars, chunk
            if chunk.turns:
                held.append(chunk.row(current, part, seq, whole))
                seq, chars, chunk = seq + 1, chars + chunk.chars, Chunk()

        for batch in batches:
            for conv_id, turn, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if conv_id != current:
                    close(alone)
                    alone, current = current is not NO_TURN, conv_id
                elif chunk.full():
                    close(False)
                    alone = False
                chunk.add(turn, role, text)
            if chars > BATCH_CHARS or len(held) > 1000:
                yield pa.RecordBatch.from_pylist(held, CHUNK)
                held, chars = [], 0
        close(False)  # the last one may go on in the next partition
        if held:
            yield pa.RecordBatch.from_pylist(held, CHUNK)

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    # Only equal rows are told apart by the last key, so that a run of them can be split.
    rows = rows.withColumn("h", F.xxhash64("role", "text")).withColumn("m", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("conv_id", "turn", "h", "m").sortWithinPartitions("conv_id", "turn", "h", "role", "text")
    return staging.write(ordered.select("conv_id", "turn", "role", "text").mapInArrow(run, CHUNK_SQL), "chunks")


# --- repair ------------------------------------------------------------------------------

LINES = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))
REPORT = pa.struct([(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])
LINES_SQL = "array<struct<role:string,text:string,edit:string>>"
REPORT_SQL = "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint,illegal:bigint,cost:bigint,audit:string>"


def illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def gaps(low: int | None, high: int | None, distinct: int) -> int:
    return 0 if low is None else high - low + 1 - distinct


def truncated(rows: str) -> int:
    return sum(letter.isupper() for letter in rows)


def repair_alone(chunks: DataFrame) -> DataFrame:
    """Conversations that are one chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reports, lines = [], []
            for c in batch.to_pylist():
                cost, audit = repair_of(c["rows"])
                reports.append({"gaps": gaps(c["min_turn"], c["max_turn"], c["n_turns"]), "blank": c["blank"], "duplicate": c["duplicate"],
                                "truncated": truncated(c["rows"]), "illegal": illegal(c["initials"]), "cost": cost, "audit": audit})
                lines.append(edited(c["roles"], c["texts"], audit, 0, begins_with_s(c["rows"], audit)))
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["part"], batch["seq"], pa.array([0] * len(lines), pa.int64()), pa.array(lines, LINES), pa.array(reports, REPORT)],
                ["conv_id", "part", "seq", "start", "lines", "report"])

    return chunks.filter("alone").drop("alone", "digests").mapInArrow(
        run, f"conv_id long, part int, seq long, start long, lines {LINES_SQL}, report {REPORT_SQL}").withColumn("alone", F.lit(True))


def later_copies(chunks: DataFrame) -> DataFrame:
    """part, seq, positions: rows of open chunks whose role and text stood in an earlier chunk.

    A chunk names each text once, so copies are combined before anything meets by text.
    """
    named = chunks.select("part", "seq", F.posexplode("digests").alias("position", "digest")).filter("digest IS NOT NULL")
    first = named.groupBy("digest").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return named.join(first, "digest").filter(F.struct("part", "seq") > F.col("first")).groupBy("part", "seq").agg(
        F.collect_list("position").alias("positions"))


def open_repairs(chunks: DataFrame, staging: Staging) -> DataFrame:
    """part, seq, audit, start, system, report of every chunk of a conversation of several chunks."""
    narrow = chunks.drop("roles", "texts", "digests").join(later_copies(chunks), ["part", "seq"], "left")
    matrix = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, doubles, matrices = [], [], []
            for letters, positions, n in zip(batch["rows"].to_pylist(), batch["positions"].to_pylist(), batch["duplicate"].to_pylist()):
                late = set(positions or ())
                letters = "".join("-" if i in late else x for i, x in enumerate(letters))
                rows.append(letters)
                doubles.append(n + len(late))
                found = ((p, q, cheapest(letters, p, (q,))) for p in range(4) for q in range(4))
                matrices.append([{"p": p, "q": q, "cost": f[0], "audit": f[1]} for p, q, f in found if f is not None])
            columns = dict(zip(batch.schema.names, batch.columns)) | {
                "rows": pa.array(rows, pa.string()), "duplicate": pa.array(doubles, pa.int64()), "matrix": pa.array(matrices, matrix)}
            del columns["positions"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    kept = narrow.drop("alone")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("positions").schema)
    searched = kept.mapInArrow(search, f"{fields}, matrix array<struct<p:int,q:int,cost:bigint,audit:string>>")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> pa.RecordBatch:
            cost, audit = joined([{(m["p"], m["q"]): (m["cost"], m["audit"]) for m in c["matrix"]} for c in held])
            pieces = split_audit(audit, [len(c["rows"]) for c in held])
            starts, n = [], 0
            for piece in pieces:
                starts.append(n)
                n += len(piece) - piece.count("D")
            initials = [i for c in held for i in (c["initials"][0], c["initials"][-1])]
            turns = [(c["min_turn"], c["max_turn"]) for c in held if c["n_turns"]]
            # A turn that goes on in the next chunk counts once.
            distinct = sum(c["n_turns"] for c in held) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
            report = {"gaps": gaps(turns[0][0], turns[-1][1], distinct) if turns else 0, "blank": sum(c["blank"] for c in held),
                      "duplicate": sum(c["duplicate"] for c in held), "truncated": sum(truncated(c["rows"]) for c in held),
                      "illegal": sum(illegal(c["initials"]) for c in held) + sum(a + b not in LEGAL for a, b in zip(initials[1::2], initials[2::2])),
                      "cost": cost, "audit": audit}
            system = begins_with_s("".join(c["rows"] for c in held), audit)
            last = len(held) - 1
            return pa.RecordBatch.from_arrays(
                [pa.array([c["part"] for c in held], pa.int32()), pa.array([c["seq"] for c in held], pa.int64()), pa.array(pieces, pa.string()),
                 pa.array(starts, pa.int64()), pa.array([system] * len(held)), pa.array([report if i == last else None for i in range(len(held))], REPORT)],
                ["part", "seq", "piece", "start", "system", "report"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["conv_id"] != row["conv_id"]:
                    yield close()
                    held = []
                held.append(row)
        if held:
            yield close()

    ordered = searched.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    return staging.write(ordered.mapInArrow(fold, f"part int, seq long, piece string, start long, system boolean, report {REPORT_SQL}"), "open_repairs")


def split_audit(audit: str, sizes: list[int]) -> list[str]:
    """The part of an audit that each chunk of so many rows has; insertions go with the chunk before them."""
    pieces, at = [], 0
    for number, size in enumerate(sizes):
        start, left = at, size
        while at < len(audit) and (left or audit[at] == "I" or number == len(sizes) - 1):
            left -= audit[at] != "I"
            at += 1
        pieces.append(audit[start:at])
    return pieces


def repair(turns: DataFrame, staging: Staging) -> DataFrame:
    """conv_id, part, seq, alone, start, lines, report: the repaired conversations in pieces.

    ``lines`` are rows (role, text, edit) of the repaired conversation from number ``start`` on;
    pieces are in order of (part, seq).  ``report`` is in the last piece of a conversation: gaps
    (missing numbers between its turns), rows with each fault, illegal (adjacent initials that
    are none of su, ua, au), cost and audit.
    """
    chunks = cut(turns, staging)
    several = chunks.filter("NOT alone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [edited(c["roles"], c["texts"], c["piece"], c["start"], c["system"])
                     for c in batch.select(["roles", "texts", "piece", "start", "system"]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["conv_id"], batch["part"], batch["seq"], batch["start"], pa.array(lines, LINES), batch["report"]],
                ["conv_id", "part", "seq", "start", "lines", "report"])

    opened = several.select("conv_id", "part", "seq", "roles", "texts").join(open_repairs(several, staging), ["part", "seq"])
    pieces = opened.mapInArrow(run, f"conv_id long, part int, seq long, start long, lines {LINES_SQL}, report {REPORT_SQL}")
    return repair_alone(chunks).unionByName(pieces.withColumn("alone", F.lit(False)))


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """conv_id, number, role, text, edit: the rows of the repaired conversations."""
    rows = pieces.select("conv_id", "start", F.posexplode("lines").alias("place", "line"))
    return rows.select("conv_id", (F.col("start") + F.col("place")).alias("number"), "line.*")


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, the report, and repaired_sha256 of the repaired ``role:text`` rows, joined by line ends.

    The digest of a long conversation is one pass over its pieces in order, holding one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, empty = hashlib.sha256(), True
        for batch in batches:
            ids, reports, found = [], [], []
            for conv_id, joined_lines, n, report in zip(*(batch[c].to_pylist() for c in ("conv_id", "joined", "n", "report"))):
                if n:
                    state.update(("" if empty else "\n").encode() + joined_lines.encode("utf-8", "surrogatepass"))
                    empty = False
                if report is not None:
                    ids.append(conv_id)
                    reports.append(report)
                    found.append(state.hexdigest())
                    state, empty = hashlib.sha256(), True
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(reports, REPORT), pa.array(found, pa.string())],
                                             ["conv_id", "report", "repaired_sha256"])

    line: Column = F.array_join(F.transform("lines", lambda x: F.concat(x.role, F.lit(":"), x.text)), "\n")
    alone = pieces.filter("alone").select("conv_id", "report", F.sha2(line, 256).alias("repaired_sha256"))
    several = pieces.filter("NOT alone").select("conv_id", "part", "seq", line.alias("joined"), F.size("lines").alias("n"), "report") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").drop("part", "seq")
    found = alone.unionByName(several.mapInArrow(run, f"conv_id long, report {REPORT_SQL}, repaired_sha256 string"))
    return found.select("conv_id", "report.*", "repaired_sha256")


# --- damage ------------------------------------------------------------------------------

def damage(turns: DataFrame) -> DataFrame:
    """Rows damaged by crc32 of ``conv_id:turn`` modulo 20, nulls written as one space.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its
    role user; the rest stay.
    """
    def known(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    case = F.pmod(F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")), F.lit(20))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        known("role").alias("role"), known("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1))
    return rows.filter("case <> 0").select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(copies).alias("copy")).drop("copy")


def damage_and_repair(turns: DataFrame, staging: Staging) -> DataFrame:
    """conv_id, the report and repaired_sha256 of every conversation, repaired after ``damage``.

    A conversation that lost all rows has zeros, an empty audit and the digest of nothing.
    """
    found = digests(repair(damage(turns), staging)).withColumnRenamed("conv_id", "found_id")
    ids = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    rows = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
