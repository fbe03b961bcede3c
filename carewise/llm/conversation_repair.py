"""Conversations brought into the form system?, (user, assistant)+ by the cheapest edits.

Rows lie in one global order, by conversation and turn, and are cut into blocks of a bounded number
of positions, so that a conversation with very many rows (or all rows without an id) is spread over
many tasks. A search sees one letter per row, never a text. The few conversations that cross a block's
end are composed from their blocks: costs between states add up like a product of matrices.

Costs: keeping a row 0, giving it the role user or assistant 2, deleting it 3, inserting a row with
empty text 2; a truncated row that stays adds 1. Blank rows and repeated ones have to go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carewise.session import broadcast_if_small, stored

BLANKS = " \t\n\x0b\f\r"
BLOCK_BITS = 14
RIGHT_PAIRS = ("su", "ua", "au")

# States: nothing yet, after the system row, after a user row, after an assistant row.
STATES = range(4)
NEXT = (2, 2, 3, 2)  # where the missing role leads
ROLE = {2: "user", 3: "assistant"}
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
# What is missing after the last row, by state: cost, audit.
CLOSING = (0, 4, 2, 0)
TAIL = ("", "II", "I", "")
NEVER = 1 << 60
GONE = "X"


def damage(turns: DataFrame) -> DataFrame:
    """The rows after the damage that their ids decide; nulls of role and text become one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.filter("kind <> 0").withColumn("copy", F.explode(copies))
    return kept.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


# ------------------------------------------------------------ search

def bounds(rows: str, end: tuple) -> list[tuple]:
    """For every place and state the least cost from there on, given the costs at the end."""
    least = [end] * (len(rows) + 1)
    after = end
    for i in range(len(rows) - 1, -1, -1):
        row = rows[i]
        base = [after[s] + DELETE for s in STATES]
        if row != GONE:
            initial, extra = row.lower(), TRUNCATED if row.isupper() else 0
            for s in STATES:
                base[s] = min(base[s], after[NEXT[s]] + REROLE + extra)
                kept = KEPT.get((initial, s))
                if kept is not None:
                    base[s] = min(base[s], after[kept] + extra)
        user, assistant = min(base[2], base[3] + INSERT), min(base[3], base[2] + INSERT)
        after = least[i] = (min(base[0], user + INSERT), min(base[1], user + INSERT), user, assistant)
    return least


def edits(row: str, state: int) -> list[tuple[str, str, int, int, int]]:
    """(initial, mark, cost, rows used, next state) of the edits at a row, by initial.

    Marks: x goes, u and a are put in, . stays, U and A get that role.
    """
    role = ROLE[NEXT[state]][0]
    found = [("D", "x", DELETE, 1, state), ("I", role, INSERT, 0, NEXT[state])]
    if row != GONE:
        extra = TRUNCATED if row.isupper() else 0
        kept = KEPT.get((row.lower(), state))
        if kept is not None:
            found.append(("K", ".", extra, 1, kept))
        found.append(("R", role.upper(), REROLE + extra, 1, NEXT[state]))
    return found


def search(rows: str, least: list[tuple], state: int = 0) -> tuple[str, str, int]:
    """The cheapest edits' initials, the ASCII-least of them, their marks, and the state after the last row.

    Depth-first branch and bound on an explicit stack. Children are taken by their initial, so a
    prefix that reaches a node later at the same cost is a worse one, which the table of costs per
    node shows. The incumbent starts with the cost that the suffix bounds prove and no audit;
    as soon as an audit has that cost, what is left on the stack can't be better and is dropped.
    """
    cost, audit, marks, last = least[0][state], None, "", state
    trail: list[tuple[int, str, str]] = []
    table: dict[tuple[int, int], int] = {}
    stack = [(0, state, 0, -1)]
    while stack:
        i, s, g, step = stack.pop()
        bound = g + least[i][s]
        if bound > cost or (audit is not None and bound == cost) or table.get((i, s), NEVER) <= g:
            continue
        table[i, s] = g
        if i == len(rows):
            found = []
            while step >= 0:
                step, letter, mark = trail[step]
                found.append((letter, mark))
            audit, marks, last = "".join(f[0] for f in reversed(found)), "".join(f[1] for f in reversed(found)), s
            continue
        for letter, mark, price, used, then in reversed(edits(rows[i], s)):
            trail.append((step, letter, mark))
            stack.append((i + used, then, g + price, len(trail) - 1))
    return audit or "", marks, last


def row_marks(audit: str, marks: str) -> list[str]:
    """The marks cut after every edit that uses a row; what is put in at the end goes with the last row."""
    cut, now = [], ""
    for letter, mark in zip(audit, marks):
        now += mark
        if letter != "I":
            cut.append(now)
            now = ""
    if now:
        cut[-1] += now
    return cut


def closed(rows: str, least: list[tuple], state: int, is_last: bool) -> tuple[int, str, list[str], int]:
    """Cost, audit and marks per row of a block that is entered in ``state``, and the state after it."""
    audit, marks, after = search(rows, least, state)
    cost = least[0][state] - (least[-1][after] if not is_last else 0)
    if is_last:
        tail = TAIL[after]
        marks += {"": "", "I": "a", "II": "ua"}[tail]
        audit += tail
    return cost, audit, row_marks(audit, marks), after


def costs_through(rows: str) -> list[int]:
    """The least cost from each state before a block to each state after it, row by row."""
    columns = [bounds(rows, tuple(0 if s == out else NEVER for s in STATES))[0] for out in STATES]
    return [min(columns[out][s], NEVER) for s in STATES for out in STATES]


def costs_before(matrix: list[int], end: tuple) -> tuple:
    return tuple(min(matrix[4 * s + out] + end[out] for out in STATES) for s in STATES)


def broken_pairs(initials: str) -> int:
    return sum(initials[i : i + 2] not in RIGHT_PAIRS for i in range(len(initials) - 1))


# ------------------------------------------------------------ on tables

SOLVED = "conv_key string, block long, cost long, audit string, marks array<string>, first_pos long"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the costs at their end, entered in a given state."""
    for batch in batches:
        out = []
        for key, block, letters, end, state, is_last, first in zip(*(batch.column(c).to_pylist() for c in ("conv_key", "block", "letters", "end", "state", "is_last", "first_pos"))):
            cost, audit, marks, _ = closed(letters, bounds(letters, tuple(end)), state, is_last)
            out.append((key, block, cost, audit, marks, first))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64()]
        columns = list(zip(*out)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_key", "block", "cost", "audit", "marks", "first_pos"])


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        matrices = [costs_through(x) for x in batch.column("letters").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_key"), batch.column("block"), pa.array(matrices, pa.list_(pa.int64()))], ["conv_key", "block", "matrix"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs at the end of each block, from the last one backwards."""
    for batch in batches:
        keys, blocks, ends, lasts = [], [], [], []
        for key, chain in zip(batch.column("conv_key").to_pylist(), batch.column("chain").to_pylist()):
            end = CLOSING
            for link in reversed(chain):
                keys.append(key)
                blocks.append(link["block"])
                ends.append(list(end))
                lasts.append(link is chain[-1])
                end = costs_before(link["matrix"], end)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(blocks, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())],
            ["conv_key", "block", "end", "is_last"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where a block leads to from every state that it may be entered in."""
    for batch in batches:
        found = []
        for letters, end, is_last in zip(*(batch.column(c).to_pylist() for c in ("letters", "end", "is_last"))):
            least = bounds(letters, tuple(end))
            found.append([closed(letters, least, s, is_last)[3] for s in STATES])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_key"), batch.column("block"), pa.array(found, pa.list_(pa.int32()))], ["conv_key", "block", "exits"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, chain in zip(batch.column("conv_key").to_pylist(), batch.column("chain").to_pylist()):
            state = 0
            for link in chain:
                rows.append((key, link["block"], state))
                state = link["exits"][state]
        keys, blocks, states = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(blocks, pa.int64()), pa.array(states, pa.int32())], ["conv_key", "block", "state"])


def _chained(blocks: DataFrame, column: str) -> DataFrame:
    """One row per conversation of several blocks; a chain has one entry per block."""
    return blocks.groupBy("conv_key").agg(F.sort_array(F.collect_list(F.struct("block", column))).alias("chain"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, which lie together and in order."""
    key, state = None, None
    for batch in batches:
        done = []
        for own, line in zip(batch.column("conv_key").to_pylist(), batch.column("line").to_pylist()):
            if own != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(line.encode())
        yield _two(done)
    if key is not None:
        yield _two([(key, state.hexdigest())])


def _two(rows: list[tuple]) -> pa.RecordBatch:
    keys, digests = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(digests, pa.string())], ["conv_key", "repaired_sha256"])


class Repair:
    """The repair of all conversations of a table (conv_id, turn, role, text).

    ``summary()`` has one row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit. ``rows()`` are the repaired rows (conv_id, place, role, text), ``digests()`` their
    SHA-256 per conversation. Rows are taken by turn (null first), then role and text. A null id
    is a conversation of its own; null roles and texts are empty. A role that begins neither
    with s, u nor a can't stay. Repeated rows are duplicates. An empty table gives no rows; other
    columns are not looked at.
    """

    def __init__(self, turns: DataFrame, block_bits: int = BLOCK_BITS):
        key = F.concat(F.when(F.col("conv_id").isNull(), "-").otherwise("+"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
        plain = turns.select(
            key.alias("conv_key"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        ordered = plain.repartitionByRange("conv_key", "turn", "role", "text").sortWithinPartitions("conv_key", "turn", "role", "text")
        self.turns = stored(ordered.withColumn("pos", F.monotonically_increasing_id()), "turns")
        self.facts = stored(self._judged(block_bits), "facts")
        self.blocks = stored(self._blocks(), "blocks")
        self.solved = stored(self._solve(), "solved")

    def _judged(self, block_bits: int) -> DataFrame:
        """Per row: its block, first fault, role's initial and letter, without text."""
        trimmed = F.btrim("text", F.lit(BLANKS))
        rows = self.turns.select(
            "conv_key", "turn", "pos", F.shiftright("pos", block_bits).alias("block"), "role", F.substring("role", 1, 1).alias("initial"),
            F.sha2("text", 256).alias("digest"), F.substring(trimmed, -1, 1).alias("end"))
        same = ["conv_key", "role", "digest"]
        first = rows.groupBy(*same).agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        seen, _ = broadcast_if_small(stored(first, "repeated-rows"))
        fault = (
            F.when(F.col("end") == "", "blank")
            .when(F.col("pos") > F.col("first"), "duplicate")
            .when(~F.col("end").isin(".", "!", "?"), "truncated")
        )
        known = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
        letter = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper("known")).otherwise(F.col("known"))
        judged = rows.join(seen, same, "left").select("conv_key", "turn", "pos", "block", fault.alias("fault"), known.alias("known"))
        return judged.select("conv_key", "turn", "pos", "block", "fault", "known", letter.alias("letter"))

    def _blocks(self) -> DataFrame:
        """The letters and initials of each conversation, block by block."""
        listed = F.sort_array(F.collect_list(F.struct("pos", "letter", "known")))
        grouped = self.facts.groupBy("conv_key", "block").agg(listed.alias("rows"))
        order = W.partitionBy("conv_key").orderBy("block")
        return grouped.select(
            "conv_key", "block", F.col("rows")[0]["pos"].alias("first_pos"),
            F.array_join("rows.letter", "").alias("letters"), F.array_join("rows.known", "").alias("initials"),
        ).withColumns({
            "n_blocks": F.count(F.lit(1)).over(W.partitionBy("conv_key")),
            "before": F.lag(F.substring("initials", -1, 1), 1, "").over(order),
        })

    def _solve(self) -> DataFrame:
        closing = F.lit(list(CLOSING)).cast("array<long>")
        whole = self.blocks.filter("n_blocks = 1").select(
            "conv_key", "block", "letters", "first_pos", closing.alias("end"), F.lit(0).alias("state"), F.lit(True).alias("is_last"))
        parts = self.blocks.filter("n_blocks > 1").select("conv_key", "block", "letters", "first_pos")
        through = parts.select("conv_key", "block", "letters").mapInArrow(_through, "conv_key string, block long, matrix array<long>")
        ends = _chained(through, "matrix").mapInArrow(_ends, "conv_key string, block long, end array<long>, is_last boolean")
        bounded = stored(parts.join(ends, ["conv_key", "block"]), "parts")
        exits = bounded.mapInArrow(_exits, "conv_key string, block long, exits array<int>")
        entries = _chained(exits, "exits").mapInArrow(_entries, "conv_key string, block long, state int")
        entered = bounded.join(entries, ["conv_key", "block"]).select(*whole.columns)
        return whole.unionByName(entered).mapInArrow(_solved, SOLVED)

    def summary(self) -> DataFrame:
        ids = self.turns.select("conv_key", "conv_id").distinct()
        wide = "decimal(20,0)"
        faults = self.facts.groupBy("conv_key").agg(
            *[F.count(F.when(F.col("fault") == kind, 1)).alias(kind) for kind in ("blank", "duplicate", "truncated")],
            F.min("turn").cast(wide).alias("low"), F.max("turn").cast(wide).alias("high"), F.count_distinct("turn").alias("turns"))
        gaps = F.coalesce((F.col("high") - F.col("low") + 1 - F.col("turns")).cast("long"), F.lit(0).cast("long"))
        pairs = self.blocks.select(
            "conv_key", F.concat("before", "initials").alias("initials")).mapInArrow(_broken, "conv_key string, illegal long")
        broken = pairs.groupBy("conv_key").agg(F.sum("illegal").alias("illegal"))
        audits = self.solved.groupBy("conv_key").agg(
            F.sum("cost").alias("cost"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
        found = ids.join(faults, "conv_key").join(broken, "conv_key").join(audits, "conv_key")
        return found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "conv_key")

    def rows(self) -> DataFrame:
        marked = self.solved.select(F.posexplode("marks").alias("i", "marks"), "first_pos").select((F.col("first_pos") + F.col("i")).alias("pos"), "marks")
        each = self.turns.join(marked, "pos").select(
            "conv_key", "conv_id", "pos", "role", "text", F.posexplode(F.split("marks", "")).alias("place", "mark"))
        mark = F.col("mark")
        role = F.when(mark.isin("u", "U"), "user").when(mark.isin("a", "A"), "assistant").otherwise(F.col("role"))
        text = F.when(mark.isin("u", "a"), "").otherwise(F.col("text"))
        return each.filter(~mark.isin("x", "")).select("conv_key", "conv_id", "pos", "place", role.alias("role"), text.alias("text"))

    def digests(self) -> DataFrame:
        """SHA-256 of the lines role:text. A task streams through its conversations and holds one hash."""
        lines = self.rows().select("conv_key", "pos", "place", F.concat("role", F.lit(":"), "text").alias("line"))
        lying = lines.repartition("conv_key").sortWithinPartitions("conv_key", "pos", "place")
        return lying.select("conv_key", "line").mapInArrow(_digests, "conv_key string, repaired_sha256 string")


def _broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [broken_pairs(x) for x in batch.column("initials").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_key"), pa.array(counts, pa.int64())], ["conv_key", "illegal"])


def repair_digest(turns: DataFrame, block_bits: int = BLOCK_BITS) -> DataFrame:
    """Damages the rows, repairs what is left, and returns one row per conversation of ``turns``.

    A conversation that loses all its rows has zeros, an empty audit and the hash of nothing.
    """
    repair = Repair(damage(turns), block_bits)
    everyone = turns.select("conv_id").distinct()
    found = repair.summary().join(repair.digests(), "conv_key", "left").withColumnRenamed("conv_id", "id_").drop("conv_key")
    zero = F.lit(0).cast("long")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return everyone.join(found, F.col("conv_id").eqNullSafe(F.col("id_")), "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
