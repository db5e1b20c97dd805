"""Repair of conversation structure by a parallel Viterbi search for the cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from io import StringIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from junctura.llm.shared import stage

# Rows of a conversation that are searched as one piece.
CHUNK = 4096
# The costs of the edits, and of a truncated row that stays; the roles made.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
COSTS = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}
FILLERS = {"u": "user", "a": "assistant"}
# Pairs of initials that may stand side by side.
LEGAL = ("su", "ua", "au")

# States of the grammar (s?(ua)+)?: nothing yet, after a system row, a user row is open, closed.
EMPTY, SYSTEM, OPEN, CLOSED = range(4)
# Where a row of each initial leads.
STEP = {
    "s": {EMPTY: SYSTEM},
    "u": {EMPTY: OPEN, SYSTEM: OPEN, CLOSED: OPEN},
    "a": {OPEN: CLOSED},
}
# What a rerole or an insertion makes in each state.
MADE = {EMPTY: "u", SYSTEM: "u", OPEN: "a", CLOSED: "u"}

# A row's symbol: its initial's place here, plus 4 if it is truncated. DOOMED rows must go.
INITIALS = "sua"
OTHER, DOOMED = 3, 8

Costs = tuple[int, int, int, int]
# Bits that each cost of a class takes in its number; costs above the least are at most 4.
BITS = 4


def _with_insertions(costs: list[int]) -> list[int]:
    """Costs to go from each state, if turns may be inserted first."""
    costs = list(costs)
    for _ in range(2):
        for state in range(4):
            costs[state] = min(costs[state], INSERT + costs[STEP[MADE[state]][state]])
    return costs


def _moves(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """The edits of a row: letter, cost, next state; insertions aside."""
    moves = [("D", DELETE, state)]
    if symbol == DOOMED:
        return moves
    extra = TRUNCATED if symbol >= 4 else 0
    initial = INITIALS[symbol % 4] if symbol % 4 < OTHER else None
    if initial and state in STEP[initial]:
        moves.append(("K", extra, STEP[initial][state]))
    moves.append(("R", REROLE + extra, STEP[MADE[state]][state]))
    return moves


def step_back(symbol: int, costs: Costs) -> Costs:
    """Costs to go before a row, from those behind it."""
    return tuple(
        _with_insertions([min(cost + costs[to] for _, cost, to in _moves(symbol, state)) for state in range(4)])
    )


def number_of(costs: Costs) -> tuple[int, int]:
    """The class of a cost vector, which vectors share that differ by a constant, and its least cost."""
    least = min(costs)
    return sum((c - least) << BITS * i for i, c in enumerate(costs)), least


def vector_of(number: int) -> Costs:
    """The vector of a class whose least cost is nothing."""
    return tuple(number >> BITS * i & (1 << BITS) - 1 for i in range(4))


#: Costs to go at the end of a conversation: a legal one is done, others need insertions.
FINAL = tuple(_with_insertions([0, 1 << 9, 1 << 9, 0]))
FINAL_CLASS = number_of(FINAL)[0]


class Table:
    """What symbols make of classes, worked out as it is needed; there are a few dozen classes."""

    def __init__(self) -> None:
        self._before: dict[tuple[int, int], int] = {}
        self._ahead: dict[tuple[int, int, int], tuple[str, int]] = {}

    def before(self, symbol: int, behind: int) -> int:
        """The class before a row of the class behind it."""
        if symbol == DOOMED:
            return behind
        key = symbol, behind
        if key not in self._before:
            self._before[key] = number_of(step_back(symbol, vector_of(behind)))[0]
        return self._before[key]

    def least_edits(self, symbol: int, behind: int, state: int) -> tuple[str, int]:
        """The ASCII-least of the cheapest edits up to and with a row, and the state behind it."""
        key = symbol, behind, state
        if key not in self._ahead:
            after = vector_of(behind)
            here = step_back(symbol, after)
            letters, at = "", state
            while letters[-1:] in ("", "I"):
                made = STEP[MADE[at]][at]
                moves = [*_moves(symbol, at), ("I", INSERT, made)]
                costs = {x: cost + (here if x == "I" else after)[to] for x, cost, to in moves}
                letter = min(x for x, cost in costs.items() if cost == here[at])
                letters, at = letters + letter, next(to for x, _, to in moves if x == letter)
            self._ahead[key] = letters, at
        return self._ahead[key]


def sweep(table: Table, symbols: bytes, behind: int, known: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """The class behind each row of a chunk from the last row on, and the class before the first.

    ``known`` is what an earlier pass found. As soon as the vectors of both passes differ by a constant
    only, they do so for all rows before as well, and the rest is taken over.
    """
    found = np.zeros(len(symbols), np.uint16)
    for i in range(len(symbols) - 1, -1, -1):
        if known is not None and known[i] == behind:
            found[: i + 1] = known[: i + 1]
            return found, table.before(symbols[0], int(found[0]))
        found[i] = behind
        behind = table.before(symbols[i], behind)
    return found, behind


def final_edits(state: int) -> str:
    """The insertions that end a conversation in ``state``."""
    letters = ""
    while FINAL[state]:
        letters, state = letters + "I", STEP[MADE[state]][state]
    return letters


def _edits(table: Table, symbols: bytes, found: np.ndarray, state: int) -> tuple[list[list[tuple[str, str]]], int]:
    """The edits (letter, role made or empty) of each row of a chunk, and the state behind the last."""
    rows = []
    for symbol, behind in zip(symbols, found.tolist(), strict=True):
        letters, end = table.least_edits(symbol, behind, state)
        own = []
        for letter in letters[:-1]:
            own.append((letter, FILLERS[MADE[state]]))
            state = STEP[MADE[state]][state]
        own.append((letters[-1], FILLERS[MADE[state]] if letters[-1] == "R" else ""))
        rows.append(own)
        state = end
    return rows, state


def _distinct_rows(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, blank, truncated, copies, doomed): equal rows of a turn as one.

    A row is doomed if it is blank or if its role and text stand at an earlier turn; so are all but the
    first of its copies.
    """
    trimmed = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    known = rows.select(
        "conv",
        "turn",
        "role",
        F.sha2("text", 256).alias("digest"),
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    keys = ["conv", "turn", "role", "digest", "blank", "truncated"]
    known = stage(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")), "turns")
    # Structs compare nulls as equal.
    said = F.struct("conv", "role", "digest").alias("said")
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    firsts = known.filter("NOT blank").groupBy(said).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stage(firsts.filter("n > 1").select("said", "first"), "firsts")
    repeated = F.coalesce(F.col("first") != place, F.lit(False))
    return known.join(firsts, said == firsts.said, "left").select(
        *keys, "copies", (F.col("blank") | repeated).alias("doomed")
    )


def _chunks(rows: DataFrame, size: int) -> DataFrame:
    """Chunks of at most ``size`` distinct rows of a conversation, numbered in order.

    conv, chunk, symbols (a byte a row), illegal (pairs within), first and last (initials), keys (turn,
    role, digest and copies of each row). Rows are sorted over range partitions, so that one conversation
    spreads over as many as it needs.
    """
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    initial = F.substring("role", 1, 1)
    place = F.when(F.length(initial) == 0, 0).otherwise(F.instr(F.lit(INITIALS), initial))
    place = F.when(place == 0, OTHER).otherwise(place - 1)
    symbol = F.when(F.col("doomed"), DOOMED).otherwise(place + 4 * F.col("truncated").cast("int"))
    rows = stage(rows.select("conv", "turn", "role", "digest", "copies", symbol.cast("int").alias("symbol")), "symbols")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kind, turn_kind = (rows.schema[c].dataType.simpleString() for c in ("conv", "turn"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own, types = TaskContext.get().partitionId() << 40, [], None

        def chunk() -> pa.RecordBatch:
            nonlocal number
            conv, turns, roles, digests, copies, symbols = zip(*own, strict=True)
            initials = [r[:1] for r in roles]
            pairs = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
            pairs += sum(copies) - len(copies)
            keys = pa.StructArray.from_arrays(
                [pa.array(turns, types[1]), pa.array(roles), pa.array(digests), pa.array(copies, pa.int64())],
                ["turn", "role", "digest", "copies"],
            )
            arrays = [
                pa.array(conv[:1], types[0]),
                pa.array([number], pa.int64()),
                pa.array([bytes(symbols)], pa.binary()),
                pa.array([pairs], pa.int64()),
                pa.array(initials[:1]),
                pa.array(initials[-1:]),
                pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), keys),
            ]
            number += 1
            own.clear()
            return pa.RecordBatch.from_arrays(arrays, ["conv", "chunk", "symbols", "illegal", "first", "last", "keys"])

        def joined(chunks: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if chunks:
                yield from pa.Table.from_batches(chunks).combine_chunks().to_batches()

        for batch in batches:
            types, done = [batch.column(0).type, batch.column(1).type], []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own and (own[0][0] != row[0] or len(own) == size):
                    done.append(chunk())
                own.append(row)
            yield from joined(done)
        if own:
            yield chunk()

    keys = f"array<struct<turn: {turn_kind}, role: string, digest: string, copies: bigint>>"
    schema = f"conv {kind}, chunk bigint, symbols binary, illegal bigint, first string, last string, keys {keys}"
    return ordered.mapInArrow(work, schema)


def _by_conversation(chunks: DataFrame, *columns: str, falling: bool = False) -> DataFrame:
    """The columns of each chunk, a conversation's in order and in one task: a narrow row a chunk."""
    chunk = F.col("chunk").desc() if falling else F.col("chunk")
    return chunks.select(*columns).repartition("conv").sortWithinPartitions("conv", chunk)


def _speculate(chunks: DataFrame, wanted: list[int]) -> DataFrame:
    """(conv, chunk, symbols, first, last, found, behind, before) with a sweep from each wanted class.

    ``found`` holds the classes of the first sweep; ``before`` has the class that a chunk makes of each
    class in ``behind``. Classes that a chunk has already are not run again.
    """
    fresh = "found" not in chunks.columns
    if fresh:
        none = F.array().cast("array<int>")
        chunks = chunks.select(
            "conv", "chunk", "symbols", "first", "last",
            F.lit(None).cast("binary").alias("found"), none.alias("behind"), none.alias("before"),
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        for batch in batches:
            founds, behinds, befores = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("symbols", "found", "behind", "before"))
            for symbols, found, behind, before in zip(*columns, strict=True):
                base = None if found is None else np.frombuffer(found, np.uint16)
                for number in wanted:
                    if number not in behind:
                        run, left = sweep(table, symbols, number, base)
                        base = run if base is None else base
                        behind.append(number)
                        before.append(left)
                founds.append(base.tobytes())
                behinds.append(behind)
                befores.append(before)
            arrays = [pa.array(founds, pa.binary()), *(pa.array(x, pa.list_(pa.int32())) for x in (behinds, befores))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *arrays], batch.schema.names)

    return stage(chunks.mapInArrow(work, chunks.schema), "sweeps")


def _stitch(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, behind, enter, joint) of the chunks of conversations that have more than one.

    ``behind`` is the class of the costs behind a chunk, ``enter`` the state in which the least edits
    come to it, and ``joint`` is 1 if the pair across its start is illegal. All chunks start from the
    final vector. Fix-up passes then run the classes that have come up at a boundary, each as far as its
    vectors differ by more than a constant from those of the first sweep. The passes end when no new
    class comes up: there are 16 classes, so at most as many passes, whatever the number of chunks, also
    where vectors never converge (a run of one role alternates between two). The chunks' small tables
    are then followed from the last chunk to the first, and the states forward.
    """
    kind = chunks.schema["conv"].dataType.simpleString()
    swept, known, met = chunks, set(), {FINAL_CLASS}
    while met - known:
        known |= met
        swept = _speculate(swept, sorted(known))
        met |= {r[0] for r in swept.select(F.explode("before")).distinct().collect()}

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number = None, FINAL_CLASS
        for batch in batches:
            own = []
            for now, _, behind, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                number = number if conv == (now,) else FINAL_CLASS
                conv = (now,)
                own.append(number)
                number = before[behind.index(number)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(own, pa.int32())], ["conv", "chunk", "number"])

    falling = _by_conversation(swept, "conv", "chunk", "behind", "before", falling=True)
    numbers = stage(falling.mapInArrow(back, f"conv {kind}, chunk bigint, number int"), "classes")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        for batch in batches:
            exits = []
            for symbols, found, number in zip(*(batch.column(c).to_pylist() for c in ("symbols", "found", "number")), strict=True):
                run, _ = sweep(table, symbols, number, np.frombuffer(found, np.uint16))
                exits.append([_leave(table, symbols, run, state) for state in range(4)])
            arrays = [batch.column(c) for c in ("conv", "chunk", "number", "first", "last")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(exits, pa.list_(pa.int32()))], [*names, "exits"])

    names = ["conv", "chunk", "number", "first", "last"]
    left = swept.join(numbers.drop("conv"), "chunk")
    schema = f"conv {kind}, chunk bigint, number int, first string, last string, exits array<int>"
    left = stage(left.mapInArrow(leave, schema), "exits")

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, before = None, EMPTY, ""
        for batch in batches:
            enter, joint = [], []
            for now, _, _, first, last, exits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                same = conv == (now,)
                state = state if same else EMPTY
                enter.append(state)
                joint.append(int(same and before + first not in LEGAL))
                conv, state, before = (now,), exits[state], last
            arrays = [*batch.columns[:3], pa.array(enter, pa.int32()), pa.array(joint, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv", "chunk", "behind", "enter", "joint"])

    rising = _by_conversation(left, *names, "exits")
    return stage(
        rising.mapInArrow(ahead, f"conv {kind}, chunk bigint, behind int, enter int, joint bigint"), "stitched"
    )


def _leave(table: Table, symbols: bytes, found: np.ndarray, state: int) -> int:
    """The state in which the least edits leave a chunk that they enter in ``state``."""
    for symbol, behind in zip(symbols, found.tolist(), strict=True):
        if symbol != DOOMED:
            state = table.least_edits(symbol, behind, state)[1]
    return state


def _located(chunks: DataFrame) -> DataFrame:
    """``chunks`` with behind, enter, joint, and whether a chunk is its conversation's last."""
    own = F.struct("conv").alias("own")
    ends = chunks.groupBy(own).agg(F.max("chunk").alias("end"), F.count(F.lit(1)).alias("n"))
    ends = stage(ends.filter("n > 1"), "long")
    split = chunks.join(ends.select("own"), F.struct("conv") == F.col("own"), "left_semi")
    stitched = _stitch(split) if ends.head(1) else None
    if stitched is None:
        return chunks.withColumns(
            {"behind": F.lit(FINAL_CLASS), "enter": F.lit(EMPTY), "joint": F.lit(0), "ends": F.lit(True)}
        )
    final = ends.select(F.col("end").alias("chunk"), F.lit(True).alias("end"))
    found = stage(stitched.drop("conv").join(final, "chunk", "left"), "located")
    return chunks.join(found.withColumnRenamed("end", "ends_split"), "chunk", "left").select(
        *chunks.columns,
        F.coalesce("behind", F.lit(FINAL_CLASS)).alias("behind"),
        F.coalesce("enter", F.lit(EMPTY)).alias("enter"),
        F.coalesce("joint", F.lit(0)).alias("joint"),
        (F.col("behind").isNull() | F.coalesce("ends_split", F.lit(False))).alias("ends"),
    )


def _traced(located: DataFrame) -> DataFrame:
    """A row per edit: conv, chunk, place, edit, role, cost, had (turn, role, digest of the row it is for)."""
    kind = located.schema["conv"].dataType.simpleString()
    had = located.schema["keys"].dataType.elementType["turn"].dataType.simpleString()
    names = ["conv", "chunk", "place", "edit", "role", "cost", "had"]
    rows = located.select("conv", "chunk", "symbols", "keys", "behind", "enter", "ends")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        for batch in batches:
            turn_type = batch.column(3).type.value_type.field("turn").type
            had_type = pa.struct([("turn", turn_type), ("role", pa.string()), ("digest", pa.string())])
            for row in range(batch.num_rows):
                symbols, keys, behind, state, ends = (batch.column(i)[row].as_py() for i in range(2, 7))
                found, _ = sweep(table, symbols, behind)
                edits, state = _edits(table, symbols, found, state)
                letters, roles, costs, of = [], [], [], []
                for symbol, key, own in zip(symbols, keys, edits, strict=True):
                    copies, kept = key.pop("copies"), {x: key[x] for x in ("turn", "role", "digest")}
                    for letter, role in own:
                        letters.append(letter)
                        roles.append(role or kept["role"])
                        stays = letter in "KR" and 4 <= symbol < DOOMED
                        costs.append(COSTS[letter] + (TRUNCATED if stays else 0))
                        of.append(None if letter == "I" else kept)
                    letters += "D" * (copies - 1)
                    roles += [kept["role"]] * (copies - 1)
                    costs += [DELETE] * (copies - 1)
                    of += [kept] * (copies - 1)
                for letter in final_edits(state) if ends else "":
                    letters.append(letter)
                    roles.append(FILLERS[MADE[state]])
                    costs.append(INSERT)
                    of.append(None)
                    state = STEP[MADE[state]][state]
                same = pa.array([row] * len(letters), pa.int64())
                arrays = [
                    batch.column(0).take(same),
                    batch.column(1).take(same),
                    pa.array(np.arange(len(letters), dtype=np.int64)),
                    pa.array(letters, pa.string()),
                    pa.array(roles, pa.string()),
                    pa.array(costs, pa.int64()),
                    pa.array(of, had_type),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = (
        f"conv {kind}, chunk bigint, place bigint, edit string, role string, cost bigint, "
        f"had struct<turn: {had}, role: string, digest: string>"
    )
    return rows.mapInArrow(work, schema)


def _plain_rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(
        F.col(f"`{conv}`").alias("conv"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"),
    )


def repair_turns(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    size: int = CHUNK,
) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits that give each conversation roles by (s?(ua)+)?, and its faults.

    The first table has a row per edit: conv, chunk, place (both in order), edit (K, R, D or I), turn and
    role and text as repaired (text null where the row goes), cost. Without the edits D it is the
    repaired conversation. Of equally cheap edits those are taken whose letters are least in ASCII order.
    The second has a row per conversation: conv, gaps, blank, duplicate, truncated, illegal.

    A conversation's rows go by turn (nulls first), those of a turn by role and the text's SHA-256. It is
    cut into chunks of ``size`` distinct rows, over as many tasks as it needs, and chunks are searched at
    the same time (see ``_stitch``). A null role or text is one space, so a null text is blank; null
    conversation ids are a conversation of their own; an empty table gives no rows; other columns are
    ignored. Only digests of texts are sorted; texts are fetched for the rows that stay.
    """
    rows = _plain_rows(conversations, conv, turn, role, text)
    known = stage(_distinct_rows(rows), "distinct")
    located = stage(_located(stage(_chunks(known, size), "chunks")), "located")
    edits = stage(_traced(located), "edits")
    # A text for each row that stays; equal rows of a turn have the same one.
    row = F.struct("conv", "turn", "role", F.sha2("text", 256).alias("digest")).alias("own")
    texts = rows.select(row, "text").groupBy("own").agg(F.first("text").alias("text"))
    stays = F.col("edit").isin("K", "R")
    own = F.struct("conv", "had.turn", F.col("had.role").alias("role"), F.col("had.digest").alias("digest"))
    columns = ["conv", "chunk", "place", "edit", F.col("had.turn").alias("turn"), "role", "cost"]
    kept = edits.filter(stays).withColumn("wanted", own).join(texts, F.col("wanted") == F.col("own"))
    filler = F.when(F.col("edit") == "I", F.lit("")).alias("text")
    edited = kept.select(*columns, "text").unionByName(edits.filter(~stays).select(*columns, filler))

    copies = F.when(F.col("doomed"), F.col("copies")).otherwise(F.col("copies") - 1)
    single = known.groupBy(F.struct("conv", "turn").alias("at")).agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(copies)).alias("duplicate"),
        F.sum((F.col("truncated") & ~F.col("doomed")).cast("long")).alias("truncated"),
    )
    turns = F.max("at.turn") - F.min("at.turn") + 1 - F.count("at.turn")
    faults = single.groupBy(F.struct("at.conv").alias("own")).agg(
        F.coalesce(turns.cast("long"), F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    pairs = located.groupBy(F.struct("conv").alias("own")).agg(
        F.sum(F.col("illegal") + F.col("joint")).alias("illegal")
    )
    return edited, faults.join(pairs, "own").select(
        F.col("own.conv").alias("conv"), "gaps", "blank", "duplicate", "truncated", "illegal"
    )


def edit_digests(edited: DataFrame) -> DataFrame:
    """One row per conversation of ``repair_turns``: conv, cost, audit, repaired_sha256.

    ``audit`` is the edits' letters in order, ``repaired_sha256`` the digest of the repaired rows as
    role:text, joined by line breaks. A digest over an ordered text can't be split: a conversation's rows
    are sorted on disk if need be and stream through one task, which holds the letters, the digest and a
    batch of rows.
    """
    rows = edited.select("conv", "chunk", "place", "edit", "role", "text", "cost")
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "chunk", "place")
    kind = rows.schema["conv"].dataType.simpleString()
    names = ["conv", "cost", "audit", "repaired_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key_type = None, pa.int64()

        def rows_of(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 4
            types = [key_type, pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        def row() -> tuple:
            conv, cost, letters, digest, _ = now
            return conv, cost, letters.getvalue(), digest.hexdigest()

        for batch in batches:
            key_type, done = batch.column(0).type, []
            columns = [batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6)]
            for conv, edit, role, text, cost in zip(*columns, strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(row())
                    now = [conv, 0, StringIO(), hashlib.sha256(), b""]
                now[1] += cost
                now[2].write(edit)
                if edit != "D":
                    now[3].update(now[4] + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    now[4] = b"\n"
            if done:
                yield rows_of(done)
        if now is not None:
            yield rows_of([row()])

    return ordered.mapInArrow(work, f"conv {kind}, cost bigint, audit string, repaired_sha256 string")


def audit_turns(
    conversations: DataFrame,
    everyone: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    size: int = CHUNK,
) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, as of ``repair_turns``.

    One row per conversation of ``everyone``; one that has no rows in ``conversations`` gets zeros, an
    empty audit and the digest of an empty text.
    """
    edited, faults = repair_turns(conversations, conv, turn, role, text, size)
    digests = edit_digests(edited)
    own = everyone.select(F.struct(F.col(f"`{conv}`").alias("conv")).alias("own")).distinct()
    faults = faults.withColumn("of", F.struct("conv")).drop("conv")
    digests = digests.withColumn("by", F.struct("conv")).drop("conv")
    joined = own.join(faults, F.col("own") == F.col("of"), "left").join(digests, F.col("own") == F.col("by"), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        F.col("own.conv").alias(conv),
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def damage_turns(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """conv, turn, role and text with a twentieth of the rows each dropped, emptied, stripped of sentence
    ends, repeated, and made the user's, by the CRC-32 of conv:turn.

    Nulls are one space, in the key of the CRC as well; conv and turn themselves stay null.
    """
    rows = _plain_rows(conversations, conv, turn, role, text)
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20).filter("harm <> 0")
    harmed: Column = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", ""))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return rows.select(
        F.col("conv").alias(conv),
        F.col("turn").alias(turn),
        F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias(role),
        harmed.otherwise(F.col("text")).alias(text),
        copies.alias("_copy"),
    ).drop("_copy")
