"""Repair of damaged conversations: the cheapest edits that give well-formed turns.

Role initials of a repaired conversation are ``(s?(ua)+)?``. Four states tell what may follow:
nothing said yet, after system, after user, after assistant; the first and the last may end.
Edits of a row: Keep (0), Rerole to user or assistant (3), Delete (4; a blank or repeated row must
go); anywhere: Insert an empty user or assistant (3). A truncated row that stays adds 3. Which role
an Insert or Rerole gives follows from the state, so the initials of the edits tell everything.

The edits are found by divide and conquer in linear space. Costs from the start run forward and
costs to the end run backward, four numbers each, until they meet in the middle of the
conversation; both halves are solved alike. Beside its cost a forward state has the rank of its
audit among the four. Audits of equally many rows that end in a row's edit are never the start
of one another, so the least audit crosses the middle at the cheapest state of least rank. A step
on normalised costs has few outcomes, which are remembered.

Two shuffles. The first moves no text: faults are found in row order, and a conversation is a byte a row
while it is solved (and 16 bytes a row that tell repeated ones). The second brings texts and audits
together; a sorted partition is read as a stream, so no task holds a conversation's texts. One conversation is
read by one task, because its digest and its edits follow its order.

Defined results: null role and text count as one space; rows are ordered by turn (nulls first), rows of equal turn by
a digest of role and text; repeated rows are duplicates; a null conv_id is a conversation of its own; a role
is known by its first character; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rideledger.llm.cluster import ship

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
WHITE = " \t\n\x0b\x0c\r"
INITIALS = "sua"
OPEN, SYSTEM, USER, ASSISTANT = range(4)
#: State after each state's next role, by initial; and after a role that is given by an edit.
NEXT = {"s": {OPEN: SYSTEM}, "u": {OPEN: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
GIVEN = {OPEN: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = {OPEN: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: Kinds of rows: 0 to 3 system, user, assistant, other; 4 more if truncated; 8 must go.
LOST = 8
NEVER = 1 << 60

Steps = tuple[tuple[int, int, int, str], ...]
Vector = tuple[tuple[int, ...], tuple[int, ...]]


def _steps(kind: int) -> Steps:
    """(state, state after, cost, edits) of a row with the insertions before it; the cheapest and least edits of each."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state = start
        for inserts in range(4):
            paid, audit = INSERT * inserts, "I" * inserts
            ways = [(state, paid + DELETE, audit + "D")]
            if kind != LOST:
                added = TRUNCATED if kind & 4 else 0
                ways.append((GIVEN[state], paid + REROLE + added, audit + "R"))
                kept = NEXT.get(INITIALS[kind & 3 : (kind & 3) + 1], {}).get(state)
                if kept is not None:
                    ways.append((kept, paid + KEEP + added, audit + "K"))
            for after, cost, edits in ways:
                best[start, after] = min(best.get((start, after), (NEVER, "")), (cost, edits))
            state = GIVEN[state]
    return tuple((start, after, cost, edits) for (start, after), (cost, edits) in sorted(best.items()))


STEPS = tuple(_steps(kind) for kind in range(LOST + 1))
EDITS = tuple({(start, after): edits for start, after, _, edits in steps} for steps in STEPS)


def _scaled(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(cost - least if cost < NEVER else NEVER for cost in costs), least


@lru_cache(maxsize=1 << 16)
def _ahead(vector: Vector, kind: int) -> tuple[Vector, int]:
    """Costs and ranks of audits from the start, one row later; costs without their least, and that."""
    costs, ranks = vector
    found = [(NEVER, (0, ""))] * 4
    for start, after, cost, edits in STEPS[kind]:
        if costs[start] < NEVER:
            found[after] = min(found[after], (costs[start] + cost, (ranks[start], edits)))
    order = sorted({audit for cost, audit in found if cost < NEVER})
    scaled, least = _scaled([cost for cost, _ in found])
    return (scaled, tuple(order.index(audit) if cost < NEVER else 0 for cost, audit in found)), least


@lru_cache(maxsize=1 << 16)
def _back(costs: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """Costs to the end, one row earlier, without their least."""
    found = [NEVER] * 4
    for start, after, cost, _ in STEPS[kind]:
        found[start] = min(found[start], costs[after] + cost if costs[after] < NEVER else NEVER)
    return _scaled(found)[0]


def _only(state: int) -> tuple[int, ...]:
    return tuple(0 if other == state else NEVER for other in range(4))


def _forward(kinds: bytes, first: int, last: int, state: int) -> tuple[Vector, int]:
    vector, total = (_only(state), (0, 0, 0, 0)), 0
    for row in range(first, last):
        vector, least = _ahead(vector, kinds[row])
        total += least
    return vector, total


def _solved(kinds: bytes, first: int, last: int, start: int, end: int, audit: list[str]) -> None:
    if last - first == 1:
        audit.append(EDITS[kinds[first]][start, end])
        return
    middle = (first + last) // 2
    costs, ranks = _forward(kinds, first, middle, start)[0]
    rest = _only(end)
    for row in range(last - 1, middle - 1, -1):
        rest = _back(rest, kinds[row])
    crossing = min(range(4), key=lambda state: (costs[state] + rest[state], ranks[state]))
    _solved(kinds, first, middle, start, crossing, audit)
    _solved(kinds, middle, last, crossing, end, audit)


def cheapest(kinds: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits, the ASCII-least audit of equals, for the kinds of rows in order."""
    if not kinds:
        return 0, ""
    (costs, ranks), total = _forward(kinds, 0, len(kinds), OPEN)
    end = min(range(4), key=lambda state: (costs[state] + ENDS[state][0], ranks[state]))
    audit: list[str] = []
    _solved(kinds, 0, len(kinds), OPEN, end, audit)
    return total + costs[end] + ENDS[end][0], "".join(audit) + ENDS[end][1]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and whether the row is there, after damage by a checksum of conv_id and turn."""
    spoken = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("conv_id", "turn", "role", "text")]
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), spoken[2].alias("role"), spoken[3].alias("text"),
        F.pmod(F.crc32(F.concat(spoken[0], F.lit(":"), spoken[1])), F.lit(20)).alias("damage"),
    )
    harmed = rows.select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("damage") != 0).alias("there"),
        F.explode(F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("copy"),
    )
    return harmed.drop("copy")


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def _known(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there and digest of rows; a table without ``there`` has all its rows."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in ("role", "text"))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
        (F.col("there") if "there" in rows.columns else F.lit(True)).alias("there"), _digest(role, text).alias("digest"),
    )


class _Faults:
    """Faults of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.kinds, self.seen = conv_id, bytearray(), set()
        self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def add(self, turn: int | None, initial: str, digest: bytes, blank: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        repeated = digest in self.seen
        self.seen.add(digest)
        if blank or repeated:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (repeated and not blank)
            self.kinds.append(LOST)
        else:
            self.truncated += truncated
            place = INITIALS.find(initial) if initial else -1
            self.kinds.append((place if place >= 0 else 3) | (4 if truncated else 0))

    def row(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, audit = cheapest(bytes(self.kinds))
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
KINDS = [pa.int64()] * 7 + [pa.string()]
SCHEMA = ", ".join(f"{name} bigint" for name in NAMES[:-1]) + ", audit string"
_NOBODY = object()


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: gaps between turns, faults by kind, cost and audit of the cheapest edits."""
    ship(rows.sparkSession)

    def told(done: list[_Faults]) -> pa.RecordBatch:
        columns = list(zip(*[one.row() for one in done], strict=True)) or [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, KINDS, strict=True)], NAMES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key = None, _NOBODY
        for batch in batches:
            done = []
            for conv_id, there, *row in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if conv_id != key:
                    if now is not None:
                        done.append(now)
                    now, key = _Faults(conv_id), conv_id
                if there:
                    now.add(*row)
            yield told(done)
        if now is not None:
            yield told([now])

    end = F.rtrim(F.col("text"), F.lit(WHITE))
    light = _known(rows).select(
        "conv_id", "there", "turn", F.substring("role", 1, 1).alias("initial"), F.substring("digest", 1, 16).alias("digest"),
        (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "digest")
    return ordered.mapInArrow(read, SCHEMA)


def edits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The edits of every conversation in order, within sorted partitions: conv_id, place, edit, role, text, summary.

    Place 0 has no edit; it stands for the conversation and carries its audit in ``summary``. A
    deleted row has the role and text that go, every other edit those that come out.
    """
    ship(rows.sparkSession)
    row = ("turn", "digest", "role", "text")
    texts = _known(rows).where("there").withColumn("digest", F.substring("digest", 1, 16))
    heads = found.select("conv_id", F.lit(0).alias("part"), *[F.lit(None).alias(name) for name in row], F.struct(*NAMES[1:]).alias("summary"))
    both = heads.unionByName(texts.select("conv_id", F.lit(1).alias("part"), *row), allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "digest")
    names = ["conv_id", "place", "edit", "role", "text", "summary"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.struct(list(zip(NAMES[1:], KINDS[1:], strict=True)))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, audit, at, state = None, "", 0, OPEN
        made: list[tuple] = []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal at
            at += 1
            made.append((conv_id, at, edit, role, text, None))

        def give() -> str:
            nonlocal state
            state = GIVEN[state]
            return "assistant" if state == ASSISTANT else "user"

        def insert() -> None:
            while at < len(audit) and audit[at] == "I":
                put("I", give(), "")

        def told() -> pa.RecordBatch:
            columns = list(zip(*made, strict=True)) or [[]] * len(names)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for owner, part, role, text, summary in zip(*[batch.column(name).to_pylist() for name in ("conv_id", "part", "role", "text", "summary")], strict=True):
                insert()  # before this row, or after the last one of the conversation before
                if part == 0:
                    conv_id, audit, at, state = owner, summary["audit"], 0, OPEN
                    made.append((conv_id, 0, None, None, None, summary))
                    continue
                edit = audit[at]
                if edit == "K":
                    state = NEXT[role[:1]][state]
                elif edit == "R":
                    role = give()
                put(edit, role, text)
            yield told()
        insert()
        yield told()

    summary = ", ".join(f"{name}: bigint" for name in NAMES[1:-1])
    return ordered.mapInArrow(read, f"conv_id bigint, place bigint, edit string, role string, text string, summary struct<{summary}, audit: string>")


def digests(done: DataFrame) -> DataFrame:
    """The audit of every conversation and the digest of the repaired ``role:text``, joined by line breaks.

    Reads ``edits`` as they lie.
    """
    names, kinds = [*NAMES, "repaired_sha256"], [*KINDS, pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, lines = None, hashlib.sha256(), 0

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for conv_id, place, edit, role, text, summary in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if place == 0:
                    if head is not None:
                        rows.append((*head, digest.hexdigest()))
                    head, digest, lines = (conv_id, *summary.values()), hashlib.sha256(), 0
                elif edit != "D":
                    digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                    lines += 1
            yield told(rows)
        if head is not None:
            yield told([(*head, digest.hexdigest())])

    return done.mapInArrow(read, f"{SCHEMA}, repaired_sha256 string")
