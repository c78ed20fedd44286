"""Repair of conversations' structure by a cheapest edit, streamed.

A conversation is well formed when its role initials read ``(s?(ua)+)?``: an
optional system turn, then user and assistant in turn.  Its rows, in order of turn,
are edited at least cost:

    Keep    0   a row whose role fits
    Rerole  1   to user or assistant
    Delete  2   the only choice for a blank row or a repeated one
    Insert  5   an empty user or assistant turn, anywhere

A truncated row (its last character is not ``.``, ``!`` or ``?``) adds 5 unless it is
deleted.  Among the cheapest edits the one whose initials come first in ASCII is taken.

Rows are repartitioned by conversation and sorted from the last turn to the first, so that
one pass carries the cost of what follows from each of the 4 states of the pattern
(nothing, after system, after user, after assistant), across Arrow batches.  In each
state a row's best edit is 2 bits: one byte a row is kept to walk back over at the end, beside
the row's role and text.  What a long conversation has gathered above ``SPILL`` bytes
goes to an unnamed file of the task in compressed blocks, so memory does not grow with the
conversation; it is read again block by block.  The file ends with the task, and a lost
task starts over from the shuffle.

Which rows repeat an earlier one is told by a window over (conversation, role, text),
which the same partitioning serves; it needs no second shuffle.

Defined results: NULL conversation ids are one conversation; NULL turns come first; rows
of one turn follow by role and text, so copies are adjacent; a NULL role or text is one
space, which is blank; a role counts by its first letter, and one without a letter is never
kept; a row that is not ``present``
only tells that its conversation exists; a conversation without rows costs nothing
and repairs to nothing; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.runtime import ship

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
EDITS = "DIKR"                       # in ASCII order
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where the one role that may be inserted (or given) leads from each state, and its name.
NEXT = (USER, USER, ASSISTANT, USER)
GIVEN = ("user", "user", "assistant", "user")
#: Where a row of an initial leads from each state, if it fits.
FITS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL_PAIRS = {"su", "ua", "au"}
SPILL = 8 << 20


def _gap(through: list[int], edit: list[int]) -> tuple[list[int], list[int]]:
    """Costs in front of a row, where turns may be inserted: ``through`` goes on with ``edit``."""
    cost = list(through)
    for _ in range(2):                                  # user and assistant lead to each other
        for s in range(4):
            cost[s] = min(cost[s], INSERT + cost[NEXT[s]])
    insert = EDITS.index("I")
    return cost, [min(e if through[s] == cost[s] else 4, insert if INSERT + cost[NEXT[s]] == cost[s] else 4)
                  for s, e in enumerate(edit)]


class Repairer:
    """Costs and edits of one conversation, fed from its last row to its first."""

    _steps: dict = {}      # (kind of row, relative costs) -> (edits byte, least cost, relative costs)

    def __init__(self, spill: int = SPILL):
        self.limit = spill
        never = 10 ** 6
        self.end, self.end_edit = _gap([0, never, never, 0], [4] * 4)      # 4: no edit, the end
        self.base, self.cost = min(self.end), tuple(c - min(self.end) for c in self.end)
        self.rows, self.edits, self.held = [], bytearray(), 0
        self.file, self.blocks = None, []

    def add(self, role: str, text: str, bad: bool, cut: bool) -> None:
        key = (role[:1] if role[:1] in FITS else "", bad, cut, self.cost)
        step = self._steps.get(key)
        if step is None:
            step = self._steps[key] = self._step(*key)
        edits, more, self.cost = step
        self.base += more
        self.edits.append(edits)
        self.rows.append((role, text))
        self.held += len(role) + len(text) + 120
        if self.held > self.limit:
            self._put()

    @staticmethod
    def _step(initial: str, bad: bool, cut: bool, after: tuple) -> tuple:
        through, edit = [], []
        for s in range(4):
            ways = [(DELETE + after[s], EDITS.index("D"))]
            if not bad:
                late = TRUNCATED if cut else 0
                ways.append((REROLE + late + after[NEXT[s]], EDITS.index("R")))
                if s in FITS.get(initial, {}):
                    ways.append((KEEP + late + after[FITS[initial][s]], EDITS.index("K")))
            cost, first = min(ways)
            through.append(cost)
            edit.append(first)
        cost, edit = _gap(through, edit)
        least = min(cost)
        return sum(e << 2 * s for s, e in enumerate(edit)), least, tuple(c - least for c in cost)

    def _put(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        block = zlib.compress(pickle.dumps((self.rows, bytes(self.edits)), protocol=4), 1)
        self.blocks.append((self.file.tell(), len(block)))
        self.file.write(block)
        self.rows, self.edits, self.held = [], bytearray(), 0

    def _forward(self):
        """(role, text, edits) of every row from the first one."""
        yield from ((*row, e) for row, e in zip(reversed(self.rows), reversed(self.edits), strict=True))
        for at, size in reversed(self.blocks):
            self.file.seek(at)
            rows, edits = pickle.loads(zlib.decompress(self.file.read(size)))
            yield from ((*row, e) for row, e in zip(reversed(rows), reversed(edits), strict=True))
        if self.file is not None:
            self.file.close()

    def total(self) -> int:
        return self.base + self.cost[START]

    def walk(self):
        """(edit, role, text) of the repaired conversation in order; deleted rows as they were."""
        state = START
        for role, text, edits in self._forward():
            while True:
                edit = EDITS[edits >> 2 * state & 3]
                if edit == "D":
                    yield edit, role, text
                elif edit == "K":
                    yield edit, role, text
                    state = FITS[role[:1]][state]
                else:
                    yield edit, GIVEN[state], "" if edit == "I" else text
                    state = NEXT[state]
                if edit != "I":
                    break
        while self.end_edit[state] != 4:
            yield "I", GIVEN[state], ""
            state = NEXT[state]


class _Facts:
    """Counts over one conversation's rows, fed from the last to the first."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.top = self.low = self.behind = None

    def add(self, turn, role, blank, repeated, cut) -> None:
        self.blank += blank
        self.duplicate += repeated
        self.truncated += cut
        if self.behind is not None and role[:1] + self.behind not in LEGAL_PAIRS:
            self.illegal += 1
        self.behind = role[:1]
        if turn is not None:
            self.turns += turn != self.low
            self.low = turn
            self.top = turn if self.top is None else self.top

    def gaps(self) -> int:
        return 0 if self.top is None else self.top - self.low + 1 - self.turns


def _conversations(batches, spill: int = SPILL):
    """Consecutive rows of equal ids: yields (id, facts, repairer) when a conversation is complete."""
    key, facts, repairer = None, None, None
    for batch in batches:
        for conv, present, turn, role, text, earlier in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if facts is None or conv != key:
                if facts is not None:
                    yield key, facts, repairer
                key, facts, repairer = conv, _Facts(), Repairer(spill)
            if not present:
                continue
            ending = text.rstrip(BLANK)
            blank = not ending
            repeated = earlier and not blank
            cut = not blank and not repeated and ending[-1] not in ".!?"
            facts.add(turn, role, blank, repeated, cut)
            repairer.add(role, text, blank or repeated, cut)
    if facts is not None:
        yield key, facts, repairer


def _ordered(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str,
             present: Column | None) -> DataFrame:
    """One partition per conversation, each from its last row to its first."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    narrow = rows.select(rows[conv_col].alias("conv_id"), there.alias("present"), rows[turn_col].cast("long").alias("turn"),
                         F.coalesce(rows[role_col].cast("string"), F.lit(" ")).alias("role"),
                         F.coalesce(rows[text_col].cast("string"), F.lit(" ")).alias("text"))
    same = Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    return (narrow.repartition("conv_id").withColumn("earlier", F.row_number().over(same) > 1)
            .sortWithinPartitions("conv_id", F.col("turn").desc_nulls_last(), F.desc("role"), F.desc("text"),
                                  F.desc("earlier")))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", present: Column | None = None, spill: int = SPILL) -> DataFrame:
    """A row per conversation: its faults, the cost and the initials of the edit, and the hash of the result.

    gaps (missing turns), blank, duplicate, truncated (each row by its first fault), illegal (neighbours whose
    role initials are not su, ua or au), cost, audit, repaired_sha256 (of ``role:text`` joined by line feeds)."""
    ship(rows.sparkSession)
    kind = rows.schema[conv_col].dataType

    def run(batches):
        for key, f, repairer in _conversations(batches, spill):
            digest, audit, first = hashlib.sha256(), [], True
            for edit, role, text in repairer.walk():
                audit.append(edit)
                if edit != "D":
                    digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
                    first = False
            yield pa.RecordBatch.from_arrays(
                [pa.array([key], arrow_kind), *(pa.array([x], pa.int64()) for x in (
                    f.gaps(), f.blank, f.duplicate, f.truncated, f.illegal, repairer.total())),
                 pa.array(["".join(audit)], pa.string()), pa.array([digest.hexdigest()], pa.string())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *counts, "audit", "repaired_sha256"]
    schema = f"conv_id {kind.simpleString()}, {', '.join(c + ' long' for c in counts)}, audit string, repaired_sha256 string"
    return _ordered(rows, conv_col, turn_col, role_col, text_col, present).mapInArrow(_many(run), schema)


def repaired_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                   text_col: str = "text", present: Column | None = None, spill: int = SPILL) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text and the edit that gave the row (K, R or I)."""
    ship(rows.sparkSession)
    kind = rows.schema[conv_col].dataType

    def run(batches):
        for key, _, repairer in _conversations(batches, spill):
            at = 0
            for edit, role, text in repairer.walk():
                if edit != "D":
                    yield pa.RecordBatch.from_arrays([
                        pa.array([key], arrow_kind), pa.array([at], pa.int64()), pa.array([role], pa.string()),
                        pa.array([text], pa.string()), pa.array([edit], pa.string())],
                        names=["conv_id", "position", "role", "text", "edit"])
                    at += 1

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(kind)
    schema = f"conv_id {kind.simpleString()}, position long, role string, text string, edit string"
    return _ordered(rows, conv_col, turn_col, role_col, text_col, present).mapInArrow(_many(run), schema)


def _many(run, rows: int = 512, size: int = 4 << 20):
    """Batches of one row put together to batches of some hundred."""
    def joined(batches):
        held, weight = [], 0
        for one in run(batches):
            held.append(one)
            weight += one.nbytes
            if len(held) >= rows or weight > size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, weight = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    return joined


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Faults dealt by crc32 of ``conv_id:turn`` modulo 20, to try the repair on: 0 drops the row (it stays, not
    ``present``), 1 empties the text, 2 takes its ``.!?``, 3 repeats the row, 4 makes it the user's."""
    def text_of(c, blank=" "):
        return F.coalesce(rows[c].cast("string"), F.lit(blank))

    fault = F.crc32(F.concat_ws(":", text_of(conv_col), text_of(turn_col)).cast("binary")) % 20
    text = text_of(text_col)
    return rows.select(
        rows[conv_col].alias("conv_id"), rows[turn_col].cast("long").alias("turn"), (fault != 0).alias("present"),
        F.when(fault == 4, F.lit("user")).otherwise(text_of(role_col)).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")
    ).drop("_copy")
