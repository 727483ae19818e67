"""Repair of conversation structure with the fewest edits, by survivor-coalescence Viterbi.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``.  Its rows are read
in order; for each of the four states that the repaired roles can be in (nothing yet, after the
system turn, after a user, after an assistant) the cheapest edits that lead there survive, the
least in ASCII order among equals:

* Keep a row (0), Rerole it to the role that is due (3), Delete it (4; required for blank and
  duplicate rows), Insert a turn with an empty text (3); a truncated row that stays adds 3.

Edits are nodes of a tree of back pointers that count the nodes and states which refer to them.  A
state that loses its last path drops the nodes that only it held, and as soon as the root has one
child left, all survivors share that child: its edit is final, is emitted and becomes the root.  So
memory holds the unresolved suffixes only, not the conversation.  Equal costs are decided by
comparing the complete unresolved suffixes back to the common ancestor; two paths to one state never
are prefixes of each other at equal cost.  A state whose cost exceeds another one's by more than it
could ever regain is dropped, so that the empty repair does not keep the root from advancing.
Rows that must be deleted leave one node for each state and no text.

Conversations are dealt by one shuffle; duplicates are found and turns ordered by sorts of the
same partitions, which spill; a task streams its rows.  A conversation is read by one task, in
order: its edits depend on each other and its digest chains its texts.

Defined results: null roles and texts count as one space, null conv_ids are one conversation, null
turns come first; rows of one turn are ordered by role and text; an empty table gives an empty
result; further columns are ignored.  Conversations without rows are reported when their ids are
given.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
ENDS = [".", "!", "?"]
RESERVED = ("blank", "duplicate")

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: the role that is due in each state, and the state that it leads to
DUE = {NOTHING: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: (state, other, most that the state can regain on the other): a system row kept instead of
#: deleted; an assistant turn that the other has to insert first
REGAIN = [
    (NOTHING, ASSISTANT, COST[DELETE]), (NOTHING, USER, COST[DELETE] + COST[INSERT]), (SYSTEM, ASSISTANT, 0), (SYSTEM, USER, COST[INSERT]),
]

_EDIT = "conv_id bigint, seq bigint, edit string, turn bigint, role string, text string, was string, fault string"
_REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


class _Node:
    __slots__ = ("parent", "edit", "row", "role", "children", "states", "depth")

    def __init__(self, parent: _Node | None, edit: str = "", row: tuple = (), role: str | None = None):
        self.parent, self.edit, self.row, self.role = parent, edit, row, role
        self.children: list[_Node] = []
        self.states = 0
        self.depth = parent.depth + 1 if parent else 0
        if parent:
            parent.children.append(self)

    def release(self) -> None:
        """Drop this node and its ancestors as far as nothing else refers to them."""
        node = self
        while node.parent and not node.states and not node.children:
            parent = node.parent
            parent.children.remove(node)
            node.parent = None
            node = parent


def _before(a: _Node, a_tail: str, b: _Node, b_tail: str) -> bool:
    """Whether the edits up to ``a`` and then ``a_tail`` come before those up to ``b`` and ``b_tail``."""
    left, right = [a_tail], [b_tail]
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edit)
            a = a.parent
        else:
            right.append(b.edit)
            b = b.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Repair:
    """One conversation, row by row; :meth:`row` and :meth:`end` return the edits that became final."""

    def __init__(self):
        self.root = _Node(None)
        self.root.states = 1
        self.best: dict[int, tuple[int, _Node]] = {NOTHING: (0, self.root)}

    def _offer(self, found: dict, state: int, cost: int, parent: _Node, edit: str, row: tuple, role: str | None) -> None:
        held = found.get(state)
        if held is None or cost < held[0] or (cost == held[0] and _before(parent, edit, held[1], held[2])):
            found[state] = cost, parent, edit, row, role

    def _advance(self, found: dict) -> None:
        """Make the offers the survivors; an offer without an edit keeps its node."""
        fresh = {}
        for state, (cost, parent, edit, row, role) in found.items():
            node = _Node(parent, edit, row, role) if edit else parent
            node.states += 1
            fresh[state] = cost, node
        old, self.best = self.best, fresh
        for _, node in old.values():
            node.states -= 1
        for _, node in old.values():
            node.release()

    def _insert(self) -> None:
        """Inserted turns: each state's role that is due, as often as it is worth its cost."""
        for _ in range(3):
            found = {state: (cost, node, "", (), None) for state, (cost, node) in self.best.items()}
            changed = False
            for state, (cost, node) in self.best.items():
                role, there = DUE[state]
                held = found.get(there)
                self._offer(found, there, cost + COST[INSERT], node, INSERT, (), role)
                changed |= found[there] is not held
            if not changed:
                return
            self._advance(found)

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> list[tuple]:
        self._insert()
        more = TRUNCATED_COST if fault == "truncated" else 0
        row = (turn, role, text, fault)
        deleted = (turn, role, None, fault)
        found: dict[int, tuple] = {}
        for state, (cost, node) in self.best.items():
            self._offer(found, state, cost + COST[DELETE], node, DELETE, deleted, None)
            if fault in RESERVED:
                continue
            due, there = DUE[state]
            if role[:1] == due[0]:
                self._offer(found, there, cost + COST[KEEP] + more, node, KEEP, row, role)
            else:
                self._offer(found, there, cost + COST[REROLE] + more, node, REROLE, row, due)
            if state == NOTHING and role[:1] == "s":
                self._offer(found, SYSTEM, cost + COST[KEEP] + more, node, KEEP, row, role)
        for state, other, gain in REGAIN:
            if state in found and other in found and found[state][0] > found[other][0] + gain:
                del found[state]
        self._advance(found)
        return self._final()

    def _final(self) -> list[tuple]:
        out = []
        while not self.root.states and len(self.root.children) == 1:
            (self.root,) = self.root.children
            self.root.parent = None
            out.append(self._edit(self.root))
        return out

    @staticmethod
    def _edit(node: _Node) -> tuple:
        turn, was, text, fault = node.row or (None, None, "", None)
        return node.edit, turn, node.role, text, was, fault

    def end(self) -> list[tuple]:
        self._insert()
        ends = [s for s in (NOTHING, ASSISTANT) if s in self.best]
        cost, node = self.best[ends[0]]
        for state in ends[1:]:
            other = self.best[state]
            if other[0] < cost or (other[0] == cost and _before(other[1], "", node, "")):
                cost, node = other
        out = []
        while node is not self.root:
            out.append(self._edit(node))
            node = node.parent
        return out[::-1]

    @property
    def unresolved(self) -> int:
        """Nodes held."""
        held, todo = 0, [self.root]
        while todo:
            held += 1
            todo += todo.pop().children
        return held


def _column_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows in batches of up to 5,000 or about 4 MB of the text column."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[text] or "") if text is not None else 0
        if len(held) == 5000 or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_EDIT_ARROW = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "bigint" else pa.string()) for c in _EDIT.split(", ")])
_REPORT_ARROW = pa.schema([(c.split()[0], pa.int64() if c.split()[1] == "bigint" else pa.string()) for c in _REPORT.split(", ")])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by conversation, in order, each led by a marker or not."""

    def edits() -> Iterator[tuple]:
        started, current, repair, seq = False, None, Repair(), 0
        for conv_id, turn, role, text, fault, marker in _column_rows(batches):
            if not started or conv_id != current:
                if started:
                    for edit in repair.end():
                        yield current, seq, *edit
                        seq += 1
                started, current, repair, seq = True, conv_id, Repair(), 0
                if marker:
                    yield conv_id, -1, None, None, None, None, None, None
            if not marker:
                for edit in repair.row(turn, role, text, fault):
                    yield current, seq, *edit
                    seq += 1
        if started:
            for edit in repair.end():
                yield current, seq, *edit
                seq += 1

    return _batches(edits(), _EDIT_ARROW, text=5)


class _Fold:
    """The report of one conversation, from its edits in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = None
        self.turns = self.illegal = self.cost = 0
        self.was = None
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.repaired = 0

    def add(self, edit, turn, role, text, was, fault) -> None:
        self.audit.append(edit)
        self.cost += COST[edit]
        if edit != INSERT:
            if fault:
                self.faults[fault] += 1
            if fault == "truncated" and edit != DELETE:
                self.cost += TRUNCATED_COST
            if turn is not None and (self.first is None or turn != self.last):
                self.first = turn if self.first is None else self.first
                self.last = turn
                self.turns += 1
            if self.was is not None and self.was[:1] + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.was = was
        if edit != DELETE:
            self.digest.update(("\n" * (self.repaired > 0) + f"{role}:{text}").encode())
            self.repaired += 1

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.turns, 2**63 - 1)
        return self.conv_id, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        fold = None
        for conv_id, _, edit, *rest in _column_rows(batches):
            if fold is None or conv_id != fold.conv_id:
                if fold:
                    yield fold.row()
                fold = _Fold(conv_id)
            if edit:
                fold.add(edit, *rest)
        if fold:
            yield fold.row()

    return _batches(rows(), _REPORT_ARROW)


def faults(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, fault): each row's first fault of blank, duplicate and truncated.
    The result is partitioned by conv_id."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
        *([F.col("_marker")] if "_marker" in turns.columns else [F.lit(False).alias("_marker")]),
    ).repartition("conv_id")
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    again = F.row_number().over(Window.partitionBy("conv_id", "_marker", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = F.when(trimmed == "", "blank").when(again, "duplicate").when(~F.substring(trimmed, -1, 1).isin(ENDS), "truncated")
    return rows.select("conv_id", "turn", "role", "text", fault.alias("fault"), "_marker")


def repair(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The edits of every conversation in order: (conv_id, seq, edit, turn, role, text, was, fault).

    ``role`` and ``text`` are those of the repaired turn, null where the row is deleted; ``was`` is the
    row's role, null for inserted turns.  Each id of ``conversations`` (conv_id) has a row with
    seq -1 and no edit."""
    rows = turns.select("conv_id", "turn", "role", "text")
    if conversations is not None:
        none = F.lit(None)
        marked = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct().select(
            "conv_id", none.cast("bigint").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(True).alias("_marker")
        )
        rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
                           F.col("text").cast("string").alias("text"), F.lit(False).alias("_marker")).unionByName(marked)
    ordered = faults(rows).sortWithinPartitions(
        F.col("conv_id"), F.col("_marker").desc(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"),
        F.coalesce(F.col("fault") == "duplicate", F.lit(False)),  # the first of equal rows stays
    )
    return ordered.mapInArrow(_repaired, _EDIT)


def report(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """One row per conversation, folded from the edits of :func:`repair` as they stream by."""
    return repair(turns, conversations).mapInArrow(_reported, _REPORT)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties
    its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets role user.  Nulls count as one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(name.cast("binary")) % 20
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), kind.alias("kind")
    )
    copies = F.when(F.col("kind") == 0, F.lit(0)).when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")
