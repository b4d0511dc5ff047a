"""Repair of conversation structure by lazy weighted determinisation.

A conversation is to have role initials of the form (s?(ua)+)?. Edits have costs: a turn is kept, given the role that fits,
or deleted, and empty turns are inserted. The automaton of the form has four states: nothing said yet, after a
system turn, after a user turn, after an assistant turn. The least costs from each of them to the end of the conversation,
less the least of all, are one state of a deterministic automaton over kinds of turns, which gives each arc the
weight that was taken off. Few such vectors occur; they and their arcs are made when first met and then looked up.

1. Faults are found in SQL functions: blank, seen earlier (by whole role and text), truncated. A turn's kind is one small number.
2. The scan reads each conversation from its end; of every turn it keeps the vector behind it, one number.
3. The trace reads from the start, along arcs that lose nothing against the vectors (tight arcs), of several the one whose edit
   has the ASCII-least initial. Delete, Insert, Keep and Rerole lead from a state to one state each, so the least initial
   at every step gives the least audit of all.

Conversations are dealt out once, by their id; each task sorts its turns, on disk if need be, and streams them, backward and
forward, a batch at a time. So a conversation of any length takes the memory of one batch and of its own audit. Its
turns are one task's work: the digest of a repaired conversation is sequential by definition.

Defined results: null roles and texts are one space; null turns come first, turns alike are ordered by role, then text; null
ids are one conversation; repeated rows are turns seen earlier; an empty role has no initial, so it is never kept; empty
texts are blank; very long texts are read whole, one at a time; an empty table gives an empty result; other columns, clashing
names too, are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.llm.common import read

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state after the next user or assistant turn, whichever fits, and the states after a kept turn by its initial.
TURN = (USER, USER, ASSISTANT, USER)
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "": {}}
INITIALS = "sua"
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Kinds of turns: to be deleted, no turn at all (dropped before), and 1 + 2 * initial + truncated for the others.
FAULTY, ABSENT = 0, -1
SPACE = " \t\n\x0b\x0c\r"

Vector = tuple[int, ...]


def _closed(v: list[float]) -> list[float]:
    """Costs with turns inserted where that is cheaper."""
    for _ in v:
        v = [min(v[q], INSERT + v[TURN[q]]) for q in range(len(v))]
    return v


class Automaton:
    """Normalised cost vectors, packed eight bits a state, and what is known of their arcs."""

    def __init__(self):
        self.end = self._pack(_closed([0, float("inf"), float("inf"), 0]))
        self.arcs: dict[tuple[int, int], int] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}

    @staticmethod
    def _pack(v) -> int:
        return sum(int(x) << 8 * q for q, x in enumerate(v))

    @staticmethod
    def _unpack(code: int) -> Vector:
        return tuple(code >> 8 * q & 255 for q in range(4))

    @staticmethod
    def _edits(kind: int, q: int) -> list[tuple[str, int, int]]:
        """(initial, cost, state after) of every edit of one turn in state q."""
        found = [("D", DELETE, q)]
        if kind != FAULTY:
            initial, truncated = divmod(kind - 1, 2)
            kept = KEPT[INITIALS[initial : initial + 1]].get(q)
            if kept is not None:
                found.append(("K", truncated * TRUNCATED, kept))
            found.append(("R", REROLE + truncated * TRUNCATED, TURN[q]))
        return found

    def _costs(self, after: int, kind: int) -> list[float]:
        v = self._unpack(after)
        return _closed([min(cost + v[to] for _, cost, to in self._edits(kind, q)) for q in range(4)])

    def back(self, after: int, kind: int) -> int:
        """The vector before a turn, from the one behind it."""
        found = self.arcs.get((after, kind))
        if found is None:
            costs = self._costs(after, kind)
            found = self.arcs[after, kind] = self._pack(c - min(costs) for c in costs)
        return found

    def trace(self, after: int, kind: int, q: int) -> tuple[str, int]:
        """Initials of the edits at one turn, insertions before it first, and the state after it."""
        found = self.traces.get((after, kind, q))
        if found is None:
            v, costs, edits, at = self._unpack(after), self._costs(after, kind), "", q
            while True:
                tight = [(e, to) for e, cost, to in self._edits(kind, at) if cost + v[to] == costs[at]]
                if INSERT + costs[TURN[at]] == costs[at]:
                    tight.append(("I", TURN[at]))
                edit, at = min(tight)
                edits += edit
                if edit != "I":
                    break
            found = self.traces[after, kind, q] = (edits, at)
        return found

    @staticmethod
    def close(q: int) -> tuple[str, int]:
        """Insertions at the end of a conversation."""
        edits = ""
        while q not in (START, ASSISTANT):
            edits, q = edits + "I", TURN[q]
        return edits, q


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    """One a Python worker: vectors that one task has met are known to the next."""
    return Automaton()


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, absent): the fixed damage of the published test, absent for the turns that it drops."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("c", (F.crc32(named) % 20).cast("int"))
    text = F.when(F.col("c") < 2, "").when(F.col("c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("c") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("c") == 0).alias("absent"), copies.alias("copy")).drop("copy")


def _kinds(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, nth, fault, kind), dealt out by conversation."""
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.coalesce("absent", F.lit(False)) if "absent" in turns.columns else F.lit(False)).alias("absent"),
    ).repartition("conv_id")
    # the partitioning by conversation holds for finer groups too
    seen = Window.partitionBy("conv_id", "role", "text", "absent").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumns({"nth": F.row_number().over(seen), "bare": F.rtrim(F.col("text"), F.lit(SPACE))})
    last = F.right("bare", F.lit(1))
    fault = F.when(F.col("absent"), "absent").when(F.col("bare") == "", "blank").when(F.col("nth") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    initial: Column = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    kind = F.when(F.col("fault") == "absent", ABSENT).when(F.col("fault").isin("blank", "duplicate"), FAULTY).otherwise(1 + 2 * initial + (F.col("fault") == "truncated").cast("int"))
    return rows.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "nth", "fault", kind.cast("int").alias("kind"))


_ORDER = ("conv_id", "turn", "role", "text", "nth")


def _scan(batches):
    """Conversations from their ends: of each turn the vector behind it."""
    auto, conv, code = automaton(), object(), 0
    for batch in batches:
        out = np.empty(batch.num_rows, np.int32)
        for i, (c, kind) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist())):
            if c != conv:
                conv, code = c, auto.end
            out[i] = code
            if kind != ABSENT:
                code = auto.back(code, kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "after"])


def _scanned(turns: DataFrame) -> DataFrame:
    """Turns in order with their kinds and the vectors behind them; all of a conversation are in one partition."""
    kinds = _kinds(turns)
    back = kinds.sortWithinPartitions(*[F.desc_nulls_last(c) for c in _ORDER])
    names = "conv_id long, turn long, role string, text string, nth int, fault string, kind int, after int"
    return back.mapInArrow(_scan, names).sortWithinPartitions(*[F.asc_nulls_first(c) for c in _ORDER])


class _Repaired:
    """The trace through one conversation: repaired turns as they come."""

    def __init__(self):
        self.auto, self.q = automaton(), START

    def turn(self, role: str, text: str, kind: int, after: int):
        """(edit, role, text) of every edit at one turn."""
        edits, q = self.auto.trace(after, kind, self.q)
        for edit in edits:
            if edit == "D":
                yield edit, role, text
                continue
            if edit != "K":
                role_now = ROLES[TURN[self.q]]
            self.q = q if edit == "K" else TURN[self.q]
            yield edit, (role if edit == "K" else role_now), ("" if edit == "I" else text)

    def close(self):
        edits, _ = self.auto.close(self.q)
        for edit in edits:
            self.q = TURN[self.q]
            yield edit, ROLES[self.q], ""


class _Digest:
    """The row of one conversation, added to turn by turn."""

    def __init__(self, conv):
        self.conv, self.steps, self.cost = conv, _Repaired(), 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.before = None
        self.turns = self.illegal = 0
        self.audit, self.sha, self.said = bytearray(), hashlib.sha256(), False

    def _edit(self, edit: str, role: str, text: str, fault: str):
        self.audit += edit.encode()
        self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + TRUNCATED * (edit in "KR" and fault == "truncated")
        if edit != "D":
            self.sha.update((f"\n{role}:{text}" if self.said else f"{role}:{text}").encode())
            self.said = True

    def add(self, turn, role, text, fault, kind, after):
        if kind == ABSENT:
            return
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        for step in self.steps.turn(role, text, kind, after):
            self._edit(*step, fault)

    def row(self) -> tuple:
        for step in self.steps.close():
            self._edit(*step, "")
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, self.audit.decode(), self.sha.hexdigest()


def _turns(batches):
    """(conv_id, turn, role, text, fault, kind, after) of every turn, in order."""
    columns = ("conv_id", "turn", "role", "text", "fault", "kind", "after")
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digests(batches):
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    rows: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
    now = None
    for conv, *turn in _turns(batches):
        if now is None or conv != now.conv:
            if now is not None:
                rows.append(now.row())
            now = _Digest(conv)
        now.add(*turn)
        if len(rows) >= 5000:
            yield made()
            rows = []
    if now is not None:
        rows.append(now.row())
    if rows:
        yield made()


def _edited(batches):
    names, kinds = ["conv_id", "place", "edit", "role", "text", "fault"], [pa.int64(), pa.int64(), *[pa.string()] * 4]
    rows: list[tuple] = []
    made = lambda: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names)
    conv, steps, place = object(), None, 0
    for c, _, role, text, fault, kind, after in _turns(batches):
        if c != conv:
            if steps is not None:
                rows += [(conv, place + i, *s, "") for i, s in enumerate(steps.close())]
            conv, steps, place = c, _Repaired(), 0
        if kind != ABSENT:
            for s in steps.turn(role, text, kind, after):
                rows.append((conv, place, *s, "" if s[0] == "I" else fault))
                place += 1
        if len(rows) >= 5000:
            yield made()
            rows = []
    if steps is not None:
        rows += [(conv, place + i, *s, "") for i, s in enumerate(steps.close())]
    if rows:
        yield made()


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text, fault): every edit of the cheapest repair of turns (conv_id, turn, role, text), in order.

    Edits are K, R, D and I; those but D, in the order of their places, are the repaired conversation.
    """
    return _scanned(turns).mapInArrow(_edited, "conv_id long, place long, edit string, role string, text string, fault string")


def digests(turns: DataFrame) -> DataFrame:
    """A row a conversation of turns (conv_id, turn, role, text): its faults, the cost and audit of its repair, the repaired text's digest.

    A true value in a column `absent` marks a turn that is not there, but whose conversation is to have a row.
    """
    return _scanned(turns).mapInArrow(_digests, DIGEST)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(damaged(read(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The least (cost, audit) of every state by recursion from each conversation's end, insertions spelt out."""

    def line(edit: str, cost: str, before: int, to: int, text: str | None) -> str:
        rest = f"b.s[{to + 1}].r"
        said = rest if text is None else f"{text} || coalesce(chr(10) || {rest}, '')"
        return f"{{'c': {before * INSERT} + {cost} + b.s[{to + 1}].c, 'a': '{'I' * before}{edit}' || b.s[{to + 1}].a, 'r': {said}}}"

    def least(q: int) -> str:
        found, p, lines = [], q, ""
        for before in range(3):
            own = lambda x: f"'{lines}' || {x}"  # noqa: B023, E731
            inserted = None if not before else f"'{lines[:-1]}'"
            found.append(line("D", str(DELETE), before, p, inserted))
            for initial, kept in KEPT.items():
                if p in kept:
                    found.append(f"CASE WHEN NOT t.gone AND left(t.role, 1) = '{initial}' THEN {line('K', 't.extra', before, kept[p], own("t.role || ':' || t.text"))} END")
            found.append(f"CASE WHEN NOT t.gone THEN {line('R', f'{REROLE} + t.extra', before, TURN[p], own(f"'{ROLES[TURN[p]]}:' || t.text"))} END")
            p = TURN[p]
            lines += f"{ROLES[p]}:\n"
        return "list_min([" + ",\n".join(found) + "])"

    return f"""
WITH RECURSIVE polynomial AS (
    SELECT list_transform(range(256), lambda i: list_reduce(list_concat([CAST(i AS BIGINT)], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
),
named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
),
coded AS (
    SELECT conv_id, turn, role, text,
           xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) % 20 AS c
    FROM named, polynomial
),
damaged AS (
    SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
           CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN c = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM coded WHERE c <> 0
),
marked AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS final FROM damaged
),
faults AS (
    SELECT *, CASE WHEN final = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           row_number() OVER w - 1 AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair
    FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth)
),
counts AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id
),
turns AS (SELECT conv_id, i, role, text, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM faults),
back AS (
    SELECT conv_id, n AS i, [{{'c': 0, 'a': '', 'r': NULL}}, {{'c': {2 * INSERT}, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}}, {{'c': {INSERT}, 'a': 'I', 'r': 'assistant:'}}, {{'c': 0, 'a': '', 'r': NULL}}] AS s
    FROM counts
    UNION ALL
    SELECT b.conv_id, b.i - 1, [
{",\n".join(least(q) for q in range(4))}
    ] FROM back b JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i - 1
)
SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
       CAST(coalesce(b.s[1].c, 0) AS BIGINT) AS cost, coalesce(b.s[1].a, '') AS audit, sha256(coalesce(b.s[1].r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 0
"""


SQL = _sql()
