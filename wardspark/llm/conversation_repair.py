"""Repair of the structure of conversations by cheapest edits.

A sound conversation is empty, or an optional system turn and then one or more pairs of user and
assistant turn. Rows may be kept (0), given the role user or assistant (``REROLE``) or deleted (``DELETE``, a must
for blank and repeated ones), and empty turns may be inserted anywhere (``INSERT``); a truncated row that
stays costs ``TRUNCATED`` more. Of the cheapest ways the one whose letters (D, I, K, R) come first wins.

Rows are dealt out by conversation and sorted by turn; a task streams through them, batch by batch, and keeps four
states: nothing yet, after the system turn, after a user, after an assistant. Each has a cost and a rank among the
letter sequences so far. Costs are taken relative to the least, so few combinations of states ever occur, and a
step is a look-up in a table that fills itself. What a row leaves behind is four bytes, the state before and
the letters for each state, and its text; both wait in buffers that go to a file of the task once they
are large, so memory is bounded however long a conversation is. The file has no name and ends with the task.

Null roles and texts count as one space, null turns come first, equal turns are ordered by role and text; the null
conversation is one of its own. An empty role has the initial of a space, too. Roles other than user, assistant and
system are told by their first letter alone. A very long text is one row like any other; rows that repeat are faults.
Other columns are not looked at, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Bytes of a conversation's texts, and of its back-pointers, held in memory.
HELD = 8 << 20
# Rows whose back-pointers are read back at once.
CHUNK = 1 << 16

BLANK = r"\A[\x20\x09-\x0D]*\z"
# the last character that isn't white space ends no sentence
OPEN_END = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
# state -> {initial of the next row: state after it}
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
# empty turns put in: letters, state before -> after
INSERTED = {"": {s: s for s in STATES},
            "I": {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER},
            "II": {START: ASSISTANT, SYSTEM: ASSISTANT, USER: USER, ASSISTANT: ASSISTANT}}
LETTERS = ["".join(x) for x in product(INSERTED, "DKR")]
FAULTS = ["", "blank", "duplicate", "truncated"]
FIELDS = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired_sha256 string")


def rows_in_order(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, here, fault``, dealt out by conversation and sorted.

    ``fault`` is 0 to 3 as in ``FAULTS``. Repeated rows are found by a second sort of the same
    partitions, so the texts are shuffled once.
    """
    here = F.coalesce(F.col("here"), F.lit(True)) if "here" in turns.columns else F.lit(True)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), here.alias("here"))
    rows = rows.withColumn("h", F.xxhash64("here", "role", "text")).repartition("conv_id")
    earlier = F.lag(F.lit(True)).over(
        Window.partitionBy("conv_id", "h", "here", "role", "text").orderBy("turn"))
    fault = (F.when(F.col("text").rlike(BLANK), 1).when(earlier, 2)
             .when(F.col("text").rlike(OPEN_END), 3).otherwise(0))
    return rows.select("conv_id", "turn", "role", "text", "here", fault.alias("fault")).sortWithinPartitions(
        F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", F.col("fault") == 2)


class Steps:
    """The transitions of combined states: (cost, rank) of each state, costs relative to the least."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.combined: list[tuple] = []
        self.known: dict[tuple[int, str, int], tuple[int, int, bytes]] = {}
        self.begin = self._number(((0, 0), None, None, None))

    def _number(self, states: tuple) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.combined)
            self.combined.append(states)
        return self.numbers[states]

    def step(self, number: int, initial: str, fault: int) -> tuple[int, int, bytes]:
        """Number after a row, what the least cost grows by, and the row's back-pointers."""
        key = number, initial, fault
        if key not in self.known:
            self.known[key] = self._step(self.combined[number], initial, fault)
        return self.known[key]

    def _step(self, states: tuple, initial: str, fault: int) -> tuple[int, int, bytes]:
        extra = TRUNCATED if fault == 3 else 0
        best: list[tuple | None] = [None] * 4
        for before, known in enumerate(states):
            if known is None:
                continue
            for inserted, moves in INSERTED.items():
                at = moves[before]
                ways = [("D", DELETE, at)]
                if fault not in (1, 2):
                    ways += [("R", REROLE + extra, after) for role, after in NEXT[at].items() if role != "s"]
                    ways += [("K", extra, NEXT[at][initial])] if initial in NEXT[at] else []
                for letter, cost, after in ways:
                    letters = inserted + letter
                    found = (known[0] + INSERT * len(inserted) + cost, known[1], letters, before)
                    if best[after] is None or found < best[after]:
                        best[after] = found
        alive = [b for b in best if b is not None]
        least = min(b[0] for b in alive)
        order = sorted(b[1:3] for b in alive)
        states = tuple(None if b is None else (b[0] - least, order.index(b[1:3])) for b in best)
        pointers = bytes(0 if b is None else b[3] << 4 | LETTERS.index(b[2]) for b in best)
        return self._number(states), least, pointers

    def end(self, number: int) -> tuple[int, int, str]:
        """Further cost, last state and letters of the cheapest end."""
        ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        cost, _, state = min((known[0] + INSERT * len(ends[s]), known[1], s) for s, known in enumerate(
            self.combined[number]) if known is not None)
        return cost, state, ends[state]


class Conversation:
    """One conversation, row by row."""

    def __init__(self, steps: Steps, conv_id):
        self.steps, self.conv_id, self.number = steps, conv_id, steps.begin
        self.cost = self.rows = self.illegal = self.turns = 0
        self.first = self.last = None
        self.before = ""
        self.faults = [0] * len(FAULTS)
        self.texts = tempfile.SpooledTemporaryFile(HELD)
        self.pointers = tempfile.SpooledTemporaryFile(HELD)

    def add(self, turn, role: str, text: str, fault: int) -> None:
        initial = role[:1] or " "
        if self.rows and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = (turn if self.first is None else self.first), turn, self.turns + 1
        self.before = initial
        self.rows += 1
        self.faults[fault] += 1
        self.number, cost, pointers = self.steps.step(self.number, initial, fault)
        self.cost += cost
        self.pointers.write(pointers)
        role, text = role.encode(), text.encode()
        self.texts.write(struct.pack("<II", len(role), len(text)) + role + text)

    def _decisions(self, state: int) -> Iterator[tuple[int, bytes]]:
        """Chunks, last first, of the number of its first row and the letters' number of each row."""
        for start in range((self.rows - 1) // CHUNK * CHUNK, -1, -CHUNK):
            self.pointers.seek(4 * start)
            data = self.pointers.read(4 * min(CHUNK, self.rows - start))
            letters = bytearray(len(data) // 4)
            for row in range(len(letters) - 1, -1, -1):
                found = data[4 * row + state]
                letters[row], state = found & 15, found >> 4
            yield start, bytes(letters)

    def _rows(self) -> Iterator[tuple[bytes, bytes]]:
        self.texts.seek(0)
        while head := self.texts.read(8):
            role, text = struct.unpack("<II", head)
            yield self.texts.read(role), self.texts.read(text)

    def result(self) -> tuple:
        cost, state, tail = self.steps.end(self.number)
        decided = tempfile.SpooledTemporaryFile(HELD)  # one byte a row, in order
        for start, letters in self._decisions(state):
            decided.seek(start)
            decided.write(letters)
        decided.seek(0)
        digest, audit, expected, some = hashlib.sha256(), [], b"user", False

        def put(role: bytes, text: bytes) -> None:
            nonlocal expected, some
            digest.update((b"\n" if some else b"") + role + b":" + text)
            some, expected = True, b"assistant" if role[:1] == b"u" else b"user"

        for role, text in self._rows():
            letters = LETTERS[decided.read(1)[0]]
            audit.append(letters)
            for letter in letters:
                if letter == "I":
                    put(expected, b"")
                elif letter != "D":
                    put(role if letter == "K" else expected, text)
        for _ in tail:
            put(expected, b"")
        for file in (self.texts, self.pointers, decided):
            file.close()
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, self.cost + cost,
                "".join(audit) + tail, digest.hexdigest())


def _column(values: pd.Series) -> list:
    return [None if missing else value for value, missing in zip(values, values.isna())]


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    steps, current, done = Steps(), None, []
    names = ["key", *[f.split()[0] for f in FIELDS.split(", ")]]
    for batch in batches:
        for key, turn, role, text, here, fault in zip(
                _column(batch["key"]), _column(batch["turn"]), batch["role"], batch["text"], batch["here"],
                batch["fault"]):
            if current is None or current.conv_id != key:
                if current is not None:
                    done.append(current.result())
                current = Conversation(steps, key)
            if here:
                current.add(None if turn is None else int(turn), role, text, fault)
        if done:
            yield pd.DataFrame(done, columns=names)
            done = []
    if current is not None:
        yield pd.DataFrame([current.result()], columns=names)


def repair(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    ``turns`` has ``conv_id, turn, role, text``, and may have a boolean ``here``: rows where it is false only
    say that there is such a conversation. ``audit`` lists the letters of the edits in order.
    """
    kind = turns.schema["conv_id"].dataType
    # ids and turns pass through pandas as text, which keeps nulls and all digits
    rows = rows_in_order(turns).select(
        F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("string").alias("turn"), "role", "text",
        "here", "fault")
    found = rows.mapInPandas(_repaired, f"key string, {FIELDS}")
    return found.select(F.col("key").cast(kind).alias("conv_id"), *[f.split()[0] for f in FIELDS.split(", ")])


def damaged(turns: DataFrame) -> DataFrame:
    """``turns`` with faults put in by ``crc32(conv_id:turn) % 20``, to try ``repair`` on; ``here`` is false for
    a dropped row."""
    def text_of(key: str) -> Column:
        return F.coalesce(F.col(key).cast("string"), F.lit(" "))

    by = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"),
                        by.alias("by"))
    times = F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("by") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        (F.col("by") != 0).alias("here"), F.explode(times).alias("copy")).drop("copy")
