"""Least-cost repair of conversations' structure by layers of cost, after Wu and Manber.

Legal orders of roles are ``(s?(ua)+)?``. For every turn there is a bitset of the grammar's
states for each cost: the states from which the turns from there on can be brought to an
accepting state at that cost. All layers of a turn are one word, cost c in bits 4c to 4c+3,
so an edit of cost c is a shift by 4c. No two states' least costs differ by more than 12,
so sixteen layers over a base are enough, and a word with its base takes the place of
all layers. The first layer that holds the start state before the first turn is the cost
of the repair; from there a trace along the bits takes the least letter of each turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clarion.functions.lineage import extended

#: Costs of the edits; a truncated turn that is kept or gets another role costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: The grammar's states: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
INITIALS = "sua"
#: State after a turn of each initial (other initials have none), and the initial that may be inserted or put in a turn's place.
AFTER = [{START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {}]
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a turn, in their order.
SOUND, BLANK, DUPLICATE, CUT = range(4)
LETTERS = "DIKR"
LAYERS = 16
#: A layer's four bits; one bit of every layer, with room for what an edit and insertions add.
_ROW, _ONES = 15, int("1" * 2 * LAYERS, 16)

#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"


def _before(word: int, step: dict[int, int]) -> int:
    """In every layer the states that ``step`` leads to a state of ``word``."""
    out = 0
    for p, q in step.items():
        out |= (word >> q & _ONES) << p
    return out


def _first(word: int) -> int:
    """Of each state only its first layer."""
    out = seen = 0
    for c in range(0, 8 * LAYERS, 4):
        new = word >> c & _ROW & ~seen
        out |= new << c
        seen |= new
    return out


def _inserted(word: int) -> int:
    """With turns inserted; more than two in a row lead to no new state."""
    for _ in range(2):
        word |= _before(word, NEXT) << 4 * INSERT
    return _first(word)


def _costs(word: int) -> list[int]:
    return [next(c for c in range(2 * LAYERS) if word >> 4 * c + q & 1) for q in range(4)]


#: The layers after the last turn.
LAST = _inserted(sum(1 << q for q in ACCEPTING))


def _choices(word: int, now: list[int], code: int) -> int:
    """Of each state the least letter that begins a cheapest repair, two bits each.

    ``word`` are the layers after the turn, ``now`` the states' first layers before it.
    """
    more = TRUNCATED if code >> 2 == CUT else 0
    out = 0
    for q in range(4):
        ways = [(DELETE, q), (INSERT, None)]
        if code >> 2 not in (BLANK, DUPLICATE):
            ways += [(more, AFTER[code & 3].get(q)), (REROLE + more, NEXT[q])]
        for k, (cost, to) in enumerate(ways):
            if k == 1:
                fits = now[NEXT[q]] + INSERT == now[q]
            else:
                fits = to is not None and now[q] >= cost and bool(word >> 4 * (now[q] - cost) + to & 1)
            if fits:
                out |= k << 2 * q
                break
    return out


@cache
def _step(word: int, code: int) -> tuple[int, int, int]:
    """The layers before a turn of ``code`` (initial and fault) over their base, what the base grew by, and the choices there."""
    new = word << 4 * DELETE
    if code >> 2 not in (BLANK, DUPLICATE):
        more = TRUNCATED if code >> 2 == CUT else 0
        new |= _before(word, AFTER[code & 3]) << 4 * more | _before(word, NEXT) << 4 * (REROLE + more)
    new = _inserted(new)
    choices = _choices(word, _costs(new), code)
    up = 0
    while not new & _ROW:
        new >>= 4
        up += 1
    assert new >> 4 * LAYERS == 0
    return new, up, choices


def repair(codes: bytes | bytearray) -> tuple[int, str]:
    """Cost and audit of the least repair of turns, each given as place of its initial in INITIALS (3: another) + 4 * fault."""
    chosen = bytearray(len(codes))
    word, cost = LAST, 0
    for i in range(len(codes) - 1, -1, -1):
        word, up, chosen[i] = _step(word, codes[i])
        cost += up
    cost += _costs(word)[START]
    state, audit = START, bytearray()
    for code, choice in zip(codes, chosen):
        while (k := choice >> 2 * state & 3) == 1:
            audit += b"I"
            state = NEXT[state]
        audit.append(ord(LETTERS[k]))
        if k:
            state = NEXT[state] if k == 3 else AFTER[code & 3][state]
    while state not in ACCEPTING:
        audit += b"I"
        state = NEXT[state]
    return cost, audit.decode()


class _Report:
    """One conversation: first its turns' codes, in order, then their roles and texts, each seen once and not kept."""

    def __init__(self):
        self.codes = bytearray()
        self.gaps = self.illegal = 0
        self.least = self.last = None
        self.audit = None

    def code(self, code: int, turn: int | None) -> None:
        if self.codes and (self.codes[-1] & 3, code & 3) not in ((0, 1), (1, 2), (2, 1)):
            self.illegal += 1
        self.codes.append(code)
        if turn is not None:
            if self.last is not None and turn > self.last:
                self.gaps += turn - self.last - 1
            self.last = turn

    def text(self, role: str, text: str) -> None:
        if self.audit is None:
            self._begin()
        code = self.codes[self.seen]
        self.seen += 1
        self._insertions()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "D":
            return
        if letter == "R":
            self.state = NEXT[self.state]
            role = ROLE[self.state]
        else:
            self.state = AFTER[code & 3][self.state]
        self._line(role, text)

    def _begin(self) -> None:
        self.cost, self.audit = repair(self.codes)
        self.at, self.seen, self.state, self.lines, self.sha = 0, 0, START, 0, hashlib.sha256()

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._line(ROLE[self.state], "")

    def _line(self, role: str, text: str) -> None:
        self.sha.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def row(self) -> tuple:
        if self.audit is None:
            self._begin()
        self._insertions()
        faults = [sum(self.codes.count(f * 4 + k) for k in range(4)) for f in (BLANK, DUPLICATE, CUT)]
        return self.gaps, *faults, self.illegal, self.cost, self.audit, self.sha.hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of conversations after the test's damage; ``gone`` rows are the dropped ones.

    Nulls of role and text, and of ids and turns in the hashed key, are one space. Repeated
    rows share their key and so their damage.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("gone"))


def repaired(rows: DataFrame) -> DataFrame:
    """Report and least repair of each conversation of ``rows`` (conv_id, turn, role, text, gone; see ``damaged``).

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Rows count in the order of turn (nulls first), role and text; ``gone``
    ones only make their conversation appear. A null conv_id is a conversation of its own. A
    role without one of the initials s, u, a, the empty one too, can't be kept. A
    conversation without rows has zeros, an empty audit and the hash of the empty string;
    no rows give no result.

    Rows are shuffled once, by conversation. The order of a conversation's texts is fixed by
    its digest, so one task reads them, one after the other: of a turn it keeps two bytes
    and its letters in the audit, so a very long conversation takes time, not memory.
    """
    conv = ["conv_id", "gone"]
    order = [F.asc_nulls_first("turn"), "role", "text"]
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    own = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "gone").repartition("conv_id")
    # Both windows keep the rows where they are: equal conversations are together.
    own = own.withColumn("n", F.row_number().over(Window.partitionBy(*conv).orderBy(*order)))
    own = own.withColumn("first", F.row_number().over(Window.partitionBy(*conv, "role", "text").orderBy("n")) == 1)
    fault = F.when(end == "", BLANK).when(~F.col("first"), DUPLICATE).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(SOUND)
    initial = F.substring("role", 1, 1)
    code = F.coalesce(*[F.when(initial == x, k) for k, x in enumerate(INITIALS)], F.lit(3)) + 4 * fault
    null = lambda kind: F.lit(None).cast(kind)
    as_code = F.struct(F.lit(0).alias("kind"), F.when(F.col("gone"), -1).otherwise(code).cast("int").alias("code"), F.col("turn"), null("string").alias("role"), null("string").alias("text"))
    as_text = F.struct(F.lit(1).alias("kind"), null("int").alias("code"), null("bigint").alias("turn"), F.col("role"), F.col("text"))
    both = F.explode(F.when(F.col("gone"), F.array(as_code)).otherwise(F.array(as_code, as_text)))
    stream = own.select("conv_id", "n", both.alias("x")).select("conv_id", "n", "x.*").sortWithinPartitions("conv_id", "kind", "n")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kind = pa.int64()

    def emit(done: list[tuple], id_type) -> pa.RecordBatch:
        columns = list(zip(*done)) if done else [[] for _ in names]
        types = [id_type, *[kind] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]):
        current, report, id_type, done = None, None, None, []
        for batch in batches:
            id_type = batch.column(0).type
            for conv_id, _, what, code, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if report is None or conv_id != current:
                    if report is not None:
                        done.append((current, *report.row()))
                    current, report = conv_id, _Report()
                if what:
                    report.text(role, text)
                elif code >= 0:
                    report.code(code, turn)
            if len(done) > 1000:
                yield emit(done, id_type)
                done = []
        if report is not None:
            done.append((current, *report.row()))
            yield emit(done, id_type)

    return stream.mapInArrow(scan, extended(stream.select("conv_id").schema, "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"))
