"""Repair against a search over all edit scripts, and the whole query against a plain reading of its rules."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clarion.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault): cheapest first, then the least audit, by uniform-cost search over scripts."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if i == len(rows) and LEGAL.fullmatch(roles):
            return cost, audit, lines
        # What a script may still become depends on the last two roles alone.
        state = (i, roles[-1:], len(roles) > 1)
        if state in seen:
            continue
        seen.add(state)
        ways = [("I", 5, i, r) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            ways.append(("D", 2, i + 1, None))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                ways += [("K", more, i + 1, role)] + [("R", 1 + more, i + 1, r) for r in ("user", "assistant")]
        for letter, extra, to, role in ways:
            new = roles if role is None else roles + role[:1]
            if role is not None and (not role or not re.fullmatch(r"(s?(ua)*u?)?", new)):
                continue
            line = () if role is None else (f"{role}:{'' if letter == 'I' else rows[i][1]}",)
            heapq.heappush(heap, (cost + extra, audit + letter, to, new, lines + line))


def plain(table):
    """The contract read row by row."""
    held = {}
    for conv, turn, role, text in table:
        rows = held.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty = set(), []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        cost, audit, lines = brute(faulty)
        n = [sum(f == kind for _, _, f in faulty) for kind in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def of(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("n", range(5))
def test_every_short_conversation(n):
    names = ["system", "user", "assistant", "tool"]
    for codes in itertools.product(range(16), repeat=n) if n < 4 else (random.Random(k).choices(range(16), k=9) for k in range(1500)):
        rows = [(names[c & 3], f"t{i}", [None, "blank", "duplicate", "truncated"][c >> 2]) for i, c in enumerate(codes)]
        assert C.repair(bytes(codes)) == brute(rows)[:2]


def test_few_words_of_layers():
    """The layers are a finite machine: long random conversations meet few words, all of sixteen layers."""
    C._step.cache_clear()
    C.repair(random.Random(1).choices(range(16), k=200_000))
    assert C._step.cache_info().currsize < 2000


def test_whole_query_as_the_rules_say(spark):
    rng = random.Random(11)
    ends = [".", "!", "?", "", " ", "\n", ". \t", "é", "…", " "]
    table = []
    for conv in [*range(150), None, -5]:
        for turn in range(rng.randrange(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "unknown", "User", None])
            text = rng.choice([None, "", "same.", "same.", " \x0b\x0c\r", "Hello there" + rng.choice(ends), f"w{turn}" * 3 + rng.choice(ends), "a:b\nc."])
            table.append((conv, rng.choice([turn, turn, turn * 3, None, 4]), role, text))
            if rng.random() < 0.1:
                table.append(table[-1])
    df = spark.createDataFrame(table, SCHEMA).withColumn("Code", F.lit(1)).withColumn("n", F.lit("x")).repartition(5)
    want = plain(table)
    assert of(C.repaired(C.damaged(df))) == want
    assert any(v[6] == "" and v[5] == 0 for v in want.values())


def test_conversations_that_lose_all_rows_and_empty_tables(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = of(C.repaired(C.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert C.repaired(C.damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_long_conversation_and_a_long_text(spark):
    """One conversation with most of the rows: its codes and letters are held, its texts pass by."""
    n = 30_000
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"), F.expr("concat('turn ', id, '.')").alias("text"))
    df = df.unionByName(spark.createDataFrame([(2, 0, "user", "x" * 2_000_000 + "."), (2, 1, "assistant", "y" * 50_000 + " " * 200_000)], SCHEMA))
    got = of(C.repaired(C.damaged(df)))
    table = [tuple(r) for r in df.collect()]
    assert got[2] == plain([t for t in table if t[0] == 2])[2]
    audit = got[1][6]
    kept = sum(x in "KRD" for x in audit)
    dropped = sum(zlib.crc32(f"1:{k}".encode()) % 20 == 0 for k in range(n))
    repeated = sum(zlib.crc32(f"1:{k}".encode()) % 20 == 3 for k in range(n))
    assert kept == n - dropped + repeated and got[1][2] == repeated
