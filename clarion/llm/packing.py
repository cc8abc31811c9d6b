"""Best-fit packing by patterns fitted with non-negative least squares.

Documents become pieces of at most ``size`` tokens. Only the histogram of piece lengths,
``size`` numbers at most, comes to the driver. There patterns of few lengths that fill a
sequence exactly are enumerated, their repeat counts are fitted to the histogram by
non-negative least squares and rounded, and what is left is packed longest first. The
plan maps ranks within a length to places, so pieces find theirs by a binary search.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clarion.functions.lineage import extended, stored
from clarion.llm import tokens

SIZE, END = 4096, 1
#: Splits of the rest beside a pattern's longest piece that are tried, steps of the fit, documents of a pattern at most.
SPLITS, STEPS, DOCUMENTS = 8, 300, 8
#: Rows numbered in one window partition.
RANK_ROWS = 200_000

Pattern = tuple[int, list[tuple[int, int]]]  # repeats, [(length, how many in one sequence)]


def patterns(counts: np.ndarray) -> list[tuple[int, ...]]:
    """Few documents that fill a sequence exactly, their lengths all present in the histogram: two or three
    lengths, or a short one several times with one or two that fill what is left."""
    size = len(counts) - 1
    present = np.flatnonzero(counts)
    out = set()
    for a in present[::-1]:
        rest = size - int(a)
        if rest <= 0:
            continue
        if rest <= a and counts[rest]:
            out.add((int(a), rest))
        # The second length from evenly spaced present ones that leave a present third.
        second = present[(present <= min(rest - 1, a)) & (present * 2 >= rest)]
        second = second[counts[rest - second] > 0]
        for b in second[np.linspace(0, len(second) - 1, min(SPLITS, len(second))).astype(int)] if len(second) else ():
            out.add((int(a), int(b), rest - int(b)))
    for b in present[present * 3 <= size]:
        most = min(DOCUMENTS - 2, (size - 1) // int(b))
        for k in np.unique(np.linspace(2, most, min(SPLITS, most - 1)).astype(int)) if most >= 2 else ():
            rest = size - int(k) * int(b)
            if counts[rest]:
                out.add(tuple(sorted((rest, *[int(b)] * int(k)), reverse=True)))
            other = present[(present * 2 >= rest) & (present < rest)]
            other = other[counts[rest - other] > 0]
            if len(other):
                # Another place among the fitting ones for each length and number, so that patterns differ.
                a = int(other[(int(b) * 7 + int(k)) % len(other)])
                out.add(tuple(sorted((a, rest - a, *[int(b)] * int(k)), reverse=True)))
    return sorted(out, reverse=True)


def fit(choices: list[tuple[int, ...]], counts: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of least squares |A x - counts|, by accelerated projected gradients.

    Column p of A says how often each length is in pattern p; A is kept as its few entries.
    """
    rows = np.array([n for c in choices for n in c])
    cols = np.array([p for p, c in enumerate(choices) for _ in c])
    times = lambda x: np.bincount(rows, x[cols], len(counts))
    back = lambda r: np.bincount(cols, r[rows], len(choices))
    # The largest eigenvalue of A'A is at most its largest row sum.
    step = 1 / max(1.0, back(times(np.ones(len(choices)))).max())
    x = y = np.zeros(len(choices))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y - step * back(times(y) - counts))
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


def plan(counts: np.ndarray) -> list[Pattern]:
    """Patterns with repeats that use every length as often as ``counts`` says."""
    left = counts.astype(np.int64).copy()
    size = len(left) - 1
    out: list[Pattern] = []
    if left[size]:
        out.append((int(left[size]), [(size, 1)]))
        left[size] = 0
    choices = patterns(left)
    if choices:
        x = np.rint(fit(choices, left)).astype(np.int64)
        for p in np.argsort(-x, kind="stable"):
            need: dict[int, int] = {}
            for n in choices[p]:
                need[n] = need.get(n, 0) + 1
            repeats = min(int(x[p]), min(int(left[n]) // k for n, k in need.items()))
            if repeats > 0:
                out.append((repeats, sorted(need.items(), reverse=True)))
                for n, k in need.items():
                    left[n] -= repeats * k
    # Residuals: each sequence takes the longest piece left and then, again and again, the longest that fits.
    have = {int(n): int(left[n]) for n in np.flatnonzero(left)}
    order = sorted(have)
    while order:
        need, room = {}, size
        at = len(order)
        while (at := bisect_right(order, room, 0, at)) > 0:
            n = order[at - 1]
            k = min(have[n], room // n)
            need[n] = k
            room -= n * k
            at -= 1
        repeats = min(have[n] // k for n, k in need.items())
        out.append((repeats, list(need.items())))
        for n, k in need.items():
            have[n] -= repeats * k
            if not have[n]:
                order.pop(bisect_right(order, n) - 1)
    return out


def places(made: list[Pattern]) -> dict[str, np.ndarray]:
    """The plan as sorted ranges of ranks: (length, first rank) -> sequence, how many of it there, offset."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for repeats, parts in made:
        offset = 0
        for n, k in parts:
            first = taken.get(n, 0)
            rows.append((n, first, sequence, k, offset))
            taken[n] = first + repeats * k
            offset += n * k
        sequence += repeats
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "k", "offset"), table.T))


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, split: str | None = tokens.WORDS, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids with ``end`` after them, cut at every ``size``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    last = int(end).to_bytes(4, "little")

    def scan(batches):
        encode = tokens.encoder(path, split).encode_all
        for batch in tokens.parts(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encode(batch.column(1).to_pylist())):
                ids += last
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a : a + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return own.mapInArrow(scan, extended(own.select("doc_id").schema, "piece int, start bigint, length bigint, ids_crc32 bigint"))


def packed(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """``rows`` (with doc_id, piece, length up to ``size``) with sequence_id and offset."""
    rows = stored(rows)
    n, counts = 0, np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most ``size`` rows
        counts[r["length"]] = r["count"]
    n = int(counts.sum())
    table = rows.sparkSession.sparkContext.broadcast(places(plan(counts)) if n else None)
    # Ranks within a length: a length may hold a third of all rows, so each is numbered in parts.
    parts = max(1, -(-n // RANK_ROWS))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sums = rows.groupBy("length", "_part").count()
    first = sums.select("length", "_part", (F.sum("count").over(Window.partitionBy("length").orderBy("_part")) - F.col("count")).alias("_first"))
    own = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("_own", own).join(first, ["length", "_part"])
    keep = [c for c in rows.columns if c != "_part"]
    ranked = ranked.select(*keep, (F.col("_first") + F.col("_own")).alias("_rank"))
    at = keep.index("length")

    def place(batches):
        p = table.value
        # The first rank is below 2 ** 44 and a length below 2 ** 19: one sorted key for both.
        keys = (p["length"] << 44) + p["first"] if p else None
        for batch in batches:
            length = batch.column(at).to_numpy()
            rank = batch.column(len(keep)).to_numpy()
            k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            turn, slot = np.divmod(rank - p["first"][k], p["k"][k])
            new = [pa.array(p["sequence"][k] + turn), pa.array(p["offset"][k] + slot * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, extended(ranked.select(*keep).schema, "sequence_id bigint, offset bigint"))


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    A null or empty text is its end token. Repeated rows are packed for themselves; no rows give no result.
    """
    return packed(pieces(docs, path, doc_id, text, size), size)
