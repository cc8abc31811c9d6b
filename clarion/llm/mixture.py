"""Mixture-controlled packing: deficit round robin over one queue per source.

Every window of the output stream gives each queue its quantum of tokens, in the queues'
order. A quantum is a fraction of tokens; what a queue could not use of it, less than one
token, is its deficit and is carried to the next window. When a queue is empty, the others
share the window anew. As documents may be cut anywhere, a queue is always served to its
last whole token, so its service before window k is a closed form of k, and a token's place
in the stream follows from its place in its queue alone. Tasks therefore need nothing of
each other but how many tokens of each source the parts before theirs hold: the deficits
are carried across partitions as they are across windows.

The stream is cut into sequences of equal size. The rest at its end is cut into sequences
of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from clarion.functions.lineage import extended, stored
from clarion.llm import tokens

SIZE, END = 2048, 1
#: Tokens of a window: so many sequences are filled to the target proportions.
WINDOW = 16 * SIZE
#: Sources with less than this part of all tokens share one queue; so there are 513 queues at most.
QUEUE_SHARE = 1 / 512
#: Units of a token in which quanta are counted.
UNIT = 256
#: Rows of places of (part, source) that are broadcast, at most; more meet their documents in a shuffle.
BROADCAST_ROWS = 300_000
#: Windows whose places a task remembers.
REMEMBERED = 4096
#: Pieces of text whose ids a Python worker remembers; the scan holds nothing else of size.
PIECES = 900_000


class Rounds:
    """The closed form: where the round robin puts each token of each queue.

    ``totals`` are the queues' tokens, ``weights`` their target proportions. While no queue
    runs empty the service before the m-th window of a phase is floor(m * quantum / UNIT)
    tokens; a phase ends with the window in which a queue runs empty.
    """

    def __init__(self, totals: list[int], weights: list[float], window: int = WINDOW):
        self.totals = np.array(totals, np.int64)
        done = np.zeros(len(totals), np.int64)
        #: Of each phase: its first window, what is served before it, the queues' quanta.
        self.first, self.base, self.quanta = [0], [done], []
        while (done < self.totals).any():
            share = np.where(done < self.totals, np.array(weights, float), 0.0)
            quanta = np.where(share > 0, np.maximum(1, np.rint(share / share.sum() * window * UNIT)), 0).astype(np.int64)
            left = np.where(share > 0, self.totals - done, np.iinfo(np.int64).max // UNIT)
            windows = int((-(-left * UNIT // np.maximum(1, quanta)))[share > 0].min())
            done = np.minimum(self.totals, done + (windows * quanta // UNIT))
            self.quanta.append(quanta)
            self.first.append(self.first[-1] + windows)
            self.base.append(done)
        self.of_queue = [[int(b[q]) for b in self.base] for q in range(len(totals))]
        self.known: dict[int, np.ndarray] = {}

    def served(self, k: int) -> np.ndarray:
        """Tokens of each queue that the windows before ``k`` take."""
        j = min(bisect_right(self.first, k) - 1, len(self.quanta) - 1)
        return np.minimum(self.base[j + 1], self.base[j] + (k - self.first[j]) * self.quanta[j] // UNIT)

    def starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each queue the stream place where window ``k`` serves it, and what was served of it before."""
        if k not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            before, after = self.served(k), self.served(k + 1)
            self.known[k] = np.stack([before.sum() + np.cumsum(after - before) - (after - before), before, after])
        return self.known[k]

    def runs(self, q: int, p: int, n: int) -> list[tuple[int, int, int]]:
        """(first of them, length, stream place) of the stretches that ``n`` tokens from place ``p`` of queue ``q`` become."""
        out: list[tuple[int, int, int]] = []
        at = 0
        while at < n:
            x = p + at
            j = bisect_right(self.of_queue[q], x) - 1
            m = ((x - self.of_queue[q][j] + 1) * UNIT - 1) // int(self.quanta[j][q])
            place, before, after = (int(v) for v in self.starts(self.first[j] + m)[:, q])
            length = min(n - at, after - x)
            place += x - before
            if out and out[-1][2] + out[-1][1] == place:
                out[-1] = (out[-1][0], out[-1][1] + length, out[-1][2])
            else:
                out.append((at, length, place))
            at += length
        return out


class Sequences:
    """Cuts of a stream of ``total`` tokens."""

    def __init__(self, total: int, size: int = SIZE):
        self.size, self.full = size, total // size
        rest, at = total % size, self.full * size
        self.tail = [at]
        for bit in range(rest.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                at += 1 << bit
                self.tail.append(at)

    def cuts(self, place: int, n: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of the pieces of ``n`` tokens from ``place`` on."""
        out = []
        while n:
            if place < self.tail[0]:
                sequence, offset = divmod(place, self.size)
                room = self.size - offset
            else:
                k = bisect_right(self.tail, place) - 1
                sequence, offset, room = self.full + k, place - self.tail[k], self.tail[k + 1] - place
            take = min(n, room)
            out.append((take, sequence, offset))
            place, n = place + take, n - take
        return out


@cache
def _plan(made: Broadcast) -> tuple[Rounds, Sequences]:
    """One plan per Python worker."""
    totals, weights, window, size = made.value
    return Rounds(totals, weights, window), Sequences(sum(totals), size)


def _encoded(docs: DataFrame, path: str, doc_id: str, text: str, source: str, split: str | None, end: int) -> DataFrame:
    """(part, source, own, n, doc_id, ids): own is how many tokens of the source stand before in the part."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.col(text).alias("text"))

    def scan(batches):
        encoder = tokens.encoder(path, split, PIECES)
        # Two bytes an id where the vocabulary allows it: this table is what is written.
        narrow = max(end + 1, encoder.tokenizer.get_vocab_size()) <= 1 << 16
        part, before = TaskContext.get().partitionId(), {}
        for batch in tokens.parts(batches):
            sources, first, n, cells = batch.column(1).to_pylist(), [], [], []
            for s, ids in zip(sources, encoder.encode_all(batch.column(2).to_pylist())):
                ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end))
                first.append(before.get(s, 0))
                n.append(len(ids))
                before[s] = first[-1] + n[-1]
                cells.append(ids.astype("<u2" if narrow else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int32()), batch.column(1), pa.array(first, pa.int64()), pa.array(n, pa.int64()), batch.column(0), pa.array(cells, pa.binary())],
                names=["part", "source", "own", "n", "doc_id", "ids"],
            )

    return own.mapInArrow(scan, f"part int, source string, own bigint, n bigint, doc_id {own.schema['doc_id'].dataType.simpleString()}, ids binary")


def pack_mixture(
    docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: dict[str, float] | None = None,
    size: int = SIZE, window: int = WINDOW, split: str | None = tokens.SPACED, end: int = END,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue) for every piece of every row of ``docs``.

    ``weights`` are the sources' target proportions (positive; sources that it lacks, and all
    without it, weigh as many parts as they have of all tokens, so that queues end together).
    A null or empty text is its end token; a null source counts as the empty string. Sources
    with less than QUEUE_SHARE of all tokens and no weight of their own share the queue
    "(rest)", in the order of parts and sources. Repeated rows are packed for themselves,
    columns besides the three named ones have no influence, no rows give no result.
    """
    spark = docs.sparkSession
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    rows = stored(_encoded(docs, path, doc_id, text, source, split, end), compression="zstd")
    sums = rows.groupBy("part", "source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") >= total * QUEUE_SHARE
    if weights:
        large |= F.col("source").isin(list(weights))
    own = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).where(large).collect()}
    names = [*sorted(own), "(rest)"]
    totals = [*(own[s] for s in names[:-1]), total - sum(own.values())]
    share = [(weights or {}).get(s, n / total if total else 0.0) for s, n in zip(names, totals)]
    plan = spark.sparkContext.broadcast((totals, share, window, size))
    # Queue places of each part's tokens of each source: a row for each, so the windows see parts, not documents.
    order = spark.createDataFrame([(s, k) for k, s in enumerate(names[:-1])], "source string, queue int")
    sums = sums.join(F.broadcast(order), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names) - 1)))
    before = F.sum("n").over(Window.partitionBy("queue").orderBy("part", "source")) - F.col("n")
    places = stored(sums.select("part", "source", "queue", before.alias("before")))
    if places.count() <= BROADCAST_ROWS:
        places = F.broadcast(places)
    rows = rows.join(places, ["part", "source"]).select("doc_id", "queue", (F.col("before") + F.col("own")).alias("p"), "n", "ids")
    named = pa.array(names)

    def cut(batches):
        rounds, sequences = _plan(plan)
        for batch in batches:
            row, start, length, crc, sequence, offset = [], [], [], [], [], []
            columns = (batch.column(k).to_pylist() for k in range(1, 5))
            for i, (q, p, n, ids) in enumerate(zip(*columns)):
                ids = memoryview(np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")).cast("B")
                for at, m, place in rounds.runs(q, p, n):
                    for take, k, where in sequences.cuts(place, m):
                        row.append(i)
                        start.append(at)
                        length.append(take)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + take)]))
                        sequence.append(k)
                        offset.append(where)
                        at += take
            row = pa.array(row, pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), *numbers, batch.column(3).take(row), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), named.take(batch.column(1).take(row))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    return rows.mapInArrow(cut, extended(rows.select("doc_id").schema, "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, queue string"))
