"""Exact removal of repeated byte strings with a logarithmic family of suffix arrays.

A string of ``length`` bytes that occurs twice is found through one suffix. Of the
k-grams in each window of ``length`` bytes the one with the least hash is the window's
anchor; equal windows have their anchor at the same place, and neighbouring windows
mostly share one, so about one suffix in a hundred is kept. A batch's suffix array is
the table of its anchored suffixes in the order of their bytes: the first 16 bytes from
the anchor, then a 128-bit digest (BLAKE2) of the whole stretch of windows that share it.
A new batch is merge-scanned against the existing levels: stretches that a level has too,
or that the batch has twice, are repeated, and their places are reported; in the same pass
the batch merges with the levels of its own size, which therefore grow geometrically.
Equal stretches settle almost all windows without a look at the texts; anchors that stand
in different stretches, at the edges of repeats, are neighbours in the merged array and are
compared window by window, in bytes. Anchors in more stretches than ``CELL`` go by counted
digests of windows instead, so no task holds a hot passage.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from clarion.functions.lineage import extended, remove, shared_dir, stored, tidy
from clarion.llm.decontaminate import shards

LENGTH, GRAM, BATCHES, FAN = 200, 16, 4, 2
#: Stretches under one anchor that one task compares; a stretch has at most 2 * LENGTH bytes, so that is 3 MB at most.
CELL = 8192
#: Bytes of text hashed at once.
SLICE = 1_500_000

_M = 0x9E3779B97F4A7C15 | 1
_INV = pow(_M, -1, 1 << 64)
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([b]), 9) for b in range(256)], dtype=np.uint64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _M, np.uint64), np.full(n, _INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Hashes of any stretch of a buffer from its prefix sums."""

    def __init__(self, data: bytes):
        n = len(data)
        up, self.down = _powers(1 << max(12, n.bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * up[:n], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, k: int) -> np.ndarray:
        """The hash of every k-gram."""
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:n]) * self.down[:n])


def stretches(data: bytes, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, bytes from the anchor, digest) of each stretch in ``data``.

    ``ends`` are the ends of the texts that ``data`` strings together; windows lie within one
    text. Bytes from the anchor are two integers in the order of the bytes, 16 bytes or the
    k-gram if that is shorter; digests are two integers.
    """
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none.reshape(0, 2), none.reshape(0, 2)
    hashed = Hashed(data)
    grams = hashed.grams(gram)
    # The hash's upper 40 bits and the place in one number: the least is the leftmost of the least.
    low = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    anchor = (low[:n] & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    inside = np.arange(n) + length <= np.repeat(ends, sizes)[:n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [n]])
    keep = inside[first]
    first, last = first[keep], last[keep]
    head = np.zeros((len(first), 16), np.uint8)
    head[:, : min(gram, 16)] = np.frombuffer(data, np.uint8)[anchor[first][:, None] + np.arange(min(gram, 16))]
    suffix = (head.view(">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    blake = hashlib.blake2b
    digest = b"".join([blake(data[i:j], digest_size=16).digest() for i, j in zip(first.tolist(), (last + length - 1).tolist())])
    return first, last - first, suffix, np.frombuffer(digest, "<i8").reshape(-1, 2)


#: An entry's place in the suffix order.
KEY = ["s1", "s2", "g1", "g2"]


def suffixes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The anchored suffixes of (doc_id, text): (s1, s2, g1, g2, c, doc_id, d, pos, n).

    d is xxhash64 of the text; pos counts bytes, n windows. A stretch that a slice of the
    input holds twice is entered once with c = 2, and its places follow with null keys.
    """
    own = docs.select("doc_id", F.col("text"))
    names = [*KEY, "c", "doc_id", "d", "pos", "n"]

    def scan(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
            at = 0
            for part in shards(texts, SLICE):
                part = [t or b"" for t in part]
                # A text longer than a slice is taken in slices that overlap by less than a window.
                if len(part) == 1 and len(part[0]) > 2 * SLICE:
                    pieces = [(0, a, part[0][a : a + SLICE + length - 1]) for a in range(0, len(part[0]) - length + 1, SLICE)]
                    groups = [[p] for p in pieces]
                else:
                    groups = [[(i, 0, t) for i, t in enumerate(part)]]
                digest = np.array([xxhash.xxh64_intdigest(t, 42) for t in part], dtype=np.uint64).view(np.int64)
                for group in groups:
                    ends = np.cumsum([len(t) for _, _, t in group])
                    first, n, suffix, g = stretches(b"".join(t for _, _, t in group), ends, length, gram)
                    if not len(first):
                        continue
                    slot = np.searchsorted(ends, first, "right")
                    row = np.array([i for i, _, _ in group])[slot]
                    pos = first - np.concatenate([[0], ends[:-1]])[slot] + np.array([a for _, a, _ in group])[slot]
                    _, one, back, times = np.unique(g[:, 0], return_index=True, return_inverse=True, return_counts=True)
                    c = np.minimum(times, 2)
                    again = np.flatnonzero(times[back] > 1)
                    # Places of repeated stretches, joined where they follow each other in a text.
                    r, p, m = row[again], pos[again], n[again]
                    start = np.ones(len(again), bool)
                    start[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + m[:-1])
                    heads = np.flatnonzero(start)
                    m = np.add.reduceat(m, heads) if len(heads) else m
                    r, p = r[heads], p[heads]
                    none = pa.nulls(len(r), pa.int64())
                    keys = [pa.array(np.ascontiguousarray(x[one, k])) for x in (suffix, g) for k in (0, 1)]
                    for rows, columns in ((row[one], [*keys, pa.array(c), pos[one], n[one]]), (r, [none] * 4 + [pa.array(np.full(len(r), 2)), p, m])):
                        yield pa.RecordBatch.from_arrays(
                            [*columns[:5], ids.take(pa.array(at + rows)), pa.array(digest[rows]), pa.array(columns[5]), pa.array(columns[6])], names=names
                        )
                at += len(part)

    kind = own.schema["doc_id"].dataType.simpleString()
    head = own.sparkSession.createDataFrame([], "s1 bigint, s2 bigint, g1 bigint, g2 bigint, c bigint").schema
    return own.mapInArrow(scan, extended(head, f"doc_id {kind}, d bigint, pos bigint, n bigint"))


class LogIndex:
    """Suffix arrays in levels under ``path``; level k holds about FAN ** k batches, and a later run can open them again.

    An entry is a stretch (``KEY``) with the number of its places, of which two at most are
    counted, and one place. Every level is a table whose files are in suffix order.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        self.levels: list[tuple[int, str]] = []
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(at):
            # A level counts once its table is complete and no later one took its entries in.
            found = {x.getPath().getName(): x.getPath().toString() for x in files.listStatus(at)}
            whole = {k: v for k, v in found.items() if k.startswith("level-") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{v}/_SUCCESS"))}
            gone = {part for k in whole for part in k.split("-")[3:]}
            self.levels = [(int(k.split("-")[1]), v) for k, v in sorted(whole.items()) if k.split("-")[2] not in gone]

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths).select(*KEY, "c", "place")

    @staticmethod
    def array(places: DataFrame) -> DataFrame:
        """The suffix array of a batch's places: equal stretches meet, and their places add up."""
        return places.select(*KEY, "c", F.struct("doc_id", "d", "pos", "n").alias("place"))

    def add(self, places: DataFrame) -> DataFrame:
        """Enters a batch's suffixes; returns (doc_id, d, pos, n) of its stretches, and of those in the levels, that are now known twice.

        One merge-scan over the new array and all levels finds the matches and writes the
        new array, merged with FAN - 1 levels of its size if there are so many, and so on.
        """
        size, merging = 0, []
        left = list(self.levels)
        while len(same := [x for x in left if x[0] == size]) >= FAN - 1:
            merging += same
            left = [x for x in left if x[0] != size]
            size += 1
        parts = [self.array(places).withColumn("source", F.lit(0))]
        for source, levels in ((1, merging), (2, left)):
            if levels:
                parts.append(self._read([p for _, p in levels]).withColumn("source", F.lit(source)))
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        new, old, own = F.col("source") == 0, F.col("source") > 0, F.col("source") < 2
        # Counts stop at two and one place stands for the stretch, so a hot stretch combines before the shuffle.
        met = every.groupBy(*KEY).agg(
            F.sum("c").alias("total"), F.max(new).alias("new"), F.sum(F.when(own, F.col("c"))).alias("own"),
            F.min(F.when(old & (F.col("c") == 1), F.col("place"))).alias("single"), F.min(F.when(own, F.col("place"))).alias("place"),
        )
        met = met.where("own > 0").select(
            *KEY, F.least(F.when(F.col("new"), F.col("total")).otherwise(F.col("own")), F.lit(2)).alias("c"), "place",
            (F.col("new") & (F.col("total") > 1)).alias("matched"), F.when(F.col("new"), F.col("single")).alias("single"),
        )
        names = "".join(f"-{p.rstrip('/').rsplit('/', 1)[1].split('-')[2]}" for _, p in merging)
        path = f"{self.path}/level-{size}-{uuid.uuid4().hex}{names}"
        with tidy(self.spark):
            met.sortWithinPartitions(*KEY).write.option("compression", "zstd").parquet(path)
        self.levels = [*left, (size, path)]
        for _, p in merging:
            remove(self.spark, p)
        written = self.spark.read.parquet(path)
        hits = places.join(written.where("matched").select(*KEY), KEY, "left_semi").select("doc_id", "d", "pos", "n")
        return hits.unionByName(written.where("single is not null").select("single.*"))

    def entries(self) -> DataFrame:
        """All levels as one array: KEY, c, place."""
        out = self._read([p for _, p in self.levels])
        if len(self.levels) == 1:
            return out
        return out.groupBy(*KEY).agg(F.least(F.sum("c"), F.lit(2)).alias("c"), F.min("place").alias("place"))


def _regions(docs: DataFrame, requests: DataFrame, length: int, windows: bool) -> DataFrame:
    """The bytes of requested stretches; with ``windows`` two digests of each of their windows instead."""
    asked = requests.groupBy("doc_id", "d").agg(F.collect_list(F.struct("pos", "n", "h", "single")).alias("asked"))
    rows = _joined(docs, asked, "inner").select("doc_id", "d", "text", "asked")
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = "w1 bigint, w2 bigint" if windows else "region binary"

    def scan(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, asked in enumerate(batch.column(3).to_pylist()):
                text = texts[i].as_py() or b""
                h, single, pos, made = [], [], [], []
                for a in asked:
                    if windows:
                        for p in range(a["pos"], a["pos"] + a["n"]):
                            x = hashlib.blake2b(text[p : p + length], digest_size=16).digest()
                            h.append(a["h"])
                            single.append(a["single"])
                            pos.append(p)
                            made.append(x)
                    else:
                        h.append(a["h"])
                        single.append(a["single"])
                        pos.append(a["pos"])
                        made.append(text[a["pos"] : a["pos"] + a["n"] + length - 1])
                ids = batch.column(0).take(pa.array([i] * len(h), pa.int64()))
                d = batch.column(1).take(pa.array([i] * len(h), pa.int64()))
                cells = [pa.array(np.frombuffer(b"".join(made), "<i8")[k::2]) for k in (0, 1)] if windows else [pa.array(made, pa.binary())]
                names = ["w1", "w2"] if windows else ["region"]
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(single, pa.bool_()), ids, d, pa.array(pos, pa.int64()), *cells], names=["h", "single", "doc_id", "d", "pos", *names])

    head = docs.sparkSession.createDataFrame([], "h bigint, single boolean").schema
    return rows.mapInArrow(scan, extended(head, f"doc_id {kind}, d bigint, pos bigint, {last}"))


def _joined(docs: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    other = spans.select(F.col("doc_id").alias("_i"), F.col("d").alias("_d"), *[c for c in spans.columns if c not in ("doc_id", "d")])
    return docs.join(other, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("d") == F.col("_d")), how)


def _verified(data: bytes, start: np.ndarray, hit: np.ndarray, one: np.ndarray, times: np.ndarray, length: int) -> np.ndarray:
    """Which windows ``hit`` have a twin in bytes. ``one`` is the first window of the same hash, ``times`` how many there are."""
    if not len(hit):
        return np.zeros(0, bool)
    view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
    same = np.concatenate([(view[start[hit[k : k + 8192]]] == view[start[one[k : k + 8192]]]).all(axis=1) for k in range(0, len(hit), 8192)])
    # Where a hash stands for different bytes, or the first window is compared with itself alone, count the bytes.
    odd = set(one[~same].tolist())
    if odd:
        doubt = np.array([o in odd for o in one.tolist()])
        of = [data[start[h] : start[h] + length] for h in np.concatenate([hit[doubt], np.array(sorted(odd))])]
        twice = {x for x, k in Counter(of).items() if k > 1}
        same[doubt] = [x in twice for x in of[: int(doubt.sum())]]
    return same


def _settle(regions: DataFrame, length: int) -> DataFrame:
    """(doc_id, d, pos, n) of the windows of single stretches that another stretch of their anchor has too."""
    kind = regions.schema["doc_id"].dataType.simpleString()
    dealt = regions.repartition("h").sortWithinPartitions("h")

    def decide(table: pa.Table):
        data = table.column("region").to_pylist()
        sizes = np.array([len(x) for x in data])
        n = np.maximum(sizes - length + 1, 0)
        row = np.repeat(np.arange(len(data)), n)
        begin = np.cumsum(sizes) - sizes
        local = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = begin[row] + local
        key = Hashed(b"".join(data)).of(start, start + length) ^ _mix(table.column("h").to_numpy().view(np.uint64))[row]
        _, one, back, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        single = table.column("single").to_numpy()
        hit = np.flatnonzero((times[back] > 1) & single[row])
        hit = hit[_verified(b"".join(data), start, hit, one[back[hit]], times[back[hit]], length)]
        if not len(hit):
            return None
        r, p = row[hit], local[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
        heads = np.flatnonzero(new)
        runs = np.diff(np.concatenate([heads, [len(hit)]]))
        r, p = r[heads], p[heads]
        take = pa.array(r)
        pos = table.column("pos").to_numpy()[r] + p
        return pa.RecordBatch.from_arrays([table.column("doc_id").combine_chunks().take(take), table.column("d").combine_chunks().take(take), pa.array(pos), pa.array(runs)], names=["doc_id", "d", "pos", "n"])

    def scan(batches):
        held: list[pa.RecordBatch] = []  # rows of the last anchor, CELL at most, until its end is seen
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.column(5).nbytes
            if size < SLICE:
                continue
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                if (out := decide(table.slice(0, cut))) is not None:
                    yield out
                held = table.slice(cut).combine_chunks().to_batches()
                size = sum(b.column(5).nbytes for b in held)
        if held and (out := decide(pa.Table.from_batches(held))) is not None:
            yield out

    return dealt.mapInArrow(scan, f"doc_id {kind}, d bigint, pos bigint, n bigint")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, cell: int = CELL) -> DataFrame:
    """(doc_id, d, spans): runs of windows, by first byte and number, that occur elsewhere in ``docs`` (doc_id, d, text)."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"
    made = suffixes(docs, length, gram).withColumn("batch", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(batches)), F.lit(0)).cast("int"))
    made.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    found = spark.read.schema(made.schema).parquet(path)
    index = LogIndex(spark)
    used = [path, index.path]
    parts = [found.where("s1 is null").select("doc_id", "d", "pos", "n")]
    for b in range(batches):
        parts.append(stored(index.add(found.where((F.col("batch") == b) & F.col("s1").isNotNull())), used))
    entries = index.entries().withColumn("h", F.xxhash64("s1", "s2"))
    # Anchors with several stretches of which one at least has a single place.
    mixed = entries.groupBy("h").agg(F.count("*").alias("m"), F.count_if(F.col("c") == 1).alias("singles")).where("m > 1 and singles > 0").select("h", "m")
    asked = stored(entries.join(mixed, "h").select("place.*", "h", (F.col("c") == 1).alias("single"), "m"), used)
    parts.append(stored(_settle(_regions(docs, asked.where(F.col("m") <= cell), length, False), length), used))
    if not asked.where(F.col("m") > cell).isEmpty():
        wide = _regions(docs, asked.where(F.col("m") > cell), length, True)
        equal = wide.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
        parts.append(wide.where("single").join(equal, ["w1", "w2"]).select("doc_id", "d", "pos", F.lit(1).cast("bigint").alias("n")))
    spans = parts[0]
    for p in parts[1:]:
        spans = spans.unionByName(p)
    out = stored(spans.groupBy("doc_id", "d").agg(F.collect_list(F.struct("pos", "n")).alias("spans")))
    for x in used:
        remove(spark, x)
    return out


def cut(text: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int]:
    """``text`` without the bytes of runs of windows (first, number), and the number of maximal removed runs."""
    out, runs, end = [], 0, -1
    at = 0
    for p, n in sorted(spans):
        stop = p + n + length - 1
        if p > end:
            out.append(text[at:p])
            runs += 1
        end = at = max(end, stop)
    out.append(text[at:])
    return b"".join(out), runs


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row of ``docs``.

    kept is what is left, as bytes. Null texts count as empty; texts shorter than
    ``length`` stay; repeated rows and copies lose all that repeats, each of them. Other
    columns, of whatever name, don't matter; no rows give no result.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("d", F.xxhash64("text"))
    rows = _joined(own, repeated(own, length, **options), "left").select("doc_id", "text", "spans")
    kind = own.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for batch in batches:
            n, removed, runs, digest, kept = [], [], [], [], []
            for t, s in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                left, k = cut(t, [(x["pos"], x["n"]) for x in s or ()], length)
                n.append(len(t))
                removed.append(len(t) - len(left))
                runs.append(k)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return rows.mapInArrow(scan, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
