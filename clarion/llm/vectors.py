"""Product quantisation of vectors, entries searched by annuli of neighbours (exponion search).

A vector's parts look for their nearest entries from their previous ones: with u the distance
to the previous entry, an entry that is as near or nearer lies within 2u of it (triangle
inequality), so only that entry's neighbours, sorted by distance, up to 2u are looked at. All
distances are exact integers: the bound is compared as squared distance <= 4 * u squared.

Each round reads a written table and writes the next one: vectors with their present entries,
and each task's sums for each entry. Those are added up to as many numbers as the codebooks
have, which is all that comes to the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clarion.functions.lineage import extended, remove, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are broadcast, at most; more meet their rows in a shuffle.
BROADCAST_ROWS = 200_000
#: Rows searched at once.
ROWS = 8192

_SCHEMA = "label_key string, v binary, codes binary, error bigint, slot int, sums array<bigint>"


def _quantised(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label_key, v): kept vectors as little-endian 32-bit integers floor(scale * x)."""

    def scan(batches):
        for batch in batches:
            column = batch.column(2)
            length = np.diff(column.offsets.to_numpy())
            keep = ~np.asarray(column.is_null())
            # The lists' own values, without what null lists may hold.
            first = column.offsets.to_numpy()[0]
            values = column.values.slice(first, int(length.sum()))
            x = np.nan_to_num(values.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan, posinf=np.nan, neginf=np.nan)
            bad = np.concatenate([[0], np.cumsum(np.isnan(x))])
            stop = np.cumsum(length)
            keep &= bad[stop] == bad[stop - length]
            with np.errstate(invalid="ignore"):
                whole = np.floor(x * scale)
            if (np.abs(whole[np.repeat(keep, length)]) > 2**26).any():
                raise ValueError(f"components beyond {2**26 // scale} have no exact 64-bit distances")
            cells = np.nan_to_num(whole).astype("<i4").tobytes()
            cells = [cells[4 * (b - n) : 4 * b] if k else None for b, n, k in zip(stop.tolist(), length.tolist(), keep.tolist())]
            kept = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), batch.column(1).take(kept), pa.array(cells, pa.binary()).take(kept)], names=["vec_id", "label_key", "v"])

    return rows.mapInArrow(scan, extended(rows.select("vec_id", "label_key").schema, "v binary"))


class Codebook:
    """Entries of all parts, with each entry's neighbours in order of distance (of equal ones by index)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # part, entry, component
        gap = entries[:, :, None, :] - entries[:, None, :, :]
        between = (gap * gap).sum(-1)
        self.near = np.argsort(between, axis=2, kind="stable")
        self.radius = np.take_along_axis(between, self.near, 2)

    def search(self, part: int, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of the nearest entry of each row of ``x``, ties to the lower index."""
        best, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for a in np.unique(start):
            rows = np.flatnonzero(start == a)
            own = x[rows]
            u = ((own - self.entries[part, a]) ** 2).sum(1)
            code, found = np.full(len(rows), a), u.copy()
            # Rows by falling radius: those that a neighbour concerns are always the first ones.
            order = np.argsort(-u, kind="stable")
            own, limit = own[order], 4 * u[order]
            code, found = code[order], found[order]
            for b, away in zip(self.near[part, a], self.radius[part, a]):
                n = np.searchsorted(-limit, -away, "right")
                if not n:
                    break
                if b == a:
                    continue
                d = ((own[:n] - self.entries[part, b]) ** 2).sum(1)
                nearer = (d < found[:n]) | ((d == found[:n]) & (b < code[:n]))
                found[:n][nearer] = d[nearer]
                code[:n][nearer] = b
            best[rows[order]], least[rows[order]] = code, found
        return best, least


def _round(rows: DataFrame, entries: np.ndarray, last: bool) -> DataFrame:
    """``rows`` (vec_id, label_key, v, codes) with new codes and errors, and after each task's rows its sums by slot.

    ``codes`` are the previous entries; null ones stand for the first entry. The last round makes no sums and leaves the vectors out.
    """
    parts, count, width = entries.shape
    book = rows.sparkSession.sparkContext.broadcast(entries)

    def scan(batches):
        codebook = Codebook(book.value)
        counts, sums = np.zeros(parts * count, np.int64), np.zeros((parts * count, width), np.int64)
        types = [pa.int32(), pa.list_(pa.int64())]
        names = ["vec_id", "label_key", "v", "codes", "error", "slot", "sums"]
        id_type = None
        for whole in batches:
            id_type = whole.column(0).type
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                n = len(batch)
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<i4").reshape(n, parts, width).astype(np.int64)
                before = batch.column(3).to_pylist()
                before = np.zeros((n, parts), np.uint8) if before[0] is None else np.frombuffer(b"".join(before), np.uint8).reshape(n, parts)
                codes, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                for p in range(parts):
                    code, d = codebook.search(p, x[:, p], before[:, p])
                    codes[:, p] = code
                    error += d
                    if not last:
                        counts[p * count : (p + 1) * count] += np.bincount(code, minlength=count)
                        for j in range(width):
                            # Sums of one slice of rows are below 2 ** 53, so exact.
                            sums[p * count : (p + 1) * count, j] += np.bincount(code, x[:, p, j], count).astype(np.int64)
                raw = codes.tobytes()
                cells = pa.array([raw[k * parts : (k + 1) * parts] for k in range(n)], pa.binary())
                v = pa.nulls(n, pa.binary()) if last else batch.column(2)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), v, cells, pa.array(error), *(pa.nulls(n, t) for t in types)], names=names)
        used = np.flatnonzero(counts)
        if len(used):
            made = [pa.array(used, pa.int32()), pa.array([[int(counts[s]), *sums[s].tolist()] for s in used], types[1])]
            empty = [pa.nulls(len(used), t) for t in (id_type, pa.string(), pa.binary(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, *made], names=names)

    return rows.select("vec_id", "label_key", "v", "codes").mapInArrow(scan, extended(rows.select("vec_id").schema, _SCHEMA))


def _moved(entries: np.ndarray, state: DataFrame) -> np.ndarray:
    """The codebook with each used entry at its parts' floored means."""
    parts, count, width = entries.shape
    sums = state.where("slot is not null").select("slot", F.posexplode("sums")).groupBy("slot", "pos").agg(F.sum("col").alias("total"))
    table = np.zeros((parts * count, width + 1), np.int64)
    for r in sums.collect():  # at most entries times (components and a count)
        table[r["slot"], r["pos"]] = r["total"]
    new = entries.reshape(parts * count, width).copy()
    used = table[:, 0] > 0
    new[used] = table[used, 1:] // table[used, :1]
    return new.reshape(entries.shape)


def compressed(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector without null and non-finite components.

    Of rows of equal ids each has its result; where they are among the first, they are taken
    in the order of their vectors' bytes, and null ids after all others. Null labels are one
    label. With fewer vectors than ``entries`` the codebooks are as small; no vectors give
    no result. Empty vectors have codes of zeros. Vectors must be of one length that
    ``parts`` divides, else ValueError; so must components be small enough for exact
    distances in 64 bits (up to 2 ** 26 after scaling). Further columns have no influence.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label_key"), F.col(vector).cast("array<double>").alias("x"))
    written: list[str] = []
    kept = stored(_quantised(own, scale), written, compression="zstd")
    sizes = kept.agg(F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    dims = (sizes[0] or 0) // 4
    if sizes[0] != sizes[1] or dims % parts:
        raise ValueError(f"vectors of {dims} to {(sizes[1] or 0) // 4} components can't be cut into {parts} equal parts")
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    book = np.array([np.frombuffer(r["v"], "<i4") for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    state = kept.withColumn("codes", F.lit(None).cast("binary"))
    for k in range(rounds + 1):
        made = stored(_round(state, book, last=k == rounds), written, compression="zstd")
        remove(spark, written.pop(0))
        if k < rounds and len(first):
            book = _moved(book, made)
        state = made.where("slot is null")
    digest = hashlib.sha256(",".join(str(x) for x in book.ravel().tolist()).encode()).hexdigest()
    errors = state.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    if errors.count() <= BROADCAST_ROWS:
        errors = F.broadcast(errors)
    errors = errors.withColumnRenamed("label_key", "_key")
    joined = state.join(errors, F.col("label_key").eqNullSafe(F.col("_key")))
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
