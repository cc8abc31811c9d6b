"""Document fingerprints from content-defined chunks.

A gear hash over the last 32 bytes proposes boundaries; a stricter test before the
normal chunk size and a looser one after it keep sizes near that (normalised chunking).
Boundaries depend on nearby bytes only, so an insertion moves no distant one. A
fingerprint is the set of the chunks' digests with their lengths; the share of a text's
chunk bytes that another text has too measures how far the one is contained in the other.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.lineage import extended

LEAST, NORMAL, MOST = 8, 24, 96
#: Top bits of the gear hash that must be zero before and after the normal size.
STRICT, LOOSE = 5, 3
_GEAR = np.array([zlib.crc32(bytes([b]), 0x5EED) for b in range(256)], dtype=np.uint32)


def gear(data: bytes) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' gear values, each shifted by its distance."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            before = h[:-s] << np.uint32(s)
            h = h.copy()
            h[s:] += before
    return h


def cuts(data: bytes, start: int = 0) -> list[int]:
    """Ends of the chunks of ``data`` from ``start``, which must be 0 or such an end."""
    n = len(data)
    if start >= n:
        return []
    skip = max(0, start - 32)  # the hash looks no further back
    h = gear(data[skip:])
    loose = np.flatnonzero(h >> np.uint32(32 - LOOSE) == 0)
    strict = loose[h[loose] >> np.uint32(32 - STRICT) == 0]
    loose_at, strict_at = (loose + skip + 1).tolist(), (strict + skip + 1).tolist()
    out = []
    i = j = 0
    p = start
    while p < n:
        i = bisect_left(strict_at, p + LEAST, i)
        if i < len(strict_at) and strict_at[i] < p + NORMAL:
            p = strict_at[i]
        else:
            j = bisect_left(loose_at, p + NORMAL, j)
            p = loose_at[j] if j < len(loose_at) and loose_at[j] < p + MOST else min(p + MOST, n)
        out.append(p)
    return out


def _codes(data: bytes, ends: list[int], start: int = 0) -> list[int]:
    out = []
    digest = xxhash.xxh32_intdigest
    for e in ends:
        out.append(digest(data[start:e]) << 8 | (e - start))
        start = e
    return out


def chunks(data: bytes) -> tuple[list[int], list[int]]:
    """Ends and codes (digest and length) of all chunks; an empty text has none."""
    ends = cuts(data)
    return ends, _codes(data, ends)


def as_text(codes: np.ndarray) -> str:
    """Sorted distinct codes, ten hexadecimal digits each: eight of the digest, two of the length."""
    return codes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    wide = np.zeros((len(fingerprint) // 10, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return wide.view(">u8").ravel().astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of a's distinct chunk bytes that b has too; of an empty text 1 in an empty one, else 0."""
    size = a & np.uint64(255)
    total = int(size.sum())
    if not total:
        return float(len(b) == 0)
    return int(size[np.isin(a, b, assume_unique=True)].sum()) / total


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (in code points) replaced by the first as many of ``following``."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """``docs`` with one more column: the fingerprint of the text; null and empty texts have an empty one."""
    at, names = docs.columns.index(text), [*docs.columns, into]

    def scan(batches):
        for batch in batches:
            got = [as_text(np.unique(np.array(chunks(t or b"")[1], np.uint64))) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=names)

    return docs.mapInArrow(scan, extended(docs.schema, f"`{into}` string"))


def _rank(x: Column, edges: list[int]) -> Column:
    """How many of the sorted ``edges`` are at most ``x``, by binary search in one constant; 0 for null."""
    bounds = F.from_json(F.lit(json.dumps(edges)), "array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(edges).bit_length()))]).cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(bounds, at + s - 1) <= x, at + s).otherwise(at))


def with_neighbours(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(part, after, doc_id, text) dealt and sorted so that rows of a part follow each other in id order.

    Rows of a part end with the first row of the next part (after = 1), the last part with
    the first of all. Parts are cut at quantiles of the id; rows of equal ids are ordered by
    text, null ids come first. Texts are shuffled once, and one text per part is repeated.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * n
    edges = sorted(set(own.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))))
    rows = own.select(_rank(F.col("doc_id"), [int(e) for e in edges]).alias("part"), F.lit(0).alias("after"), "doc_id", "text")
    heads = rows.groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("h"))
    order = Window.orderBy("part")  # as many rows as parts
    last = F.max("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.coalesce(F.lag("part").over(order), last).alias("part"), F.lit(1).alias("after"), "h.doc_id", "h.text")
    return rows.unionByName(heads).repartition(n, "part").sortWithinPartitions("part", "after", "doc_id", "text")


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    The next document is the one after in ascending id, of the last one the first; a single
    document follows itself. Null texts count as empty; repeated rows follow each other. Ids
    must be integers; other columns, of whatever name, don't matter. No rows give no result.
    """
    rows = with_neighbours(docs, doc_id, text)

    def scan(batches):
        part = held = None
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for p, after, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                data = t.encode()
                ends, codes = chunks(data)
                own = np.unique(np.array(codes, np.uint64))
                if held is not None and part == p:
                    i0, t0, ends0, codes0, own0 = held
                    new = edited(t0, t)
                    raw = new.encode()
                    # Chunks that end in the untouched part stay; only the rest is cut anew.
                    same = len(t0[: len(t0) - len(t0) // 4].encode())
                    k = bisect_left(ends0, same + 1)
                    # The last end of a text is no boundary, and one at the very edge may have been.
                    k -= bool(k and ends0[k - 1] == ends0[-1])
                    begin = ends0[k - 1] if k else 0
                    other = np.unique(np.array(codes0[:k] + _codes(raw, cuts(raw, begin), begin), np.uint64))
                    row = (i0, len(t0), hashlib.sha256(raw).hexdigest(), as_text(own0), as_text(other), containment(own0, other), containment(own0, own))
                    for column, value in zip(out, row):
                        column.append(value)
                part, held = p, None if after else (i, t, ends, codes, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return rows.mapInArrow(scan, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
