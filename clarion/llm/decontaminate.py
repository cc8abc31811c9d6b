"""Benchmark decontamination with suffix arrays of the training text.

Every task cuts its documents into shards of bounded size and builds a word-level
suffix array of each shard, ordered by the first ``window`` words of a suffix. Every
suffix of every benchmark item is then looked up by binary search in every shard; the
range found gives the places where it occurs verbatim, and neighbouring places are
joined to the longest verbatim matches. No training row is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from clarion.functions.lineage import extended, free_name, stored

WINDOW = 10
#: Characters of training text in one suffix array.
SHARD_BYTES = 4_000_000
#: UTF-8 bytes of benchmark text that are broadcast at once; a larger benchmark goes through in blocks.
BLOCK_BYTES = 16_000_000

#: Lower-cases A-Z and turns every byte that is no digit, letter or part of a non-ASCII character into a space.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

SPANS = "array<struct<start:int,length:int,item:string,item_start:int>>"


def words_of(text: str | bytes | None) -> list[bytes]:
    """The words of a text: runs of digits, ASCII letters and non-ASCII characters, A-Z lower-cased."""
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_WORDS).split()


class Queries:
    """The benchmark's suffixes as fixed-width keys for binary search; items of equal words are one sequence with several ids."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        rows: dict[tuple[int, ...], list[str]] = {}
        for i, t in sorted((str(i), t) for i, t in items):
            rows.setdefault(tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)), []).append(i)
        ids = [list(row) for row in rows]
        #: The ids of each sequence, in order; one id may stand for several sequences.
        self.names = list(rows.values())
        lows, highs, where, lengths, heads = [], [], [], [], set()
        self.single: set[int] = set()
        for k, row in enumerate(ids):
            n = min(window, len(row))
            if n == 1:
                self.single.add(row[0])
            for j in range(len(row) - n + 1 if n else 0):
                part = row[j : j + n]
                if n > 1:
                    heads.add((part[0], part[1]))
                lows.append(part + [0] * (window - n))
                highs.append(part + [2**32 - 1] * (window - n))
                where.append((k, j))
                lengths.append(n)
        self.low = self.keys(np.array(lows, dtype=np.uint32).reshape(-1, window))
        self.high = self.keys(np.array(highs, dtype=np.uint32).reshape(-1, window))
        self.where = np.array(where, dtype=np.int64).reshape(-1, 2)
        self.lengths = np.array(lengths, dtype=np.int64)
        self.heads = np.unique(np.array([a << 32 | b for a, b in heads], dtype=np.int64))
        self.single_ids = np.array(sorted(self.single), dtype=np.int64)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Rows of word ids as byte strings whose order is that of the ids."""
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").ravel()

    def search(self, docs: list[list[bytes]]) -> list[list[tuple[int, int, int, int]]]:
        """For each document its longest verbatim matches: (word, number of words, sequence, its word)."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in docs]
        if not len(self.low):
            return out
        get, w = self.vocab.get, self.window
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        # One sentinel after each document, and room for the last suffix.
        flat = np.zeros(int((sizes + 1).sum()) + w, dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(sizes + 1)])
        for a, d in zip(first, docs):
            flat[a : a + len(d)] = [get(x, 0) for x in d]
        # Suffixes that begin with no word pair of the benchmark can't be met by any search.
        head = flat[:-w] << 32 | flat[1 : len(flat) - w + 1]
        at = np.searchsorted(self.heads, head)
        keep = (self.heads[np.minimum(at, len(self.heads) - 1)] == head) if len(self.heads) else np.zeros(len(head), bool)
        if len(self.single_ids):
            keep |= np.isin(flat[: len(head)], self.single_ids)
        starts = np.flatnonzero(keep)
        if not len(starts):
            return out
        suffixes = self.keys(flat[starts[:, None] + np.arange(w)[None, :]])
        # Ids past a document's end would read the next one; the sentinel 0 stops every match before them.
        order = np.argsort(suffixes, kind="stable")
        array, starts = suffixes[order], starts[order]
        lo = np.searchsorted(array, self.low, "left")
        hi = np.searchsorted(array, self.high, "right")
        found = np.flatnonzero(hi > lo)
        if not len(found):
            return out
        n = hi[found] - lo[found]
        q = np.repeat(found, n)
        pos = starts[np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        item, j = self.where[q].T
        # Windows that continue each other in both the item and the document form one match.
        order = np.lexsort((pos, pos - j, item))
        item, j, pos, length = item[order], j[order], pos[order], self.lengths[q][order]
        new = np.ones(len(pos), bool)
        new[1:] = (item[1:] != item[:-1]) | (pos[1:] - j[1:] != pos[:-1] - j[:-1]) | (pos[1:] != pos[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(pos)]]) - 1
        doc = np.searchsorted(first, pos[heads], "right") - 1
        for k, (a, b) in enumerate(zip(heads, tails)):
            d = int(doc[k])
            out[d].append((int(pos[a] - first[d]), int(pos[b] - pos[a] + length[b]), int(item[a]), int(j[a])))
        return out


@cache
def _queries(block: Broadcast) -> Queries:
    return Queries(*block.value)


def _covered(spans: list[dict]) -> int:
    total = end = 0
    for s, n in sorted((x["start"], x["length"]) for x in spans):
        total += max(0, s + n - max(s, end))
        end = max(end, s + n)
    return total


def shards(texts: list[bytes | None], limit: int) -> Iterator[list[bytes | None]]:
    """Runs of texts of about ``limit`` bytes in all; a longer text is a run of its own."""
    part: list[bytes | None] = []
    size = 0
    for t in texts:
        if part and size + len(t or b"") > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or b"")
    if part:
        yield part


def matches(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, into: str = "matches",
) -> DataFrame:
    """``docs`` with one more column ``into``: the longest verbatim matches with benchmark items.

    The column holds n_words, n_hit (words inside any match, each once), items (ids as
    strings, sorted, distinct) and spans: start and length in words of the document, the
    item's id as a string (of items of equal words the first), and the item's word where it begins. Items of fewer words than
    ``window`` match whole; null and wordless items never match; null and empty texts
    have no words and no matches. Repeated documents and items are each matched for
    themselves. Further columns pass through.

    The benchmark's size is summed first: it is broadcast in blocks of at most
    ``block_bytes``; with more than one block, the documents are read once per block.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.octet_length("t") + F.lit(64))).first()[0] or 0
    blocks = max(1, -(-total // max(1, block_bytes // 2)))
    names, at, width = [*docs.columns, into], docs.columns.index(text), len(docs.columns)
    kind = pa.struct([
        ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("item", pa.string()), ("item_start", pa.int32())]))),
    ])
    schema = extended(docs.schema, f"`{into}` struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:{SPANS}>")
    out = docs
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)
        block = spark.sparkContext.broadcast(([(r["i"], r["t"].encode()) for r in part.collect()], window))

        def scan(batches, block=block, first=b == 0):
            q = _queries(block)
            for batch in batches:
                cells = []
                before = None if first else batch.column(width).to_pylist()
                for texts in shards(batch.column(at).cast(pa.binary()).to_pylist(), shard_bytes):
                    words = [words_of(t) for t in texts]
                    for own, found in zip(words, q.search(words)):
                        spans = [{"start": a, "length": n, "item": q.names[k][0], "item_start": j} for a, n, k, j in found]
                        ids = {i for k in {m[2] for m in found} for i in q.names[k]}
                        if before:
                            spans = before[len(cells)]["spans"] + spans
                            ids |= set(before[len(cells)]["items"])
                        cells.append({"n_words": len(own), "n_hit": _covered(spans), "items": sorted(ids), "spans": spans})
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(cells, kind)], names=names)

        out = out.mapInArrow(scan, schema)
        if b + 1 < blocks:
            out = stored(out)
            block.unpersist()
    return out


RESULTS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without its text, with n_words, n_hit, n_items, items_sha256, contaminated and longest.

    items_sha256 is of the matched ids, sorted as strings, comma-joined (of the empty
    string where there are none); longest is the length of the longest match in words.
    Columns of ``docs`` that bear a result's name in any case give way to it.
    """
    docs = docs.select(text, *[c for c in docs.columns if c != text and c.lower() not in RESULTS])
    name = free_name("_matches", docs.columns)
    m = F.col(name)
    values = (
        m.n_words, m.n_hit, F.size(m["items"]).cast("bigint"), F.sha2(F.array_join(m["items"], ","), 256), m.n_hit > 0,
        F.coalesce(F.array_max(m.spans.length), F.lit(0)),
    )
    found = matches(docs, benchmark, text, into=name, **options)
    return found.select(*[c for c in docs.columns if c != text], *[v.alias(k) for k, v in zip(RESULTS, values)])


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text shares no window with the benchmark; columns as they were."""
    name = free_name("_matches", docs.columns)
    found = matches(docs, benchmark, text, into=name, **options)
    return found.where(F.col(name).n_hit == 0).drop(name)
