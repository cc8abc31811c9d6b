"""SimHash near-duplicates with pivot distance tables.

Each distinct fingerprint gets its Hamming distances to fixed reference fingerprints
(the pivots) once. By the triangle inequality two fingerprints within ``max_bits`` of
each other differ by at most that in every coordinate, so a pair whose largest
coordinate difference is more is discarded; survivors are verified.

A pivot table alone has no sub-quadratic way to bring pairs together: random 64-bit
words pass one pivot in about half of all cases. Pairs are therefore enumerated only
inside buckets that share some blocks of bits (any two words within ``max_bits`` share
at least one choice of blocks), and the pivot tables work inside the buckets. Buckets
of more than ``CELL`` fingerprints are cut into pieces that meet two by two in tasks of
their own, and each task returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from clarion.functions.lineage import extended, free_name, stored
from clarion.operators.graph import connected_components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Fingerprints of a bucket, or of a piece of a bucket, in one comparison.
CELL = 2048
#: Rows that go, of which the ids are broadcast, at most.
BROADCAST_ROWS = 1_000_000
#: Reference fingerprints: bit j of pivot i is the parity of i & j (Walsh functions, 32 bits apart).
PIVOTS = [sum((bin(i & j).count("1") & 1) << j for j in range(64)) for i in range(16)]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a UTF-8 text: words between ASCII white space, A-Z lower-cased.

    Every shingle of ``shingle`` words counts, repeats included; a text of fewer words is
    one shingle; null, empty and blank texts give zero. A bit needs more than half.
    """
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    k = min(shingle, len(words))
    first = starts[: len(words) - k + 1]
    last = starts[k - 1 :] + sizes[k - 1 :]
    xx = xxhash.xxh64_intdigest
    h = np.array([xx(line[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(h), 65536):  # a slice at a time: the bits of a long text take 64 bytes a shingle
        ones += np.unpackbits(h[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed 64-bit integer."""
    rest = [c for c in docs.columns if c != text]
    at, keep = docs.columns.index(text), [docs.columns.index(c) for c in rest]

    def scan(batches):
        for batch in batches:
            got = np.array([fingerprint(t, shingle) for t in batch.column(at).cast(pa.binary()).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(got.view(np.int64))], names=[*rest, into])

    return docs.mapInArrow(scan, extended(docs.select(*rest).schema, f"`{into}` bigint"))


def block_masks(n: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of which any two 64-bit words within ``max_bits`` agree on at least one.

    64 bits in ``max_bits`` + k blocks: k of them are free of differences. k is the least
    for which a bucket of evenly spread words holds no more than a few of ``n``.
    """
    for k in range(1, 5):
        blocks = max_bits + k
        edges = [64 * i // blocks for i in range(blocks + 1)]
        masks = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
        out = [sum(c) for c in combinations(masks, k)]
        if n >> (64 * k // blocks) <= 4:
            break
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _table(fp: Column) -> Column:
    """Distances to the pivots, a byte each, as a binary column."""
    byte = [F.lpad(F.hex(F.bit_count(fp.bitwiseXOR(F.lit(_signed(p))))), 2, "0") for p in PIVOTS]
    return F.unhex(F.concat(*byte))


def near(fp: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i of ``left``, j of ``right``) within ``max_bits``: pivot filter, then verification."""
    order = right[np.argsort(table[right, 0], kind="stable")]
    key = table[order, 0].astype(np.int16)
    a, b = [], []
    for i in left:
        d = int(table[i, 0])
        cand = order[np.searchsorted(key, d - max_bits) : np.searchsorted(key, d + max_bits, "right")]
        cand = cand[cand != i]
        for p in range(1, table.shape[1]):
            if not len(cand):
                break
            cand = cand[np.abs(table[cand, p].astype(np.int16) - int(table[i, p])) <= max_bits]
        cand = cand[np.bitwise_count(fp[cand] ^ fp[i]) <= max_bits]
        a.append(np.full(len(cand), i))
        b.append(cand)
    return np.concatenate(a or [left[:0]]), np.concatenate(b or [left[:0]])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of ``n`` nodes over links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    return label


def links(fps: DataFrame, fp: str = "fp", node: str = "node", max_bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """(src, dst) between nodes of distinct fingerprints whose components are those of all pairs within ``max_bits``."""
    fps = fps.select(F.col(fp).alias("fp"), F.col(node).alias("node"))
    masks = block_masks(fps.count(), max_bits)
    cells = fps.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("c")).select("fp", "node", "c.t", "c.key")
    sizes = cells.groupBy("t", "key").count().where("count > 1").select("t", "key", F.ceil(F.col("count") / cell).cast("int").alias("pieces"))
    cells = cells.join(sizes, ["t", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int"))
    # A bucket of one piece is one group; of several, a piece meets every other piece in a group of its own.
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    cells = cells.select("t", "key", "fp", "node", "own", other.alias("other"))
    groups = (
        cells.groupBy("t", "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
        .agg(F.collect_list(F.struct("fp", "node", "own", _table(F.col("fp")).alias("table"))).alias("members"))
        .where(F.size("members") > 1)
        .select("p", "q", "members")
    )

    def compare(batches):
        for batch in batches:
            src, dst = [], []
            for p, q, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                m = members.values
                f = m.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                own = m.field("own").to_numpy(zero_copy_only=False)
                nodes = m.field("node").to_numpy(zero_copy_only=False)
                table = np.frombuffer(b"".join(m.field("table").to_pylist()), np.uint8).reshape(len(f), -1)
                here, there = np.flatnonzero(own == p), np.flatnonzero(own == q)
                if len(here) and len(there):
                    low = forest(len(f), *near(f, table, here, there, max_bits))
                    k = np.flatnonzero(low != np.arange(len(f)))
                    src.append(nodes[k])
                    dst.append(nodes[low[k]])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *src])), pa.array(np.concatenate([none, *dst]))], names=["src", "dst"])

    return groups.mapInArrow(compare, "src bigint, dst bigint").distinct()


def _components(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, component_id): of every fingerprint of ``fps`` (fp, doc_id) the least id reachable over links."""
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # Fingerprints are the nodes: rows that repeat an id with another text stay apart.
    named = reps.join(connected_components(links(reps.where("least is not null"), node="fp", max_bits=max_bits)), reps.fp == F.col("id"), "left")
    named = stored(named.select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id. Ids must be integers.

    component_id is the least doc_id reachable over links of at most ``max_bits``
    differing bits, the row's own included. Texts without words share fingerprint zero.
    Rows with a null doc_id keep a fingerprint and link to nothing: component_id null
    unless equal fingerprints have an id. Repeated rows are repeated in the result; other
    columns, of whatever name, don't matter, and no rows give no result.
    """
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    fps = stored(fingerprints(own, "text", "fp", shingle))
    named = _components(fps, max_bits).select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per class: the one of the least doc_id, and of the least hash of its text where that id repeats.

    Rows are told apart by id and text, so an id on two different texts loses neither; of
    rows that repeat both, the one whose JSON has the least SHA-256 stays. Rows with a null id
    belong to no class and all stay. Ids must be integers; a null text is an empty one and
    stays null; no rows give no result.
    Which rows go is settled over narrow rows. They are counted, and broadcast up to
    ``BROADCAST_ROWS`` of them; more meet the texts in a shuffle.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    own = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), digest.alias("d"), F.col(text).alias("text"))
    fps = stored(fingerprints(own, "text", "fp", shingle))
    named = _components(fps, max_bits).select("fp", "component")
    rows = stored(fps.groupBy("fp", "doc_id", "d").agg(F.count("*").alias("n")).join(named, "fp"))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "d")).alias("first"))
    judged = rows.join(first, "component").withColumn("stays", (F.col("doc_id") == F.col("first.doc_id")) & (F.col("d") == F.col("first.d")))
    a, b = (free_name(x, docs.columns) for x in ("_doc", "_text"))
    settled = stored(judged.where("not stays or n > 1").select(F.col("doc_id").alias(a), F.col("d").alias(b), "stays"))
    few = (lambda x: F.broadcast(x)) if settled.count() <= BROADCAST_ROWS else (lambda x: x)
    same = lambda x: (F.col(doc_id).cast("bigint") == x[a]) & (digest == x[b])
    kept = docs.join(few(settled), same(settled), "left_anti")
    twice = settled.where("stays")
    if not twice.isEmpty():
        key = free_name("_digest", docs.columns)
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        repeats = docs.join(few(twice), same(twice), "left_semi").groupBy(F.col(doc_id).alias(a), digest.alias(key))
        kept = kept.unionByName(repeats.agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias(key + "_row")).select(F.col(key + "_row.*")))
    return kept
