"""Vector codes against a plain product quantisation that looks at every entry."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from clarion.llm import vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(table, parts=8, entries=16, rounds=6):
    kept = []
    for i, x, label in table:
        if x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        kept.append((i, [math.floor(4096 * float(np.float32(c))) for c in x], label))
    width = len(kept[0][1]) // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    books = [[cut(x, p) for _, x, _ in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for k in range(rounds + 1):
        codes = [[min(range(len(books[p])), key=lambda e: (far(cut(x, p), books[p][e]), e)) for p in range(parts)] for _, x, _ in kept]
        if k < rounds:
            for p in range(parts):
                groups = defaultdict(list)
                for (_, x, _), c in zip(kept, codes):
                    groups[c[p]].append(cut(x, p))
                for e, own in groups.items():
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    errors = [sum(far(cut(x, p), books[p][c[p]]) for p in range(parts)) for (_, x, _), c in zip(kept, codes)]
    sums = defaultdict(int)
    for (_, _, label), e in zip(kept, errors):
        sums[label] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted((repr(i), "".join(f"{c:02x}" for c in code), e, sums[label], digest) for (i, _, label), code, e in zip(kept, codes, errors))


def of(df):
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def make(rng, n, dims, spread=1.0):
    return [(k, [rng.gauss(k % 5, spread) if rng.random() < 0.9 else 0.0 for _ in range(dims)], rng.choice([0, 1, 1, None])) for k in range(n)]


@pytest.mark.parametrize("seed, n, dims, spread", [(1, 300, 16, 1.0), (2, 200, 8, 0.001), (3, 9, 24, 0.3), (4, 120, 16, 50.0)])
def test_same_as_plain_search(spark, monkeypatch, seed, n, dims, spread):
    monkeypatch.setattr(vectors, "ROWS", 37)
    rng = random.Random(seed)
    table = make(rng, n, dims, spread)
    table += [(n, None, 1), (n + 1, [None] * dims, 0), (n + 2, [math.nan] * dims, 0), (n + 3, [0.0] * (dims - 1) + [-math.inf], 3), (2, table[2][1], 0), (5, table[1][1], 7), (None, table[3][1], 2)]
    rng.shuffle(table)
    df = spark.createDataFrame(table, SCHEMA).withColumn("Codes", F.lit("x")).withColumn("slot", F.lit(1)).repartition(5)
    assert of(vectors.compressed(df)) == plain(table)


def test_exponion_looks_at_what_it_must():
    """The search equals a full one from every start, ties included."""
    rng = np.random.default_rng(5)
    entries = rng.integers(-4, 5, (2, 16, 3))
    entries[0, 7] = entries[0, 3]
    book = vectors.Codebook(entries)
    x = rng.integers(-6, 7, (500, 3))
    for p in range(2):
        d = ((x[:, None, :] - entries[p][None]) ** 2).sum(-1)
        for start in (rng.integers(0, 16, 500), np.zeros(500, int), np.full(500, 15)):
            code, least = book.search(p, x, start)
            assert (code == d.argmin(1)).all() and (least == d.min(1)).all()


def test_empty_tables_empty_vectors_and_bad_ones(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 0)
    assert vectors.compressed(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.compressed(spark.createDataFrame([(1, None, 1), (2, [math.nan], 1)], SCHEMA)).count() == 0
    got = vectors.compressed(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA)).collect()
    assert [(r.code, r.error, r.label_error) for r in got] == [("00" * 8, 0, 0)] * 2
    with pytest.raises(ValueError):
        vectors.compressed(spark.createDataFrame([(1, [1.0] * 9, 1)], SCHEMA))
    with pytest.raises(ValueError):
        vectors.compressed(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], SCHEMA))
    with pytest.raises(Exception, match="exact 64-bit"):
        vectors.compressed(spark.createDataFrame([(1, [1e9] * 8, 1)], SCHEMA))


def test_floors_go_down(spark):
    table = [(k, [-0.0001 * k, 0.0001 * k, -1.0, 1.0, -0.5, 0.5, k / 7, -k / 7], 1) for k in range(40)]
    assert of(vectors.compressed(spark.createDataFrame(table, SCHEMA))) == plain(table)
