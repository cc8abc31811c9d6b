import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import CLASHES, ODD, docs, words

from clarion.llm import repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length=200, gram=16, **options):
    got = repeats.deduplicate(docs(spark, texts, extra=CLASHES), length=length, gram=gram, **options).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == brute(texts, length)


def test_production_length(spark):
    rng = random.Random(1)
    passage = words(rng, 90, 5000)
    texts = ODD + [words(rng, 300, 5000) for _ in range(15)]
    texts += [words(rng, 40, 5000) + passage + words(rng, 40, 5000), passage, passage[:199], passage[10:215] + "é" + passage[:250], passage + passage]
    texts += [texts[12], "ab" * 400, "é" * 300]
    check(spark, texts)


@pytest.mark.parametrize("seed, cell", [(0, 2000), (1, 3), (2, 1)])
def test_small_alphabets(spark, seed, cell):
    """Short windows over few letters: every way of overlapping, also past the limit of one comparison."""
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab" if k % 3 else "abcdefgh") for _ in range(rng.randrange(0, 60))) for k in range(50)]
    texts += [t[:7] + "Z" + t[8:] for t in texts[:20]]
    check(spark, texts, length=12, gram=4, cell=cell)


def places(spark, texts, first):
    own = docs(spark, texts, range(first, first + len(texts))).selectExpr("doc_id", "text", "xxhash64(text) as d")
    return repeats.suffixes(own).where("s1 is not null")


def test_batches_meet_the_levels_of_earlier_runs(spark):
    """Every batch is scanned against all levels, also by an index that a later run opens; levels merge geometrically."""
    rng = random.Random(3)
    passage = words(rng, 80, 9999)
    index, found, sizes = repeats.LogIndex(spark), [], []
    for k in range(7):
        hits = index.add(places(spark, [words(rng, 200, 9999), passage + words(rng, 20, 9999)], 2 * k)).collect()
        found.append({r.doc_id for r in hits})
        sizes.append(sorted(size for size, _ in index.levels))
        index = repeats.LogIndex(spark, index.path)
    assert found[0] == set() and found[1] == {1, 3} and all(2 * k + 1 in f and not any(i % 2 == 0 for i in f) for k, f in enumerate(found[1:], 1))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2]]
    once = index.entries().where("c = 1").count()
    assert index.entries().count() > once > 0


def test_levels_are_in_the_order_of_the_bytes(spark):
    rng = random.Random(4)
    texts = [words(rng, 300, 9999) for _ in range(6)]
    index = repeats.LogIndex(spark)
    index.add(places(spark, texts, 0))
    seen = 0
    for f in index.entries().inputFiles():
        keys = [tuple(r[k] for k in repeats.KEY) for r in spark.read.parquet(f).collect()]
        assert keys == sorted(keys)
        heads = [b"".join(((x + (1 << 63)) % (1 << 64)).to_bytes(8, "big") for x in k[:2]) for k in keys]
        assert heads == sorted(heads) and all(any(h in t.encode() for t in texts) for h in heads)
        seen += len(keys)
    assert seen > 50


def test_equal_hashes_of_different_bytes_are_no_repeats(monkeypatch, spark):
    """With hashes of windows that all collide, the bytes decide."""
    monkeypatch.setattr(repeats.Hashed, "of", lambda self, start, end: start * 0)
    data, n = b"abcabdabcxyz", 3
    start = np.arange(len(data) - n + 1)
    same = repeats._verified(data, start, start, start * 0, start * 0 + len(start), n)
    assert [data[k : k + n] for k in np.flatnonzero(same)] == [b"abc", b"abc"]


def test_texts_beyond_a_slice(spark):
    """A text of over 3 MB is taken in overlapping slices; repeats within it, over their edges and in others are found."""
    rng = random.Random(9)
    raw = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz     ", k=2 * repeats.SLICE + 400_000))
    far = raw[5_000:5_600]
    edge = raw[repeats.SLICE - 300 : repeats.SLICE + 300]
    text = raw + "Q" + far
    other = "Q" * 50 + edge + "Z" * 50
    got = {r.doc_id: r for r in repeats.deduplicate(docs(spark, [text, other, far[:199]])).collect()}
    assert (got[0].n_bytes, got[0].n_removed, got[0].n_spans) == (len(text), 3 * 600, 3)
    assert (got[1].n_removed, got[1].n_spans, got[1].kept_sha256) == (600, 1, hashlib.sha256(b"Q" * 50 + b"Z" * 50).hexdigest())
    left = raw[:5_000] + raw[5_600 : repeats.SLICE - 300] + raw[repeats.SLICE + 300 :] + "Q"
    assert got[0].kept_sha256 == hashlib.sha256(left.encode()).hexdigest() and got[2].n_removed == 0


def test_odd_tables(spark):
    assert repeats.deduplicate(docs(spark, [])).count() == 0
    same = "x" * 10 + "".join(chr(97 + k % 26) for k in range(300))
    got = repeats.deduplicate(docs(spark, [same, same], [1, 1])).collect()
    assert [r.n_removed for r in got] == [310, 310]
    assert [r.n_removed for r in repeats.deduplicate(docs(spark, [same, same, "a"], [None, None, None])).orderBy("n_bytes").collect()] == [0, 310, 310]
