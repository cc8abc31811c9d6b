import hashlib
import random

import numpy as np
from helpers import CLASHES, ODD, docs, words

from clarion.llm import chunkprints


def whole(text):
    return np.unique(np.array(chunkprints.chunks(text.encode())[1], np.uint64))


def test_same_as_from_scratch(spark):
    rng = random.Random(2)
    texts = ODD + [words(rng, rng.randrange(0, 300)) for _ in range(60)]
    ids = sorted(rng.sample(range(10_000), len(texts)))
    got = {r.doc_id: r for r in chunkprints.compare(docs(spark, texts, ids, extra=CLASHES)).collect()}
    for k, i in enumerate(ids):
        t, after = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        q = len(t) // 4
        new = t[: len(t) - q] + after[:q]
        a, b, c = whole(t), whole(new), whole(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (chunkprints.as_text(a), chunkprints.as_text(b))
        assert (r.near_edited, r.near_next) == (chunkprints.containment(a, b), chunkprints.containment(a, c))
        assert chunkprints.from_text(r.fingerprint).tolist() == a.tolist()


def test_insertions_move_no_distant_boundary():
    rng = random.Random(5)
    text = words(rng, 2000, 5000).encode()
    a = chunkprints.chunks(text)[1]
    b = chunkprints.chunks(text[:3000] + b"inserted words" + text[3000:])[1]
    assert len(set(a) - set(b)) <= 12
    sizes = np.diff([0, *chunkprints.cuts(text)])
    assert sizes.max() <= chunkprints.MOST and sizes[:-1].min() >= chunkprints.LEAST


def test_edited_texts_are_near_and_others_are_not(spark):
    rng = random.Random(7)
    texts = [words(rng, 300, 5000) for _ in range(40)]
    got = chunkprints.compare(docs(spark, texts)).collect()
    assert all(r.near_edited > 0.6 and r.near_next < 0.1 for r in got)


def test_odd_tables(spark):
    assert chunkprints.compare(docs(spark, [])).count() == 0
    one = chunkprints.compare(docs(spark, ["just one text here"], [5])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    same = chunkprints.compare(docs(spark, ["a text", "a text", None, None], [3, 3, None, 4])).collect()
    assert len(same) == 4 and len({r.fingerprint for r in same}) == 2


def test_parts_by_binary_search(spark):
    from pyspark.sql import functions as F

    for n in (0, 1, 2, 3, 7, 8, 100):
        edges = list(range(5, 5 + 3 * n, 3))
        df = spark.createDataFrame([(x,) for x in [None, *range(0, 320)]], "x bigint")
        got = df.select("x", chunkprints._rank(F.col("x"), edges).alias("k")).collect()
        assert all(r.k == sum(r.x is not None and e <= r.x for e in edges) for r in got)
