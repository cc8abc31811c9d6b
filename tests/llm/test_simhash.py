import random

import pytest
import xxhash
from helpers import CLASHES, ODD, docs, words

from clarion.llm import simhash


def plain(text, k=4):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(ids, fps, most=4):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i in range(len(fps)):
        least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return [least[root(i)] for i in range(len(fps))]


def test_fingerprints_and_classes_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    texts = list(ODD)
    for _ in range(25):
        base = words(rng, 200).split()
        for n in (0, 1, 2, 6):
            edited = list(base)
            for _ in range(n):
                edited[rng.randrange(len(edited))] = "edit"
            texts.append(" ".join(edited))
    ids = [3 * k + 1 for k in range(len(texts))]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.classes(docs(spark, texts, ids)).collect()}
    fps = [plain(t) for t in texts]
    assert [got[i][0] for i in ids] == [f"{f:016x}" for f in fps]
    assert [got[i][1] for i in ids] == components(ids, fps)


def test_hot_buckets_are_cut_without_losing_links(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = [base ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(0, 9))) for _ in range(400)]
    fps = sorted(set(fps))
    rows = [(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)]
    links = simhash.links(spark.createDataFrame(rows, "fp bigint, node bigint"), cell=32)
    from clarion.operators.graph import connected_components

    named = {r.id: r.component for r in connected_components(links).collect()}
    want = components(list(range(len(fps))), fps)
    assert [named.get(k, k) for k in range(len(fps))] == want


def test_one_document_of_each_class_stays(spark):
    text = "the same words again and again in one long line"
    df = docs(spark, [text, text, "other words entirely, nothing shared at all", None, ""], [5, 2, 9, None, 7], extra=CLASHES)
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 2), (False, 7), (False, 9), (True, None)]
    assert simhash.classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [simhash.BROADCAST_ROWS, 0])
def test_rows_not_ids_are_told_apart(spark, monkeypatch, limit):
    """One id on two texts loses neither; copies and rows that repeat both leave one; null ids stay."""
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", limit)
    a, b = "the quick brown fox jumps over the lazy dog again", "entirely other words stand in this second text here"
    df = docs(spark, [a, b, b, b, a, a, None], [1, 1, 1, 2, 3, None, None], extra=CLASHES)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in simhash.deduplicated(df).collect())
    assert got == sorted([(-1, ""), (-1, a), (1, a), (1, b)])
    assert simhash.deduplicated(df).columns == df.columns


def test_of_rows_that_repeat_id_and_text_a_fixed_one_stays(spark):
    rows = [(1, "same text of some words", "en", "a", 1), (1, "same text of some words", "pt", "b", 2), (1, "same text of some words", None, "b", 2), (2, "quite another text with more of them", "en", "c", 3)]
    kept = set()
    for k in range(3):
        df = spark.createDataFrame(rows[k:] + rows[:k], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
        got = simhash.deduplicated(df)
        assert got.columns == df.columns
        kept.add(tuple(sorted(map(repr, got.collect()))))
    assert len(kept) == 1 and len(kept.pop()) == 2


def test_texts_beyond_one_slice_of_shingles():
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(70_000))
    assert simhash.fingerprint(text.encode()) == plain(text)
