import hashlib
import random
import re

import pytest
from helpers import CLASHES, ODD, docs, words
from pyspark.sql import functions as F

from clarion.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    grams = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[j : j + n]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for g, names in grams.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found |= names
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block", [10_000_000, 700])
def test_same_as_brute_force(spark, block):
    rng = random.Random(5)
    items = [(k, words(rng, n, 30)) for k, n in enumerate([25, 12, 10, 9, 3, 1, 40])] + [(7, "Solo"), (8, None), (9, "..."), (3, words(rng, 11, 30)), (10, "a, B c")]
    texts = ODD + [words(rng, 400, 30) for _ in range(20)]
    for k, (_, t) in enumerate(items[:7]):
        texts += [words(rng, 30) + " " + t.upper() + ". " + words(rng, 5), t, t[: len(t) // 2]]
    texts += ["say solo now", "A b C"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs(spark, texts), bench, block_bytes=block).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == brute(texts, items)


def test_longest_matches_have_places(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{k}" for k in range(20)))], "item_id bigint, text string")
    text = "lead in " + " ".join(f"b{k}" for k in range(3, 17)) + " tail"
    m = decontaminate.matches(docs(spark, [text]), bench).first()["matches"]
    assert [tuple(s) for s in m["spans"]] == [(2, 14, "1", 3)]


def test_empty_tables_and_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    full = docs(spark, ["one two three four five six seven eight nine ten", "clean", None], extra=CLASHES)
    kept = decontaminate.decontaminated(full, bench)
    assert kept.columns == full.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    got = decontaminate.contamination(full, bench)
    assert {r.doc_id: r.n_words for r in got.select("doc_id", F.col("n_words")).collect()} == {0: 10, 1: 1, 2: 0}
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.decontaminated(full, bench.limit(0)).count() == 3


def test_items_of_equal_words_are_searched_once(spark):
    """Every id of equal items is reported, also over several blocks; the window is stored once."""
    window = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(k, window if k % 2 else f"{window} und more {k}") for k in range(30)] + [(99, None)], "item_id bigint, text string")
    df = docs(spark, [f"a {window} b", "none of it", None, f"{window} " * 50])
    for block in (16_000_000, 300):
        got = {r.doc_id: r for r in decontaminate.contamination(df, items, block_bytes=block).collect()}
        ids = ",".join(sorted(map(str, range(30))))
        assert [got[k].n_items for k in range(4)] == [30, 0, 0, 30]
        assert got[0].items_sha256 == hashlib.sha256(ids.encode()).hexdigest() and got[0].n_hit == 12
    q = decontaminate.Queries([(k, window.encode()) for k in range(1000)], 10)
    assert len(q.low) == 3 and len(q.names[0]) == 1000 and len(q.search([decontaminate.words_of(window)])[0]) == 1


@pytest.mark.parametrize("block", [16_000_000, 40])
def test_an_id_of_several_texts_stands_for_each(spark, block):
    items = [(3, "x y z"), (3, "p q r"), (5, "p q r"), (3, "a b c"), (4, "x y z"), (10, "x y z")]
    texts = ["say p q r now", "x y z", "a b c and p q r", "a b c", "none"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs(spark, texts), bench, block_bytes=block).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == brute(texts, items)
    assert [r.n_items for r in got] == [2, 3, 2, 1, 0]


def test_one_text_larger_than_a_shard(spark):
    rng = random.Random(9)
    items = [(1, words(rng, 12, 30)), (2, "p q r")]
    texts = [words(rng, 3000, 30) + " p q r " + items[0][1].upper(), "p q r", None]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.contamination(docs(spark, texts), bench, shard_bytes=500).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == brute(texts, items)
