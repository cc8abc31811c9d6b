import random
import zlib
from collections import defaultdict

from helpers import CLASHES, ODD, docs, words

from clarion.llm import sharding


def rows_of(df):
    return df.collect()


def test_law_groups_and_slots(spark):
    rng = random.Random(1)
    texts = ODD + [words(rng, rng.randrange(1, 400)) for _ in range(600)]
    texts += [texts[20]] * 40 + [None]
    df = docs(spark, texts, extra=CLASHES)
    got = sharding.shard_documents(df, shards=8).collect()
    assert len(got) == len(texts)
    by_text, load, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 16 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        by_text[t].add(r.shard)
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(sum(r.size for r in got if (texts[r.doc_id] or "") == t) for t in by_text)
    assert max(load.values()) - min(load.values()) <= largest
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_documents(df.repartition(3), shards=8).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}


def test_scheduling_is_longest_first():
    plan = sharding.schedule([("a", 7), ("b", 5), ("c", 4), ("d", 3), ("e", 1)], 2)
    load = defaultdict(int)
    for k, n in (("a", 7), ("b", 5), ("c", 4), ("d", 3), ("e", 1)):
        load[plan[k]] += n
    assert sorted(load.values()) == [10, 10]


def test_odd_tables(spark):
    assert sharding.shard_documents(docs(spark, [])).count() == 0
    twice = docs(spark, ["a", "a", None], [1, 1, None])
    got = sharding.shard_documents(twice).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3
