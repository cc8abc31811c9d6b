"""Ranks by sample sort against sorted lists, with a key that holds most of the rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clarion.operators import ranks, retrieval, splits
from clarion.sources import tsv


def hot(spark, n=4000):
    rng = random.Random(2)
    rows = [(None if k % 31 == 0 else "hot" if k % 10 else f"k{k % 7}", rng.randrange(50), k) for k in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, value int, id int").repartition(7), rows


@pytest.mark.parametrize("bound", [0, 10**6])
def test_ranks_and_totals_of_a_hot_key(spark, monkeypatch, bound):
    monkeypatch.setattr(ranks, "BROADCAST_ROWS", bound)
    df, rows = hot(spark)
    got = ranks.ranked(df, ["key"], [F.desc("value"), F.asc("id")], "r", "n")
    want, seen = {}, Counter()
    sizes = Counter(k for k, _, _ in rows)
    for k, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want[i] = (seen[k], sizes[k])
        seen[k] += 1
    assert {r.id: (r.r, r.n) for r in got.collect()} == want
    assert {r.id: (r.r, r.n) for r in ranks.ranked_in_task(df, ["key"], [F.desc("value"), F.asc("id")], "r", "n").collect()} == want


def test_without_keys_clashing_names_and_no_rows(spark):
    df, rows = hot(spark, 500)
    df = df.withColumnsRenamed({"value": "_at", "key": "_first"})
    got = ranks.ranked(df, [], [F.asc("id")], "r", "n")
    assert {r.id: (r.r, r.n) for r in got.collect()} == {k: (k, 500) for k in range(500)}
    assert ranks.ranked(df, ["_first"], [F.asc("id")]).columns == ["_first", "_at", "id", "rank"]
    assert ranks.ranked(df.limit(0), ["_first"], [F.asc("id")]).count() == 0


def test_no_window_sees_a_key(spark):
    """The ranks of hot keys come from places in sorted ranges; the hot key lies in several of them."""
    df, _ = hot(spark)
    scored = df.select("key", F.col("id").alias("ix"), (F.col("value") / 4.0).alias("lexical"), (F.col("value") / 50).alias("similarity"))
    made = [
        retrieval.fused(scored, ["key"]), retrieval.candidates(scored, ["key"]), tsv.length_batches(df, "value", 16, ["id"]),
        splits.packed(spark.range(40).select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("component")), {"train": 20, "calibration": 10, "test": 10}),
    ]
    for out in made:
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = df.repartitionByRange(F.asc("key"), F.asc("id")).withColumn("p", F.spark_partition_id())
        assert {r.p for r in ranged.collect() if r.key == "hot"} == {0, 1, 2, 3}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_small_keys_give_the_same(spark):
    df, _ = hot(spark, 600)
    scored = df.select("key", F.col("id").alias("ix"), (F.col("value") / 4.0).alias("lexical"), (F.col("value") / 50).alias("similarity")).where("key is not null")
    rows = lambda d: sorted(map(tuple, d.collect()))
    for f in (retrieval.fused, retrieval.candidates):
        assert rows(f(scored, ["key"])) == rows(f(scored, ["key"], small=True))


def test_exact_ranks_by_histograms(spark):
    """Values at any rank, with ties, huge spreads, infinities, NaN and nulls; no task sorts a group."""
    rng = random.Random(9)
    inf, nan = float("inf"), float("nan")
    groups = {
        "ties": [1.0] * 500 + [2.0] * 499, "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 308) for _ in range(400)], "plain": [rng.gauss(0, 1) for _ in range(701)],
        "odd": [inf, -inf, nan, nan, 0.0, -0.5, 1e308, -1e308, 5e-324], "one": [3.0], None: [float(k) for k in range(10)], "none": [],
    }
    rows = [(g, x) for g, xs in groups.items() for x in [*xs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    key = lambda x: (x != x, x)
    for rank, at in ((F.floor(F.col("n") / 2), lambda n: n // 2), (F.lit(0), lambda n: 0), (F.col("n") - 1, lambda n: n - 1), (F.ceil(F.col("n") * 19 / 20) - 1, lambda n: -(-19 * n // 20) - 1)):
        got = {r.g: repr(r.value) for r in ranks.at_rank(df, ["g"], "x", rank).collect()}
        assert got == {g: repr(sorted(xs, key=key)[at(len(xs))]) for g, xs in groups.items() if xs}
    whole = sorted((x for xs in groups.values() for x in xs), key=key)
    (r,) = ranks.at_rank(df, [], "x", F.floor(F.col("n") / 3), "third").collect()
    assert r.third == whole[len(whole) // 3]
    assert ranks.at_rank(df.limit(0), ["g"], "x", F.lit(0)).count() == 0
