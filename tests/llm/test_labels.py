"""The two learned scores: held-out figures, no use of held-out labels, odd texts."""

import math
import random
import zlib

import numpy as np
import pytest
from helpers import CLASHES, ODD, docs
from pyspark.sql import functions as F

from clarion.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.mark.parametrize("score, label, folds, held, least", [(toxicity.toxicity, "toxic", 5, 0, 0.8), (quality.quality, "quality", 3, 1, 0.85)])
def test_held_out_ranking(tables, score, label, folds, held, least):
    d, y = tables
    got = score(d, y).join(y, "doc_id", "left").collect()
    assert len(got) == d.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert auc([(r.score, r[label]) for r in got if r.held_out and r[label] is not None]) >= least


@pytest.mark.parametrize("score, label, folds, held", [(toxicity.toxicity, "toxic", 5, 0), (quality.quality, "quality", 3, 1)])
def test_held_out_labels_are_not_used(spark, tables, score, label, folds, held):
    d, y = tables
    d, y = d.where("doc_id < 300"), y.where("doc_id < 300")
    out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds) == held
    flipped = y.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)).cast("int"))
    a, b = ({r.doc_id: r.score for r in score(d, l).collect()} for l in (y, flipped))
    assert a == b


@pytest.mark.parametrize("score", [toxicity.toxicity, quality.quality])
def test_odd_tables(spark, tables, score):
    _, y = tables
    df = docs(spark, ODD, extra=CLASHES)
    nulls = spark.createDataFrame([(0, None, None), (1, 1, 0), (1, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (y, y.limit(0), nulls, y.withColumn("text", F.lit("x")).withColumn("_id", F.lit(1))):
        rows = score(df, labels).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score(docs(spark, []), y).count() == 0


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({" zorg": 3.0, " vile ": 2.0}, [" vile dust "], [-4.0, 3.0, 0.5])
    assert toxicity.fold("Z0RG-ling vіle") == " zorg ling vile "  # a digit and a Cyrillic letter
    assert lexicon.features("Z0rgling")[0] > 0 and lexicon.features("vile")[0] > 0
    assert lexicon.features("vile dust") == lexicon.features("calm dust")
    long, short = lexicon.score("vile " + "calm " * 400), lexicon.score("vile calm")
    assert long < short


def test_folding_of_evasions():
    plain = toxicity.fold("vile")
    for evasion in ("VILE", "ｖｉｌｅ", "vi​le", "vi­le", "vílẹ", "v1le", "vіle", "𝓿𝓲𝓵𝓮", "vílé"):
        assert toxicity.fold(evasion) == plain, evasion
    for upper, lower in (("ДУРАК", "дурак"), ("ΒΛΆΚΑΣ", "βλάκας"), ("ÅSNA", "åsna"), ("ЁЛКА", "ёлка")):
        assert toxicity.fold(upper) == toxicity.fold(lower) != " "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("​…—") == " "
    assert toxicity.fold("a—b“c” d") == " a b c d "


def test_matches_are_those_of_plain_search():
    """The automaton against a search at every place, for overlapping entries and exceptions."""
    rng = random.Random(6)
    syllables = ["ka", "lo", "mi", "zu", "re"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    for _ in range(60):
        entries = {(f" {word(2)} " if rng.random() < 0.5 else f" {word(2)}"): 1.0 + rng.random() for _ in range(rng.randrange(0, 8))}
        exceptions = [f" {word(3)} " for _ in range(3)] + [f" {word(2)} {word(2)} " for _ in range(3)]
        lexicon = toxicity.Lexicon(entries, exceptions, [0.0, 1.0, 1.0])
        for _ in range(10):
            folded = toxicity.fold(" ".join(word(rng.randrange(1, 4)) for _ in range(rng.randrange(0, 25))))
            want = {}
            for k in range(len(folded)):
                for e, w in entries.items():
                    if folded.startswith(e, k):
                        want[k] = max(w, want.get(k, 0.0))
            for x in exceptions:
                for a in range(len(folded)):
                    if folded.startswith(x, a):
                        want = {k: w for k, w in want.items() if not a <= k < a + len(x) - 1}
            assert lexicon.found(folded) == want


def test_lexicon_counts_are_those_of_all_rows(spark):
    """Weights and exceptions learned in tasks against counts over the same rows in one loop."""
    rng = random.Random(7)
    rows = []
    for k in range(400):
        y = int(k % 2)
        own = [f"w{rng.randrange(20000)}" for _ in range(12)] + (["skark"] if y and rng.random() < 0.6 else []) + (["skarkfish"] if not y and k % 9 == 0 else [])
        rng.shuffle(own)
        rows.append((k, " ".join(own), y))
    rows += [(400 + k, rows[1][1], 1) for k in range(6)]  # copies of one toxic text
    rows.append((500, None, 1))
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    y = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    entries, exceptions, _ = toxicity.learn(d, y)
    sample = [(t, y) for i, t, y in rows if t is not None and zlib.crc32(str(i).encode()) % 5]
    words = [(set(toxicity.fold(t).split()), y) for t, y in sample]
    frequent = {w for w in set().union(*(w for w, _ in words)) if 4 * sum(w in own for own, _ in words) > len(words)}
    pos = {tuple(toxicity._signature(sorted(w), frequent)): w for w, y in words if y}.values()
    neg = [w for w, y in words if not y]
    has = lambda w, e: e.strip() in w if e.endswith(" ") else any(x.startswith(e.strip()) for x in w)
    assert any("skark".startswith(e.strip()) for e in entries)
    for e, weight in entries.items():
        m, n = (sum(has(w, e) for w in side) for side in (pos, neg))
        assert weight == pytest.approx(math.log((m + 0.5) / (len(pos) + 1)) - math.log((n + 0.5) / (len(neg) + 1)))
    if not any(e.endswith(" ") for e in entries):
        assert " skarkfish " in exceptions


def test_samples_are_bounded_and_take_long_and_repeated_rows(spark):
    from clarion.llm.labels import training_rows

    d = spark.createDataFrame([(k % 50, f"{'long ' * 9000}{k}") for k in range(100)] + [(90, None)], "doc_id bigint, text string")
    y = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(3, 0)], "doc_id bigint, toxic int")
    rows, totals = training_rows(d, y, "toxic", 5, 0, 10)
    got = rows.collect()
    assert sum(r.y for r in got) <= 10 and len(got) <= 20 and all(len(r.text) > 40_000 for r in got)
    assert totals == {v: sum(zlib.crc32(str(k).encode()) % 5 != 0 and k % 2 == v and k != 3 for k in range(100)) for v in (0, 1)}


def test_scores_are_sums_of_table_entries(spark, tables):
    """Vectorised bin additions against one row and one table at a time; trees against every cut."""
    d, y = tables
    model = quality.learn(d.where("doc_id < 400"), y)
    texts = [None, "", "one", *(r.text for r in d.limit(40).collect())]
    got = {r.doc_id: r.score for r in quality.scores(docs(spark, texts).select("doc_id", "text"), model).collect()}
    assert model.pairs and any(t.any() for t in model.tables)
    for k, t in enumerate(texts):
        x = quality.features((t or "").encode())
        bins = [sum(edge <= v for edge in edges) for v, edges in zip(x, model.edges)]
        total = model.intercept + sum(table[b] for table, b in zip(model.tables, bins))
        total += sum(table[model.coarse[f][bins[f]], model.coarse[g][bins[g]]] for f, g, table in model.pairs)
        assert got[k] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, total)))), abs=1e-9)
    rng = np.random.default_rng(3)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.uniform(0.5, 3, 9)
        value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + 1)
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        cuts = [c for c in range(1, 9) if h[:c].sum() >= 2 and h[c:].sum() >= 2]
        best = max(cuts, key=lambda c: gain(0, c) + gain(c, 9))
        want = np.r_[np.full(best, value(0, best)), np.full(9 - best, value(best, 9))] if gain(0, best) + gain(best, 9) > gain(0, 9) + 1e-9 else np.full(9, value(0, 9))
        assert np.allclose(quality._tree(g, h, 1), want)
