import tempfile

from pyspark.sql import functions as F

from clarion.functions import encoding, notes
from clarion.operators import evaluation, retrieval
from clarion.sources import records


def test_special_tokens_survive_truncation(spark):
    df = spark.createDataFrame([(list(range(10, 30)), list(range(50, 54)))], "p array<int>, h array<int>")
    row = df.select(encoding.single(F.col("p"), 1, 2, 8), encoding.pair(F.col("p"), F.col("h"), 101, 102, 12), encoding.pair(F.col("h"), F.col("p"), 101, 102, 10), encoding.fitted(F.col("h"), 6), encoding.fitted(F.col("p"), 3)).first()
    assert row[0] == [1, 10, 11, 12, 13, 14, 15, 2]
    assert row[1]["ids"] == [101, 10, 11, 12, 13, 14, 102, 50, 51, 52, 53, 102] and row[1]["segments"] == [0] * 7 + [1] * 5 and row[1]["mask"] == [1] * 12
    assert row[2]["ids"] == [101, 102, *range(10, 17), 102]
    assert row[3] == [50, 51, 52, 53, 0, 0] and row[4] == [10, 11, 12]
    m = spark.range(1).select(encoding.labelled(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(0.1), F.lit(0.9)))).first()[0]
    assert m == {"a": 0.1, "b": 0.9}


def test_notes(spark):
    rows = [("u", True, "unknown", "mixed"), (None, True, "unknown", "mixed"), (None, False, "incompatible", "mixed"), (None, False, "unknown", "mixed"), (None, False, "compatible", "mixed"), (None, False, "compatible", "insufficient"), (None, False, "compatible", "supports")]
    df = spark.createDataFrame(rows, "d string, p boolean, a string, s string")
    assert [r[0] for r in df.select(notes.evidence_note(*[F.col(c) for c in "dpas"])).collect()] == ["sameOrigin", "partial", "otherPeriod", "periodUnknown", "mixed", "insufficient", "complete"]
    e = spark.createDataFrame([("noConnection",), ("modelLoadFailed",), ("?",), (None,)], "e string")
    assert [r[0] for r in e.select(notes.retriable(F.col("e"))).collect()] == [True, False, None, None]
    assert spark.range(1).select(notes.shown_excerpt(F.lit("  " + "x" * 301))).first()[0] == "x" * 299 + "…"


def test_training_guard(spark):
    pair = "array<struct<premise:string,hypothesis:string,label:string>>"
    df = spark.createDataFrame([("1", "train", "reviewed", [("p", "h", "neutral"), ("p", "h", "other")]), ("2", "test", "reviewed", [("p", "h", "entailment")]), ("3", "train", "pending", [("p", "h", "entailment")])], f"id string, split string, review_status string, pairs {pair}")
    pairs = evaluation.training_pairs(df)
    assert [(r.id, r.label) for r in pairs.collect()] == [("1", "neutral")]
    assert {r.label for r in evaluation.missing_labels(pairs).collect()} == {"entailment", "contradiction"}
    claims = spark.range(3).withColumnRenamed("id", "claim_id")
    assert tuple(evaluation.negation_coverage(claims, claims.where("claim_id < 2")).first()) == (3, 1)


def test_state_and_runs(spark):
    path = tempfile.mkdtemp(prefix="spark-") + "/state"
    assert records.load_state(spark, path, "hits int").count() == 0
    for n in (1, 2):
        records.save_state(spark.createDataFrame([(n,)], "hits int"), path)
    assert [r.hits for r in records.load_state(spark, path, "hits int").collect()] == [2]
    rows = retrieval.consecutive(spark.range(10).withColumn("k", F.lit(0)), ["k"], [F.col("id")], 4)
    assert [r.batch for r in rows.orderBy("id").collect()] == [0] * 4 + [1] * 4 + [2] * 2
