"""Queries over the whole of their tables, on tables where a cut would show."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import oracle
from clarion.operators import evaluation
from clarion.plans import catalog, inputs, verification


def same(spark, folder, duck, name):
    columns, got = oracle.of_spark(catalog.queries()[name](spark, folder))
    names, want = oracle.of_sql(duck, catalog.oracle_sql()[name])
    assert columns == names and len(got) == len(want)
    assert [(a, b) for a, b in zip(got, want) if a != b][:3] == []
    return got


@pytest.fixture(scope="module")
def items(sf_dir, tmp_path_factory):
    """A folder with 50 benchmark items and 150 documents, and DuckDB over it."""
    folder, c = tmp_path_factory.mktemp("items"), duckdb.connect()
    c.execute(f"copy (select i as item_id, text from range(50) t(i) join '{sf_dir}/benchmark.parquet' b on b.item_id = i % 40) to '{folder}/benchmark.parquet'")
    c.execute(f"copy (select * from '{sf_dir}/documents.parquet' where doc_id < 150) to '{folder}/documents.parquet'")
    for t in ("benchmark", "documents"):
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), c


def test_every_item_is_ranked_over_whole_texts(spark, items):
    folder, duck = items
    same(spark, folder, duck, "origin_diversity_rank")
    ranked = catalog.queries()["origin_diversity_rank"](spark, folder)
    assert {r.claim_id for r in ranked.select("claim_id").distinct().collect()} == set(range(50))
    assert inputs.hit_claims(spark, folder).count() == 50


def test_excess_of_whole_claims(spark, sf_dir):
    same(spark, sf_dir, oracle.connection(sf_dir), "claim_validity")


@pytest.fixture(scope="module")
def turns(sf_dir, tmp_path_factory):
    """A folder with conversations, two turns of which have one opening and role, and DuckDB over it."""
    folder, c = tmp_path_factory.mktemp("turns"), duckdb.connect()
    opening = "the same opening of two turns"
    c.execute(f"copy (select conv_id, turn, role, text from '{sf_dir}/conversations.parquet' union all select 9001, k, 'user', '{opening} ' || k from range(2) t(k)) to '{folder}/conversations.parquet'")
    c.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    return str(folder), c


def test_turns_with_one_opening_are_different_pairs(spark, turns):
    same(spark, *turns, "audit_counts")


def test_real_texts_meet_the_200_character_rule(spark, turns):
    got = same(spark, *turns, "request_status")
    assert got


def test_every_turn_is_expanded(spark, turns):
    same(spark, *turns, "neighbour_expansion")


def test_every_document_is_compared_with_its_leaders(spark, sf_dir):
    duck = oracle.connection(sf_dir)
    got = same(spark, sf_dir, duck, "leader_dedup")
    assert len(got) == duck.execute("select count(*) from documents").fetchone()[0]


def test_every_document_is_an_article_of_a_claim(spark, sf_dir):
    n = oracle.connection(sf_dir).execute("select count(*) from documents").fetchone()[0]
    got = catalog.queries()["verify_claims"](spark, sf_dir).collect()
    assert len(got) == -(-n // 8)
    assert (sum(r.found for r in got), sum(r.read for r in got)) == (n, n)


def test_all_steps_of_the_policy_grid(spark, sf_dir):
    got = same(spark, sf_dir, oracle.connection(sf_dir), "policy_grid")
    assert len(got) == 190
    plan = catalog.queries()["policy_grid"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_votes_decide_like_whole_records(spark):
    """Null origins, single origins, neutral, unusable and empty claims, against records that hold all passages."""
    rng = random.Random(5)
    rows = [(k % 12, rng.choice([None, "", "a", "b"]) if k % 12 > 3 else "a", rng.random() < 0.2, "articleBody", "compatible", None, [rng.uniform(0, 3) for _ in range(3)]) for k in range(90)]
    p = spark.createDataFrame(rows, "id long, origin_group string, is_partial boolean, provenance string, temporal_alignment string, duplicate_of string, logits array<double>")
    gold = spark.range(13).select("id", F.when(F.col("id") % 2 == 0, "CONFIRMADO").otherwise("DIVERGENTE").alias("verdict"))
    none = spark.createDataFrame([(12, 0, "", [])], p.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.lit("").alias("error"), F.collect_list(F.struct("origin_group", "is_partial", "provenance", "temporal_alignment", "duplicate_of", F.array(F.struct("logits")).alias("passages"))).alias("sources")).schema)
    records = p.groupBy("id").agg(F.count("*").cast("int").alias("n"), F.when(F.col("id") == 7, "timeout").otherwise("").alias("error"), F.collect_list(F.struct("origin_group", "is_partial", "provenance", "temporal_alignment", "duplicate_of", F.array(F.struct("logits")).alias("passages"))).alias("sources")).unionByName(none).withColumnRenamed("n", "found_articles")
    want = oracle.of_spark(evaluation.policy_grid(gold, records))
    assert oracle.of_spark(evaluation.policy_grid_of_votes(gold, records.drop("sources"), evaluation.strongest_votes(p))) == want


def test_a_reviewed_entry_settles_its_claim(spark):
    day = dt.datetime(2026, 1, 1)
    text = "A lei foi aprovada em 10/05/2023 segundo o governo"
    claims_ = spark.createDataFrame([(1, text, day), (2, "O hospital da cidade foi aberto ao público", day)], "claim_id long, text string, reference_ts timestamp")
    hits = spark.createDataFrame([(k, k, f"https://bbc.com/{k}", "notícia", "texto", 0.5) for k in (1, 2)], "claim_id long, ix int, url string, title string, content string, score double")
    articles = spark.createDataFrame([(f"https://bbc.com/{k}", "O hospital da cidade e a lei que foi aprovada segundo o governo nesta semana. " * 4, "articleBody", False, None, None) for k in (1, 2)], "url string, text string, provenance string, is_partial boolean, published_at timestamp, original_source string")
    entry = ("e", text, [], 2023, "CONTRADITO", "https://bbc.com/lei", "o trecho", "reviewed", ["a", "b"], 0)
    catalog_ = spark.createDataFrame([entry], "id string, claim string, entities array<string>, event_year int, verdict string, url string, excerpt string, status string, reviewer_ids array<string>, position int")
    infer = lambda p: p.withColumn("logits", F.array(F.lit(5.0), F.lit(0.0), F.lit(0.0)))
    results, sources = verification.verify(claims_, hits, articles, infer, catalog=catalog_)
    got = {r.claim_id: (r.verdict, r.error, r.found, r.sources) for r in results.collect()}
    assert set(got) == {1, 2} and got[1] == ("CONTRADITO", None, 0, 0) and got[2][2] == 1
    assert {r.claim_id for r in sources.collect()} == {2}


def test_marks_of_fixtures_end_where_ascii_words_end(spark, tmp_path):
    long = " mentegaque de doll los adoboja asdora elasciónas"
    texts = ["Porñosaras" + long + "\nPor" + long + "\nPorta" + long, "POR!" + long + "\nleia TAMBÉM" + long + "\ncurta\n", "Por_" + long, "Foto\u0301" + long, "Publıcado em" + long, "", None]
    spark.createDataFrame(list(enumerate(texts, 101)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = same(spark, str(tmp_path), duck, "fixture_lines")
    assert (101, 0, True) in got and (101, 2, False) in got


def test_sentences_keep_what_is_not_a_space_at_their_ends(spark, tmp_path):
    texts = ["0 graus às 10. 1 não é 11? 2222222! 3", "  dois espaços .   fim  ", "0", "Um. Um. 1 e 1.\t", ""]
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(spark, str(tmp_path), duck, "sentence_stats")
