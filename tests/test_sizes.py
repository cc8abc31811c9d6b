"""How work is dealt and how often it is done: what larger tables depend on."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

from clarion.functions import passages as rules, urls
from clarion.functions.scores import cosine, length
from clarion.functions.text import fold, terms, token_estimate as chunk_tokens
from clarion.operators import chunking, claims, duplicates, evaluation, pages, retrieval
from clarion.plans import verification
from clarion.plans.verification import hashed_embedding
from clarion.sources import search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_walks_of_one_partition_are_dealt_to_several_tasks_and_sent_together(spark):
    starts = spark.range(3000, numPartitions=1).select(F.concat(F.lit("x"), F.col("id").cast("string"), F.lit(":0:3:1")).alias("start"))
    found = search.followed(starts, "clarion.sources.frozen:count_pages").withColumn("task", F.spark_partition_id())
    assert found.count() == 9000 and found.select("start", "page").distinct().count() == 9000
    assert found.select("task").distinct().count() > 1


def test_a_claim_is_folded_once_for_its_searches(spark):
    rows = [(k, t) for k, t in enumerate(["Hoje o preço subiu", "Em 31/02/2020 caiu", "Em 05/03/2019 segundo o órgão", "agora preside", "a " * 300, "", None])]
    made = claims.query_plan(spark.createDataFrame(rows, "claim_id int, text string").withColumn("reference_ts", F.lit("2024-02-01 12:00:00").cast("timestamp")))
    assert plan(made).count("translate(") == 1
    got = {(r.claim_id, r.kind): r.text for r in made.collect()}
    assert got[0, "descriptive"] == "em 2024-02-01 o preço subiu" and got[3, "contextual"] == "agora preside 2024-02-01" and (4, "contextual") in got
    assert {k for k, _ in got} == {0, 1, 2, 3, 4, 5}


def test_words_of_passages_meet_as_numbers_and_ids_may_repeat(spark):
    gold = [("a", "https://x.org/1", "one two three"), ("a", "https://x.org/2", "four five six"), ("a", "https://x.org/1", "seven eight nine")]
    shown = [(1, "https://x.org/1", "zero one two three"), (1, "https://x.org/2", "four five six"), (2, "https://x.org/1", "six seven eight nine"), (3, "https://x.org/2", "one two three")]
    got = evaluation.matched_spans(spark.createDataFrame(gold, "span_id string, url string, text string"), spark.createDataFrame(shown, "passage_id int, url string, text string"))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 2)]
    assert "word#" in plan(got) and got.select("span_id").where("span_id = 'a'").count() == 2


def test_scans_and_passages_are_handed_on_in_bounded_batches():
    html = pa.array(["<p>" + "a" * 300_000] * 10 + [None, ""])
    ids = pa.array(range(12))
    made = list(pages._scans([pa.RecordBatch.from_arrays([html, ids], names=["html", "id"])], ["id"]))
    assert [b.num_rows for b in made] == [4, 4, 4] and [i for b in made for i in b["id"].to_pylist()] == list(range(12))
    parts = pa.array([["Uma frase. " * 30_000]] * 5 + [None, []])
    batch = pa.RecordBatch.from_arrays([parts, pa.array([512] * 7), pa.array(range(7))], names=["_parts", "_limit", "id"])
    cut = list(chunking._cuts([batch], ["id"], lambda p, b: chunking.passages(p, b)))
    assert [b.num_rows for b in cut] == [4, 3] and [i for b in cut for i in b["id"].to_pylist()] == list(range(7))
    assert [len(x) > 1 for b in cut for x in b["_p"].to_pylist()] == [True] * 5 + [False] * 2


def test_more_events_are_more_partitions(spark, monkeypatch):
    monkeypatch.setattr(pages, "EVENTS", 100)
    read = pages.scanned(spark.range(50).select("id", F.repeat(F.lit("<p>a</p>"), 20).alias("html")))
    assert pages._exploded(read).rdd.getNumPartitions() == 30


def test_texts_that_link_alike_are_compared_once(spark, monkeypatch):
    """300 texts of three bases with a word of their own each: as many kinds as bases, not as texts."""
    word = lambda k: "".join(chr(98 + int(d)) for d in str(k))
    base = [" ".join(f"b{word(k)}x{word(j)}" for j in range(60)) for k in range(3)]
    texts = [f"v{word(k)} {base[k % 3]}" if k % 2 else f"{base[k % 3]} w{word(k)}" for k in range(300)]
    sizes, stored = [], duplicates.stored

    def counted(df, *paths, **options):
        made = stored(df, *paths, **options)
        if "common" in made.columns and "piece" in made.columns:
            sizes.append(made.count())
        return made

    monkeypatch.setattr(duplicates, "stored", counted)
    got = {r.doc_id: (r.family, r.links) for r in duplicates.families(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {k: (k % 3, 99) for k in range(300)} and sizes == [3]


def test_texts_of_rare_guards_are_compared_without_counting_shingles(spark):
    words = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100))
    rows = [(k, f"Nome{chr(97 + k // 2)} {words} {'fim' if k % 2 else 'termo'}") for k in range(40)]
    _, distinct = duplicates.representatives(spark.createDataFrame(rows, "doc_id int, text string"))
    assert {r.texts for r in distinct.collect()} == {2}
    assert {(r.a, r.b) for r in duplicates.near_pairs(distinct).collect()} == {(2 * k, 2 * k + 1) for k in range(20)}
    assert duplicates.prefixes(distinct.where(F.col("texts") > duplicates.TEXTS), 0.85).count() == 0


def test_a_text_is_folded_once_when_it_is_cut(spark):
    _, distinct = duplicates.representatives(spark.createDataFrame([(1, "um dois"), (2, "um dois tres")], "doc_id int, text string"))
    assert plan(distinct).count("translate(") == 1


def test_passage_rules_look_before_they_replace(spark):
    """Plain searches decide whether a pattern is needed; what is left is what all patterns leave."""
    tail = " e o governo anunciou ontem que a obra da ponte nova ficou pronta"
    texts = ["Por Ana da Silva* 10/05/2023 às 7h30 -" + tail, "Por  Ana" + tail + " Foto: Rui", "Porta 1/2 8h5 9:3 :" + tail, "Publicado\tem 10:20 | Atualizado" + tail, "LEIA MAIS:" + tail, "Última newsletter" + tail, "a b c " + "x" * 40, "a b c d " + "x" * 40, " \x0b; ", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    plain = F.col("t")
    for pattern in rules.CHROME:
        plain = F.regexp_replace(plain, pattern, " ")
    plain = F.btrim(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(rules.EDGES))
    got = df.select("id", rules.without_chrome(F.col("t")).alias("a"), plain.alias("b"), rules.rejection(F.col("t")).alias("why"))
    assert all(r.a == r.b for r in got.collect())
    assert {r.id: r.why for r in got.collect()} == {0: None, 1: None, 2: None, 3: "pageTitle", 4: "navigation", 5: "navigation", 6: "tooShort", 7: None, 8: "tooShort", 9: "tooShort", 10: None}
    assert "RLIKE navegue" not in plan(got) and plan(got.select("why")).count("Contains(") + plan(got.select("why")).count("contains(") > 14


def test_leaders_keep_digests_and_cut_only_contested_texts(spark):
    words = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    rows = [(1, k, f"https://x.org/{k}", t, False) for k, t in enumerate([words, words + " fim", words, "nada disso"])]
    paths = []
    led = duplicates.leaders(spark.createDataFrame(rows, "claim_id int, rank int, url string, text string, is_partial boolean"), paths=paths)
    kept = spark.read.parquet(paths[0])
    assert not {"text", "shingles"} & set(kept.columns) and {r.rank: r._contested for r in kept.collect()}[3]
    assert {r.rank: r.leader_url for r in led.collect()} == {0: None, 1: "https://x.org/0", 2: "https://x.org/0", 3: None}


def test_scores_of_a_groups_own_query_are_those_of_bm25(spark):
    docs = spark.createDataFrame([("a", 1, "o gato e o rato"), ("a", 2, "o cão"), ("a", 3, None), ("b", 1, "gato gato 1,5")], "g string, d int, t string")
    q = spark.createDataFrame([("a", 0, "gato o"), ("b", 0, "gato 1,5")], "g string, q int, t string")
    whole = {(r.g, r.d): r.score for r in retrieval.bm25(docs, q, ["g"], "d", "t", "q", "t").collect()}
    asked = docs.join(q.select("g", F.array_distinct(terms(F.col("t"))).alias("asked")), "g").select("g", "d", retrieval.matched(F.col("t"), F.col("asked")).alias("m")).select("g", "d", "m.*")
    assert {(r.g, r.d): r.score for r in retrieval.bm25_of_own(asked, ["g"], ["d"]).collect()} == whole and len(whole) == 3


def test_documents_scores_add_up_where_their_terms_lie(spark):
    docs = spark.createDataFrame([(k, "gato rato " * (k % 3) + "cão") for k in range(50)], "d int, t string")
    got = retrieval.bm25(docs, spark.createDataFrame([(7, "gato"), (8, "cão rato")], "q int, t string"), [], "d", "t", "q", "t")
    assert len(got.collect()) == 33 + 50 and "hashpartitioning(_q" not in got._jdf.queryExecution().executedPlan().toString()


def test_paragraphs_and_passages_are_folded_once_each(spark):
    made = chunking.windows(spark.createDataFrame([(1, "Leia Também\nUma frase inteira com palavras que bastam, e mais uma. " * 3, 9)], "id int, text string, n int"), "text", "n")
    assert plan(made).count("translate(") == 2 and [(r.ix, r.text[:3]) for r in made.collect()][0] == (0, "Uma")


def listed(df, *names):
    """The rows of each key as lists in order of ix."""
    return df.groupBy("k").agg(*[F.array_sort(F.collect_list(F.struct("ix", n))).getField(n).alias(n) for n in names])


def test_passages_in_a_list_are_scored_and_chosen_like_rows(spark):
    words = "gato rato cão pão 1,5 casa".split()
    rows = [(k, i, " ".join(words[(i * 7 + j * j + k) % 6] for j in range((i * 5 + k) % 9))) for k, n in enumerate((1, 30, 49, 200)) for i in range(n)]
    docs = spark.createDataFrame(rows, "k int, ix int, text string")
    q = spark.createDataFrame([(0, 0, "rato"), (1, 0, "gato 1,5 nada"), (2, 0, "casa cão"), (3, 0, None)], "k int, q int, t string")
    whole = {(r.k, r.ix): r.score for r in retrieval.bm25(docs, q, ["k"], "ix", "text", "q", "t").collect()}
    own = listed(docs, "text").join(q.select("k", F.coalesce(F.array_distinct(terms(F.col("t"))), F.array().cast("array<string>")).alias("asked")), "k")
    own = own.select("k", retrieval.scores_of_own(F.transform("text", fold), F.col("asked")).alias("s")).withColumn("c", retrieval.candidates_of_own(F.col("s")))
    got = own.select("k", F.posexplode(F.arrays_zip("s", "c")).alias("ix", "x")).select("k", "ix", "x.s", "x.c").collect()
    assert {(r.k, r.ix): r.s for r in got if r.s > 0} == whole and len(got) == len(rows)
    flat = spark.createDataFrame([(r.k, r.ix, r.s) for r in got], "k int, ix int, lexical double")
    assert {(r.k, r.ix) for r in retrieval.candidates(flat, ["k"]).collect()} == {(r.k, r.ix) for r in got if r.c} and not all(r.c for r in got)


def test_passages_in_a_list_grow_like_rows(spark):
    texts = {0: ["a b", "c d", "a b", "e " * 40, "a b", ""], 1: ["só esta"], 2: ["x y z", "x y z", "w"]}
    rows = [(k, i, t) for k, all_ in texts.items() for i, t in enumerate(all_)]
    windows = spark.createDataFrame(rows, "k int, ix int, text string")
    chosen = spark.createDataFrame([(0, 4, 1, 0.5), (0, 2, 2, 0.4), (0, 3, 3, 0.3), (1, 0, 1, 0.9), (2, 1, 2, 0.2), (2, 2, 1, 0.1)], "k int, ix int, position int, similarity double")
    for room in (2, 4, 7, 100):
        grown = retrieval.expanded(windows, chosen.join(windows, ["k", "ix"]), ["k"], F.lit(room), chunk_tokens)
        want = {(r.k, r.position, r.similarity, r.expanded) for r in grown.collect()}
        own = listed(windows, "text").join(chosen.groupBy("k").agg(F.collect_list(F.struct("position", "ix", "similarity")).alias("c")), "k")
        got = own.select("k", F.explode(retrieval.expanded_of_own(F.col("text"), F.col("c"), F.lit(room), chunk_tokens)).alias("x")).select("k", "x.*").collect()
        assert {(r.k, r.position, r.similarity, r.expanded) for r in got} == want and len(got) == len(want)


def test_only_contested_texts_are_folded_again(spark):
    """The digest of a text is no key of the join, where each text would have to be folded for it."""
    rows = [(1, k, f"https://x.org/{k}", f"nada disso {k}", False) for k in range(3)]
    led = duplicates.leaders(spark.createDataFrame(rows, "claim_id int, rank int, url string, text string, is_partial boolean"))
    joins = [x for x in plan(led).splitlines() if "Join" in x]
    assert joins and not any("sha2" in x for x in joins)


def test_words_are_counted_once_embedded_as_before(spark):
    import zlib

    import numpy as np

    texts = ["", "um dois dois", "É o  gato\te o RATO " * 9, None, "0"]
    for r in hashed_embedding(spark.createDataFrame([(t,) for t in texts], "text string")).collect():
        v = np.zeros(64, np.float32)
        for w in (r.text or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >> 31 else -1
        assert r.vector == (v / (np.linalg.norm(v) or 1)).tolist()


def test_given_lengths_give_the_same_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.5, 3.0], [0.1, 0.2, 0.7]), ([0.0], [1.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<float>, b array<float>")
    rows = df.select(cosine(F.col("a"), F.col("b")).alias("x"), cosine(F.col("a"), F.col("b"), length(F.col("a")), length(F.col("b"))).alias("y")).collect()
    assert [r.x for r in rows] == [r.y for r in rows] and rows[0].x > 0


def test_a_host_is_parsed_once_for_all_its_suffixes(spark):
    made = spark.createDataFrame([("https://www.g1.globo.com./x",), ("https://saude.gov.br",), ("http://globo.com",), ("no url",), (None,)], "u string").select(urls.matched_domain(urls.host(F.col("u"))).alias("d"), urls.profile(urls.host(F.col("u"))).alias("p"))
    assert len(re.findall(r"\bu#", plan(made.select("d")).splitlines()[0])) == 1
    assert [(r.d, r.p.editorial_origin) for r in made.collect()] == [("g1.globo.com", "grupo-globo"), ("gov.br", "saude.gov.br"), (None, "grupo-globo"), (None, None), (None, None)]


def test_sentences_end_where_they_did_and_passages_that_fit_are_not_cut_again():
    behind = re.compile(r"(?<=[.!?])\s+")
    for text in ("", "  Um. Dois?! Três", "a.b c .  d !\te", ". . x", "fim. ", "a. b"):
        assert chunking._sentences(text) == [s for s in (p.strip() for p in behind.split(text)) if s]
    asked = []

    def tokens(text):
        asked.append(text)
        return len(text.split())

    for budget in (1, 2, 5, 9):
        for text in ("um dois. três quatro cinco seis. sete", "a b c d e f g h", "x" * 40, ""):
            assert chunking.passages([text] * 3, budget, chunking.estimate) == chunking.passages([text] * 3, budget, lambda t: chunking.estimate(t))
    assert chunking.passages(["um dois três."], 9, tokens) == ["um dois três."] and asked == ["um dois três."]


def test_articles_of_one_partition_are_cut_in_many_tasks(spark, monkeypatch):
    seen, lists = [], chunking.window_lists

    def watched(docs, *rest, **more):
        seen.append(docs.rdd.getNumPartitions())
        return lists(docs, *rest, **more)

    monkeypatch.setattr(chunking, "window_lists", watched)
    claim = spark.createDataFrame([(1, "O hospital foi aberto")], "claim_id long, text string").withColumn("reference_ts", F.lit("2024-02-01 12:00:00").cast("timestamp"))
    hits = spark.range(40, numPartitions=1).select(F.lit(1).cast("long").alias("claim_id"), F.col("id").alias("ix"), F.concat(F.lit("https://bbc.com/"), F.col("id").cast("string")).alias("url"), F.lit("o hospital").alias("title"), F.lit("da cidade").alias("content"), F.lit(0.5).alias("score"))
    none = [F.lit(None).cast(k).alias(n) for n, k in (("published_at", "timestamp"), ("original_source", "string"))]
    articles = hits.select("url", F.lit("O hospital da cidade foi aberto ao público nesta semana. ").alias("text"), F.lit("articleBody").alias("provenance"), F.lit(False).alias("is_partial"), *none)
    results, _ = verification.verify(claim, hits, articles, lambda p: p.withColumn("logits", F.array(F.lit(5.0), F.lit(0.0), F.lit(0.0))))
    assert [(r.found, r.read, r.verdict) for r in results.collect()] == [(40, 8, "CONFIRMADO")]
    assert seen == [verification.TASKS * spark.sparkContext.defaultParallelism]
