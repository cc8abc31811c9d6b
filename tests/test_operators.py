"""Cases that SQL can't hold: literal examples, folds against brute force, pages, sources, streams."""

import datetime as dt
import json
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clarion.functions import passages as rules, scores, text as tx, urls
from clarion.operators import audits, chunking, claims, duplicates, evaluation, pages, quota, quiz, retrieval, splits, verdicts
from clarion.plans import inputs
from clarion.sources import records, search, tsv


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


# Scalar rules


def test_host_and_allowlist(spark):
    cases = [
        ("https://www.g1.globo.com/x", "g1.globo.com"), ("https://sub.G1.globo.com./x", "g1.globo.com"), ("https://fakeg1.globo.com.evil.com/", None), ("https://notgov.br/", None),
        ("https://agenciagov.ebc.com.br/", "agenciagov.ebc.com.br"), ("https://band.com.br/a", "www.band.com.br"), ("https://saude.gov.br/", "gov.br"), ("no url", None),
    ]
    got = values(spark, cases, "url string, want string", urls.matched_domain(urls.host(F.col("url"))), "want")
    assert [a for a, _ in got] == [b for _, b in got]
    ok = values(spark, [("https://u:p@bbc.com/",), ("http://bbc.com/",), ("https://bbc.com/",), ("::bad::",)], "url string", urls.allowed(F.col("url")))
    assert [x for (x,) in ok] == [False, False, True, False]


def test_two_canonical_urls(spark):
    got = values(spark, [("https://WWW.a.com/p/?utm_source=x&id=1#f",), ("https://a.com/?fbclid=1",)], "u string", urls.canonical_online(F.col("u")), urls.canonical_offline(F.col("u")))
    assert got == [("https://a.com/p/?id=1", "https://a.com/p"), ("https://a.com", "https://a.com")]


def test_passage_rules_name_their_reason(spark):
    good = "O ministério informou nesta terça que a campanha de vacinação foi ampliada para todo o país."
    cases = [
        ("Title: Economia e mercado hoje", "pageTitle"), ("Economia | Portal de notícias", "pageTitle"), ("A taxa caiu | diz órgão, e o governo comemorou o resultado do mês.", None),
        ("Leia também: outras notícias do dia e da semana passada", "navigation"), ("Curto demais.", "tooShort"), ("Por Ana Maria da Silva 27/04/2023 15h57 Atualizado em 28/04/2023", "tooShort"),
        ("Por causa da chuva, o evento foi adiado para a próxima semana no parque.", None), ("Foto: Reprodução de imagem muito comprida de arquivo pessoal do autor", "tooShort"), (good, None), ("", "tooShort"),
    ]
    got = values(spark, cases, "p string, want string", rules.rejection(F.col("p")), "want")
    assert [a for a, _ in got] == [b for _, b in got]
    assert values(spark, [(good, False), (good, True), (good, None)], "p string, v boolean", rules.rejection(F.col("p"), F.col("v"))) == [("noVerb",), (None,), (None,)]


def test_best_label_ties(spark):
    got = values(spark, [(0.4, 0.4, 0.2), (0.4, 0.2, 0.4), (0.2, 0.3, 0.5)], "e double, n double, c double", scores.best_label(F.col("e"), F.col("n"), F.col("c")))
    assert [x for (x,) in got] == ["neutral", "entailment", "contradiction"]


def test_vectors_and_intervals(spark):
    v = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], []), ([0.0], [1.0])]
    assert [x for (x,) in values(spark, v, "a array<float>, b array<float>", scores.cosine(F.col("a"), F.col("b")))] == [1.0, 0.0, -1.0, 0.0, 0.0, 0.0]
    ((w, none),) = values(spark, [(8, 10)], "s int, n int", scores.wilson(F.col("s"), F.col("n")), scores.wilson(F.lit(0), F.lit(0)))
    assert none is None and (round(w["low"], 4), round(w["high"], 4)) == (0.4902, 0.9433)
    ((m,),) = values(spark, [([4.0, 1.0, 3.0, 2.0],)], "x array<double>", scores.upper_median(F.col("x")))
    assert m == 3.0
    rule = values(spark, [([0.7, 0.2, 0.1], 0.8), ([0.7, 0.2, 0.1], 0.1), ([0.1, 0.2, 0.7], 0.6)], "p array<double>, n double", scores.symmetric(F.col("p"), F.col("n"), 0.5), scores.differential(F.col("p")[0], F.col("n"), 0.2))
    assert rule == [("neutral", "neutral"), ("entailment", "entailment"), ("contradiction", "contradiction")]


def test_words_and_pools(spark):
    ((kept, pooled),) = values(spark, [("A inflação de São Paulo, e o novo IPCA.", [[1.0, 3.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0])], "t string, v array<array<double>>, m array<int>", tx.keywords(F.col("t")), scores.mean_pool(F.col("v"), F.col("m")))
    assert kept == "inflação São Paulo, IPCA." and pooled == [2.0, 4.0]


# Claims


def test_context_of_relative_days_and_dates(spark):
    at = dt.datetime(2026, 11, 4, 15)
    texts = ["Ontem choveu", "hoje e anteontem", "Em 31/02/2024 algo", "em 05/03/2021 houve", "atualmente é", "nada aqui", "O rei diz que sim em 1999"]
    rows = values(spark, [(t, at) for t in texts], "t string, at timestamp", claims.context(F.col("t"), F.col("at")))
    c = [r[0] for r in rows]
    assert [x["kind"] for x in c] == ["recent", "recent", "historical", "historical", "current", "timeless", "historical"]
    assert c[0]["start"] == dt.datetime(2026, 11, 3, 3) and c[1]["start"] == dt.datetime(2026, 11, 3, 3)
    assert c[2]["start"] == dt.datetime(2024, 1, 1, 3) and c[3]["end"] == dt.datetime(2021, 3, 6, 3) and c[6]["attributed"]


def test_alignment_names_the_day(spark):
    start, end = dt.datetime(2021, 3, 5, 3), dt.datetime(2021, 3, 6, 3)
    rows = [("em 5 de Março de 2021", dt.datetime(2024, 1, 1)), ("sem data", dt.datetime(2024, 1, 1)), ("sem data", None), ("x", dt.datetime(2021, 3, 5, 12))]
    got = values(spark, [("historical", start, end, p, t) for t, p in rows], "k string, s timestamp, e timestamp, p timestamp, t string", claims.alignment(*[F.col(c) for c in "ksept"]))
    assert [x for (x,) in got] == ["compatible", "incompatible", "unknown", "compatible"]


def test_rephrasing(spark):
    texts = [("Ele disse que sim.",), ("A casa caiu e o João saiu cedo.",), ("A casa caiu.",), ("Além disso choveu.",)]
    assert [x for (x,) in values(spark, texts, "t string", claims.needs_rephrasing(F.col("t")))] == [True, True, False, False]
    assert [x for (x,) in values(spark, texts, "t string", claims.needs_rephrasing(F.col("t"), strict=True))] == [True, True, False, True]


def test_catalog_needs_the_same_claim_year_and_reviewers(spark):
    text = "Em 2023, o aplicativo permitia acesso."
    own = spark.createDataFrame([(1, text, "historical", dt.datetime(2023, 1, 1, 3)), (2, text, "timeless", None), (3, "Em 2023, outro texto.", "historical", dt.datetime(2023, 1, 1, 3))], "claim_id int, text string, kind string, start timestamp")
    columns = "id string, position int, claim string, entities array<string>, event_year int, verdict string, url string, excerpt string, status string, reviewer_ids array<string>"
    good = ("a", 1, text.upper(), ["Aplicativo"], 2023, "CONTRADITO", "https://aosfatos.org/x", "É falso", "reviewed", ["r", "s"])
    bad = [("b", 0, *good[2:9], ["r", "r"]), ("c", 0, *good[2:4], 2022, *good[5:]), ("d", 0, *good[2:3], ["Outro"], *good[4:]), ("e", 0, *good[2:8], "pending", ["r", "s"])]
    got = claims.catalog_matches(own, spark.createDataFrame([good, *bad], columns)).collect()
    assert [tuple(r) for r in got] == [(1, "a")]


# Retrieval, duplicates, verdicts


def test_bm25_keeps_numbers(spark):
    docs = spark.createDataFrame([(0, 0, "A taxa chegou a 9,1% no mês"), (0, 1, "A taxa chegou a 6,2% no mês"), (1, 0, "nada")], "g int, d int, t string")
    q = spark.createDataFrame([(0, 0, "A taxa chegou a 6,2%"), (1, 0, "outra")], "g int, q int, t string")
    got = {(r.g, r.d): r.score for r in retrieval.bm25(docs, q, ["g"], "d", "t", "q", "t").collect()}
    assert got[0, 1] > got[0, 0] and (1, 0) not in got


def test_small_edits_that_reverse_a_text_are_no_duplicates(spark):
    body = " ".join(f"palavra{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))
    texts = [body + " custou 200 milhões", body + " custou 900 milhões", body + " a agência comprovou", body + " a agência não comprovou", body + " fim da linha", body + " fim da estrada", body + " fim da linha"]
    membership, pairs = duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert {(r.a, r.b) for r in pairs.collect()} == {(4, 5)}
    assert {r.doc_id: r.representative for r in membership.collect()}[6] == 4


def test_near_duplicates_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        base = [f"t{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.choice([3, 8, 80]))]
        for n in (0, 1, 2, 4):
            words = list(base)
            for _ in range(n):
                words[rng.randrange(len(words))] = "novo"
            texts.append(" ".join(words))
    membership, pairs = duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    reps = sorted({r.representative for r in membership.collect()})
    sets = {i: {" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w := texts[i].split()) >= 5 else set(w) for i in reps}
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want


def _brute_families(texts):
    """(representative, family, links) of each id by all pairs, for texts of lower-case words without numbers or qualifiers."""
    first = {}
    for i, t in sorted(texts.items()):
        first.setdefault(tuple(t.split()), i)
    sets = {}
    for w, i in first.items():
        sets[i] = {w[k : k + 5] for k in range(len(w) - 4)} if len(w) >= 5 else set(w)
    near = {a: {b for b in sets if b != a and sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])} for a in sets}
    family = {a: a for a in sets}
    for _ in sets:
        family = {a: min([family[a], *[family[b] for b in near[a]]]) for a in sets}
    return {i: (r := first[tuple(t.split())], family[r], len(near[r])) for i, t in texts.items()}


@pytest.mark.parametrize("rows, mass, few, columns", [(256, 1 << 19, 16, 4096), (3, 1 << 19, 0, 7), (256, 90, 4, 64), (256, 1 << 19, 10**9, 4096)])
def test_families_are_those_of_all_pairs(spark, monkeypatch, rows, mass, few, columns):
    """In blocks of any size, pair by pair, and both."""
    for name, value in zip(("ROWS", "MASS", "FEW", "COLUMNS"), (rows, mass, few, columns)):
        monkeypatch.setattr(duplicates, name, value)
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfg") for _ in range(4))
    texts = {}
    for size, copies in ((40, 14), (60, 9), (7, 6), (3, 4), (200, 5)):
        base = [word() for _ in range(size)]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.choice([0, -1, rng.randrange(size)])] = word()
            base = words if rng.random() < 0.4 else base  # chains, so that families are no cliques
            texts[len(texts)] = " ".join(words)
    texts |= {len(texts) + k: t for k, t in enumerate(["", " ", texts[0], texts[20], "x"])}
    df = spark.createDataFrame([*[(i, t, 1) for i, t in texts.items()], (1000, None, 2)], "doc_id int, text string, links int")
    got = {r.doc_id: (r.representative, r.family, r.links) for r in duplicates.families(df).collect()}
    want = _brute_families(texts | {1000: ""})
    assert got == want
    assert max(k for _, _, k in want.values()) > 3 and any(f != r for r, f, _ in want.values())


def test_families_of_repeated_ids_and_of_nothing(spark):
    body = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    df = spark.createDataFrame([("a", body), ("a", body), ("a", "outro"), ("b", body + " fim"), (None, body)], "doc_id string, text string")
    got = sorted((r.doc_id, r.representative, r.family, r.links) for r in duplicates.families(df).collect())
    assert [r[:2] for r in got] == [("a", "a")] * 3 + [("b", "b")]
    assert len(set(got)) == 2 and got == sorted((r.doc_id, r.representative, r.family, r.links) for r in duplicates.families(df).collect())
    assert duplicates.families(df.where("false")).count() == 0


def test_leaders_are_no_closure_and_follow_only_usable_ones(spark):
    body = " ".join(f"p{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [
        (1, 0, "https://a.com/x", body, True, True), (1, 1, "https://b.com/x", body, False, True), (1, 2, "https://c.com/x", "outro texto", False, False),
        (1, 3, "https://d.com/x", "outro texto", False, True), (1, 4, "https://www.b.com/x?utm_a=1", "nada igual", False, True),
    ]
    df = spark.createDataFrame(rows, "claim_id int, rank int, url string, text string, is_partial boolean, ok boolean")
    got = {r.rank: r.leader_url for r in duplicates.leaders(df, usable="ok").collect()}
    assert got == {0: "https://b.com/x", 1: None, 2: None, 3: None, 4: "https://b.com/x"}


def sources(spark, rows):
    return spark.createDataFrame(rows, "claim_id int, url string, origin string, eligible boolean, stance string, confidence double, evidence array<struct<label:string,confidence:double>>")


@pytest.mark.parametrize(
    "labels, want",
    [
        (["entailment", "entailment", "contradiction"], "DIVERGENTE"), (["entailment"] + ["neutral"] * 4, "CONFIRMADO"), (["neutral"] * 3, "SEM_INFORMACAO"),
        ([], "NAO_ENCONTRADO"), (["contradiction"], "CONTRADITO"),
    ],
)
def test_no_majority_erases_a_conflict(spark, labels, want):
    rows = [(1, f"u{k}", f"o{k}", True, None, 0.9, [(x, 0.9)]) for k, x in enumerate(labels)]
    claim = spark.createDataFrame([(1,)], "claim_id int")
    assert verdicts.verdicts(claim, sources(spark, rows)).first().verdict == want


def test_single_origin_threshold_and_eligibility(spark):
    claim = spark.createDataFrame([(1,), (2,)], "claim_id int")
    rows = [
        (1, "a", "o", True, None, 0.9, [("entailment", 0.95), ("contradiction", 0.65)]),
        (2, "a", "o", True, None, 0.9, [("entailment", 0.95)]), (2, "b", "p", False, None, 0.9, [("contradiction", 0.99)]),
    ]
    got = {r.claim_id: r.verdict for r in verdicts.verdicts(claim, sources(spark, rows), 0.5, 0.9).collect()}
    assert got == {1: "CONFIRMADO", 2: "CONFIRMADO"}


# Chunks and pages


def test_passages_stay_within_budget_and_overlap():
    rng = random.Random(1)
    text = [" ".join("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) + ("." if rng.random() < 0.15 else "") for _ in range(rng.randrange(1, 120))) for _ in range(30)]
    text.append("x" * 500)
    made = chunking.passages(text, 20)
    assert all(chunking.estimate(p) <= 20 for p in made)
    joined = "".join("".join(p.split()) for p in made)
    for p in text:
        for w in p.split():
            if len(w) < 60:
                assert w in joined
    two = chunking.passages(["Primeira frase aqui. Segunda frase aqui.", "Outro parágrafo."], 100)
    assert two == ["Primeira frase aqui. Segunda frase aqui.", "Segunda frase aqui. Outro parágrafo."]
    assert "".join(chunking.passages(["y" * 100], 5)) == "y" * 100


def test_chunks_drop_navigation(spark):
    df = spark.createDataFrame([(1, "Title: x\nUma frase boa e longa.\n\nLeia também: y\nOutra frase."), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.doc_id, r.ix, r.passage) for r in chunking.chunked(df).orderBy("doc_id", "ix").collect()]
    assert got == [(1, 0, "Uma frase boa e longa."), (1, 1, "Uma frase boa e longa. Outra frase.")]


PAGE = """<html><head><script type="application/ld+json">{"@graph": [{"@type": "WebPage"}, {"@type": ["NewsArticle"], "headline": "Título", "datePublished": "2026-11-04T10:00:00-03:00",
 "author": {"name": "Ana"}, "articleBody": "%s"}]}</script><link rel="canonical" href="https://www.bbc.com/a"><meta property="og:title" content="Outro"></head>
<body><nav><p>Menu menu menu menu menu menu menu menu</p></nav><div><a href="/x">%s</a><p>links links links links links links</p></div>
<article><p>%s</p><p>Curto</p><aside><p>Anúncio que não deveria entrar aqui</p></aside></article></body>"""


def read_pages(spark, htmls):
    """Main and tight text of each page."""
    read = pages.scanned(spark.createDataFrame(list(enumerate(htmls)), "k int, html string"))
    both = read.join(pages.main_text(read), "_row", "left").join(pages.tight_text(read).withColumnRenamed("text", "tight"), "_row", "left")
    return [(r.text or "", r.tight) for r in both.orderBy("k").collect()]


def test_main_text_prefers_paragraphs_over_links(spark):
    body = "Parágrafo com conteúdo suficiente para ser lido. " * 3
    two = "<div><p>Um parágrafo aberto que segue sem fim<p>Outro parágrafo aberto que também segue</div>"
    tight = f"<body><div class=related><p>{body * 3}</p></div><section><div><p>{body * 3}</p></div></section></body>"
    # An unclosed navigation ends with what holds it; marks count as their characters; hidden texts inside a paragraph's container go.
    odd = f"<body><header><nav><p>{body * 9}</header><main><p>{body}&amp; <b>x<i>y</b> z<div><p>{body}</p></main></section><p>nach dem Ende, auch lang genug"
    got = read_pages(spark, [PAGE % ("", "z" * 300, body), "<p>só texto", None, two, tight, odd, "", "a<br>b\n\n c<script>x</script>"])
    assert got[0][0] == f"{body.strip()}\nCurto"
    assert got[1][0] == "só texto" and got[2] == got[6] == ("", None)
    assert got[3][0].count("\n") == 1
    assert got[4][1] == (body * 3).strip()
    assert got[5][0] == f"{body.strip()} & xy z\n{body.strip()}"
    assert got[7] == ("a b\nc", None)


def test_structured_articles_are_walked_in_order(spark):
    ld = lambda *xs: "".join(f'<script type="application/ld+json">{x}</script>' for x in xs)
    deep = '{"a": 1, "mainEntity": [[{"@graph": [{"mainEntity": {"@type": "ClaimReview", "headline": "fundo"}}]}]]}'
    cases = [
        ld("{broken", '[{"@type": "Person", "headline": "p"}, {"@type": "Article", "headline": "a", "isAccessibleForFree": false}]'), ld(deep),
        ld('{"@type": "WebPage", "@graph": [{"@type": "NewsArticle", "headline": 5, "author": {"name": "Ana"}}], "mainEntity": {"@type": "Article", "headline": "m"}}'),
        ld('{"@type": ["X", "ReportageNewsArticle"], "headline": "fora", "@graph": [{"@type": "Article", "headline": "dentro"}]}'), ld('"Article"', "[]", "null") + '<meta name="og:title" content="m">', None,
    ]
    read = pages.scanned(spark.createDataFrame(list(enumerate(cases)), "k int, html string"))
    got = {r.k: (r.title, r.author, r.paywalled) for r in read.join(pages.heads(read), "_row", "left").collect()}
    assert got == {0: ("a", None, True), 1: ("fundo", None, False), 2: (None, "Ana", False), 3: ("fora", None, False), 4: ("m", None, False), 5: (None, None, None)}


def test_articles_take_structured_text_only_of_free_pages(spark):
    long = "Texto completo da matéria em dados estruturados. " * 6
    free, paid = PAGE % (long, "", "curto"), (PAGE % (long, "", "curto")).replace('"headline"', '"isAccessibleForFree": "False", "headline"')
    visible = PAGE % (long, "", long)
    rows = [("https://bbc.com/1", free), ("https://bbc.com/2", paid), ("https://bbc.com/3", visible), ("http://bbc.com/4", visible)]
    got = {r.url[-1]: r for r in pages.articles(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert (got["1"].provenance, got["1"].text, got["1"].title if "title" in got["1"] else got["1"].page_title) == ("structuredData", long.strip(), "Título")
    assert got["2"].text is None and got["2"].discard_reason == "paywall"
    assert got["3"].provenance == "articleBody" and not got["3"].is_partial and got["3"].canonical_url == "https://www.bbc.com/a" and got["3"].author == "Ana"
    assert got["3"].published_at == dt.datetime(2026, 11, 4, 13) and got["4"].discard_reason == "disallowedURL"


def test_bytes_and_dates(spark):
    rows = [("é".encode(), "2026-11-04"), ("é".encode("latin-1"), "2026-11-04T10:00:00.250Z"), (b"x" * (3 << 20) + b"y", "ontem")]
    got = values(spark, rows, "b binary, d string", pages.decoded(F.col("b")), pages.parsed_date(F.col("d")))
    assert [x for x, _ in got] == ["é", "é", None]
    assert [d for _, d in got] == [dt.datetime(2026, 11, 4), dt.datetime(2026, 11, 4, 10, 0, 0, 250000), None]


def test_links_of_the_same_family(spark):
    html = '<a href="/noticia/2026/11/uma-longa-materia">a</a><a class=x href="https://outro.com/2026/11/uma-longa-materia">b</a><a href="/noticia/2026/11/uma-longa-materia">a</a><a href="/video/2026/11/x-y-z-w">v</a><a href="//m.a.com/materia-de-teste-12345">m</a><a href="/x">x</a>'
    got = pages.links(spark.createDataFrame([(1, "https://www.a.com/home", html)], "page_id int, url string, html string")).orderBy("position").collect()
    assert [r.link for r in got] == ["https://www.a.com/noticia/2026/11/uma-longa-materia", "https://m.a.com/materia-de-teste-12345"]


# Evaluation and splits


def test_missing_and_repeated_predictions_show(spark):
    gold, p = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("b",), ("b",), ("c",)], "id string")
    assert {(r.id, r.problem) for r in evaluation.coverage_errors(gold, p).collect()} == {("a", "missing"), ("b", "repeated"), ("c", "unknown")}


def test_errors_stay_in_the_denominator(spark):
    gold = spark.createDataFrame([("1", "CONFIRMADO", [("e", "https://a.com/x", "o trecho certo")], [["e"]]), ("2", "CONTRADITO", [], [["e"]])], f"id string, verdict string, evidence {records.EVIDENCE}, sufficient_evidence_sets array<array<string>>")
    shown = [("e", "https://www.a.com/x/?q=1", "antes O  TRECHO certo depois")]
    p = spark.createDataFrame([("1", "CONFIRMADO", None, 0.9, shown, 1.0, 1), ("2", None, "timeout", None, [], 2.0, 3)], f"id string, verdict string, error string, confidence double, evidence {records.EVIDENCE}, elapsed_seconds double, search_calls int")
    r = evaluation.report(evaluation.scored(gold, p)).first()
    assert (r.accuracy["value"], r.failures, r.directional_precision["value"], r.resolvable_coverage["value"]) == (0.5, 1, 1.0, 0.5)
    assert r.precision_contradito["value"] is None and r.latency_p95 == 2.0


def test_selected_policy_meets_both_targets(spark):
    grid = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.9, 0.9, 0.6, 0.95), (0, 1, 0.5, 0.525, 0.7, 0.8, 0.8, 0.92), (1, 1, 0.525, 0.525, 0.7, 0.8, 0.8, 0.92)], "i int, j int, minimum double, single double, macro_f1 double, accuracy double, coverage double, precision double")
    assert [(r.i, r.j) for r in evaluation.selected_policy(grid).collect()] == [(0, 1)]
    assert evaluation.selected_policy(grid, precision=0.99).count() == 0


def test_gate_and_label_order(spark):
    side = {"directional_precision": 0.95, "resolvable_coverage": 0.8, "accuracy": 0.9, "total_coverage": 0.8}
    phone = {"peak_ram_mb": 500.0, "p95_seconds": 9.0, "free_storage_mb": 100.0, "repeated": True}
    good = {
        "blind_test_claims": 300, "blind_test_sha256": "x", "candidate": side, "baseline": side | {"accuracy": 0.8}, "tokenizer_parity": True, "model_parity": True, "critical_regressions": True,
        "devices": [phone | {"name": "iPhone 13"}, phone | {"name": "iPhone 16"}], "model_sha256": "m", "policy_version": "p",
    }
    bad = good | {"blind_test_claims": 10, "devices": [phone | {"name": "iPhone 13", "p95_seconds": 16.0}]}
    path = tempfile.mkdtemp(prefix="spark-") + "/r.json"
    Path(path).write_text(json.dumps(good) + "\n" + json.dumps(bad) + "\n")
    rows = spark.read.json(path)
    got = [r[0] for r in rows.select(evaluation.gate_errors(F.struct(*rows.columns))).collect()]
    assert got == [[], ["blindTest", "devices", "budget:iPhone 13"]]
    probes = spark.createDataFrame([([9.0, 1.0, 0.0], "neutral"), ([0.0, 5.0, 1.0], "contradiction")], "logits array<double>, expected string")
    assert [r.order for r in evaluation.label_order(probes).collect()] == ["neutral,contradiction,entailment"]
    epochs = spark.createDataFrame([(1, 0.8, 0.5), (2, 0.8, 0.4), (3, 0.7, 0.1)], "epoch int, f1 double, loss double")
    assert evaluation.best_epoch(epochs).first().epoch == 2
    assert [r.problem for r in audits.training_errors(epochs, epochs.where("epoch = 1")).collect()] == ["epoch", "loss"]


def test_exact_packing_and_its_failure(spark):
    single = spark.range(1200).selectExpr("id", "id as component")
    got = {r.split: r["n"] for r in splits.packed(single).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 600, "calibration": 300, "test": 300}
    with pytest.raises(ValueError):
        splits.packed(spark.range(1200).selectExpr("id", "id % 2 as component"))
    with pytest.raises(ValueError):
        splits.packed(spark.range(10).selectExpr("id", "id as component"))


# Quota


def brute_quota(rows, limits, burst):
    used, minute, count, out = {}, {}, {}, {}
    for rid, ts, lane in sorted(rows, key=lambda r: (r[1], r[0])):
        period, m = ts.strftime("%Y-%m"), int(ts.timestamp() // 60)
        u = used.setdefault(period, dict.fromkeys(limits, 0))
        ok = u[lane] < limits[lane] and (m != minute.get(period) or count[period] < burst)
        reason = None if ok else "quota_exceeded" if u[lane] >= limits[lane] else "rate_limited"
        if ok:
            count[period] = count[period] + 1 if m == minute.get(period) else 1
            minute[period] = m
            u[lane] += 1
        out[rid] = (ok, reason)
    return out


def requests(n, seed):
    rng = random.Random(seed)
    t, rows = dt.datetime(2024, 1, 31, 23, 30, tzinfo=dt.timezone.utc), []
    for k in range(n):
        t += dt.timedelta(seconds=rng.choice([0, 1, 5, 30]))
        rows.append((k, t, rng.choice(["production", "production", "evaluation"])))
    return rows


def test_quota_is_the_fold_of_all_requests(spark):
    rows = requests(900, 2)
    df = spark.createDataFrame(rows, "request_id int, ts timestamp, lane string")
    limits = {"production": 150, "evaluation": 30}
    got = {r.request_id: (r.accepted, r.reason) for r in quota.reserved(df.repartition(5), limits, burst=4).collect()}
    want = brute_quota(rows, limits, 4)
    assert got == want and {"quota_exceeded", "rate_limited", None} == {x for _, x in want.values()}


def test_quota_of_the_query_is_the_fold(spark, sf_dir):
    from clarion.plans.evidence_queries import quota_fold

    rows = [(r.request_id, r.ts.replace(tzinfo=dt.timezone.utc), r.lane) for r in inputs.requests(spark, sf_dir).collect()]
    got = {r.request_id: (r.accepted, r.reason) for r in quota_fold(spark, sf_dir).collect()}
    assert got == brute_quota(rows, {"production": 300, "evaluation": 40}, 3)


def test_the_stream_decides_like_the_batch(spark):
    from clarion.streaming.quota import reserved

    rows = requests(300, 3)
    limits = {"production": 60, "evaluation": 15}
    path = tempfile.mkdtemp(prefix="spark-")
    for k in range(3):
        spark.createDataFrame(rows[100 * k : 100 * (k + 1)], "request_id int, ts timestamp, lane string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("request_id int, ts timestamp, lane string").option("maxFilesPerTrigger", 1).parquet(path)
    q = reserved(stream, limits, burst=3).writeStream.format("memory").queryName("decided").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).outputMode("append").start()
    try:
        q.processAllAvailable()
        got = {r.request_id: (r.accepted, r.reason) for r in spark.table("decided").collect()}
    finally:
        q.stop()
    assert got == brute_quota(rows, limits, 3)


def test_request_bodies(spark):
    body = json.dumps({"query": " preço ", "topic": "news", "time_range": "year", "country": "brazil", "start_date": "2024-02-30", "api_key": "x"})
    ((b,),) = values(spark, [(body,)], "b string", quota.search_body(F.col("b"), F.array(F.lit("bbc.com"))))
    assert (b["query"], b["topic"], b["time_range"], b["country"], b["start_date"], b["max_results"]) == ("preço", "news", "year", None, None, 20)
    codes = values(spark, [(432,), (429,), (503,), (200,), (408,)], "s int", quota.error_code(F.col("s")))
    assert [c for (c,) in codes] == ["quota_exceeded", "rate_limited", "unavailable", None, "timeout"]


# Quiz, sources


def test_answers_and_days(spark):
    got = values(spark, [(" Verdade ",), ("FAKE",), ("talvez",)], "a string", quiz.answer(F.col("a")))
    assert [x for (x,) in got] == ["fato", "farsa", "talvez"]
    q = spark.range(500).withColumnRenamed("id", "question_id")
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in (1, 2, 3, 3)], "day date")
    a, b = (sorted(map(tuple, quiz.daily(x, days).collect())) for x in (q, q.repartition(3)))
    assert a == b and [d.day for d, _ in a] == [1, 2, 3]
    assert quiz.daily(q.limit(0), days).count() == 0
    assert quiz.round_of(q, 7, fact_id="question_id").count() == 10


def test_tsv_sources(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    Path(path, "q.tsv").write_text("\n\nid\ttitulo\tfonte\tbinario\tmotivo\tautor\tlink\n1\tA \"b\"\tf\tFATO\tm\ta\tl\n2\tquebrada\n3\tC\tf\tFARSA\tm\ta\tl\textra\n")
    assert [(r.id, r.title) for r in tsv.questions(spark, f"{path}/q.tsv").orderBy("id").collect()] == [("1", 'A "b"'), ("3", "C")]
    assert tsv.questions(spark, f"{path}/q.tsv", strict=False).count() == 3
    Path(path, "c.tsv").write_text("﻿ID\tTítulo\tURL\tBinário\tData\tAssunto\n7\tAlgo\thttps://www.a.com/x/?q=1\tFARSA\t2024\tt\n8\t\thttps://b.com\tFATO\t\t\n9\tOutro\thttp://c.com\tFATO\t\t\n")
    (c,) = tsv.import_candidates(spark, f"{path}/c.tsv").collect()
    assert (c.id, c.candidate_verdict, c.review_status, len(c.family_id)) == ("quiz-7", "CONTRADITO", "pending", 16)
    Path(path, "p.tsv").write_text("sentence1\tsentence2\tgold_label\na\tb\tneutral\n\tb\tneutral\na\tb\tneutral\nx\ty\t-\n")
    rows = tsv.pairs(spark, f"{path}/p.tsv")
    audit = audits.pair_audit(rows).first()
    assert (audit["rows"], audit.neutral, audit.invalid, audit.empty_premise, audit.duplicate_pairs) == (4, 3, 1, 1, 1)
    assert tsv.training_pairs(rows).count() == 2
    batches = tsv.length_batches(rows.fillna("").withColumn("n", F.length("sentence1")), "n", 2, ["sentence1", "sentence2"], parts=1)
    assert batches.groupBy("batch").count().agg(F.max("count")).first()[0] <= 2
    with pytest.raises(ValueError):
        tsv.pairs(spark, f"{path}/q.tsv")


def test_record_sources(spark):
    path = tempfile.mkdtemp(prefix="spark-")
    gold = spark.createDataFrame([("a", "texto", ["r"])], "id string, claim string, reviewers array<string>")
    records.write_lines(gold, f"{path}/gold")
    assert records.read_lines(spark, f"{path}/gold", records.GOLD).first().claim == "texto"
    entry = {"id": "a", "claim": "c", "entities": ["e"], "eventYear": 2023, "verdict": "CONTRADITO", "url": "https://bbc.com", "title": "t", "excerpt": "x", "publishedAt": "2023", "status": "reviewed", "reviewerIDs": ["r", "s"]}
    Path(path, "catalog.json").write_text(json.dumps([entry, entry | {"id": "b"}]))
    Path(path, "broken.json").write_text("{nope")
    assert [(r.id, r.position, r.event_year) for r in records.catalog(spark, f"{path}/catalog.json").collect()] == [("a", 0, 2023), ("b", 1, 2023)]
    assert records.catalog(spark, f"{path}/broken.json").count() == records.catalog(spark, f"{path}/none.json").count() == 0
    policy = {"version": "v", "modelVersion": "m", "temperature": 1.5, "minimumConfidence": 0.6, "singleSourceMinimumConfidence": 0.7, "calibrated": True, "calibrationDigest": "a" * 64}
    Path(path, "policy.json").write_text(json.dumps(policy))
    assert records.policy(spark, f"{path}/policy.json", "m")["minimum"] == 0.6
    assert records.policy(spark, f"{path}/policy.json", "other") == verdicts.BASELINE
    assert records.label_order(spark, '{"0": "Entailment", "1": "neutral", "2": "contradiction"}') == list(scores.LABELS)
    with pytest.raises(ValueError):
        records.label_order(spark, '{"0": "yes", "1": "no"}')
    Path(path, "run.log").write_text('x\n2024 GATELINE {"variant": "a", "ms": 1.5}\nGATELINE {broken\n')
    assert [tuple(r) for r in records.structured_lines(spark, f"{path}/run.log", "GATELINE", "variant string, ms double").where("variant is not null").collect()] == [("a", 1.5)]
    import hashlib

    manifest = spark.createDataFrame([("policy.json", hashlib.sha256(Path(path, "policy.json").read_bytes()).hexdigest()), ("run.log", "0" * 64), ("gone", "0" * 64)], "path string, sha256 string")
    assert {tuple(r) for r in audits.manifest_errors(records.files(spark, path), manifest).collect()} == {("run.log", "changed"), ("gone", "missing")}
    assert records.report_lines(gold, ["id", "claim"]).first()[0] == "| a | texto |"


def ask(text, parameters):
    if text == "quota":
        return 432, []
    return 200, [{"title": f"{text} {k}", "url": f"https://bbc.com/{k}", "score": 0.5} for k in range(parameters["n"])]


def page(address):
    n = int(address)
    return 200, [{"id": n * 10 + k} for k in range(2)], str(n + 1) if n < 3 else None


def test_search_and_paged_sources(spark):
    search.register(spark)
    hits = spark.read.format("clarion_search").options(client="test_operators:ask", queries=json.dumps(["a", "quota"]), parameters=json.dumps({"n": 25})).load()
    assert hits.where("query = 'a'").count() == 20 and [r.status for r in hits.where("query = 'quota'").collect()] == [432]
    rows = spark.read.format("clarion_paged").options(client="test_operators:page", starts=json.dumps(["1", "3"])).load()
    assert sorted(json.loads(r.row)["id"] for r in rows.collect()) == [10, 11, 20, 21, 30, 30, 31, 31]
    limited = spark.read.format("clarion_paged").options(client="test_operators:page", starts=json.dumps(["1"]), pages="2").load()
    assert limited.count() == 4


def test_triage_and_gate_summary(spark):
    models = spark.createDataFrame([("a", ["pt"], ["filter=pt,text-classification"], {"0": "x"}), ("b/bertimbau", ["pt"], ["search=x"], {"0": "x", "1": "y", "2": "z"}), ("c", ["en"], ["search=x"], None)], "id string, tags array<string>, sources array<string>, id2label map<string,string>")
    assert {r.id: (r.reason, r.three_labels) for r in audits.triaged(models, "(?i)bertimbau").collect()} == {"a": ("catalog", False), "b/bertimbau": ("name", True)}
    lines = spark.createDataFrame([("v", "load", 0, 5.0, 100.0), ("v", "nli", 1, 9.0, 90.0), ("v", "end", 2, 9.0, 95.0)], "variant string, stage string, seq int, peak_resident_mb double, free_disk_mb double")
    r = audits.gate_summary(lines).first()
    assert (r.lines, r.least_free_disk_mb, r.heaviest_stage, r.first_stage) == (3, 90.0, "nli", "load")


def test_frozen_corpus_replay(spark):
    """A claim with support and refutation diverges; a republication follows its leader and casts no vote."""
    from clarion.plans import verification

    yes = "A prefeitura confirmou que o novo hospital da cidade foi aberto ao público nesta semana. " * 4
    no = "Segundo a secretaria, o hospital da cidade continua fechado e sem data para receber o público. " * 4
    claims_ = spark.createDataFrame([(1, "O hospital da cidade foi aberto ao público", dt.datetime(2026, 1, 1)), (2, "Nada parecido existe", dt.datetime(2026, 1, 1)), (3, "O hospital da cidade foi aberto", dt.datetime(2026, 1, 1))], "claim_id int, text string, reference_ts timestamp")
    found = [(1, 0, "https://bbc.com/a"), (1, 1, "https://dw.com/b"), (1, 2, "https://exame.com/c"), (3, 0, "https://r7.com/unread")]
    hits = spark.createDataFrame([(c, i, u, "hospital da cidade", "aberto ao público", 0.5) for c, i, u in found], "claim_id int, ix int, url string, title string, content string, score double")
    texts = [("https://bbc.com/a", yes), ("https://dw.com/b", no), ("https://exame.com/c", yes)]
    articles = spark.createDataFrame([(u, t, "articleBody", False, None, None) for u, t in texts], "url string, text string, provenance string, is_partial boolean, published_at timestamp, original_source string")

    def infer(p):
        return p.withColumn("logits", F.when(F.col("premise").contains("fechado"), F.array(F.lit(0.0), F.lit(0.0), F.lit(5.0))).otherwise(F.array(F.lit(5.0), F.lit(0.0), F.lit(0.0))))

    results, src = verification.verify(claims_, hits, articles, infer)
    got = {r.claim_id: (r.verdict, r.error, r.sources) for r in results.collect()}
    assert got == {1: ("DIVERGENTE", None, 3), 2: ("NAO_ENCONTRADO", None, 0), 3: (None, "readingIncomplete", 0)}
    assert {r.url: r.duplicate_of for r in src.collect()} == {"https://bbc.com/a": None, "https://dw.com/b": None, "https://exame.com/c": "https://bbc.com/a"}


def test_paged_walks_go_on_where_they_stopped(spark):
    """Pages are followed in tasks from a table; 404 ends an address; the rest of a stopped walk is the same as one walk."""
    from clarion.sources import search

    starts = spark.createDataFrame([("a:0:5:2",), ("b:0:1:1",), ("gone:0:0:3",), (None,)], "start string")
    client = "clarion.sources.frozen:count_pages"
    whole = search.followed(starts, client)
    first = search.followed(starts, client, pages=2)
    rest = search.followed(search.unfinished(first), client, pages=2)
    last = search.followed(search.unfinished(rest), client)
    rows = lambda df: sorted((r.start, r.page, r.status, *r.rows) for r in df.collect())
    assert rows(whole) == rows(first.unionByName(rest).unionByName(last))
    assert [(r.start, r.status) for r in first.where("size(rows) = 0").collect()] == [("gone:0:0:3", 404)]
    assert {r.page for r in whole.where("start like 'a%'").collect()} == set(range(5))
    assert search.unfinished(last).count() == 0


def test_spans_are_found_across_tables(spark):
    gold = [("a", "https://www.a.com/x/", "The  quick brown\nfox"), ("b", "https://a.com/x", "quick brown"), ("c", "https://a.com/x", "ick brown fo"), ("d", "https://a.com/y", "the quick brown fox"),
            ("e", "https://a.com/x", "the slow brown fox"), ("f", "https://a.com/x", "FOX"), ("g", None, "fox"), ("h", "https://a.com/x", None), ("i", "https://a.com/x", "")]
    shown = [(1, "https://a.com/x#top", "Say: the quick  brown fox jumps"), (2, "https://a.com/x", "no animal, only quick brownies"), (3, "https://a.com/x", ""), (4, None, "fox"), (5, "https://a.com/x", None)]
    got = evaluation.matched_spans(spark.createDataFrame(gold, "span_id string, url string, text string"), spark.createDataFrame(shown, "passage_id int, url string, text string"))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 1), ("b", 2), ("c", 1), ("f", 1), ("i", 1), ("i", 2)]
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
