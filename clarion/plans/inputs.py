"""Inputs of the registered queries, derived from the test tables by integer arithmetic, for Spark and as SQL.

Each has a DataFrame function and a SQL text with the same columns, so queries and their
SQL equivalents begin with equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clarion.operators import verdicts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage per document: claim_id, url, origin, logits, similarity, is_partial, provenance, alignment."""
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id", (d % 97).alias("claim_id"), F.floor(d / 291).cast("bigint").alias("rank"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), d.cast("string")).alias("url"),
        F.col("source").alias("origin"), F.array(*[((d * a) % b) / 25.0 for a, b in ((37, 101), (53, 103), (71, 107))]).alias("logits"),
        (((d * 29) % 100) / 100.0).alias("similarity"), (d % 11 == 0).alias("is_partial"), F.when(d % 13 == 0, "searchSnippet").otherwise("articleBody").alias("provenance"),
        F.when(d % 7 == 0, "unknown").when(d % 7 == 1, "incompatible").otherwise("compatible").alias("alignment"), "text",
    )


JUDGED_SQL = """judged as (
  select *, case when n >= e and n >= c then 'neutral' when e >= c then 'entailment' else 'contradiction' end as label,
    case when n >= e and n >= c then n when e >= c then e else c end as confidence
  from (select *, exp(z1 - m) / t as e, exp(z2 - m) / t as n, exp(z3 - m) / t as c from (
    select *, exp(z1 - m) + exp(z2 - m) + exp(z3 - m) as t from (
      select doc_id, doc_id % 97 as claim_id, doc_id // 291 as rank, 'https://' || source || '.example.org/' || doc_id as url, source as origin,
        ((doc_id * 37) % 101) / 25.0 as z1, ((doc_id * 53) % 103) / 25.0 as z2, ((doc_id * 71) % 107) / 25.0 as z3, greatest(z1, z2, z3) as m,
        ((doc_id * 29) % 100) / 100.0 as similarity, doc_id % 11 = 0 as is_partial, case when doc_id % 13 = 0 then 'searchSnippet' else 'articleBody' end as provenance,
        case when doc_id % 7 = 0 then 'unknown' when doc_id % 7 = 1 then 'incompatible' else 'compatible' end as alignment, text
      from documents))))"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.judged(passages(spark, sf_dir))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source per judged passage, as the verdict takes it; documents divisible by 5 have a stance only."""
    j = judged(spark, sf_dir)
    evidence = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<struct<label:string,confidence:double>>")).otherwise(F.array(F.struct("label", "confidence")))
    stance = F.when(F.col("doc_id") % 15 == 0, "mixed").otherwise(verdicts.stance_of(F.col("label")))
    ok = verdicts.eligible(F.col("is_partial"), F.col("provenance"), F.col("alignment"), F.lit(None))
    return j.select("doc_id", "claim_id", "url", "origin", ok.alias("eligible"), stance.alias("stance"), "confidence", evidence.alias("evidence"))


VOTES_SQL = (
    JUDGED_SQL
    + """,
sources as (
  select *, not is_partial and provenance <> 'searchSnippet' and alignment = 'compatible' as eligible,
    case when doc_id % 15 = 0 then 'mixed' when label = 'entailment' then 'supports' when label = 'contradiction' then 'refutes' else 'insufficient' end as stance
  from judged),
votes as (
  select claim_id, url, origin, label, confidence from sources where eligible and doc_id % 5 <> 0 and label <> 'neutral' and confidence >= {minimum}
  union all
  select claim_id, url, origin, 'entailment', confidence from sources where eligible and doc_id % 5 = 0 and stance in ('supports', 'mixed') and confidence >= {minimum}
  union all
  select claim_id, url, origin, 'contradiction', confidence from sources where eligible and doc_id % 5 = 0 and stance in ('refutes', 'mixed') and confidence >= {minimum}),
single as (select claim_id, count(distinct origin) = 1 as one from votes group by claim_id),
counted as (select v.*, one from votes v join single using (claim_id) where not one or confidence >= {single})"""
)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim per event, worded by its type: today, yesterday, a date, a year, current, recent or none."""
    date = F.date_format("ts", "dd/MM/yyyy")
    text = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("Hoje o preço subiu "), F.col("value").cast("string")))
        .when(F.col("event_id") % 7 == 1, F.concat(F.lit("O ministro disse ONTEM que a taxa caiu em "), F.col("event_type")))
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit("A lei foi aprovada em "), date, F.lit(" segundo o órgão")))
        .when(F.col("event_id") % 7 == 3, F.concat(F.lit("Em "), F.date_format("ts", "yyyy"), F.lit(" a safra foi recorde")))
        .when(F.col("event_id") % 7 == 4, F.lit("O partido atualmente preside a câmara"))
        .when(F.col("event_id") % 7 == 5, F.lit("A empresa acabou de demitir funcionários nos Últimos dias"))
        .otherwise(F.concat(F.lit("A Terra é redonda "), F.repeat(F.lit("e gira "), F.pmod(F.col("event_id"), F.lit(40)).cast("int"))))
    )
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("claim_id"), text.alias("text"), F.col("ts").cast("timestamp").alias("reference_ts"))


CLAIMS_SQL = """claims as (
  select event_id as claim_id, ts as reference_ts, case event_id % 7
    when 0 then 'Hoje o preço subiu ' || cast(value as varchar) when 1 then 'O ministro disse ONTEM que a taxa caiu em ' || event_type
    when 2 then 'A lei foi aprovada em ' || strftime(ts, '%d/%m/%Y') || ' segundo o órgão' when 3 then 'Em ' || strftime(ts, '%Y') || ' a safra foi recorde'
    when 4 then 'O partido atualmente preside a câmara' when 5 then 'A empresa acabou de demitir funcionários nos Últimos dias'
    else 'A Terra é redonda ' || repeat('e gira ', (event_id % 40)::int) end as text from events),
contexts as (
  select *, case event_id7 when 0 then 'recent' when 1 then 'recent' when 2 then 'historical' when 3 then 'historical' when 4 then 'current' when 5 then 'recent' else 'timeless' end as kind,
    case event_id7 when 0 then day0 when 1 then day0 - interval 1 day when 2 then date_trunc('day', reference_ts) + interval 3 hour when 3 then date_trunc('year', reference_ts) + interval 3 hour
      when 4 then day0 - interval 30 day when 5 then day0 - interval 7 day end as start_ts,
    case event_id7 when 0 then day0 + interval 1 day when 1 then day0 when 2 then date_trunc('day', reference_ts) + interval 27 hour
      when 3 then date_trunc('year', reference_ts) + interval 1 year + interval 3 hour when 4 then reference_ts when 5 then reference_ts end as end_ts,
    event_id7 = 1 or event_id7 = 2 as attributed
  from (select *, claim_id % 7 as event_id7, date_trunc('day', reference_ts - interval 3 hour) + interval 3 hour as day0 from claims))"""


DOMAINS = ("g1.globo.com", "www.bbc.com", "saude.gov.br", "oglobo.globo.com", "aosfatos.org", "agenciabrasil.ebc.com.br", "not-allowed.example.com")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits of all benchmark items: a whole document per hit, at addresses of seven domains, some of them repeated."""
    d = F.col("doc_id")
    items = F.broadcast(read(spark, sf_dir, "benchmark").agg(F.count("*").alias("_items")))
    domain = F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (d % 7 + 1).cast("int"))
    return read(spark, sf_dir, "documents").crossJoin(items).select(
        (d % F.col("_items")).alias("claim_id"), d.alias("ix"), F.concat(F.lit("https://"), domain, F.lit("/noticia/"), (d % 45).cast("string"), F.when(d % 3 == 0, "?utm_source=x").otherwise("/")).alias("url"),
        F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), ((d % 10) / 10.0).alias("score"),
    )


def hit_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")


def article_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a claim for every eight documents: each at a URL of its own, every tenth found once more under another spelling."""
    d = F.col("doc_id")
    domain = F.element_at(F.array(*[F.lit(x) for x in DOMAINS[:6]]), (d % 6 + 1).cast("int"))
    again = F.explode(F.when(d % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    return read(spark, sf_dir, "documents").select("doc_id", "text", again).select(
        F.floor(d / 8).cast("bigint").alias("claim_id"), (d * 2 + F.col("again")).alias("ix"), F.concat(F.lit("https://"), domain, F.lit("/noticia/"), d.cast("string"), F.when(F.col("again") == 1, "?utm_source=x").otherwise("/")).alias("url"),
        F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), ((d % 10) / 10.0).alias("score"),
    )


def article_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims of ``article_hits``, worded by the benchmark items in turn."""
    items = read(spark, sf_dir, "benchmark")
    n = F.broadcast(items.agg(F.count("*").alias("_items")))
    own = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 8).cast("bigint").alias("claim_id")).distinct().crossJoin(n)
    return own.join(items, F.col("claim_id") % F.col("_items") == F.col("item_id")).select("claim_id", "text")


HITS_SQL = """hits as (
  select doc_id % (select count(*) from benchmark) as claim_id, doc_id as ix, 'https://' || d || '/noticia/' || doc_id % 45 || case when doc_id % 3 = 0 then '?utm_source=x' else '/' end as url,
    'https://' || case when d = 'www.bbc.com' then 'bbc.com' else d end || '/noticia/' || doc_id % 45 as canonical, d,
    substr(text, 1, 60) as title, text as content, (doc_id % 10) / 10.0 as score,
    case d when 'g1.globo.com' then 'grupo-globo' when 'oglobo.globo.com' then 'grupo-globo' when 'www.bbc.com' then 'bbc.com' when 'saude.gov.br' then 'gov.br'
      when 'agenciabrasil.ebc.com.br' then 'ebc' else d end as origin
  from (select *, ['g1.globo.com', 'www.bbc.com', 'saude.gov.br', 'oglobo.globo.com', 'aosfatos.org', 'agenciabrasil.ebc.com.br', 'not-allowed.example.com'][doc_id % 7 + 1] as d from documents)),
hit_claims as (select item_id as claim_id, text from benchmark)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cases of the labelled documents: expected, actual, correct and the measures of a run."""
    d = F.col("doc_id")
    actual = F.element_at(F.array(*[F.lit(x) for x in ("CONFIRMADO", "CONTRADITO", "DIVERGENTE", "SEM_INFORMACAO", "NAO_ENCONTRADO", "ERROR", "CONFIRMADO", "CONFIRMADO", "CONTRADITO", "CONTRADITO")]), ((d * 31) % 10 + 1).cast("int"))
    own = read(spark, sf_dir, "labels").select(d.alias("id"), F.when(F.col("quality") == 1, "CONFIRMADO").otherwise("CONTRADITO").alias("expected"), actual.alias("actual"))
    i = F.col("id")
    return own.select(
        "id", "expected", "actual", (i % 3 != 0).alias("sufficient"), ((F.col("actual") == F.col("expected")) & (~F.col("actual").isin("CONFIRMADO", "CONTRADITO", "DIVERGENTE") | (i % 3 != 0))).alias("correct"),
        (i % 4 != 0).alias("annotated"), F.when(i % 5 != 0, ((i * 17) % 100) / 100.0).alias("confidence"), (((i * 13) % 997) / 100.0).alias("elapsed_seconds"), (i % 4).cast("int").alias("search_calls"),
    )


CASES_SQL = """cases as (
  select *, actual = expected and (actual not in ('CONFIRMADO', 'CONTRADITO', 'DIVERGENTE') or sufficient) as correct from (
    select doc_id as id, case when quality = 1 then 'CONFIRMADO' else 'CONTRADITO' end as expected,
      ['CONFIRMADO', 'CONTRADITO', 'DIVERGENTE', 'SEM_INFORMACAO', 'NAO_ENCONTRADO', 'ERROR', 'CONFIRMADO', 'CONFIRMADO', 'CONTRADITO', 'CONTRADITO'][(doc_id * 31) % 10 + 1] as actual,
      doc_id % 3 <> 0 as sufficient, doc_id % 4 <> 0 as annotated, case when doc_id % 5 <> 0 then ((doc_id * 17) % 100) / 100.0 end as confidence,
      ((doc_id * 13) % 997) / 100.0 as elapsed_seconds, doc_id % 4 as search_calls from labels))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logits with a label, for calibration."""
    d = F.col("doc_id")
    z = F.array(*[((d * a) % b) / 25.0 for a, b in ((37, 101), (53, 103), (71, 107))])
    return read(spark, sf_dir, "labels").select(z.alias("logits"), F.when(d % 2 == 0, "entailment").when(d % 3 == 0, "neutral").otherwise("contradiction").alias("label"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records of documents with errors and leaks planted by number."""
    d = F.col("doc_id")
    s = d.cast("string")
    reviewed = d % 4 != 0
    evidence = F.array(F.struct(F.concat(F.lit("e"), s).alias("id"), F.concat(F.when(d % 17 == 0, "http").otherwise("https"), F.lit("://www."), F.col("source"), F.lit(".example.org/a"), (d % 300).cast("string"), F.lit("/?x=1")).alias("url"), F.col("text").alias("text")))
    return read(spark, sf_dir, "documents").select(
        s.alias("id"), F.when(d % 101 == 0, "").otherwise(F.col("text")).alias("claim"), F.concat(F.lit("ev"), (d % 400).cast("string")).alias("event_id"), F.sha2("text", 256).alias("family_id"),
        F.when(d % 19 == 0, "soon").otherwise("2024-05-01T00:00:00Z").alias("reference_date"), F.when(reviewed, "reviewed").otherwise("pending").alias("review_status"),
        F.when(d % 23 == 0, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("reviewers"), F.when(d % 29 == 0, "TALVEZ").otherwise("CONFIRMADO").alias("verdict"),
        F.element_at(F.array(F.lit("train"), F.lit("calibration"), F.lit("test")), (d % 3 + 1).cast("int")).alias("split"), F.lit(None).cast("string").alias("source_url"), evidence.alias("evidence"),
        F.when(d % 31 == 0, F.array(F.array(F.lit("zz")))).otherwise(F.array(F.array(F.concat(F.lit("e"), s)))).alias("sufficient_evidence_sets"),
        F.array(F.struct(F.lit("p").alias("premise"), F.lit("h").alias("hypothesis"), F.when(d % 37 == 0, "maybe").otherwise("neutral").alias("label"))).alias("pairs"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in order of events; two seconds stand for a minute, so that minutes fill up."""
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 40)).alias("ts"), F.when(F.col("event_type") == "error", "evaluation").otherwise("production").alias("lane")
    )


#: Logits of labels as SQL, shared by the calibration queries.
OBSERVATIONS_SQL = """observations as (
  select z1, z2, z3, case when doc_id % 2 = 0 then z1 when doc_id % 3 = 0 then z2 else z3 end as z from (
    select doc_id, ((doc_id * 37) % 101) / 25.0 as z1, ((doc_id * 53) % 103) / 25.0 as z2, ((doc_id * 71) % 107) / 25.0 as z3 from labels))"""
