"""Queries over claims, hits, passages, sources and verdicts, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from clarion.functions.lineage import shared_dir
from clarion.functions.passages import rejection
from clarion.functions.scores import cosine
from clarion.functions.text import QUALIFIERS, token_estimate
from clarion.operators import claims as claim_ops, duplicates, quota, ranks, retrieval, verdicts
from clarion.plans import inputs, verification
from clarion.streaming import quota as streaming_quota

MINIMUM, SINGLE = 0.50, 0.65


def verdict_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.range(0, 120).select(F.col("id").alias("claim_id"), (F.col("id") % 3).alias("hits"))
    return verdicts.verdicts(claims, inputs.sources(spark, sf_dir), MINIMUM, SINGLE, hits="hits")


VERDICT_SQL = f"""with {inputs.VOTES_SQL.format(minimum=MINIMUM, single=SINGLE)},
claims as (select range as claim_id, range % 3 as hits from range(120)),
per as (select claim_id, bool_or(label = 'entailment') as s, bool_or(label = 'contradiction') as r from counted group by claim_id),
n as (select claim_id, count(*) as sources from sources group by claim_id)
select claim_id, case when coalesce(sources, 0) = 0 then case when hits > 0 then 'SEM_INFORMACAO' else 'NAO_ENCONTRADO' end
    when s and r then 'DIVERGENTE' when s then 'CONFIRMADO' when r then 'CONTRADITO' else 'SEM_INFORMACAO' end as verdict,
  coalesce(sources, 0) as sources, coalesce(one, false) as one_origin
from claims left join n using (claim_id) left join per using (claim_id) left join single using (claim_id)"""


def contributing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.contributing(inputs.sources(spark, sf_dir), MINIMUM, SINGLE)


def claim_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = spark.range(0, 120).select(F.col("id").alias("claim_id"), (F.col("id") % 5).alias("found"), (F.col("id") % 2).alias("read"))
    s = inputs.judged(spark, sf_dir)
    kind = F.when(F.col("is_partial"), "partialContent").when(F.col("alignment") == "unknown", "temporalUncertainty").when(F.col("alignment") == "incompatible", "temporalMismatch")
    limits = s.select("claim_id", kind.alias("limitation")).where("limitation is not null")
    out = verdicts.diagnostics(claims, inputs.sources(spark, sf_dir), "found", "read", limits, minimum=MINIMUM, single=SINGLE)
    return out.withColumn("limitations", F.array_join("limitations", ","))


DIAGNOSTICS_SQL = f"""with {inputs.VOTES_SQL.format(minimum=MINIMUM, single=SINGLE)},
claims as (select range as claim_id, range % 5 as found, range % 2 as read from range(120)),
l as (select claim_id, string_agg(distinct case when is_partial then 'partialContent' when alignment = 'unknown' then 'temporalUncertainty' else 'temporalMismatch' end, ',' order by
    case when is_partial then 'partialContent' when alignment = 'unknown' then 'temporalUncertainty' else 'temporalMismatch' end) as limitations
  from judged where is_partial or alignment in ('unknown', 'incompatible') group by claim_id),
u as (select claim_id, count(distinct url) as used, count(distinct origin) as independent_origins from counted group by claim_id)
select claim_id, found, read, coalesce(used, 0) as used, coalesce(independent_origins, 0) as independent_origins, coalesce(limitations, '') as limitations
from claims left join u using (claim_id) left join l using (claim_id)"""


def softmax_best_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = inputs.judged(spark, sf_dir)
    return j.select("doc_id", "label", *[F.round(c, 9).alias(c) for c in ("entailment", "neutral", "contradiction", "confidence")])


def article_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts.article_labels(inputs.judged(spark, sf_dir), ["claim_id", "rank"], ix="doc_id")
    return out.select("claim_id", "rank", "label", F.round("confidence", 9).alias("confidence"), "similarity", "stance", "passages", "excerpt")


ARTICLE_SQL = f"""with {inputs.JUDGED_SQL},
d as (select *, label <> 'neutral' and confidence >= 0.5 as dir from judged),
b as (select claim_id, rank, label, confidence, similarity, text from d where dir qualify row_number() over (partition by claim_id, rank order by confidence desc, doc_id) = 1),
m as (select claim_id, rank, confidence, similarity, text from d qualify row_number() over (partition by claim_id, rank order by similarity desc, doc_id) = 1),
a as (select claim_id, rank, bool_or(dir and label = 'entailment') as s, bool_or(dir and label = 'contradiction') as r, count(*) as passages from d group by all)
select a.claim_id, a.rank, coalesce(b.label, 'neutral') as label, round(coalesce(b.confidence, m.confidence), 9) as confidence, coalesce(b.similarity, m.similarity)::double as similarity,
  case when s and r then 'mixed' when s then 'supports' when r then 'refutes' else 'insufficient' end as stance, passages,
  case when length(coalesce(b.text, m.text)) > 300 then substr(coalesce(b.text, m.text), 1, 299) || '…' else coalesce(b.text, m.text) end as excerpt
from a left join b using (claim_id, rank) join m using (claim_id, rank)"""


def claim_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = claim_ops.context(F.col("text"), F.col("reference_ts"))
    out = inputs.claims(spark, sf_dir).withColumn("c", c)
    return out.select("claim_id", "c.kind", F.unix_micros("c.start").alias("start_us"), F.unix_micros("c.end").alias("end_us"), F.col("c.attributed").alias("attributed"))


CONTEXT_SQL = f"with {inputs.CLAIMS_SQL} select claim_id, kind, epoch_us(start_ts) as start_us, epoch_us(end_ts) as end_us, attributed from contexts"


def temporal_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against the order of their number: when it was placed, and a note that may name the claim's date."""
    c = inputs.claims(spark, sf_dir).withColumn("c", claim_ops.context(F.col("text"), F.col("reference_ts")))
    o = inputs.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), F.col("o_orderdate").cast("timestamp").alias("published"), "o_orderpriority")
    both = c.join(o, "claim_id")
    note = F.when(F.col("claim_id") % 4 == 0, F.concat(F.lit("publicado em "), F.date_format("reference_ts", "yyyy-MM-dd"))).when(F.col("claim_id") % 4 == 1, F.lit("balanço de 2024")).otherwise(F.col("o_orderpriority"))
    published = F.when(F.col("claim_id") % 9 != 0, F.col("published"))
    return both.select("claim_id", claim_ops.alignment(F.col("c.kind"), F.col("c.start"), F.col("c.end"), published, note).alias("alignment"))


ALIGNMENT_SQL = f"""with {inputs.CLAIMS_SQL},
both_ as (select c.*, case when claim_id % 9 <> 0 then o_orderdate end as published,
    case claim_id % 4 when 0 then 'publicado em ' || strftime(reference_ts, '%Y-%m-%d') when 1 then 'balanço de 2024' else o_orderpriority end as note
  from contexts c join orders on o_orderkey = claim_id)
select claim_id, case when kind = 'timeless' then 'compatible' when published is null then 'unknown'
    when kind = 'historical' and ((epoch(end_ts) - epoch(start_ts) > 300 * 86400 and contains(note, strftime(start_ts - interval 3 hour, '%Y')))
      or contains(note, strftime(start_ts - interval 3 hour, '%Y-%m-%d'))) then 'compatible'
    when coalesce(published < start_ts, false) or coalesce(published > end_ts, false) then 'incompatible' else 'compatible' end as alignment from both_"""


def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = claim_ops.query_plan(inputs.claims(spark, sf_dir))
    return plan.select("claim_id", "ordinal", "kind", "text", F.size("domains").alias("n_domains"), F.col("domains")[0].alias("first_domain"))


#: ``cut`` cuts at the last white space within n characters, or hard.
PLAN_SQL = f"""with {inputs.CLAIMS_SQL},
w as (select claim_id, kind, reference_ts, case when start_ts is null then text else regexp_replace(text, '(?i)\\b(hoje|ontem)\\b', 'em ' || strftime(start_ts - interval 3 hour, '%Y-%m-%d'), 'g') end as t from contexts),
p as (select *, case when length(t) <= 200 then t else trim(regexp_extract(substr(t, 1, 200), '(?s)^(.*)\\s\\S*$', 1)) end as primary_,
    case when length(t) <= 175 then t else trim(regexp_extract(substr(t, 1, 175), '(?s)^(.*)\\s\\S*$', 1)) end as p175,
    case when length(t) <= 188 then t else trim(regexp_extract(substr(t, 1, 188), '(?s)^(.*)\\s\\S*$', 1)) end as p188 from w),
q as (
  select claim_id, 0 as o, 'descriptive' as kind, primary_ as text from p union all
  select claim_id, 1, 'contextual', case when length(t) > 200 then regexp_replace(right(t, 200), '^[^ ]* ', '') when kind = 'current' then p175 || ' ' || strftime(reference_ts - interval 3 hour, '%Y-%m-%d') else primary_ end from p union all
  select claim_id, 2, 'factCheck', p188 || ' checagem' from p),
f as (select * from q where text <> '' qualify row_number() over (partition by claim_id, text order by o) = 1)
select claim_id, (row_number() over (partition by claim_id order by o) - 1)::int as ordinal, kind, text, case when kind = 'factCheck' then 4 else 31 end as n_domains,
  case when kind = 'factCheck' then 'aosfatos.org' else 'agenciabrasil.ebc.com.br' end as first_domain from f"""


def origin_diversity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.ranked_articles(inputs.hits(spark, sf_dir), inputs.hit_claims(spark, sf_dir))
    return out.where("position <= 8").select("claim_id", "position", "ix", "origin", F.round("relevance", 6).alias("relevance"))


_TERMS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+(?:[.,]\d+)?')"
RANK_SQL = f"""with {inputs.HITS_SQL},
d as (select claim_id, ix, {_TERMS.format("title || ' ' || content")} as w from hits),
s as (select claim_id, count(*) as n_docs, greatest(1.0, avg(len(w))) as mean from d group by claim_id),
q as (select distinct claim_id, unnest({_TERMS.format("text")}) as t from hit_claims),
o as (select claim_id, ix, len(w) as n, unnest(w) as t from d),
tf as (select claim_id, ix, n, t, count(*) as tf from o join q using (claim_id, t) group by all),
df as (select claim_id, t, count(*) as df from tf group by all),
b as (select claim_id, ix, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) as bm25 from tf join df using (claim_id, t) join s using (claim_id) group by all),
r as (select h.*, coalesce(bm25, 0.0) + score as relevance from hits h left join b using (claim_id, ix) where d <> 'not-allowed.example.com'),
u as (select * from r qualify row_number() over (partition by claim_id, canonical order by relevance desc, ix) = 1),
v as (select *, row_number() over (partition by claim_id, origin order by relevance desc, ix) > 1 as later from u)
select claim_id, (row_number() over (partition by claim_id order by later, relevance desc, ix))::int as position, ix, origin, round(relevance, 6)::double as relevance
from v qualify position <= 8"""


def bm25_benchmark_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents of every benchmark item, over the whole table's statistics."""
    scores = retrieval.bm25(inputs.read(spark, sf_dir, "documents"), inputs.read(spark, sf_dir, "benchmark"), [], "doc_id", "text", "item_id", "text", digits=5)
    return retrieval.top(scores, ["item_id"], [F.desc("score"), F.asc("doc_id")], 5)


BM25_SQL = f"""with d as (select doc_id, {_TERMS.format("text")} as w from documents),
s as (select count(*) as n_docs, greatest(1.0, avg(len(w))) as mean from d),
q as (select distinct item_id, unnest({_TERMS.format("text")}) as t from benchmark),
o as (select doc_id, len(w) as n, unnest(w) as t from d),
tf as (select doc_id, n, t, count(*) as tf from o where t in (select t from q) group by all),
df as (select t, count(*) as df from tf group by all),
b as (select item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 5) as score from tf join df using (t) join q using (t), s group by all)
select item_id, doc_id, score, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank from b qualify rank <= 5"""


def _label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the cosine to the first vector of its label, and a lexical score by number."""
    e = inputs.read(spark, sf_dir, "embeddings")
    claim = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("claim"))
    both = e.join(claim, "label")
    return both.select("label", F.col("vec_id").alias("ix"), F.round(cosine(F.col("embedding"), F.col("claim")), 6).alias("similarity"), ((F.col("vec_id") * 37) % 23 / 10.0).alias("lexical"))


_VECTORS_SQL = """c as (select label, arg_min(embedding, vec_id) as claim from embeddings group by label),
v as (select label, vec_id as ix, round(list_cosine_similarity(embedding::double[], claim::double[]), 6) as similarity, ((vec_id * 37) % 23) / 10.0 as lexical from embeddings join c using (label))"""


def cosine_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.nearest(_label_vectors(spark, sf_dir), ["label"]).select("label", "ix", "similarity", "rank")


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.fused(_label_vectors(spark, sf_dir), ["label"])
    return out.where("position <= 20").select("label", "ix", F.round("fused", 9).alias("fused"), F.col("position").cast("int").alias("position"))


RRF_SQL = f"""with {_VECTORS_SQL},
r as (select *, row_number() over (partition by label order by lexical desc, ix) as l, row_number() over (partition by label order by similarity desc, ix) as s from v),
f as (select label, ix, round(case when lexical > 0 then 1 / (60 + l) else 0.0 end + case when similarity >= 0.25 then 1 / (60 + s) else 0.0 end, 12) as fused from r)
select label, ix, round(fused, 9) as fused, (row_number() over (partition by label order by fused desc, ix))::int as position from f where fused > 0 qualify position <= 20"""


def candidate_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.read(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 1).cast("bigint").alias("doc_id"), ((F.col("doc_id") * 41) % 67 / 4.0).alias("lexical"))
    d = ranks.ranked(d, ["source"], [F.asc("doc_id")], "ix").withColumn("ix", F.col("ix").cast("int"))
    return retrieval.candidates(d, ["source"]).select("source", "doc_id", "ix")


CANDIDATES_SQL = """with d as (select source, doc_id, ((doc_id * 41) % 67) / 4.0 as lexical, (row_number() over (partition by source order by doc_id) - 1)::int as ix from documents),
r as (select *, greatest(1, count(*) over (partition by source) // 16) as step, row_number() over (partition by source order by lexical desc, ix) as best from d)
select source, doc_id, ix from r where best <= 48 or (ix % step = 0 and ix // step < 16)"""


def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as windows: every one grows by its neighbours within 300 tokens."""
    w = inputs.read(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ix"), "text")
    chosen = w.withColumn("position", F.col("ix"))
    out = retrieval.expanded(w, chosen, ["conv_id"], F.lit(300), token_estimate)
    return out.select("conv_id", "ix", F.md5("expanded").alias("expanded_md5"), F.length("expanded").alias("n_chars"))


_TOKENS = "greatest(ceil(length({0}) / 3.0), len(list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')))"
EXPANSION_SQL = f"""with w as (select conv_id, turn as ix, text, lead(text) over (partition by conv_id order by turn) as nxt, lag(text) over (partition by conv_id order by turn) as bef from conversations),
f as (select conv_id, text, arg_min(struct_pack(nxt, bef), ix) as near from w group by conv_id, text),
c as (select w.conv_id, w.ix, w.text, near.nxt as nxt, near.bef as bef from w join f on w.conv_id = f.conv_id and w.text = f.text),
o as (select *, case when nxt is not null and {_TOKENS.format("(text || ' ' || nxt)")} <= 300 then text || ' ' || nxt else text end as one from c),
e as (select *, case when bef is not null and {_TOKENS.format("(bef || ' ' || one)")} <= 300 then bef || ' ' || one else one end as expanded from o)
select conv_id, ix, md5(expanded) as expanded_md5, length(expanded)::int as n_chars from e qualify row_number() over (partition by conv_id, expanded order by ix) = 1"""


def expansion_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.needs_more(inputs.passages(spark, sf_dir))


TRIGGER_SQL = """select doc_id % 97 as claim_id, count(*) as hits, count(distinct source) as origins, count(distinct source) < 2 or count(*) < 4 as expand from documents group by 1"""


def keep_first_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clarion.functions.urls import canonical_online

    h = inputs.hits(spark, sf_dir).withColumn("canonical", canonical_online(F.col("url")))
    return claim_ops.keep_first(h, ["claim_id", "canonical"], [F.col("ix")]).select("claim_id", "ix", "canonical")


FIRST_SQL = f"with {inputs.HITS_SQL} select claim_id, ix, canonical from hits qualify row_number() over (partition by claim_id, canonical order by ix) = 1"


def _republished(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and of every tenth of them a version with a word more and one with a word less, under negative ids."""
    d = inputs.read(spark, sf_dir, "documents").select("doc_id", "text")
    more = d.where("doc_id % 10 = 3").select((-1 - F.col("doc_id")).alias("doc_id"), F.concat("text", F.lit(" outra")).alias("text"))
    less = d.where("doc_id % 10 = 7").select((-1 - F.col("doc_id")).alias("doc_id"), F.regexp_replace("text", r"^\S+\s+", "").alias("text"))
    return d.unionByName(more).unionByName(less)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between different texts of the documents and planted republications."""
    return duplicates.near_duplicates(_republished(spark, sf_dir))[1]


def near_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.representatives(_republished(spark, sf_dir))[0]


def _reprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and families of 2,000 texts: for every thousand documents two benchmark items in small letters, with a word of each document's own before or after."""
    d = inputs.read(spark, sf_dir, "documents").select("doc_id", "text")
    plain = F.regexp_replace(F.lower("text"), "[0-9]", "")
    items = inputs.read(spark, sf_dir, "benchmark").select("item_id", plain.alias("item"))
    n = F.broadcast(items.agg(F.count("*").alias("_items")))
    thousand = F.floor(F.col("doc_id") / 1000).cast("bigint")
    base = d.select(thousand.alias("k")).distinct().crossJoin(n)
    first, second = items.toDF("i", "x"), items.toDF("j", "y")
    base = base.join(first, F.col("k") % F.col("_items") == F.col("i")).join(second, (F.col("k") + 1) % F.col("_items") == F.col("j"))
    word = F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij")
    own = d.withColumn("k", thousand).join(base.select("k", F.concat_ws(" ", "x", "y").alias("base")), "k")
    before = own.select((-1 - 2 * F.col("doc_id")).alias("doc_id"), F.concat(F.lit("v"), word, F.lit(" "), "base").alias("text"))
    after = own.select((-2 - 2 * F.col("doc_id")).alias("doc_id"), F.concat("base", F.lit(" w"), word).alias("text"))
    return d.unionByName(before).unionByName(after)


def near_duplicate_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and planted reprint: its representative, its family and its number of links."""
    return duplicates.families(_reprinted(spark, sf_dir))


_NAMES = r"list_sort(list_distinct(list_transform(regexp_extract_all({0}, '(?:^|[^\p{{L}}\p{{N}}_])\p{{Lu}}[\p{{L}}\p{{N}}]+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}_]', ''))))"
_QUALIFIERS = repr(list(QUALIFIERS))
_PROTECTED = f"""list_sort(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_contains({_QUALIFIERS}, w[i]) then w[i]
    when regexp_matches(w[i], '\\p{{N}}') then array_to_string(w[greatest(i - 1, 1):least(i + 1, len(w))], ' ') end), lambda x: x is not null))"""
_SHINGLES = "list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else w end)"
_REPUBLISHED = r"""docs as (select doc_id, text from documents union all select -1 - doc_id, text || ' outra' from documents where doc_id % 10 = 3
  union all select -1 - doc_id, regexp_replace(text, '^\S+\s+', '') from documents where doc_id % 10 = 7)"""
DUPLICATES_SQL = f"""with {_REPUBLISHED}, t as (select doc_id, text, {_TERMS.format("text")} as w from docs),
r as (select * from t qualify row_number() over (partition by w order by doc_id) = 1),
g as (select doc_id, {_PROTECTED} as p, {_NAMES.format("text")} as n, {_SHINGLES} as s from r),
c as (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.s, b.s)) as x, len(a.s) + len(b.s) as y from g a join g b on a.p = b.p and a.n = b.n and a.doc_id < b.doc_id)
select a, b, round(x / (y - x), 6) as similarity from c where x / (y - x) >= 0.85"""
_REPRINTED = """items as (select item_id, regexp_replace(lower(text), '[0-9]', '', 'g') as item from benchmark), m as (select count(*) as n from benchmark),
o as (select doc_id, x.item || ' ' || y.item as base, translate(doc_id::varchar, '0123456789', 'abcdefghij') as word from documents, m, items x, items y
  where x.item_id = doc_id // 1000 % n and y.item_id = (doc_id // 1000 + 1) % n),
docs as (select doc_id, text from documents union all select -1 - 2 * doc_id, 'v' || word || ' ' || base from o union all select -2 - 2 * doc_id, base || ' w' || word from o)"""
#: Labels go along the links until each text has the least of its family; 12 steps are more than the families' widths.
FAMILIES_SQL = f"""with recursive {_REPRINTED}, t as (select doc_id, text, {_TERMS.format("text")} as w from docs),
v as (select doc_id, min(doc_id) over (partition by w) as representative from t),
g as materialized (select doc_id, {_PROTECTED} as p, {_NAMES.format("text")} as n, list_transform({_SHINGLES}, lambda x: hash(x)) as s from t where doc_id in (select representative from v)),
c as materialized (select a.doc_id as a, b.doc_id as b, len(list_intersect(a.s, b.s)) as x, len(a.s) + len(b.s) as y from g a join g b on a.p = b.p and a.n = b.n and a.doc_id < b.doc_id),
e as materialized (select a, b from c where x / (y - x) >= 0.85 union all select b, a from c where x / (y - x) >= 0.85),
l(id, family, step) as (select doc_id, doc_id, 0 from g union all
  select id, min(family), step + 1 from (select e.b as id, l.family, l.step from l join e on l.id = e.a where l.step < 12 union all select id, family, step from l where step < 12) group by id, step),
k as (select a as id, count(*) as links from e group by a)
select v.doc_id, v.representative, l.family, coalesce(k.links, 0)::bigint as links from v join l on l.id = v.representative and l.step = 12 left join k on k.id = v.representative"""
MEMBERS_SQL = f"with {_REPUBLISHED}, t as (select doc_id, {_TERMS.format('text')} as w from docs) select doc_id, min(doc_id) over (partition by w) as representative from t"


def leader_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim for every eight documents of similar length in order of text, so that copies meet; a fifth of the URLs repeat."""
    d = inputs.read(spark, sf_dir, "documents").withColumn("size", F.floor(F.length("text") / 64).cast("bigint"))
    page = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("l"), F.col("size").cast("string"))).otherwise(F.col("doc_id").cast("string"))
    d = retrieval.consecutive(d, ["size"], [F.col("text"), F.col("doc_id")], duplicates.ARTICLES).select(
        (F.col("size") * (1 << 32) + F.col("batch")).alias("claim_id"), F.col("doc_id").alias("rank"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), page).alias("url"),
        "text", (F.col("doc_id") % 11 == 0).alias("is_partial"),
    )
    return duplicates.leaders(d)


LEADERS_SQL = f"""with recursive t as (
  select (length(text) // 64) * 4294967296 + (row_number() over (partition by length(text) // 64 order by text, doc_id) - 1) // 8 as claim_id, doc_id as rank,
    'https://' || source || '.example.org/' || case when doc_id % 5 = 0 then 'l' || length(text) // 64 else doc_id::varchar end as url, doc_id % 11 = 0 as is_partial, text, {_TERMS.format("text")} as w from documents),
g as (select *, {_PROTECTED} as p, {_NAMES.format("text")} as nm, {_SHINGLES} as s, row_number() over (partition by claim_id order by is_partial, rank) as k from t),
near as (select b.claim_id, b.k, list(a.k order by a.k) as like_ from g a join g b on a.claim_id = b.claim_id and a.k < b.k and (a.url = b.url or a.w = b.w or (a.p = b.p and a.nm = b.nm
    and len(list_intersect(a.s, b.s)) >= 0.85 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) and len(a.s) > 0)) group by all),
fold(claim_id, k, leaders, leader) as (
  select claim_id, 1::bigint, [1::bigint], null::bigint from g where k = 1
  union all
  select f.claim_id, g.k, case when len(list_intersect(coalesce(n.like_, []), f.leaders)) > 0 then f.leaders else list_append(f.leaders, g.k) end, list_min(list_intersect(coalesce(n.like_, []), f.leaders))
  from fold f join g on g.claim_id = f.claim_id and g.k = f.k + 1 left join near n on n.claim_id = g.claim_id and n.k = g.k)
select g.claim_id, g.rank, g.url, l.url as leader_url from g join fold f on g.claim_id = f.claim_id and g.k = f.k left join g l on l.claim_id = f.claim_id and l.k = f.leader"""


def quota_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quota.reserved(inputs.requests(spark, sf_dir), {"production": 300, "evaluation": 40}, burst=3)
    return out.select("request_id", "period", "lane", "accepted", "reason")


#: The fold in order of arrival, one request a step; the state is the counts of both lanes and of the minute.
QUOTA_SQL = """with recursive t as (select event_id as request_id, make_timestamp(epoch_us(ts) // 40) as w, case when event_type = 'error' then 'evaluation' else 'production' end as lane from events),
q as (select *, strftime(w, '%Y-%m') as period, epoch_us(w) // 60000000 as minute, row_number() over (partition by strftime(w, '%Y-%m') order by w, request_id) as k from t),
f(period, k, request_id, lane, p, e, minute, n, reason) as (
  select period, 0::bigint, null::bigint, null::varchar, 0, 0, -1::bigint, 0, null::varchar from (select distinct period from q)
  union all
  select period, k, request_id, lane, p + (ok and lane = 'production')::int, e + (ok and lane = 'evaluation')::int, case when ok then m else old end, case when not ok then n when m = old then n + 1 else 1 end,
    case when ok then null when not room then 'quota_exceeded' else 'rate_limited' end
  from (select *, room and (m <> old or n < 3) as ok from (
    select q.period, q.k, q.request_id, q.lane, f.p, f.e, f.n, f.minute as old, q.minute as m, case when q.lane = 'production' then f.p < 300 else f.e < 40 end as room from f join q on q.period = f.period and q.k = f.k + 1)))
select request_id, period, lane, reason is null as accepted, reason from f where k > 0"""


def streamed_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests as a stream: they arrive as files in four stretches of time, and after each one the stream is started anew."""
    path = f"{shared_dir(spark)}/quota-{uuid.uuid4().hex}"
    own = inputs.requests(spark, sf_dir)
    at = F.unix_micros("ts")
    low, high = own.agg(F.min(at), F.max(at)).first()
    if low is None:  # no requests: an empty stream
        low = high = 0
    for k in range(4):
        stretch = F.coalesce(F.floor((at - low) * 4 / (high - low + 1)), F.lit(0))
        own.where(stretch == k).write.mode("append").parquet(f"{path}/arrived")
        arrived = spark.readStream.schema(own.schema).parquet(f"{path}/arrived")
        streaming_quota.follow(arrived, path, {"production": 300, "evaluation": 40}, burst=3).awaitTermination()
    return streaming_quota.decisions(spark, path).select("request_id", "period", "lane", "accepted", "reason")


def session_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "search").otherwise("pair").alias("kind"), "event_id")
    return quota.session_caps(e, "user_id", "kind", [F.col("event_id")]).select("user_id", "kind", "event_id")


SESSION_SQL = """select user_id, case when event_type = 'error' then 'search' else 'pair' end as kind, event_id from events
qualify row_number() over (partition by user_id, kind order by event_id) <= case when kind = 'search' then 3 else 24 end"""


def verify_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over a claim for every eight documents, each an article; logits stand in by a rule."""
    claims = inputs.article_claims(spark, sf_dir).withColumn("reference_ts", F.lit("2024-02-01 12:00:00").cast("timestamp"))
    hits = inputs.article_hits(spark, sf_dir)
    articles = hits.select(
        "url", F.col("content").alias("text"), F.lit("articleBody").alias("provenance"), (F.floor(F.col("ix") / 2) % 9 == 0).alias("is_partial"), F.lit("2024-01-20").cast("timestamp").alias("published_at"), F.lit(None).cast("string").alias("original_source")
    )

    def infer(pairs: DataFrame) -> DataFrame:
        h = lambda k: F.crc32(F.concat(F.lit(k), "premise", "hypothesis").cast("binary")) % 97 / 20.0
        return pairs.withColumn("logits", F.array(h("e"), h("n"), h("c")))

    results, _ = verification.verify(claims, hits, articles, infer)
    return results


def paragraph_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ix", "p"))
    return d.select("doc_id", "ix", F.coalesce(rejection(F.col("p")), F.lit("kept")).alias("reason"))


QUALITY_SQL = r"""with d as (select doc_id, unnest(string_split(text, chr(10))) as p, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ix from documents),
c as (select doc_id, ix, trim(regexp_replace(p, '\s+', ' ', 'g')) as t, strip_accents(lower(trim(regexp_replace(p, '\s+', ' ', 'g')))) as f from d),
b as (select *, trim(trim(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '(^|[^\p{L}\p{N}_])Por\s+\p{Lu}[\p{L}''-]+(?:\s+(?:d[aeo]s?\s+)?\p{Lu}[\p{L}''-]+)*\*?', '\1 ', 'g'), '\b\d{1,2}/\d{1,2}/\d{2,4}\b', ' ', 'g'), '\b\d{1,2}h\d{2}\b', ' ', 'g'),
    '\b\d{1,2}:\d{2}\b', ' ', 'g'), '\b(?:Atualizado|Publicado)(?:\s+em)?\b', ' ', 'g'),
    '\b(?:Foto|Fotos|Imagem|Imagens|Crédito|Créditos|Arte|Ilustração|Legenda|Reprodução|Divulgação)\s*:.*$', ' ', 'g'), '\s+', ' ', 'g')), ' —–-•|,;:') as body from c)
select doc_id, ix::int as ix, case when starts_with(f, 'title:') or (contains(t, ' | ') and not regexp_matches(t, '[.!?…]$')) then 'pageTitle'
  when regexp_matches(f, 'navegue direto pelo app|mais lidas|leia tambem|leia mais|veja tambem|continua depois da publicidade|compartilhe|ultimas noticias|pular para o conteudo|todos os direitos reservados|receba as principais noticias|assine a newsletter|newsletter|clique aqui|web stories') then 'navigation'
  when length(body) < 40 or len(list_filter(regexp_split_to_array(body, '\s+'), lambda x: x <> '')) < 5 then 'tooShort' else 'kept' end as reason from b"""

SQL = {
    "verdict_rollup": VERDICT_SQL,
    "contributing_sources": f"with {inputs.VOTES_SQL.format(minimum=MINIMUM, single=SINGLE)} select distinct claim_id, url, origin from counted",
    "claim_diagnostics": DIAGNOSTICS_SQL,
    "softmax_best_label": f"with {inputs.JUDGED_SQL} select doc_id, label, round(e, 9) as entailment, round(n, 9) as neutral, round(c, 9) as contradiction, round(confidence, 9) as confidence from judged",
    "article_label": ARTICLE_SQL,
    "claim_context": CONTEXT_SQL,
    "temporal_alignment": ALIGNMENT_SQL,
    "search_plan": PLAN_SQL,
    "origin_diversity_rank": RANK_SQL,
    "bm25_benchmark_docs": BM25_SQL,
    "cosine_top3": f"with {_VECTORS_SQL} select label, ix, similarity, (row_number() over (partition by label order by similarity desc, ix))::int as rank from v where similarity >= 0.25 qualify rank <= 3",
    "rrf_fusion": RRF_SQL,
    "candidate_sampling": CANDIDATES_SQL,
    "neighbour_expansion": EXPANSION_SQL,
    "expansion_trigger": TRIGGER_SQL,
    "keep_first_hits": FIRST_SQL,
    "near_duplicates": DUPLICATES_SQL,
    "near_duplicate_members": MEMBERS_SQL,
    "near_duplicate_families": FAMILIES_SQL,
    "leader_dedup": LEADERS_SQL,
    "session_budget": SESSION_SQL,
    "quota_fold": QUOTA_SQL,
    "streamed_quota": QUOTA_SQL,
    "paragraph_quality": QUALITY_SQL,
}
QUERIES = [
    verdict_rollup, contributing_sources, claim_diagnostics, softmax_best_label, article_label, claim_context, temporal_alignment, search_plan,
    origin_diversity_rank, bm25_benchmark_docs, cosine_top3, rrf_fusion, candidate_sampling, neighbour_expansion, expansion_trigger, keep_first_hits,
    near_duplicates, near_duplicate_members, near_duplicate_families, leader_dedup, quota_fold, streamed_quota, session_budget, verify_claims, paragraph_quality,
]
