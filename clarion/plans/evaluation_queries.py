"""Queries of the evaluation toolkit, audits, splits and the quiz, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clarion.functions.scores import Z95
from clarion.functions.urls import host
from clarion.operators import audits, evaluation, quiz, splits
from clarion.operators.verdicts import VERDICTS
from clarion.plans import inputs

#: All 602 candidates.
TEMPERATURES = evaluation.temperatures()


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(inputs.cases(spark, sf_dir))


CONFUSION_SQL = f"""with {inputs.CASES_SQL}, v as (select unnest({list(VERDICTS)!r}) as expected)
select v.expected, {", ".join(f'count(*) filter (actual = {x!r}) as "{x}"' for x in (*VERDICTS, "ERROR"))} from v left join cases using (expected) group by v.expected"""

_RATIOS = {
    "accuracy": ("correct", "true"), "directional_precision": ("dir and correct", "dir"), "precision_confirmado": ("actual = 'CONFIRMADO' and correct", "actual = 'CONFIRMADO'"),
    "precision_contradito": ("actual = 'CONTRADITO' and correct", "actual = 'CONTRADITO'"), "total_coverage": ("dir", "true"),
    "resolvable_coverage": ("res and dir", "res"), "evidence_recall": ("sufficient", "annotated"),
}


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluation.report(inputs.cases(spark, sf_dir))
    flat = [F.round(F.col(k)[p], 9).alias(f"{k}_{p}") for k in _RATIOS for p in ("value", "low", "high")]
    return r.select("n", F.round("macro_f1", 9).alias("macro_f1"), *flat, "high_confidence_errors", "latency_p95", F.round("mean_search_calls", 9).alias("mean_search_calls"), "failures")


def _ratio_sql(name: str, a: str, b: str) -> str:
    n, k, z = f"nullif(count(*) filter ({b}), 0)", f"count(*) filter ({a})", Z95
    p = f"({k} * 1.0::double / {n})"
    centre, radius = f"({p} + {z * z} / (2 * {n}))", f"({z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0::double * {n} * {n})))"
    return f"round({p}, 9) as {name}_value, round(greatest(0.0::double, ({centre} - {radius}) / (1 + {z * z} / {n})), 9) as {name}_low, round(least(1.0::double, ({centre} + {radius}) / (1 + {z * z} / {n})), 9) as {name}_high"


_F1 = " + ".join(f"coalesce(2.0::double * count(*) filter (expected = '{v}' and actual = '{v}') / nullif(2.0::double * count(*) filter (expected = '{v}' and actual = '{v}') + count(*) filter ((expected = '{v}') <> (actual = '{v}')), 0), 0.0)" for v in VERDICTS)
REPORT_SQL = f"""with {inputs.CASES_SQL}, c as (select *, actual in ('CONFIRMADO', 'CONTRADITO') as dir, expected in ('CONFIRMADO', 'CONTRADITO') as res from cases)
select count(*) as n, round(({_F1}) / 5, 9) as macro_f1, {", ".join(_ratio_sql(k, *v) for k, v in _RATIOS.items())},
  case when count(*) filter (dir and confidence is not null) > 0 then count(*) filter (dir and confidence >= 0.85 and not correct) end as high_confidence_errors,
  quantile_disc(elapsed_seconds, 0.95)::double as latency_p95, round(avg(search_calls), 9) as mean_search_calls, count(*) filter (actual = 'ERROR') as failures from c"""


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = inputs.judged(spark, sf_dir).select(F.col("label").alias("predicted"), F.when(F.col("doc_id") % 2 == 0, "entailment").when(F.col("doc_id") % 3 == 0, "neutral").otherwise("contradiction").alias("truth"))
    m = evaluation.class_metrics(o)
    return m.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


CLASS_SQL = f"""with {inputs.JUDGED_SQL}, o as (select label as predicted, case when doc_id % 2 = 0 then 'entailment' when doc_id % 3 = 0 then 'neutral' else 'contradiction' end as truth from judged),
l as (select unnest(['entailment', 'neutral', 'contradiction']) as label),
c as (select label, count(*) filter (truth = label and predicted = label) as tp, count(*) filter (predicted = label) as said, count(*) filter (truth = label) as support from l, o group by label)
select label, round(coalesce(tp * 1.0::double / nullif(said, 0), 0), 9) as precision, round(coalesce(tp * 1.0::double / nullif(support, 0), 0), 9) as recall, round(coalesce(2.0::double * tp / nullif(said + support, 0), 0), 9) as f1, support from c"""


def calibration_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = evaluation.losses(inputs.observations(spark, sf_dir), TEMPERATURES)
    return ls.select("position", "temperature", F.round("loss", 8).alias("loss"))


LOSS_SQL = f"""with {inputs.OBSERVATIONS_SQL}, t as (select unnest({TEMPERATURES}::double[]) as temperature, generate_subscripts({TEMPERATURES}, 1) - 1 as position)
select position::int as position, temperature, round(avg(-ln(greatest(1e-15, exp((z - greatest(z1, z2, z3)) / temperature) /
  (exp((z1 - greatest(z1, z2, z3)) / temperature) + exp((z2 - greatest(z1, z2, z3)) / temperature) + exp((z3 - greatest(z1, z2, z3)) / temperature))))), 8) as loss from observations, t group by all"""


def calibration_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of all 602 temperatures."""
    best = evaluation.fitted_temperature(inputs.observations(spark, sf_dir))
    return best.select(F.round("temperature", 9).alias("temperature"), F.round("loss_before", 8).alias("loss_before"), F.round("loss_after", 8).alias("loss_after"))


TEMPERATURE_SQL = f"""with {inputs.OBSERVATIONS_SQL}, t as (select exp(-3 + range * 0.01::double) as temperature, range as position from range(601) union all select 1.0, 601),
l as (select position, temperature, avg(-ln(greatest(1e-15, exp((z - greatest(z1, z2, z3)) / temperature) /
  (exp((z1 - greatest(z1, z2, z3)) / temperature) + exp((z2 - greatest(z1, z2, z3)) / temperature) + exp((z3 - greatest(z1, z2, z3)) / temperature))))) as loss from observations, t group by all)
select round(arg_min(temperature, (round(loss, 12), position)), 9) as temperature, round(min(case when temperature = 1.0 then loss end), 8) as loss_before, round(min(loss), 8) as loss_after from l"""


def policy_votes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gold, claims, votes) of the passages."""
    p = inputs.passages(spark, sf_dir).withColumn("id", F.col("claim_id"))
    votes = evaluation.strongest_votes(p.select("id", F.col("origin").alias("origin_group"), "provenance", "is_partial", F.col("alignment").alias("temporal_alignment"), F.lit(None).cast("string").alias("duplicate_of"), "logits"))
    claims = p.groupBy("id").agg(F.count("*").alias("found_articles")).withColumn("error", F.when(F.col("id") % 41 == 0, "timeout"))
    gold = spark.range(0, 97).select("id", F.when(F.col("id") % 3 == 0, "CONFIRMADO").when(F.col("id") % 3 == 1, "CONTRADITO").otherwise("DIVERGENTE").alias("verdict"))
    return gold, claims, votes


def policy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluation.policy_grid_of_votes(*policy_votes(spark, sf_dir))
    return g.select("i", "j", *[F.round(c, 9).alias(c) for c in ("minimum", "single", "macro_f1", "accuracy", "coverage", "precision")])


POLICY_SQL = f"""with p as (
  select doc_id % 97 as id, origin, case when is_partial or provenance = 'searchSnippet' or alignment <> 'compatible' then null when z1 >= z2 and z1 >= z3 then 'e' when z2 >= z3 then 'n' else 'c' end as label,
    1 / (exp(z1 - m) + exp(z2 - m) + exp(z3 - m)) as score from (
      select doc_id, source as origin, ((doc_id * 37) % 101) / 25.0 as z1, ((doc_id * 53) % 103) / 25.0 as z2, ((doc_id * 71) % 107) / 25.0 as z3, greatest(z1, z2, z3) as m, doc_id % 11 = 0 as is_partial,
        case when doc_id % 13 = 0 then 'searchSnippet' else 'articleBody' end as provenance, case when doc_id % 7 = 0 then 'unknown' when doc_id % 7 = 1 then 'incompatible' else 'compatible' end as alignment from documents)),
g as (select a.range as i, b.range as j from range(19) a, range(19) b where a.range <= b.range),
r as (select distinct id from p),
v as (select i, j, id, count(distinct origin) = 1 as one, bool_or(label = 'e') as e, bool_or(label = 'c') as c, coalesce(bool_or(label = 'e' and score >= 0.5 + j * 0.025), false) as e1, coalesce(bool_or(label = 'c' and score >= 0.5 + j * 0.025), false) as c1
  from g, p where label <> 'n' and score >= 0.5 + i * 0.025 group by all),
a as (select g.i, g.j, r.id, case when r.id % 41 = 0 then 'ERROR' when (case when one then e1 else e end) and (case when one then c1 else c end) then 'DIVERGENTE' when (case when one then e1 else e end) then 'CONFIRMADO'
    when (case when one then c1 else c end) then 'CONTRADITO' else 'SEM_INFORMACAO' end as actual, case when r.id % 3 = 0 then 'CONFIRMADO' when r.id % 3 = 1 then 'CONTRADITO' else 'DIVERGENTE' end as expected
  from g cross join r left join v on g.i = v.i and g.j = v.j and r.id = v.id)
select i::int as i, j::int as j, round(0.5 + i * 0.025, 9)::double as minimum, round(0.5 + j * 0.025, 9)::double as single, round(({_F1}) / 5, 9) as macro_f1, round(count(*) filter (actual = expected) * 1.0::double / count(*), 9) as accuracy,
  round(coalesce(count(*) filter (actual in ('CONFIRMADO', 'CONTRADITO') and expected in ('CONFIRMADO', 'CONTRADITO')) * 1.0::double / nullif(count(*) filter (expected in ('CONFIRMADO', 'CONTRADITO')), 0), 0), 9) as coverage,
  round(coalesce(count(*) filter (actual in ('CONFIRMADO', 'CONTRADITO') and expected = actual) * 1.0::double / nullif(count(*) filter (actual in ('CONFIRMADO', 'CONTRADITO')), 0), 0), 9) as precision from a group by i, j"""


def verified_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages shown for annotated spans; some ids, URLs and spans are wrong on purpose."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    base = F.concat(F.lit("https://www."), F.col("source"), F.lit(".example.org/"), s)
    gold = F.array(F.struct(F.concat(F.lit("e"), s).alias("id"), F.concat(base, F.lit("/?a=1")).alias("url"), F.substring("text", 5, 30).alias("text")))
    shown = F.array(F.struct(F.concat(F.when(d % 5 == 0, "x").otherwise("e"), s).alias("id"), F.when(d % 7 == 0, "https://other.example/").otherwise(F.concat(F.replace(base, F.lit("www."), F.lit("")), F.lit("#top"))).alias("url"), F.when(d % 3 == 0, F.replace(F.substring("text", 1, 60), F.lit(" "), F.lit("  "))).otherwise(F.substring("text", 20, 60)).alias("text")))
    ids = evaluation.verified_evidence(gold, shown)
    sets = F.array(F.array(F.concat(F.lit("e"), s)), F.array(F.concat(F.lit("e"), s), F.lit("other")))
    return inputs.read(spark, sf_dir, "documents").select("doc_id", F.array_join(ids, ",").alias("ids"), evaluation.sufficient(sets, ids).alias("sufficient"))


EVIDENCE_SQL = r"""with t as (select doc_id, doc_id % 5 <> 0 and doc_id % 7 <> 0 and contains(lower(trim(regexp_replace(case when doc_id % 3 = 0 then replace(substr(text, 1, 60), ' ', '  ') else substr(text, 20, 60) end, '\s+', ' ', 'g'))),
  lower(trim(regexp_replace(substr(text, 5, 30), '\s+', ' ', 'g')))) and length(case when doc_id % 3 = 0 then substr(text, 1, 60) else substr(text, 20, 60) end) > 0 as ok from documents)
select doc_id, case when ok then 'e' || doc_id else '' end as ids, ok as sufficient from t"""


def matched_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans from all over the documents' texts against whole passages, each a table; some spans or addresses are changed, some of one word."""
    d, k = inputs.read(spark, sf_dir, "documents"), F.col("doc_id")
    page = F.concat(F.lit("example.org/"), "source", F.lit("/"), F.floor(k / 4).cast("string"))
    n = F.greatest(F.lit(1), F.length("text"))
    spans = d.select("doc_id", F.length("text").alias("n"), page.alias("page"), "text", F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j"))
    text = F.substring(F.col("text"), 1 + (k * 37 + F.col("j") * 1009) % F.greatest(F.lit(1), F.col("n")), F.when(k % 11 == 0, 4).otherwise(40).cast("int"))
    gold = spans.select(
        F.concat_ws("-", "doc_id", "j").alias("span_id"), F.concat(F.lit("https://www."), F.when(k % 7 == 0, F.concat("page", F.lit("x"))).otherwise(F.col("page")), F.lit("/?a=1")).alias("url"),
        F.when(k % 5 == 0, F.concat(text, F.lit(" ZZ"))).otherwise(F.replace(text, F.lit(" "), F.lit("  "))).alias("text"),
    )
    shown = d.where(n > 1).select(k.alias("passage_id"), F.concat(F.lit("https://"), page, F.lit("#top")).alias("url"), "text")
    return evaluation.matched_spans(gold, shown)


_LEVEL = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"
SPAN_SQL = rf"""with s as (select doc_id, j, 'www.example.org/' || source || '/' || doc_id // 4 as page, substr(text, (1 + (doc_id * 37 + j * 1009) % greatest(1, length(text)))::bigint, case when doc_id % 11 = 0 then 4 else 40 end) as span
  from documents, (select unnest(range(3)) as j)),
g as (select doc_id || '-' || j as span_id, page, {_LEVEL.format("case when doc_id % 5 = 0 then span || ' ZZ' else replace(span, ' ', '  ') end")} as span from s where doc_id % 7 <> 0),
p as (select doc_id as passage_id, 'www.example.org/' || source || '/' || doc_id // 4 as page, {_LEVEL.format("text")} as passage from documents where length(text) > 1)
select span_id, passage_id from g join p using (page) where passage <> '' and contains(passage, span)"""


def record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.record_errors(inputs.records(spark, sf_dir)).select("id", F.coalesce("error", F.lit("")).alias("error"))


RECORD_SQL = """select cast(doc_id as varchar) as id, case when doc_id % 101 = 0 or text = '' then 'grouping' when doc_id % 4 = 0 then ''
  when doc_id % 29 = 0 then 'verdict' when doc_id % 19 = 0 then 'date' when doc_id % 23 = 0 then 'review'
  when doc_id % 31 = 0 then 'sufficiency' when doc_id % 17 = 0 or text = '' then 'evidence' when doc_id % 37 = 0 then 'pair' else '' end as error from documents"""

_KEYS_SQL = """keys as (select distinct * from (
  select doc_id, ['train', 'calibration', 'test'][doc_id % 3 + 1] as split, 'event:ev' || doc_id % 400 as key from documents
  union all select doc_id, ['train', 'calibration', 'test'][doc_id % 3 + 1], 'family:' || sha256(text) from documents
  union all select doc_id, ['train', 'calibration', 'test'][doc_id % 3 + 1], 'url:' || case when doc_id % 17 = 0 then 'http' else 'https' end || '://' || source || '.example.org/a' || doc_id % 300 from documents))"""


def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.leaks(splits.group_keys(inputs.records(spark, sf_dir))).select("key", F.array_join("splits", ",").alias("splits"), "records")


LEAK_SQL = f"with {_KEYS_SQL} select key, string_agg(distinct split, ',' order by split) as splits, count(distinct doc_id) as records from keys group by key having count(distinct split) > 1"


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.explode(F.array(F.sha2("text", 256), F.concat(F.lit("n"), (F.floor(F.col("doc_id") / 3)).cast("string")))).alias("key"))


def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a text or a run of three numbers, directly or through others."""
    return splits.components(_families(spark, sf_dir))


COMPONENT_SQL = """with recursive k as (select doc_id as id, sha256(text) as key from documents union all select doc_id, 'n' || doc_id // 3 from documents),
e as (select distinct a.id as a, b.id as b from k a join k b using (key)),
r(id, c) as (select id, id from k union select e.b, r.c from r join e on r.id = e.a)
select id, min(c) as component from r group by id"""


def split_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each split gets when whole components (here pairs of numbers) are packed to exact targets."""
    d = inputs.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 2).cast("string").alias("key"))
    c = splits.components(d)
    n = c.count()
    q = 2 * (n // 8)
    return splits.packed(c, {"train": n - 2 * q, "calibration": q, "test": q}).groupBy("split").agg(F.count("*").alias("n"))


PACKING_SQL = """with n as (select count(*) as n, 2 * (count(*) // 8) as q from documents)
select 'train' as split, n - 2 * q as n from n union all select 'calibration', q from n union all select 'test', q from n"""


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = inputs.judged(spark, sf_dir).withColumn("truth", F.col("doc_id") % 2 == 0).withColumn("kind", F.col("provenance"))
    return evaluation.threshold_sweep(j, "entailment", "truth", [0.25, 0.35, 0.5, 0.65, 0.8], ["kind"])


SWEEP_SQL = f"""with {inputs.JUDGED_SQL}, t as (select unnest([0.25, 0.35, 0.5, 0.65, 0.8]::double[]) as threshold)
select provenance as kind, threshold, count(*) as n, count(*) filter ((e >= threshold) = (doc_id % 2 = 0)) as hits from judged, t group by all"""


def stable_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = inputs.judged(spark, sf_dir).select(F.col("doc_id").alias("d"), F.floor(F.col("doc_id") / 3).alias("grupo"), F.col("label").alias("predicted"), (F.col("label") == "entailment").alias("correct"))
    return evaluation.stability(j)


STABLE_SQL = f"""with {inputs.JUDGED_SQL} select doc_id // 3 as grupo, count(*) as n, count(distinct label) = 1 as stable, count(distinct label) = 1 and bool_and(label = 'entailment') as stable_correct from judged group by 1"""


def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pairs: the role is the hypothesis; labels are given by number, a tenth of them unknown."""
    t = F.col("turn") + F.col("conv_id")
    label = F.when(t % 10 == 9, "?").when(t % 3 == 0, "entailment").when(t % 3 == 1, "neutral").otherwise("contradiction")
    return audits.pair_audit(inputs.read(spark, sf_dir, "conversations").select(F.col("text").alias("sentence1"), "role", label.alias("gold_label")), hypothesis="role")


AUDIT_SQL = """with p as (select trim(text) as a, trim(role) as b, case when (turn + conv_id) % 10 = 9 then '?' when (turn + conv_id) % 3 = 0 then 'entailment' when (turn + conv_id) % 3 = 1 then 'neutral' else 'contradiction' end as l from conversations)
select count(*) as rows, count(*) filter (l = 'entailment') as entailment, count(*) filter (l = 'neutral') as neutral, count(*) filter (l = 'contradiction') as contradiction, count(*) filter (l = '?') as invalid,
  count(*) filter (a = '') as empty_premise, count(*) filter (b = '') as empty_hypothesis, count(distinct (a, b)) as unique_pairs, count(*) - count(distinct (a, b)) as duplicate_pairs from p"""


def search_leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.read(spark, sf_dir, "pages").select((F.col("page_id") % 20).alias("query"), host(F.col("url")).alias("host"), ((F.col("page_id") * 7) % 40 / 10.0).alias("seconds"))
    out = audits.leak_audit(p, F.col("host").endswith("example.org"))
    return out.withColumn("mean", F.round("mean", 9))


LEAKAUDIT_SQL = """select page_id % 20 as query, count(*) as results, count(*) filter (not ends_with(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), 'example.org')) as outside, min(((page_id * 7) % 40) / 10.0)::double as least,
  round(avg(((page_id * 7) % 40) / 10.0), 9) as mean, max(((page_id * 7) % 40) / 10.0)::double as most from pages group by 1"""


def usable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.read(spark, sf_dir, "pages").select(host(F.col("url")).alias("domain"), (F.length("html") > 3000).alias("usable"))
    return audits.usable_domains(p)


def upper_median_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audits.run_stats(inputs.read(spark, sf_dir, "events"), ["event_type"])
    return out.withColumn("mean", F.round("mean", 6))


MEDIAN_SQL = """select event_type, count(value) as n, min(value) as least, round(avg(value), 6) as mean, list_sort(list(value) filter (value is not null))[count(value) // 2 + 1] as upper_median, max(value) as most from events group by 1"""


def quiz_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = inputs.read(spark, sf_dir, "labels").select(F.col("doc_id").alias("fact_id"), F.when(F.col("quality") == 1, "FATO").otherwise("FARSA").alias("binary"))
    said = F.element_at(F.array(F.lit(" Verdade"), F.lit("mentira"), F.lit("certo"), F.lit("fake")), (F.col("event_id") % 4 + 1).cast("int"))
    answers = inputs.read(spark, sf_dir, "events").where("event_id % 3 > 0").select(F.col("event_id").alias("fact_id"), quiz.answer(said).alias("word"))
    both = answers.join(facts, "fact_id").select("fact_id", quiz.graded(F.col("binary"), F.col("word") == "fato").alias("correct"))
    return quiz.report(facts.select("fact_id"), both)


QUIZ_SQL = """select doc_id as fact_id, case when event_id is null then 'skip' when (quality = 1) = (event_id % 4 in (0, 2)) then 'hit' else 'miss' end as outcome
from labels left join (select event_id from events where event_id % 3 > 0) on doc_id = event_id"""


def quiz_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quiz.counters(quiz_report(spark, sf_dir))


def daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each day of events."""
    q = inputs.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"))
    return quiz.daily(q, inputs.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")))


DAILY_SQL = """with q as (select doc_id as question_id, row_number() over (order by md5(cast(doc_id as varchar)), doc_id) - 1 as n, count(*) over () as total from documents),
d as (select distinct ts::date as day from events)
select day, question_id from d join q on n = ('0x' || substr(md5(cast(day as varchar)), 1, 12))::bigint % total"""

SQL = {
    "daily_pick": DAILY_SQL, "confusion_matrix": CONFUSION_SQL, "evaluation_report": REPORT_SQL, "class_metrics": CLASS_SQL, "calibration_losses": LOSS_SQL, "calibration_temperature": TEMPERATURE_SQL,
    "policy_grid": POLICY_SQL, "verified_evidence": EVIDENCE_SQL, "matched_spans": SPAN_SQL, "record_errors": RECORD_SQL, "split_leakage": LEAK_SQL, "split_components": COMPONENT_SQL, "split_packing": PACKING_SQL,
    "threshold_sweep": SWEEP_SQL, "stable_families": STABLE_SQL, "audit_counts": AUDIT_SQL, "search_leak_audit": LEAKAUDIT_SQL,
    "usable_domains": "select lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as domain, count(*) as urls, bool_or(length(html) > 3000) as usable from pages group by 1",
    "upper_median_stats": MEDIAN_SQL, "quiz_report": QUIZ_SQL,
    "quiz_counters": f"select count(*) filter (outcome = 'hit') as hits, count(*) filter (outcome = 'miss') as misses, count(*) filter (outcome = 'skip') as skips from ({QUIZ_SQL})",
}
QUERIES = [
    confusion_matrix, evaluation_report, class_metrics, calibration_losses, calibration_temperature, policy_grid, verified_evidence, record_errors, split_leakage,
    matched_spans, split_components, split_packing, threshold_sweep, stable_families, audit_counts, search_leak_audit, usable_domains, upper_median_stats, quiz_report, quiz_counters, daily_pick,
]
