"""Queries over sources and sinks: each writes a derived file to the shared folder and reads it back, with its SQL."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from clarion.functions.lineage import shared_dir, stored
from clarion.operators import audits, claims as claim_ops, pages as page_ops
from clarion.plans import inputs
from clarion.sources import records, search, tsv


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _lines(df: DataFrame, name: str, header: str | None = None) -> str:
    """Writes a column of lines as text; a header goes to a file of its own."""
    path = _path(df.sparkSession, name)
    df.write.text(path)
    if header is not None:
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)
    return path


def fact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiz facts of the labels: a header, rows of too few fields and rows of one more among them."""
    s = F.col("doc_id").cast("string")
    fields = [s, F.concat(F.lit("https://example.org/"), s), F.lit("fonte"), F.lit("2024-01-01"), F.lit("por \"quê\""), F.lit(""), F.concat(F.lit("título "), s), F.when(F.col("quality") == 1, "FATO").otherwise("FARSA"), F.lit("saúde")]
    line = F.when(F.col("doc_id") % 10 == 0, F.concat_ws("\t", *fields)).when(F.col("doc_id") % 10 == 1, F.concat_ws("\t", *fields, F.lit("autor"), F.lit("mais\r"))).otherwise(F.concat_ws("\t", *fields, F.lit("autor\r")))
    path = _lines(inputs.read(spark, sf_dir, "labels").select(line.alias("value")), "facts", "\t".join(tsv.FACT).replace("id\t", "ID\t", 1))
    return tsv.facts(spark, path).select(F.col("id").cast("bigint").alias("id"), "url", "reason", "title", "binary", "author")


FACT_SQL = """select doc_id as id, 'https://example.org/' || doc_id as url, 'por "quê"' as reason, 'título ' || doc_id as title, case when quality = 1 then 'FATO' else 'FARSA' end as binary, 'autor' as author
from labels where doc_id % 10 <> 0"""


def question_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the day of the documents; ids that are no numbers and broken records go."""
    s = F.col("doc_id").cast("string")
    line = F.concat_ws("\t", F.when(F.col("doc_id") % 9 == 4, F.concat(F.lit("n"), s)).otherwise(F.concat(F.lit(" "), s)), F.concat(F.lit("pergunta "), s), "source", F.lit("true"), F.lit("motivo"), "lang", F.when(F.col("doc_id") % 6 != 5, F.lit("https://example.org")))
    path = _lines(inputs.read(spark, sf_dir, "documents").select(line.alias("value")), "questions", "\t".join(tsv.QUESTION))
    return tsv.questions(spark, path).select(F.trim("id").cast("bigint").alias("id"), "title", "source", "author", "link")


QUESTION_SQL = """select doc_id as id, 'pergunta ' || doc_id as title, source, lang as author, 'https://example.org' as link from documents where doc_id % 9 <> 4 and doc_id % 6 <> 5"""


def quiz_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold candidates from a quiz file of the pages; rows without a title and pages that are not HTTPS go."""
    p = inputs.read(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ID"), F.when(F.col("page_id") % 8 != 0, F.concat(F.lit(" título "), F.col("page_id").cast("string"))).alias("Título"), F.col("url").alias("URL"),
        F.when(F.col("page_id") % 3 == 0, "FARSA").otherwise("FATO").alias("Binário"), F.lit("2024").alias("Data"), F.lit("saúde").alias("Assunto"),
    )
    path = _path(spark, "candidates")
    p.write.csv(path, sep="\t", header=True)
    return tsv.import_candidates(spark, path)


CANDIDATE_SQL = r"""with p as (select page_id, url, regexp_extract(url, '^([a-zA-Z]+)://', 1) || '://' || regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') ||
  regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '') as offline from pages where starts_with(url, 'https://') and page_id % 8 <> 0)
select 'quiz-' || page_id as id, 'título ' || page_id as claim, url as source_url, substr(sha256(offline), 1, 16) as event_id, substr(sha256(offline), 1, 16) as family_id, '2024' as source_date_suggestion,
  'saúde' as topic, 'pending' as review_status, case when page_id % 3 = 0 then 'CONTRADITO' else 'CONFIRMADO' end as candidate_verdict from p"""


def gold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold records written as JSON lines and read with their schema."""
    path = _path(spark, "gold")
    records.write_lines(inputs.records(spark, sf_dir), path)
    r = records.read_lines(spark, path, records.GOLD)
    return r.select(
        "id", F.md5("claim").alias("claim_md5"), "event_id", "review_status", F.array_join("reviewers", ",").alias("reviewers"), "split", F.col("source_url").isNull().alias("no_source"),
        F.col("evidence")[0]["url"].alias("url"), F.md5(F.col("evidence")[0]["text"]).alias("evidence_md5"), F.array_join(F.flatten("sufficient_evidence_sets"), ",").alias("needed"), F.col("pairs")[0]["label"].alias("label"),
    )


GOLD_SQL = """select cast(doc_id as varchar) as id, md5(case when doc_id % 101 = 0 then '' else text end) as claim_md5, 'ev' || doc_id % 400 as event_id, case when doc_id % 4 <> 0 then 'reviewed' else 'pending' end as review_status,
  case when doc_id % 23 = 0 then 'a' else 'a,b' end as reviewers, ['train', 'calibration', 'test'][doc_id % 3 + 1] as split, true as no_source,
  case when doc_id % 17 = 0 then 'http' else 'https' end || '://www.' || source || '.example.org/a' || doc_id % 300 || '/?x=1' as url, md5(text) as evidence_md5,
  case when doc_id % 31 = 0 then 'zz' else 'e' || doc_id end as needed, case when doc_id % 37 = 0 then 'maybe' else 'neutral' end as label from documents"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries as stored: one per wording and status of the dated claims, some unreviewed, of one reviewer, or of another year."""
    c = inputs.claims(spark, sf_dir).where("claim_id % 7 in (2, 3)").groupBy("text").agg(F.min("claim_id").alias("k"), F.min("reference_ts").alias("ts"))
    kinds = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3))).alias("v")
    e = c.select("*", kinds)
    id_ = F.concat(F.lit("f"), F.col("k").cast("string"), F.lit("-"), F.col("v").cast("string"))
    return e.select(
        "k", "v", id_.alias("id"), F.upper("text").alias("claim"), F.when(F.col("v") == 3, F.array(F.lit("Órgão"))).otherwise(F.array().cast("array<string>")).alias("entities"),
        (F.year("ts") + F.when(F.col("v") == 1, 1).otherwise(0)).alias("eventYear"), F.lit("CONTRADITO").alias("verdict"), F.lit("https://www.bbc.com/x").alias("url"), F.lit("t").alias("title"), F.lit("trecho").alias("excerpt"),
        F.lit("2024-01-01").alias("publishedAt"), F.when((F.col("v") == 0) & (F.col("k") % 2 == 0), "pending").otherwise("reviewed").alias("status"), F.when(F.col("v") == 2, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("reviewerIDs"),
    )


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog file, one JSON array, written and read back; as many entries as days and years of claims."""
    columns = [x.strip().split(" ", 1)[0] for x in records.CATALOG.split(", ")]
    whole = _entries(spark, sf_dir).groupBy().agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("k", "v", *columns))), lambda e: F.struct(*[e[c].alias(c) for c in columns]))).alias("value"))
    path = _path(spark, "catalog")
    whole.write.text(path)
    return records.catalog(spark, path)


def catalog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _catalog(spark, sf_dir)
    return c.select("id", "position", "claim", F.size("entities").alias("n_entities"), "event_year", "status", F.array_join("reviewer_ids", ",").alias("reviewers"))


_ENTRIES_SQL = f"""{inputs.CLAIMS_SQL},
w as (select text, min(claim_id) as k, min(reference_ts) as ts from claims where claim_id % 7 in (2, 3) group by text),
entries as (select 'f' || k || '-' || v as id, row_number() over (order by k, v) - 1 as position, text, upper(text) as claim, (v = 3)::int as n_entities, (year(ts) + (v = 1)::int)::int as event_year,
  case when v = 0 and k % 2 = 0 then 'pending' else 'reviewed' end as status, case when v = 2 then 'a,a' else 'a,b' end as reviewers, v from w, (select unnest([0, 1, 2, 3]) as v))"""
ENTRY_SQL = f"with {_ENTRIES_SQL} select id, position, claim, n_entities, event_year, status, reviewers from entries"


def settled_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that a reviewed entry of the catalog settles: its year, the same terms, two reviewers, all entities named."""
    c = inputs.claims(spark, sf_dir).withColumn("c", claim_ops.context(F.col("text"), F.col("reference_ts")))
    return claim_ops.catalog_matches(c.select("claim_id", "text", F.col("c.kind").alias("kind"), F.col("c.start").alias("start")), _catalog(spark, sf_dir))


SETTLED_SQL = f"""with {_ENTRIES_SQL}
select claim_id, arg_min(e.id, position) as entry_id from contexts c join entries e on e.text = c.text and e.event_year = year(c.start_ts - interval 3 hour)
where kind = 'historical' and e.status = 'reviewed' and reviewers = 'a,b' and (v <> 3 or contains(strip_accents(lower(c.text)), 'orgao')) group by claim_id"""


def policy_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policy that each of the suppliers' files, a line each, puts in force for a model; the baseline where it is not valid."""
    k = F.col("s_suppkey")
    given = inputs.read(spark, sf_dir, "supplier").select(
        k.cast("string").alias("file"), F.concat(F.lit("v"), F.when(k % 13 > 0, k.cast("string")).otherwise("")).alias("version"), F.when(k % 3 == 0, "other").otherwise("m1").alias("modelVersion"),
        (k % 11 * 2.5).alias("temperature"), (0.4 + k % 5 / 10).alias("minimumConfidence"), (0.4 + k % 7 / 10).alias("singleSourceMinimumConfidence"), (k % 4 > 0).alias("calibrated"),
        F.when(k % 17 > 0, F.sha2("s_name", 256)).otherwise("short").alias("calibrationDigest"),
    )
    path = _path(spark, "policies")
    records.write_lines(given, path)
    p = F.col("in_force")
    return records.policies(records.read_lines(spark, path, f"file string, {records.POLICY}"), "m1").select("file", *[p[c].alias(c) for c in ("temperature", "minimum", "single", "calibrated")])


POLICY_FILE_SQL = """with p as (select s_suppkey as k, s_suppkey % 11 * 2.5::double as t, 0.4::double + s_suppkey % 5 / 10.0::double as m, 0.4::double + s_suppkey % 7 / 10.0::double as s from supplier),
v as (select *, k % 3 <> 0 and k % 4 > 0 and k % 17 > 0 and t between 0.049 and 21 and m between 0.5 and 1 and s >= m and s <= 1 as ok from p)
select cast(k as varchar) as file, case when ok then t else 1 end::double as temperature, case when ok then m else 0.5 end::double as minimum, case when ok then s else 0.5 end::double as single, ok as calibrated from v"""


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in the order of their ids, from a configuration of each supplier: all six orders, letters of both cases, repeated and broken ones."""
    k = F.col("s_suppkey")
    names = F.array(*[F.array(*[F.lit(x) for x in p]) for p in _ORDERS])
    own = F.element_at(names, (k % 6 + 1).cast("int"))
    text = F.concat(F.lit('{"2": "'), own[2], F.lit('", "0": "'), F.upper(own[0]), F.lit('", "1": "'), F.when(k % 5 == 0, own[0]).otherwise(own[1]), F.when(k % 7 == 0, "").otherwise('"}'))
    return inputs.read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(records.ordered_labels(text), ",").alias("labels"))


_ORDERS = [("entailment", "neutral", "contradiction"), ("entailment", "contradiction", "neutral"), ("neutral", "entailment", "contradiction"), ("neutral", "contradiction", "entailment"), ("contradiction", "entailment", "neutral"), ("contradiction", "neutral", "entailment")]
LABELS_SQL = f"select s_suppkey, case when s_suppkey % 5 > 0 and s_suppkey % 7 > 0 then {[','.join(p) for p in _ORDERS]!r}[s_suppkey % 6 + 1] end as labels from supplier"


def frozen_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches for region names, answered from stored results: the names of nations; one was never stored."""
    n = inputs.read(spark, sf_dir, "nation").join(inputs.read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    stored = n.select(
        F.col("r_name").alias("query"), F.col("n_name").alias("title"), F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"), F.lower("n_name").alias("content"),
        (k / 4).alias("score"), F.lit(None).cast("string").alias("published_date"), k.alias("position"),
    )
    asked = inputs.read(spark, sf_dir, "region").select(F.col("r_name").alias("query")).unionByName(spark.createDataFrame([("NOWHERE",)], "query string"))
    return search.replayed(asked, stored).select("query", "rank", "title", "url", "content", "score", "status")


FROZEN_SQL = """select r_name as query, (row_number() over (partition by r_name order by n_nationkey) - 1)::int as rank, n_name as title, 'https://example.org/' || n_nationkey as url, lower(n_name) as content,
  n_nationkey / 4.0::double as score, 200 as status from nation join region on n_regionkey = r_regionkey union all select 'NOWHERE', null, null, null, null, null, 404"""


def paged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs of all customers' addresses, page by page: two pages each, then what is left of them; some addresses are not there."""
    k = F.col("c_custkey")
    address = F.concat_ws(":", F.concat(F.lit("c"), k.cast("string")), F.lit("0"), (k % 5).cast("string"), (1 + k % 3).cast("string"))
    client = "clarion.sources.frozen:count_pages"
    first = stored(search.followed(inputs.read(spark, sf_dir, "customer").select(address.alias("start")), client, pages=2))
    found = first.unionByName(search.followed(search.unfinished(first), client))
    r = found.select("start", "page", F.explode("rows").alias("row"))
    return r.select("start", "page", F.get_json_object("row", "$.name").alias("name"), F.get_json_object("row", "$.n").cast("int").alias("n"))


PAGED_SQL = """with c as (select 'c' || c_custkey as name, c_custkey % 5 as pages, 1 + c_custkey % 3 as size from customer),
p as (select *, unnest(range(pages)) as page from c), r as (select *, unnest(range(size)) as i from p)
select name || ':0:' || pages || ':' || size as start, page::int as page, name, (page * size + i)::int as n from r"""


def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of pages as text: UTF-8, or Latin-1 where a byte breaks it; nothing over 3 MiB."""
    raw = F.col("html").cast("binary")
    raw = F.when(F.col("page_id") % 5 == 0, F.concat(raw, F.unhex(F.lit("E9")))).when(F.col("page_id") % 50 == 1, F.concat(raw, F.repeat(F.lit("x"), F.lit(3 * 1024 * 1024)).cast("binary"))).otherwise(raw)
    text = page_ops.decoded(raw)
    return inputs.read(spark, sf_dir, "pages").select("page_id", F.length(text).alias("n_chars"), F.right(text, F.lit(1)).alias("last"))


DECODED_SQL = """select page_id, case when page_id % 5 = 0 then case when strlen(html) + 1 <= 3145728 then strlen(html) + 1 end
    when page_id % 50 = 1 then null else length(html) end::int as n_chars,
  case when page_id % 5 = 0 then 'é' when page_id % 50 = 1 then null else right(html, 1) end as last from pages"""


def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state saved twice keeps the later one; where nothing was saved there are no rows."""
    path, schema = _path(spark, "state"), "name string, doc_id bigint"
    least = inputs.read(spark, sf_dir, "documents").agg(F.lit("question").alias("name"), F.min("doc_id").alias("doc_id"))
    most = inputs.read(spark, sf_dir, "documents").agg(F.lit("question").alias("name"), F.max("doc_id").alias("doc_id"))
    for state in (least, most):
        records.save_state(state, path)
    return records.load_state(spark, path, schema).unionByName(records.load_state(spark, path + "-none", schema))


def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a manifest without a file or with another digest; documents stand for files."""
    d = inputs.read(spark, sf_dir, "documents")
    s = F.col("doc_id").cast("string")
    files = d.where("doc_id % 11 <> 0").select(s.alias("path"), F.col("text").cast("binary").alias("content"))
    manifest = d.select(s.alias("path"), F.upper(F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)).alias("sha256"))
    return audits.manifest_errors(files, manifest)


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder with their digests: a text per region."""
    path = _path(spark, "files")
    inputs.read(spark, sf_dir, "region").select("r_name", F.col("r_name").alias("value")).repartition(1).write.partitionBy("r_name").option("lineSep", "\n").text(path)
    return records.files(spark, path, "*.txt").select(F.sha2("content", 256).alias("sha256"), "length")


def pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs of the turns, written as a table with header; those with a known label and two sides train."""
    t = F.col("turn") + F.col("conv_id")
    label = F.when(t % 10 == 9, "?").when(t % 3 == 0, "entailment").when(t % 3 == 1, "neutral").otherwise("contradiction")
    p = inputs.read(spark, sf_dir, "conversations").select(F.md5("text").alias("sentence1"), F.when(t % 8 != 0, F.concat(F.lit("um \"dito\" de "), "role")).alias("sentence2"), label.alias("gold_label"), "conv_id", "turn")
    path = _path(spark, "pairs")
    p.write.csv(path, sep="\t", header=True, quote='"', escape='"')
    return tsv.training_pairs(tsv.pairs(spark, path)).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "sentence1", "sentence2", "gold_label")


PAIR_SQL = """with p as (select *, turn + conv_id as t from conversations)
select conv_id, turn, md5(text) as sentence1, 'um "dito" de ' || role as sentence2, case when t % 3 = 0 then 'entailment' when t % 3 = 1 then 'neutral' else 'contradiction' end as gold_label from p where t % 10 <> 9 and t % 8 <> 0"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a log of the events, a fifth of them of other kinds or broken."""
    e = inputs.read(spark, sf_dir, "events")
    j = F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("variant"), F.concat(F.lit("s"), (F.col("event_id") % 6).cast("string")).alias("stage"), (F.col("event_id") * 7 % 1000).alias("free_disk_mb"), (F.col("event_id") * 13 % 997).alias("peak_resident_mb"), (F.col("event_id") % 5 * 128).alias("tokens")))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("12:00 INFO OTHER "), j)).when(F.col("event_id") % 11 == 0, F.lit("12:00 INFO GATE {\"seq\": ")).otherwise(F.concat(F.lit("12:00 INFO GATE "), j))
    path = _lines(e.select(line.alias("value")), "log")
    return records.structured_lines(spark, path, "GATE", "seq bigint, variant string, stage string, free_disk_mb bigint, peak_resident_mb bigint, tokens int")


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", "variant", "stage", "free_disk_mb", "peak_resident_mb")


_LOG_SQL = "log as (select event_id as seq, event_type as variant, 's' || event_id % 6 as stage, event_id * 7 % 1000 as free_disk_mb, event_id * 13 % 997 as peak_resident_mb, event_id % 5 * 128 as tokens from events where event_id % 5 <> 0 and event_id % 11 <> 0)"


def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the log's runs needed, per variant: extremes, the heaviest stage, the first one."""
    return audits.gate_summary(_log(spark, sf_dir))


GATE_SUMMARY_SQL = f"""with {_LOG_SQL} select variant, count(*) as lines, min(free_disk_mb) as least_free_disk_mb, max(peak_resident_mb) as most_resident_mb, arg_max(stage, (peak_resident_mb, -seq)) as heaviest_stage, arg_min(stage, seq) as first_stage from log group by 1"""


def gate_by_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's peak memory per variant, a column for each length in tokens."""
    return audits.by_length(_log(spark, sf_dir), "variant", "tokens", "peak_resident_mb", (128, 256, 384, 512))


GATE_TOKENS_SQL = f"with {_LOG_SQL} select variant, {', '.join(f'max(peak_resident_mb) filter (tokens = {n}) as t{n}' for n in (128, 256, 384, 512))} from log group by 1"


def prediction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as lines of JSON with sorted keys, as a reader of text sees them; nulls are left out."""
    d = F.col("doc_id")
    p = inputs.read(spark, sf_dir, "labels").select(F.concat(F.lit("p"), d.cast("string")).alias("id"), F.when(d % 4 != 0, "CONFIRMADO").alias("verdict"), F.when(d % 4 == 0, "timeout").alias("error"), (d % 3).cast("int").alias("search_calls"))
    path = _path(spark, "predictions")
    records.write_lines(p, path)
    return spark.read.text(path).select("value")


PREDICTION_SQL = """select '{' || case when doc_id % 4 = 0 then '"error":"timeout",' else '' end || '"id":"p' || doc_id || '","search_calls":' || doc_id % 3 || case when doc_id % 4 <> 0 then ',"verdict":"CONFIRMADO"' else '' end || '}' as value from labels"""


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a Markdown table of the pages, written and read as text; bars in cells are escaped."""
    p = inputs.read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("a|b "), "url").alias("url"), F.when(F.col("page_id") % 3 != 0, F.length("html")).alias("n"))
    return spark.read.text(_lines(records.report_lines(p, ["page_id", "url", "n"]), "report")).select("value")


REPORT_ROW_SQL = r"""select '| ' || page_id || ' | a\|b ' || url || ' | ' || case when page_id % 3 <> 0 then length(html)::varchar else '' end || ' |' as value from pages"""

SQL = {
    "fact_rows": FACT_SQL, "question_rows": QUESTION_SQL, "quiz_candidates": CANDIDATE_SQL, "gold_lines": GOLD_SQL, "catalog_entries": ENTRY_SQL, "settled_claims": SETTLED_SQL,
    "policy_in_force": POLICY_FILE_SQL, "model_labels": LABELS_SQL, "frozen_search": FROZEN_SQL,
    "paged_rows": PAGED_SQL, "decoded_pages": DECODED_SQL, "saved_state": "select 'question' as name, max(doc_id) as doc_id from documents",
    "file_manifest": "select cast(doc_id as varchar) as path, case when doc_id % 11 = 0 then 'missing' else 'changed' end as problem from documents where doc_id % 11 = 0 or doc_id % 7 = 0",
    "stored_files": r"select sha256(r_name || chr(10)) as sha256, strlen(r_name) + 1 as length from region", "pair_rows": PAIR_SQL,
    "log_records": f"with {_LOG_SQL} select seq, variant, stage, free_disk_mb, peak_resident_mb from log", "gate_summary": GATE_SUMMARY_SQL, "gate_by_tokens": GATE_TOKENS_SQL,
    "prediction_lines": PREDICTION_SQL, "report_rows": REPORT_ROW_SQL,
}
QUERIES = [
    fact_rows, question_rows, quiz_candidates, gold_lines, catalog_entries, settled_claims, policy_in_force, model_labels, frozen_search, paged_rows, decoded_pages, saved_state, file_manifest,
    stored_files, pair_rows, log_records, gate_summary, gate_by_tokens, prediction_lines, report_rows,
]
