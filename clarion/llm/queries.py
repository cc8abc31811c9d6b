"""The registered queries of this subpackage, by operator number, and their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clarion.llm import chunkprints, conversations, decontaminate, mixture, packing, quality, repeats, secrets, sharding, simhash, tokenfiles, toxicity, vectors


#: Where the public tokenizers' files are, by name.
TOKENIZERS = public_tokenizers.path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, _read(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.tokenized(_read(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), TOKENIZERS("word_bpe_49k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.deduplicate(_read(spark, sf_dir, "documents")).drop("kept")


def op10_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkprints.compare(_read(spark, sf_dir, "documents"))


def op11_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.pack_mixture(_read(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(_read(spark, sf_dir, "conversations")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.compressed(_read(spark, sf_dir, "embeddings"))


_ALL = [op1_decontaminate, op2_simhash, op3_toxicity, op4_sharding, op5_token_files, op6_secrets, op7_packing, op8_quality, op9_repeats, op10_chunk_fingerprints,
        op11_mixture_packing, op12_conversation_repair, op13_vector_codes]


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in [*_ALL, pipeline]}


_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
DECONTAMINATE_SQL = f"""with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
i as (select item_id, w, least(10, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
q as (select item_id, n, j, array_to_string(w[j:j + n - 1], ' ') as g from (select item_id, n, w, unnest(range(1, len(w) - n + 2)) as j from i)),
g as (select doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from q) where len(w) >= n)),
m as (select doc_id, item_id, n, p, j from g join q using (n, g)),
h as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(p, p + n)) as k from m) group by doc_id),
s as (select doc_id, count(distinct item_id) as n_items, sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) as digest from m group by doc_id),
r as (select doc_id, item_id, n, p - j as diagonal, p - row_number() over (partition by doc_id, item_id, p - j order by p) as island from m),
l as (select doc_id, max(k) as longest from (select doc_id, count(*) + n - 1 as k from r group by doc_id, item_id, diagonal, island, n) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(digest, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(longest, 0)::int as longest from d left join h using (doc_id) left join s using (doc_id) left join l using (doc_id)"""



def _found_sql(kind: int, pattern: str, group: int = 0) -> str:
    """Matches of one pattern with their number; places add up from the pieces between matches and the matches."""
    p = pattern.replace("'", "''")
    return f"""select doc_id, owner, {kind} as kind, gaps, found, vals, unnest(range(1, len(found) + 1)) as k from (
  select doc_id, owner, regexp_split_to_array(text, '{p}') as gaps, regexp_extract_all(text, '{p}') as found, regexp_extract_all(text, '{p}', {group}) as vals from t)"""


SECRETS_SQL = f"""with t as (select doc_id, coalesce(source, '') as owner, coalesce(text, '') as text from documents),
f as ({_found_sql(0, secrets.ASSIGN, 2)} union all {_found_sql(1, secrets.ACCESS)} union all {_found_sql(2, secrets.HEX)} union all {_found_sql(4, secrets.TOKEN)}),
m as (select doc_id, owner, kind, vals[k] as val, coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:k], lambda x: length(x))), 0) as stop, length(found[k]) as n from f),
c as (select doc_id, owner, kind, val, (stop - n)::bigint as start, stop::bigint as stop, (stop - length(val))::bigint as vstart from m
  where (kind <> 0 or length(val) >= {secrets.ASSIGN_VALUE}) and (kind <> 1 or length(val) >= {secrets.ACCESS_LENGTH})),
b as (select doc_id, kind, start, stop from c where kind < 4),
l as (select * from c where {secrets.LIVE_SQL.format(v="val")} and (kind < 4 or not exists (select 1 from b where b.doc_id = c.doc_id and b.start < c.stop and c.start < b.stop))),
r as (select val from l group by val having count(distinct owner) <= {secrets.MAX_OWNERS} and count(distinct doc_id) <= {secrets.MAX_REPOSITORIES}),
a as (select distinct doc_id, case when kind < 4 then 3 else 4 end as kind, vstart as start, stop from l where val in (select val from r)),
s as (select *, {list(secrets.KINDS)!r}[kind + 1] || ':' || start || ':' || stop as s from (select * from b union all select doc_id, kind, start, stop from a)),
g as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex, count(*) filter (kind > 2) as n_live,
  string_agg(s, ',' order by start, kind, stop) as spans, string_agg(s, ',' order by start, kind, stop) filter (kind < 3) as base from s group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live
from t left join g using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """The others use hashes, tokenizers, learned models or schedules that SQL lacks; tests hold them against brute force."""
    return {"op1_decontaminate": DECONTAMINATE_SQL, "op6_secrets": SECRETS_SQL}
