"""Queries over texts, URLs and pages, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clarion.functions import passages as rules, text as tx, urls
from clarion.operators import chunking, claims as claim_ops, domains, pages, quota, retrieval
from clarion.plans import inputs

ENTRIES = ("example.org", "www.example.com", "example.net", "m.example.org", "blog.example.com", "net")


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return inputs.read(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.canonical_online(u).alias("online"), urls.canonical_offline(u).alias("offline"), urls.secure(u).alias("secure"))


URL_SQL = r"""with p as (select page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) as proto, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) as auth,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as query from pages),
q as (select *, lower(regexp_replace(auth, '\.+$', '')) as host, array_to_string(list_filter(string_split(query, '&'), lambda x: not regexp_matches(x, '^(utm_|(fbclid|gclid)(=|$))')), '&') as kept from p)
select page_id, host, regexp_replace(proto || '://' || replace(lower(auth), 'www.', '') || path || case when kept <> '' then '?' || kept else '' end, '^/+|/+$', '', 'g') as online,
  proto || '://' || regexp_replace(lower(auth), '^www\.', '') || regexp_replace(path, '/+$', '') as offline, lower(proto) = 'https' and not contains(auth, '@') as secure from q"""


def allowlist_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = inputs.read(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    table = spark.createDataFrame([(e,) for e in ENTRIES], "domain string")
    return domains.match(p, "host", table).select("page_id", "host", "matched", urls.matched_domain(F.col("host"), ENTRIES).alias("matched_literal"))


ALLOWLIST_SQL = rf"""with p as (select page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) as host from pages),
e as (select unnest({list(ENTRIES)!r}) as domain),
m as (select page_id, arg_max(domain, length(regexp_replace(domain, '^www\.', ''))) as matched from p join e on regexp_replace(host, '^www\.', '') = regexp_replace(domain, '^www\.', '')
  or ends_with(regexp_replace(host, '^www\.', ''), '.' || regexp_replace(domain, '^www\.', '')) group by page_id)
select page_id, host, matched, matched as matched_literal from p left join m using (page_id)"""


def allowed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two allowed pages of every language path, filtered before they are cut."""
    p = inputs.read(spark, sf_dir, "pages").withColumn("section", F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1))
    ok = urls.allowed(F.col("url"), ("example.org", "blog.example.com"))
    return domains.first_allowed(p, ["section"], [F.col("page_id")], ok, 2).select("section", "page_id")


ALLOWED_SQL = r"""select regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) as section, page_id from pages
where starts_with(url, 'https://') and regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '(^|\.)(example\.org|blog\.example\.com)$')
qualify row_number() over (partition by section order by page_id) <= 2"""


def domain_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = inputs.hits(spark, sf_dir).select("ix", urls.matched_domain(urls.host(F.col("url"))).alias("domain")).where("domain is not null")
    p = urls.profile(F.col("domain"))
    return h.select("ix", "domain", p.getField("name").alias("name"), p.kind.alias("kind"), p.editorial_origin.alias("origin"))


PROFILE_SQL = """with d as (select doc_id as ix, ['g1.globo.com', 'bbc.com', 'gov.br', 'oglobo.globo.com', 'aosfatos.org', 'agenciabrasil.ebc.com.br'][doc_id % 7 + 1] as domain from documents where doc_id % 7 < 6)
select ix, domain, case domain when 'g1.globo.com' then 'G1' when 'bbc.com' then 'BBC' when 'aosfatos.org' then 'Aos Fatos' when 'agenciabrasil.ebc.com.br' then 'Agência Brasil' else domain end as name,
  case domain when 'gov.br' then 'primary' when 'aosfatos.org' then 'factCheck' else 'journalism' end as kind,
  case when ends_with(domain, 'globo.com') then 'grupo-globo' when ends_with(domain, 'ebc.com.br') then 'ebc' else domain end as origin from d"""


def claim_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = claim_ops.validity(F.col("text"))
    return inputs.read(spark, sf_dir, "documents").select("doc_id", v.status.alias("status"), v.delta.alias("delta"))


VALIDITY_SQL = """with t as (select doc_id, length(trim(text)) as n from documents)
select doc_id, case when n = 0 then 'empty' when n < 15 then 'tooShort' when n > 1000 then 'tooLong' else 'valid' end as status,
  case when n = 0 then 0 when n < 15 then 15 - n when n > 1000 then n - 1000 else 0 end::int as delta from t"""


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    c = claim_ops.candidates(t)
    return inputs.read(spark, sf_dir, "documents").select(
        "doc_id", F.size(c).alias("n_sentences"), F.md5(F.array_join(c, "|")).alias("digest"), claim_ops.needs_rephrasing(t).alias("needs_rephrasing"), tx.token_estimate(t).alias("tokens"), F.md5(claim_ops.first_query(t)).alias("query_md5")
    )


SENTENCE_SQL = r"""with s as (select doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as a from documents),
d as (select doc_id, text, case when len(a) > 0 then list_filter(a, lambda x, i: list_position(a, x) = i) else [trim(text)] end as c from s)
select doc_id, len(c)::int as n_sentences, md5(array_to_string(c, '|')) as digest,
  len(list_filter(c, lambda x: regexp_matches(strip_accents(lower(x)), '^(ele|ela|eles|elas|isso|isto|esse|essa|esses|essas|por isso)\b') or regexp_matches(x, '\s(?:e|mas|porém|enquanto)\s+(?:a|o|os|as|um|uma)\s+\p{Lu}[\p{L}]+\s'))) > 0 as needs_rephrasing,
  greatest(ceil(length(text) / 3.0), len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))::int as tokens,
  md5(case when length(c[1]) <= 200 then c[1] when trim(regexp_extract(substr(c[1], 1, 200), '(?s)^(.*)\s\S*$', 1)) = '' then substr(c[1], 1, 200) else trim(regexp_extract(substr(c[1], 1, 200), '(?s)^(.*)\s\S*$', 1)) end) as query_md5 from d"""


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.read(spark, sf_dir, "benchmark").select("item_id", tx.keywords(F.col("text")).alias("keywords"))


KEYWORD_SQL = rf"""select item_id, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '' and not list_contains({list(tx.STOP_WORDS)!r}, trim(lower(x), '.,')))[1:8], ' ') as keywords from benchmark"""

_TERMS = r"regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}]+(?:[.,]\d+)?')"


def doc_terms_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, documents, occurrences) over the whole table; counts combine before the shuffle."""
    t = inputs.read(spark, sf_dir, "documents").select("doc_id", F.explode(tx.terms(F.col("text"))).alias("term"))
    per = t.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


TERM_SQL = f"with t as (select doc_id, unnest({_TERMS}) as term from documents) select term, count(distinct doc_id) as documents, count(*) as occurrences from t group by term"


def protected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tx.terms(F.col("text"))
    return inputs.read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(tx.protected(w), "|")).alias("protected_md5"), F.size(tx.names(F.col("text"))).alias("n_names"), F.size(tx.shingles(w)).alias("n_shingles"))


PROTECTED_SQL = rf"""with t as (select doc_id, text, {_TERMS} as w from documents)
select doc_id, md5(array_to_string(list_sort(list_filter(list_transform(range(1, len(w) + 1), lambda i: case when list_contains({list(tx.QUALIFIERS)!r}, w[i]) then w[i]
    when regexp_matches(w[i], '\p{{N}}') then array_to_string(w[greatest(i - 1, 1):least(i + 1, len(w))], ' ') end), lambda x: x is not null)), '|')) as protected_md5,
  len(list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])\p{{Lu}}[\p{{L}}\p{{N}}]+'), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}_]', ''))))::int as n_names,
  len(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) else w end))::int as n_shingles from t"""


def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("html")
    inner = F.regexp_replace(F.regexp_extract(h, r"(?s)<article[^>]*>(.*?)</article>", 1), "<[^>]+>", " ")
    whole = F.regexp_replace(h, "<[^>]+>", " ")
    return inputs.read(spark, sf_dir, "pages").select(
        "page_id", rules.needs_scripts(h).alias("needs_scripts"), rules.noise(h).alias("noise"), rules.paywalled(h, [inner]).alias("paywalled"), rules.better_extract(inner, whole).alias("winner"),
        F.coalesce(rules.blocked(F.when(F.col("page_id") % 10 == 0, 403).otherwise(200), h), F.lit("")).alias("blocked"),
    )


# The same patterns for DuckDB, where a flag for letters of all scripts is not needed.
_NOISE, _PAYWALL = (p.replace("(?iu)", "(?i)").replace("'", "''") for p in (rules.NOISE, rules.PAYWALL))
SIGNAL_SQL = rf"""with p as (select page_id, html, regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1), '<[^>]+>', ' ', 'g') as a, regexp_replace(html, '<[^>]+>', ' ', 'g') as b,
  list_sum(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda x: length(x))) as n from pages),
s as (select *, len(regexp_extract_all(html, '{_NOISE}')) as noise, len(regexp_extract_all(a, '{_NOISE}')) as na, len(regexp_extract_all(b, '{_NOISE}')) as nb from p)
select page_id, length(html) < 3000 or regexp_matches(html, '{rules.EMPTY_ROOT}') or (coalesce(n, 0) < 150 and length(html) > 20000) as needs_scripts, noise::int as noise,
  regexp_matches(a, '{_PAYWALL}') or (length(a) < 200 and regexp_matches(html, '{_PAYWALL}')) as paywalled,
  case when length(a) < 200 and length(b) < 200 then 'none' when length(a) >= 200 and (length(b) < 200 or (-na, length(a)) > (-nb, length(b))) then 'a'
    when length(b) >= 200 and (length(a) < 200 or (-nb, length(b)) > (-na, length(a))) then 'b' else 'tie' end as winner,
  case when page_id % 10 = 0 then 'status:403' when {" when ".join(f"contains(lower(html), '{m}') then 'marker:{m}'" for m in rules.BLOCK_MARKERS)} when length(html) < 1500 then 'short' else '' end as blocked from s"""


def longest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = inputs.read(spark, sf_dir, "documents").where(F.length("text") >= 1000)
    return retrieval.top(d.withColumn("n", F.length("text")), ["source"], [F.desc("n"), F.asc("doc_id")], 3).select("source", "doc_id", "n", "rank")


LONGEST_SQL = """select source, doc_id, length(text)::int as n, (row_number() over (partition by source order by length(text) desc, doc_id))::int as rank from documents where length(text) >= 1000 qualify rank <= 3"""


def request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of conversation turns: broken JSON, missing queries, long ones and wrong methods among them."""
    t = F.col("turn")
    quoted = F.to_json(F.struct(F.col("text").alias("query")))
    body = (
        F.when(t % 7 == 1, F.concat(F.lit("{"), quoted)).when(t % 7 == 2, F.lit('{"q": 1}')).when(t % 7 == 3, F.lit('{"query": 5}'))
        .when(t % 7 == 4, F.to_json(F.struct(F.repeat(F.lit("x"), F.lit(201)).alias("query")))).when(t % 7 == 5, F.to_json(F.struct(F.repeat(F.lit("y"), F.lit(9000)).alias("query")))).otherwise(quoted)
    )
    status = quota.request_status(F.when(F.col("conv_id") % 5 == 0, "GET").otherwise("POST"), F.when(F.col("conv_id") % 7 == 0, "text/plain").otherwise("application/json; charset=utf-8"), body.cast("binary"))
    return inputs.read(spark, sf_dir, "conversations").select("conv_id", "turn", status.status.alias("status"), F.coalesce(status.code, F.lit("")).alias("code"))


REQUEST_SQL = """select conv_id, turn, case when conv_id % 5 = 0 then 405 when conv_id % 7 = 0 then 400 when turn % 7 = 5 then 413 when turn % 7 in (1, 2, 3, 4) then 400 when length(trim(text)) not between 1 and 200 then 400 else 200 end as status,
  case when conv_id % 5 = 0 then 'method_not_allowed' when conv_id % 7 = 0 then 'invalid_body' when turn % 7 in (1, 5) then 'invalid_body' when turn % 7 in (2, 3, 4) then 'invalid_query' when length(trim(text)) not between 1 and 200 then 'invalid_query' else '' end as code from conversations"""


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 126 tokens of every whole document."""
    d = inputs.read(spark, sf_dir, "documents").select("doc_id", "text")
    return chunking.chunked(d, budget=126)


# A step of the recursion is a paragraph; inside it sentences and words are gathered by reductions over lists.
# For texts without words of over 378 characters, as the test documents'.
_PHRASES = " or ".join(f"contains(f, '{tx.folded_text(p)}')" for p in rules.NAVIGATION)
_CUT = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_FITS = f"(greatest(ceil(length({{0}}) / 3.0), len({_CUT})) <= 126)"
_PARTS = r"list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
_GATHER = f"list_reduce(list_transform({_CUT}, lambda w: [w]), lambda a, b: case when {_FITS.format("(a[-1] || ' ' || b[1])")} then list_append(a[:-2], a[-1] || ' ' || b[1]) else a || b end)"
_UNITS = f"flatten(list_transform(parts, lambda u: case when {_FITS.format('u')} then [u] else {_GATHER.format('u')} end))"
_ONE = "{'made': list_append(a.made[:-2], a.made[-1] || ' ' || b.last), 'last': b.last}"
_NEXT = f"{{'made': list_append(a.made, case when {_FITS.format("(a.last || ' ' || b.last)")} then a.last || ' ' || b.last else b.last end), 'last': b.last}}"
_PACK = f"list_reduce(list_transform({_UNITS}, lambda u: {{'made': [u], 'last': u}}), lambda a, b: case when {_FITS.format("(a.made[-1] || ' ' || b.last)")} then {_ONE} else {_NEXT} end).made"
CHUNK_SQL = rf"""with recursive r as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\n\r\x0b\x0c]+'), lambda x: trim(x)), lambda x: x <> '') as every from documents),
f as (select doc_id, k, t, strip_accents(lower(t)) as f, x from (select doc_id, generate_subscripts(every, 1) as k, unnest(every) as x, trim(regexp_replace(x, '\s+', ' ', 'g')) as t from r)),
p as (select doc_id, list(x order by k) as ps from f where not (starts_with(f, 'title:') or (contains(t, ' | ') and not regexp_matches(t, '[.!?…]$')) or {_PHRASES}) group by doc_id),
s(doc_id, ps, k, made) as (select doc_id, ps, 0, []::varchar[] from p union all
  select doc_id, ps, k + 1, case when {_FITS.format("body")} then [body] when len(parts) > 1 then {_PACK} else {_GATHER.format("body")} end
  from (select *, {_PARTS.format("body")} as parts from (select doc_id, ps, k, concat_ws(' ', {_PARTS.format("made[-1]")}[-1], ps[k + 1]) as body from s where k < len(ps)))),
o as (select doc_id, k, unnest(made) as passage, generate_subscripts(made, 1) as j from s)
select doc_id, (row_number() over (partition by doc_id order by k, j) - 1)::int as ix, passage from o"""


def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = pages.scanned(inputs.read(spark, sf_dir, "pages").select("page_id", "html"))
    p = read.select("_row", "page_id").join(pages.main_text(read), "_row", "left").join(pages.tight_text(read).withColumnRenamed("text", "tight"), "_row", "left")
    text = F.coalesce("text", F.lit(""))
    return p.select("page_id", F.length(text).alias("n_chars"), F.md5(text).alias("text_md5"), F.length("tight").alias("tight_chars"))


def _unescaped(x: str) -> str:
    """Marks of the test pages as their characters, in SQL; the ampersand last."""
    for mark, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{mark}', '{char}')"
    return x


# For pages whose only container with paragraphs is one article, and whose paragraphs hold inline elements alone, as the test pages'.
_FLAT = r"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
_TEXT = _unescaped(r"regexp_replace(replace({x}, '<br>', ' '), '<[^>]*>', '', 'g')")
_BARE = "html"
for _pattern in (r"<!--.*?-->", "<script.*?</script>", "<style.*?</style>", "<nav.*?</nav>", "<footer.*?(?:</footer>|$)"):
    _BARE = f"regexp_replace({_BARE}, '(?s){_pattern}', '', 'g')"
MAIN_SQL = rf"""with p as (select page_id, {_TEXT.format(x=_BARE)} as every, string_split(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '<p>')[2:] as ps from pages),
q as (select page_id, every, list_filter(list_transform(ps, lambda x: {_FLAT.format(x=_TEXT.format(x="regexp_replace(x, '(?s)</p>.*', '')"))}), lambda x: x <> '') as ps from p),
t as (select page_id, case when len(list_filter(ps, lambda x: length(x) >= {pages.LEAST_PARAGRAPH})) > 0 then array_to_string(ps, chr(10))
    else array_to_string(list_filter(list_transform(regexp_split_to_array(every, '
|[

]'), lambda x: {_FLAT.format(x="x")}), lambda x: x <> ''), chr(10)) end as text,
  length(array_to_string(ps, chr(10) || chr(10))) as tight from q)
select page_id, length(text)::int as n_chars, md5(text) as text_md5, case when tight >= {pages.LEAST_TEXT} then tight end::int as tight_chars from t"""


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with heads planted by number: paid ones, broken and nested JSON-LD, structured texts of empty pages, marks and metadata."""
    k = F.col("page_id")
    n = k.cast("string")
    ld = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *[x if isinstance(x, Column) else F.lit(x) for x in parts], F.lit("</script>"))
    body = F.repeat(F.concat(F.lit("palavra "), n, F.lit(" ")), 40)
    head = (
        F.when(k % 6 == 1, ld('{"@type": "NewsArticle", "headline": "H', n, '", "author": {"name": "Ana"}, "isAccessibleForFree": false, "datePublished": "2024-01-02"}'))
        .when(k % 6 == 2, F.concat(ld("{broken"), ld('{"@graph": [{"@type": "WebPage", "headline": "w"}, {"@type": ["Article"], "headline": "G', n, '", "articleBody": "', body, '"}]}'), F.lit("<p>curto</p>")))
        .when(k % 6 == 3, F.concat(ld('[[{"mainEntity": [{"@type": "ClaimReview", "headline": "C', n, '", "isBasedOn": "https://a.test/"}]}]]'), F.lit('<link rel="x canonical" href="https://g1.globo.com/c/'), n, F.lit('"><meta property="article:published_time" content="2024-03-04T05:06:07Z">')))
        .when(k % 6 == 4, F.lit('<div class="x paywall"></div><meta property="og:type" content="website">')).when(k % 6 == 5, F.concat(ld('{"@type": "Person"}'), F.lit('<meta property="og:title" content="O'), n, F.lit('">'))).otherwise("")
    )
    own = inputs.read(spark, sf_dir, "pages").select("page_id", "url", F.when(k % 6 == 2, head).otherwise(F.concat(head, "html")).alias("html"))
    return pages.articles(own).select("page_id", F.md5("text").alias("text_md5"), "provenance", "is_partial", "canonical_url", "page_title", "author", "published_at", "original_source", "discard_reason")


ARTICLES_SQL = rf"""{MAIN_SQL.rsplit("select page_id, length(text)", 1)[0].rstrip()},
a as (select page_id as k, k % 6 as c, url, case when c = 2 then trim(repeat('palavra ' || k || ' ', 40)) else text end as text, c in (1, 4) as part from t join pages using (page_id)),
o as (select *, length(text) >= {pages.LEAST_TEXT} as ok, not starts_with(url, 'https://') as unsafe from a)
select k as page_id, case when ok then md5(text) end as text_md5, case when ok and c = 2 then 'structuredData' when ok then 'articleBody' end as provenance, case when ok then part end as is_partial,
  case when c = 3 then 'https://g1.globo.com/c/' || k end as canonical_url, case c when 1 then 'H' || k when 2 then 'G' || k when 3 then 'C' || k when 5 then 'O' || k end as page_title, case when c = 1 then 'Ana' end as author,
  case when c = 1 then timestamp '2024-01-02' when c = 3 then timestamp '2024-03-04 05:06:07' end as published_at, case when c = 3 then 'https://a.test/' end as original_source,
  case when unsafe then 'disallowedURL' when not ok and part then 'paywall' when not ok then 'unusable' end as discard_reason from o"""


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with links planted by number: articles of the own family and of others, sections, repeats and relative ones."""
    k = F.col("page_id").cast("string")
    href = lambda at: F.concat(F.lit('<a class="x" href="'), at, F.lit('">l</a>'))
    own = F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0), F.lit("/"))
    planted = F.concat(
        href(F.lit("/tag/one-two-three-four")), href(F.concat(F.lit("/noticia/um-dois-tres-quatro-"), k)), href(F.lit("mailto:a@example.org")), href(F.concat(F.lit("https://elsewhere.test/a-long-slug-here-"), k)),
        href(F.concat(F.lit(" /noticia/um-dois-tres-quatro-"), k, F.lit(" "))), href(F.concat(own, F.lit("x/2024/05/materia-"), k)), href(F.lit("/curta")), href(F.concat(F.lit("/id/1234500"), k)), href(F.concat(F.lit("/a-b-c-d-e-f/"), k)),
    )
    p = inputs.read(spark, sf_dir, "pages").select("page_id", "url", F.concat(planted, F.regexp_replace("html", "(?i)<a[^>]*>", "")).alias("html"))
    return pages.links(p)


LINKS_SQL = r"""with p as (select page_id as k, regexp_extract(url, '^[a-z]+://[^/?#]+') as root from pages)
select k as page_id, 1::int as position, root || '/noticia/um-dois-tres-quatro-' || k as link from p union all select k, 2, root || '/x/2024/05/materia-' || k from p union all select k, 3, root || '/id/1234500' || k from p"""


SQL = {
    "url_canonical": URL_SQL, "allowlist_match": ALLOWLIST_SQL, "allowed_pages": ALLOWED_SQL, "domain_profiles": PROFILE_SQL, "claim_validity": VALIDITY_SQL,
    "sentence_stats": SENTENCE_SQL, "keyword_queries": KEYWORD_SQL, "doc_terms_df": TERM_SQL, "protected_terms": PROTECTED_SQL, "page_signals": SIGNAL_SQL,
    "longest_per_source": LONGEST_SQL, "page_links": LINKS_SQL, "page_main_text": MAIN_SQL, "page_articles": ARTICLES_SQL, "chunk_documents": CHUNK_SQL, "request_status": REQUEST_SQL,
}
QUERIES = [
    url_canonical, allowlist_match, allowed_pages, domain_profiles, claim_validity, sentence_stats, keyword_queries, doc_terms_df, protected_terms,
    page_signals, longest_per_source, request_status, chunk_documents, page_main_text, page_articles, page_links,
]
