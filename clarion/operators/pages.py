"""Web pages: main text, article data, links.

A small scanner turns each page into its tags and texts, once. What lies in what is then a
matter of running sums over a page's events, choices are aggregations, and JSON-LD is
walked as VARIANT values.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.lineage import extended, stored
from clarion.functions.passages import ARTICLE_HINT, NO_ARTICLE
from clarion.functions.text import collapse
from clarion.functions.urls import allowed, host, part, same_family, secure

# Elements without content, containers, void elements, elements that a paragraph can't hold.
DROPPED = frozenset("script style noscript iframe svg form nav header footer aside figure figcaption".split())
DROPPED_B = frozenset("script style nav footer aside form header noscript".split())
CONTAINERS = ("article", "main", "section", "div")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ARTICLE_TYPES = ("NewsArticle", "Article", "ReportageNewsArticle", "ClaimReview")
PAID_CLASSES = ("paywall", "subscription-required", "article-preview")
LEAST_PARAGRAPH, LEAST_TEXT, MOST_BYTES = 25, 200, 3 << 20
#: Characters of pages whose events a worker holds at once, but for one page.
SCANNED = 1 << 20
#: Events of a partition, on average, while pages are worked on.
EVENTS = 100_000


class _Tags(HTMLParser):
    """The tags and texts of a page in order; every element is closed, by its end tag or by what ends one around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events: list[tuple] = []  # kind (1 opens, -1 closes, 2 is void, 0 text), tag, attributes as JSON, text
        self.open: list[str] = []
        self.data: list[str] = []

    def _flush(self) -> None:
        if self.data:
            self.events.append((0, None, None, "".join(self.data)))
            self.data = []

    def _close(self, until: str | None) -> None:
        self._flush()
        while self.open:
            tag = self.open.pop()
            self.events.append((-1, tag, None, None))
            if tag == until:
                return

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in CLOSES_P and "p" in self.open:
            self._close("p")
        self.events.append((2 if tag in VOID else 1, tag, json.dumps({k: v or "" for k, v in attrs}) if attrs else None, None))
        if tag == "br":
            self.data.append(" ")
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            self._close(tag)

    def handle_data(self, data):
        self.data.append(data)


_EVENTS = pa.list_(pa.struct([("kind", pa.int8()), ("name", pa.string()), ("attrs", pa.string()), ("value", pa.string())]))


def _scans(batches, names: list[str]):
    """Batches of html and other columns with the events of SCANNED characters at a time."""
    for batch in batches:
        found = []
        at = size = 0
        for k, text in enumerate(batch.column(0)):
            text = text.as_py() or ""
            tags = _Tags()
            tags.feed(text)
            tags.close()
            tags._close(None)
            found.append(tags.events)
            size += len(text)
            if size >= SCANNED or k + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(found)).columns[1:], pa.array(found, _EVENTS)], names=[*names, "_events"])
                at, found, size = k + 1, [], 0


def scanned(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with a number ``_row`` and the page's ``_events``, written: each page is read once.

    Null and empty pages have no events. What a worker holds at once is an Arrow batch of pages and the events of SCANNED characters.
    """
    rest = [c for c in pages.columns if c != html]
    own = pages.select(html, *rest, F.monotonically_increasing_id().alias("_row"))
    return stored(own.mapInArrow(lambda batches: _scans(batches, [*rest, "_row"]), extended(own.drop(html).schema, "_events array<struct<kind:tinyint,name:string,attrs:string,value:string>>")))


def _attribute(name: str) -> Column:
    return F.get_json_object("attrs", f"$['{name}']")


def _exploded(pages: DataFrame) -> DataFrame:
    """An event a row, all of a page in one partition from here on; with more events there are more partitions, not larger ones."""
    n = pages.agg(F.sum(F.size(F.col("_events.kind")))).first()[0] or 0
    parts = max(pages.sparkSession.sparkContext.defaultParallelism, -(-n // EVENTS))
    return pages.select("_row", F.posexplode("_events").alias("i", "e")).select("_row", "i", "e.*").repartition(parts, "_row")


def _blocks(pages: DataFrame, dropped: frozenset[str], denied: str | None = None) -> DataFrame:
    """Visible blocks of scanned pages: each paragraph's text, each other text, each container's place and contents.

    Columns: _row, at (place of its first event), what (container, paragraph, other), name, raw
    and text (of paragraphs and others), and of containers end, n (characters of long
    paragraphs), links (characters of link texts), elements and joined (length of all
    paragraphs, two characters between them). Elements nest, so whatever a container holds is
    the difference of running sums at its two ends: no container meets its paragraphs.
    """
    page = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind").isin(1, -1), F.col("kind").cast("int")).otherwise(0)
    e = _exploded(pages).withColumn("depth", F.sum(step).over(page))
    e = e.withColumn("level", F.when(F.col("kind") == -1, F.col("depth") + 1).when(F.col("kind") == 1, F.col("depth")))
    hides = F.col("name").isin(*dropped)
    if denied:
        names = F.concat_ws(" ", _attribute("class"), _attribute("id"))
        hides = hides | (~F.col("name").isin("html", "body", "main", "article") & names.rlike(denied))
    e = e.withColumn("hides", (F.col("kind") == 1) & hides)
    # Events of one level are an open one and its close one, in turn.
    peers = Window.partitionBy("_row", "level").orderBy("i")
    e = e.withColumn("hides", F.when(F.col("kind") == -1, F.lag("hides").over(peers)).otherwise(F.col("hides")))
    inside = lambda test: F.sum(F.when(test, step).otherwise(0)).over(page)
    e = e.withColumns({
        "hidden": inside(F.col("hides")), "_p": inside(F.col("name") == "p"), "_a": inside(F.col("name") == "a"),
        "number": F.max(F.when((F.col("kind") == 1) & (F.col("name") == "p"), F.col("i"))).over(page), "elements": F.sum(F.when(F.col("kind") > 0, 1).otherwise(0)).over(page),
    })
    shown, text = F.col("hidden") == 0, F.col("kind") == 0
    container = F.col("name").isin(*CONTAINERS, "body") & F.col("kind").isin(1, -1)
    opens_p = shown & (F.col("kind") == 1) & (F.col("name") == "p")
    what = F.when(container, "container").when(opens_p | (shown & text & (F.col("_p") > 0)), "paragraph").when(shown & text, "other")
    at = F.when(F.col("kind") == 1, F.col("i")).when(text & (F.col("_p") > 0), F.col("number")).otherwise(F.col("i"))
    link = F.when(text & shown & (F.col("_a") > 0), F.length(collapse(F.col("value")))).otherwise(0)
    own = e.withColumn("what", what).where("what is not null").withColumn("at", at).withColumn("link", link)
    held = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text, F.struct("i", "value")))), lambda x: x["value"]), "")
    firsts = [F.first(F.when(F.col("what") == "container", F.col(c)), ignorenulls=True).alias(c) for c in ("name", "kind", "level", "elements")]
    b = own.groupBy("_row", "at", "what").agg(held.alias("raw"), F.sum("link").alias("link"), *firsts)
    b = b.withColumn("text", F.when(F.col("what") == "paragraph", collapse(F.col("raw"))).otherwise(""))
    size = F.length("text")
    order = Window.partitionBy("_row").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda x: F.sum(x).over(order)
    sums = F.struct(
        upto(F.when(size >= LEAST_PARAGRAPH, size).otherwise(0)).alias("n"), upto(F.col("link")).alias("links"), F.col("elements").alias("elements"),
        upto(F.when(size > 0, size + 2).otherwise(0)).alias("joined"), F.col("at").alias("end"),
    )
    b = b.withColumn("sums", sums)
    after = F.lead("sums").over(Window.partitionBy("_row", "what", "level").orderBy("at"))
    b = b.withColumn("after", after).where("what <> 'container' or kind = 1")
    held_by = {c: F.when(F.col("what") == "container", F.col(f"after.{c}") - F.col(f"sums.{c}")) for c in ("n", "links", "elements", "joined")}
    return b.withColumns(held_by | {"end": F.col("after.end")}).withColumn("joined", F.greatest(F.lit(0), F.col("joined") - 2)).drop("sums", "after", "kind", "level", "link")


def _lines(b: DataFrame, best: Column, between: str, otherwise: bool) -> DataFrame:
    """(_row, text): the paragraphs of the container ``best`` of each page, else all its text if ``otherwise``."""
    b = b.withColumn("best", best)
    taken = (F.col("what") == "paragraph") & (F.col("text") != "") & (F.col("at") > F.col("best.at")) & (F.col("at") < F.col("best.end"))
    every = F.col("best").isNull() & (F.col("what") != "container")
    joined = lambda test, c: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("at", F.col(c).alias("x"))))), lambda y: y["x"])
    out = b.groupBy("_row").agg(F.max(F.col("best").isNotNull()).alias("found"), F.array_join(joined(taken, "text"), between).alias("chosen"), F.array_join(joined(every, "raw"), "").alias("raw"))
    lines = F.filter(F.transform(F.split("raw", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), collapse), lambda x: x != "")
    return out.select("_row", F.when(F.col("found"), F.col("chosen")).otherwise(F.array_join(lines, "\n") if otherwise else F.lit(None)).alias("text"))


def main_text(pages: DataFrame) -> DataFrame:
    """(_row, text) of scanned pages: paragraphs, a line each, of the container with most paragraph text and least links; else all text.

    A container's score is the length of its paragraphs of LEAST_PARAGRAPH characters or more,
    less the share of link text. The first of equal scores wins. Pages without visible text have no row.
    """
    b = _blocks(pages, DROPPED)
    score = F.col("n") - F.col("links")  # n * (1 - links / n), exact
    ranked = F.when((F.col("what") == "container") & F.col("name").isin(*CONTAINERS) & (score > 0), F.struct(score.alias("score"), (-F.col("at")).alias("first"), "at", "end"))
    return _lines(b, F.max(ranked).over(Window.partitionBy("_row")), "\n", True)


def tight_text(pages: DataFrame, denied: str = r"(?i)(sidebar|related|share|newsletter|comment|advert|promo|breadcrumb)") -> DataFrame:
    """(_row, text), the other extract: the first article if of LEAST_TEXT characters, else the smallest container with nine tenths of the most text; else null."""
    b = _blocks(pages, DROPPED_B, denied)
    page = Window.partitionBy("_row")
    article = F.col("name") == "article"
    first = F.min(F.when(article, F.struct("at", "end", "joined"))).over(page)
    b = b.withColumn("first", first).withColumn("long", ~article & (F.col("joined") >= LEAST_TEXT)).withColumn("most", F.max(F.when(F.col("long"), F.col("joined"))).over(page))
    smallest = F.min(F.when(F.col("long") & (F.col("joined") >= 0.9 * F.col("most")), F.struct("elements", "at", "end"))).over(page)
    best = F.when(F.col("first.joined") >= LEAST_TEXT, F.struct("first.at", "first.end")).otherwise(F.when(smallest.isNotNull(), F.struct(smallest["at"].alias("at"), smallest["end"].alias("end"))))
    return _lines(b, best, "\n\n", False)


def _article_objects(scripts: DataFrame) -> DataFrame:
    """(_row, v): the first article object of the scripts (_row, i, value) of each page, in order of appearance; an object comes before what it holds.

    Values are walked level by level through arrays, ``@graph`` and ``mainEntity``; each level
    is written, and the walk ends with the deepest one. Text that isn't JSON is passed over.
    """
    kind = lambda v: F.schema_of_variant(v)
    front = scripts.select("_row", F.array(F.col("i")).alias("path"), F.try_parse_json("value").alias("v")).where("v is not null")
    found = None
    while True:
        front = stored(front)
        if front.isEmpty():
            break
        t = F.coalesce(F.try_variant_get("v", "$['@type']", "array<string>"), F.array(F.try_variant_get("v", "$['@type']", "string")))
        own = front.where(F.arrays_overlap(t, F.array(*[F.lit(x) for x in ARTICLE_TYPES])) & kind(F.col("v")).startswith("OBJECT")).select("_row", "path", F.to_json("v").alias("text"))
        found = own if found is None else found.unionByName(own)
        items = F.when(kind(F.col("v")).startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>"))
        held = F.filter(F.array(F.try_variant_get("v", "$['@graph']", "variant"), F.try_variant_get("v", "$['mainEntity']", "variant")), lambda x: x.isNotNull())
        below = F.when(items.isNotNull(), items).when(kind(F.col("v")).startswith("OBJECT"), held)
        front = front.select("_row", "path", F.posexplode(below).alias("k", "v")).where("v is not null").select("_row", F.concat("path", F.array("k")).alias("path"), "v")
    if found is None:
        return scripts.select("_row", F.lit("{}").alias("text")).limit(0).select("_row", F.parse_json("text").alias("v"))
    return found.groupBy("_row").agg(F.min_by("text", "path").alias("text")).select("_row", F.parse_json("text").alias("v"))


def heads(pages: DataFrame) -> DataFrame:
    """Metadata of scanned pages, a row for each with any event: _row, paywalled, marked_paid, og_type, canonical, title, author,
    published, modified, body, original_source."""
    e = _exploded(pages)
    opens = F.col("kind") > 0
    before = Window.partitionBy("_row").orderBy("i")
    ld = F.lag(opens & (F.col("name") == "script") & (_attribute("type") == "application/ld+json")).over(before)
    scripts = stored(e.withColumn("ld", ld).where("ld and kind = 0").select("_row", "i", "value"))
    key = F.coalesce(F.nullif(_attribute("property"), F.lit("")), _attribute("name"))
    content = F.nullif(_attribute("content"), F.lit(""))
    is_meta = opens & (F.col("name") == "meta") & content.isNotNull()
    meta = lambda k: F.min_by(content, F.when(is_meta & (key == k), F.col("i")))
    rel = opens & (F.col("name") == "link") & F.array_contains(F.split(_attribute("rel"), r"\s+"), "canonical")
    classes = F.split(_attribute("class"), r"\s+")
    paid = opens & (
        F.coalesce((_attribute("itemprop") == "isAccessibleForFree") & (_attribute("content") == "false"), F.lit(False)) | F.coalesce(_attribute("data-paywall") == "true", F.lit(False))
        | F.coalesce(_attribute("data-article-access") == "paid", F.lit(False)) | F.coalesce(F.arrays_overlap(classes, F.array(*[F.lit(x) for x in PAID_CLASSES])), F.lit(False))
    )
    names = {"m_title": "og:title", "m_author": "author", "m_published": "article:published_time", "m_modified": "article:modified_time", "m_source": "citation_source", "og_type": "og:type"}
    h = e.groupBy("_row").agg(*[meta(k).alias(n) for n, k in names.items()], F.min_by(_attribute("href"), F.when(rel, F.col("i"))).alias("canonical"), F.bool_or(paid).alias("marked_paid"))
    h = h.join(_article_objects(scripts), "_row", "left")
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", F.try_variant_get("v", path, "string"))
    one = lambda path, other: F.coalesce(F.nullif(text(path), F.lit("")), F.col(other))
    free = F.coalesce(F.lower(F.try_variant_get("v", "$.isAccessibleForFree", "string")) == "false", F.lit(False))
    return h.select(
        "_row", free.alias("paywalled"), "marked_paid", "og_type", "canonical", one("$.headline", "m_title").alias("title"), one("$.author.name", "m_author").alias("author"),
        one("$.datePublished", "m_published").alias("published"), one("$.dateModified", "m_modified").alias("modified"), text("$.articleBody").alias("body"), one("$.isBasedOn", "m_source").alias("original_source"),
    )


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 where valid, else ISO 8859-1; null over MOST_BYTES."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    return F.when(F.octet_length(content) <= MOST_BYTES, F.coalesce(utf8, F.decode(content, "ISO-8859-1")))


def fetched(answers: DataFrame, attempts: int = 2) -> DataFrame:
    """(url, final_url, text, problem) of stored answers (url, final_url, statuses, content), the first problem that holds.

    The address must be allowed before the request and again after redirects; a timeout or
    server error is tried again, ``attempts`` times in all; bodies over MOST_BYTES are no text.
    """
    tried = F.slice("statuses", F.lit(1), F.lit(attempts))
    final = F.filter(tried, lambda s: ~((s == 408) | (s >= 500)))
    status = F.coalesce(F.try_element_at(final, F.lit(1)), F.try_element_at(tried, F.lit(-1)))
    text = decoded(F.col("content"))
    problem = (
        F.when(~allowed(F.col("url")), "disallowedURL").when(status.isNull() | (status == 408) | (status >= 500), "unreachable").when(~status.between(200, 299), F.concat(F.lit("status:"), status.cast("string")))
        .when(~allowed(F.col("final_url")), "disallowedRedirect").when(text.isNull(), "tooLarge")
    )
    return answers.select("url", "final_url", F.when(problem.isNull(), text).alias("text"), problem.alias("problem"))


def parsed_date(text: Column) -> Column:
    """ISO 8601 with zone, with or without fractions, or a date at midnight UTC; null otherwise. For a session in UTC."""
    iso = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"
    return F.when(text.rlike(iso), text.try_cast("timestamp")).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def articles(pages: DataFrame, url: str = "url", html: str = "html", snippet: str | None = None) -> DataFrame:
    """``pages`` without html, with text, provenance, is_partial, canonical_url, title, author, published_at, modified_at,
    original_source and discard_reason.

    JSON-LD text stands in for a short visible text of a free page. A text below LEAST_TEXT is
    discarded as paywall or unusable; a snippet of that length then stands in, partial.
    """
    rest = [c for c in pages.columns if c != html]
    read = scanned(pages, html)
    h = heads(read)
    h = h.select("_row", F.struct(*[c for c in h.columns if c != "_row"]).alias("_h"))
    v = main_text(read).select("_row", F.col("text").alias("_v"))
    p = read.drop("_events").join(h, "_row", "left").join(v, "_row", "left").withColumn("_v", F.coalesce("_v", F.lit("")))
    none = F.coalesce(F.col("_h.paywalled"), F.lit(False))
    h = F.col("_h")
    hidden = ~none & (F.length("_v") < LEAST_TEXT) & (F.length(h.body) >= LEAST_TEXT)
    p = p.withColumn("_s", F.coalesce(hidden, F.lit(False)))
    lines = F.array_join(F.filter(F.transform(F.split(h.body, r"[\n\r]+"), collapse), lambda x: x != ""), "\n")
    partial = none | F.coalesce(h.og_type == "website", F.lit(False)) | F.coalesce(h.marked_paid, F.lit(False))
    p = p.withColumn("_t", F.when(F.col("_s"), lines).otherwise(F.col("_v"))).withColumn("_partial", partial)
    ok = F.length("_t") >= LEAST_TEXT
    other = F.col(snippet) if snippet else F.lit(None).cast("string")
    stand = F.coalesce(F.length(other) >= LEAST_TEXT, F.lit(False))
    canonical = h.canonical
    absolute = F.when(canonical.rlike("^https?://"), canonical).when(canonical.startswith("/"), F.concat(part(F.col(url), "PROTOCOL"), F.lit("://"), part(F.col(url), "AUTHORITY"), canonical))
    return p.select(
        *rest, F.when(ok, F.col("_t")).when(stand, other).alias("text"),
        F.when(ok & F.col("_s"), "structuredData").when(ok, "articleBody").when(stand, "searchSnippet").alias("provenance"),
        F.when(ok, F.col("_partial")).when(stand, True).alias("is_partial"),
        F.when(allowed(absolute), absolute).alias("canonical_url"), h.title.alias("page_title"), h.author.alias("author"),
        parsed_date(h.published).alias("published_at"), parsed_date(h.modified).alias("modified_at"), h.original_source.alias("original_source"),
        F.when(~secure(F.col(url)), "disallowedURL").when(~ok & F.col("_partial"), "paywall").when(~ok, "unusable").alias("discard_reason"),
    )


def links(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", n: int = 3) -> DataFrame:
    """(page_id, position, link): the first ``n`` distinct links of a page that look like articles of its own family."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']+)["']"""), F.lit(1))
    each = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("u"), F.posexplode(F.transform(hrefs, lambda h: F.btrim(h))).alias("i", "h"))
    each = each.where((F.col("h") != "") & ~F.col("h").rlike(NO_ARTICLE))
    root = F.concat(part(F.col("u"), "PROTOCOL"), F.lit("://"), part(F.col("u"), "AUTHORITY"))
    folder = F.regexp_replace(F.coalesce(part(F.col("u"), "PATH"), F.lit("/")), "[^/]*$", "")
    full = F.when(F.col("h").rlike("^https?://"), F.col("h")).when(F.col("h").startswith("//"), F.concat(part(F.col("u"), "PROTOCOL"), F.lit(":"), F.col("h"))).when(F.col("h").startswith("/"), F.concat(root, F.col("h"))).when(~F.col("h").rlike("^[a-zA-Z]+:"), F.concat(root, folder, F.col("h")))
    each = each.withColumn("link", full).where(F.col("link").isNotNull() & same_family(host(F.col("link")), host(F.col("u"))))
    path = F.coalesce(part(F.col("link"), "PATH"), F.lit(""))
    each = each.where((F.length(F.btrim(path, F.lit("/"))) >= 8) & path.rlike(ARTICLE_HINT))
    first = each.groupBy("page_id", "link").agg(F.min("i").alias("i"))
    w = Window.partitionBy("page_id").orderBy("i")
    return first.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n).select("page_id", "position", "link")
