"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns. Their values' hashes are counted over the whole corpus
by distinct repositories and owners: a value of more than ``MAX_OWNERS`` owners or more than
``MAX_REPOSITORIES`` repositories is a copied example, any other that looks random is
taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.lineage import free_name, stored

# The patterns of the base kinds, the least lengths of what they must find, in the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs of 24 or more: a shorter run fails as a whole, so nothing else can match within it
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
#: Added kind: a long run of token characters outside the base spans that looks random.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "live", "token")
#: A value with more owners than this is a copied example.
MAX_OWNERS = 2
#: So is one in more repositories than this, whoever owns them.
MAX_REPOSITORIES = 10
#: A value that looks random: letters and digits, eight characters or more.
LIVE = r"^(?=.*[0-9].*[0-9])(?=.*[A-Za-z]).{8,}$"
LIVE_SQL = "regexp_matches({v}, '[0-9].*[0-9]') and regexp_matches({v}, '[A-Za-z]') and length({v}) >= 8"

#: Rows of spans that are broadcast to their texts, at most; more meet them in a shuffle.
BROADCAST_ROWS = 500_000


def _found(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches in order: kind, ordinal, gap before the match, its length, its value.

    The pieces between matches and the matches alternate, so their lengths add up to the places.
    """
    zipped = F.zip_with(
        F.transform(F.split(text, pattern, -1), F.length), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"))
    )
    value = lambda m: F.regexp_extract(m, pattern, value_group) if value_group else m
    each = F.transform(
        F.filter(zipped, lambda x: x.m.isNotNull()),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("ordinal"), x.gap.alias("gap"), F.length(x.m).alias("n"), value(x.m).alias("value")),
    )
    return F.when(text.rlike(pattern), each).otherwise(F.array().cast("array<struct<kind:int,ordinal:int,gap:int,n:int,value:string>>"))


def candidates(rows: DataFrame) -> DataFrame:
    """A row per candidate of ``rows`` (row, owner, repository, found): kind, start, end, vstart, hash, random, inside.

    Places are sums over what comes before in the text, and ``inside`` (the candidate overlaps
    a base one) compares it with the furthest end before and the nearest start after it; so a
    text with many matches takes time in proportion to them, but for the sorts.
    """
    each = rows.select("row", "owner", "repository", F.explode("found").alias("c")).select("row", "owner", "repository", "c.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("row", "kind").orderBy("ordinal")).cast("int")
    each = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).withColumn("vstart", F.col("end") - F.col("size"))
    each = each.where(((F.col("kind") != 0) | (F.col("size") >= ASSIGN_VALUE)) & ((F.col("kind") != 1) | (F.col("size") >= ACCESS_LENGTH)))
    order = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < 4
    reached = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # Base spans that begin later are met in reverse order: the least start of those is the last one seen there.
    ahead = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1))
    inside = F.coalesce(reached > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    return each.withColumn("inside", inside).select("row", "owner", "repository", "kind", "start", "end", "vstart", "hash", "random", "inside")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(row, doc_id, base, added) per row of ``docs``: arrays of (start, kind, end), kinds as places in ``KINDS``.

    base: assign, access and hex spans. added: the value of each base candidate that is
    owner-specific and looks random (live), and such runs outside base spans (token).
    A value is owner-specific with at most ``max_owners`` owners and ``max_repositories`` repositories.
    A null owner or repository counts as one more owner or repository; null and empty texts
    have no spans. Repeated rows each get a result; they add to no count, being of one
    repository. Columns of any name may come along; no rows give no result.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(_found(t, ASSIGN, 0, 2), _found(t, ACCESS, 1), _found(t, HEX, 2), _found(t, TOKEN, 4))
    one = F.transform(found, lambda x: F.struct(x.kind, x.ordinal, x.gap, x.n, F.length(x.value).alias("size"), F.sha2(x.value, 256).alias("hash"), x.value.rlike(LIVE).alias("random")))
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"), one.alias("found"),
    ))
    every = stored(candidates(rows))
    live = every.where(F.col("random") & ((F.col("kind") < 4) | ~F.col("inside")))
    # Owners and repositories are counted apart, as either may have several of the other; each value's own are made distinct before they are counted.
    sides = F.explode(F.array(F.struct(F.lit("owner").alias("side"), F.col("owner").alias("name")), F.struct(F.lit("repository").alias("side"), F.col("repository").alias("name"))))
    counts = (
        live.select("hash", sides.alias("by")).groupBy("hash", "by").agg(F.lit(1).alias("x"))
        .groupBy("hash").agg(F.count_if(F.col("by.side") == "owner").alias("owners"), F.count_if(F.col("by.side") == "repository").alias("repositories"))
    )
    rare = counts.where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).select("hash")
    kind = F.when(F.col("kind") < 4, 3).otherwise(4)
    added = live.join(rare, "hash").select("row", F.col("vstart").alias("start"), kind.alias("kind"), "end", F.lit(False).alias("base"))
    spans = every.where("kind < 4").select("row", "start", "kind", "end", F.lit(True).alias("base")).unionByName(added)
    own = F.struct("start", "kind", "end")
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("base"), own))).alias("base"), F.array_sort(F.collect_set(F.when(~F.col("base"), own))).alias("added"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.select("row", "doc_id").join(spans, "row", "left").select("row", "doc_id", F.coalesce("base", empty).alias("base"), F.coalesce("added", empty).alias("added"))


def _joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x.kind), x.start.cast("string"), x.end.cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live per row of ``docs``; as ``scan`` otherwise."""
    found = scan(docs, **options)
    n = lambda k: F.size(F.filter("base", lambda x: x.kind == k)).cast("bigint")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_live"),
    )


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with live credentials in ``text`` replaced by ``mark``; copied examples stay. Columns as they were.

    Rows meet their spans by id and text, so rows that repeat both get the same text. Only
    texts with spans are changed; their spans are counted first and broadcast where few.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    name = free_name("_id", docs.columns)
    keyed = docs.select(F.struct(F.col(doc_id).alias("id"), digest.alias("digest")).alias(name), *[c for c in docs.columns])
    spans = scan(keyed, name, text, **options).where(F.size("added") > 0).select("doc_id", "added").dropDuplicates(["doc_id"])
    spans = spans.select("doc_id", F.explode("added").alias("c")).select("doc_id", "c.start", "c.end")
    reached = F.coalesce(F.max("end").over(Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # What stays before each mark; a span that begins inside an earlier one only moves its end.
    spans = spans.withColumn("reached", reached).withColumn("gap", F.when(F.col("start") >= F.col("reached"), F.struct("reached", "start")))
    found = stored(spans.groupBy("doc_id").agg(F.array_sort(F.collect_list("gap")).alias("gaps"), F.max("end").alias("tail")))
    if (found.select(F.sum(F.size("gaps"))).first()[0] or 0) <= BROADCAST_ROWS:
        found = F.broadcast(found)
    whole = F.col(text)
    gaps = F.transform(found["gaps"], lambda g: whole.substr(g.reached + 1, g.start - g.reached))
    new = F.concat(F.array_join(gaps, mark), F.lit(mark), whole.substr(found["tail"] + 1, F.length(whole)))
    joined = keyed.join(found, keyed[name].eqNullSafe(found["doc_id"]), "left")
    return joined.select(*[F.when(found["tail"].isNull(), keyed[c]).otherwise(new).alias(c) if c == text else keyed[c] for c in docs.columns])
