"""Republished texts: exact and near duplicates under guards, and the leader pass of one claim's articles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.lineage import remove, stored
from clarion.functions.text import jaccard, let, names, protected, shingles, terms
from clarion.operators.graph import connected_components

LEAST = 0.85
#: Texts and shingles of a piece, comparisons of classes that go without blocks, and columns of a product at once.
ROWS, MASS, FEW, COLUMNS = 1024, 1 << 19, 16, 4096
#: Texts of a guard that are compared each with each, without a look at how rare their shingles are.
TEXTS = 8
#: Articles of one claim that are ever read.
ARTICLES = 8


def guards(text: Column, words: Column) -> Column:
    """Digest of what must be equal in near duplicates: qualifiers, numbers with neighbours, and names."""
    return F.sha2(F.to_json(F.struct(protected(words).alias("p"), names(text).alias("n"))), 256)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(membership, linkable texts): texts of equal term sequences are one, named after its least id.

    membership: (doc_id, representative). linkable: (representative, guard, texts, shingles) of the texts
    whose guard another one has too, ``texts`` in all, the shingles as 64-bit hashes. Ids and digests are written once; only
    texts that can link are read again, folded once and cut into shingles.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    digest = lambda words: F.unhex(F.sha2(F.array_join(words, " "), 256))
    worded = own.withColumn("words", terms(F.col("text")))
    named = stored(worded.select("doc_id", digest(F.col("words")).alias("same"), F.unhex(guards(F.col("text"), F.col("words"))).alias("guard")), paths)
    first = named.groupBy("same").agg(F.min("doc_id").alias("representative"))
    membership = named.select("doc_id", "same").join(first, "same").select("doc_id", "representative")
    # An id that repeats with different texts stands for one of them, always the same.
    kept = named.join(first, (named.same == first.same) & (named.doc_id == first.representative), "left_semi").groupBy("doc_id").agg(F.min(F.struct("same", "guard")).alias("r")).select("doc_id", "r.*")
    shared = kept.groupBy("guard").agg(F.count("*").alias("texts")).where("texts > 1")
    live = kept.join(shared, "guard").select(F.col("doc_id").alias("representative"), F.col("same").alias("same_"), "guard", "texts")
    hashed = lambda words: F.array_distinct(F.transform(shingles(words), lambda s: F.xxhash64(s)))
    # A filter by the digest would be pushed below the words and fold every text again, so what is cut says whether it is the text.
    made = let(terms(F.col("text")), lambda w: F.struct((digest(w) == F.col("same_")).alias("own"), hashed(w).alias("shingles")))
    found = own.join(live, own.doc_id == live.representative).select("representative", "guard", "texts", made.alias("made"))
    cut = found.groupBy("representative").agg(F.max_by(F.struct("guard", "texts", "made.shingles"), "made.own").alias("r"))
    return membership, cut.select("representative", "r.*")


def prefixes(distinct: DataFrame, least: float) -> DataFrame:
    """(representative, guard, n, common, prefix): of n shingles those that another text of the guard has, rarest first, and of the rarest n - ceil(least * n) + 1 those among them.

    A shingle is a hash of it and the guard here. Hashes that fall together only let more texts meet.
    """
    each = distinct.select("representative", "guard", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).withColumn("s", F.xxhash64("guard", "s"))
    seen = each.groupBy("s").agg(F.count("*").alias("f"))
    # An element that one text alone has joins nothing. The files of like texts are small, their rows are not: none are broadcast.
    ordered = each.join(seen.where("f > 1").hint("merge"), "s")
    ordered = ordered.groupBy("representative", "guard", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("common"))
    single = F.col("n") - F.size("common")  # they come first in the order
    room = F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9).cast("int") + 1 - single
    ordered = ordered.withColumn("room", room).where("room > 0").withColumn("common", F.col("common.s"))
    return ordered.select("representative", "guard", "n", "common", F.slice("common", F.lit(1), F.greatest("room", F.lit(0))).alias("prefix"))


def _close(n: str, m: str, least: float) -> Column:
    """Whether sets of so many elements can reach ``least``."""
    return (F.col(n) >= F.col(m) * F.lit(least) - 1e-9) & (F.col(m) >= F.col(n) * F.lit(least) - 1e-9)


def _few(distinct: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the guards with at most TEXTS texts: all their pairs of like sizes."""
    sets = distinct.where(F.col("texts") <= TEXTS).withColumn("n", F.size("shingles"))
    x, y = (sets.select("guard", F.col("representative").alias(k), F.col("n").alias(f"n_{k}"), F.col("shingles").alias(f"shingles_{k}")) for k in "ab")
    pairs = x.join(y, "guard").where((F.col("a") < F.col("b")) & _close("n_a", "n_b", least))
    similarity = let(F.size(F.array_intersect("shingles_a", "shingles_b")), lambda both: F.try_divide(both, F.col("n_a") + F.col("n_b") - both))
    return pairs.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= least)


def near_pairs(distinct: DataFrame, least: float = LEAST) -> DataFrame:
    """(a, b, similarity) with a < b of distinct texts with equal guards and a Jaccard of ``least`` or more.

    Guards block the join, and texts whose guard no other has were never cut. The texts of a guard that few have are compared
    each with each. Else sets of n elements at ``least`` must share one of
    their first n - ceil(least * n) + 1 elements in any common order; rarest first, so that
    phrases that many texts share join nothing. Candidates are then verified on their whole
    sets. ``distinct`` is written once, as it is read often.
    """
    distinct = stored(distinct)
    many = distinct.where(F.col("texts") > TEXTS)
    prefix = prefixes(many, least).select("representative", "guard", "n", F.explode("prefix").alias("s"))
    a, b = prefix.alias("a"), prefix.alias("b")
    on = (F.col("a.guard") == F.col("b.guard")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.representative") < F.col("b.representative")) & _close("a.n", "b.n", least)
    pairs = a.join(b, on).select(F.col("a.representative").alias("a"), F.col("b.representative").alias("b")).distinct()
    sets = many.select("representative", "shingles")
    pairs = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", jaccard(F.col("x"), F.col("y")).alias("similarity"))
    return pairs.where(F.col("similarity") >= least).unionByName(_few(distinct, least)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): every link between different texts, and which texts each id stands for."""
    membership, distinct = representatives(docs, doc_id, text)
    return membership, near_pairs(distinct, least)


def _met(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Of one block: the links across it of each kind's texts and the least kind of its component in it. Intersections are counted by products of 0/1 matrices."""
    rows = rows.sort_values("representative", ignore_index=True)
    n, weight = rows["n"].to_numpy(), rows["weight"].to_numpy()
    left, right = (np.flatnonzero(rows["side"].isin(sides).to_numpy()) for sides in (("left", "both"), ("right", "both")))
    at = np.repeat(np.arange(len(rows)), rows["common"].map(len).to_numpy())
    ids, column, seen = np.unique(np.concatenate(rows["common"].to_list()), return_inverse=True, return_counts=True)
    kept = seen[column] > 1
    column = (np.cumsum(seen > 1) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    at, column = at[kept][order], column[order]
    shared = np.zeros((len(left), len(right)))
    for low in range(0, int((seen > 1).sum()), COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(rows), COLUMNS), np.float32)
        has[at[a:b], column[a:b] - low] = 1
        shared += has[left] @ has[right].T
    with np.errstate(invalid="ignore"):
        near = shared / (n[left][:, None] + n[right][None, :] - shared) >= least
    near &= left[:, None] != right[None, :]
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, left, near @ weight[right])
    if len(left) + len(right) == len(rows):  # two pieces: each link was seen from the left only
        np.add.at(links, right, weight[left] @ near)
    root = np.arange(len(rows))
    while True:
        over, under = (np.where(m, root[i], len(rows)).min(1, initial=len(rows)) for m, i in ((near, right[None, :]), (near.T, left[None, :])))
        new = root.copy()
        np.minimum.at(new, left, over)
        np.minimum.at(new, right, under)
        if (new == root).all():
            break
        root = new
    out = pd.DataFrame({"representative": rows["representative"], "links": links, "parent": rows["representative"].to_numpy()[root]})
    return out[links > 0]


def families(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, representative, family, links), a row for each document: the texts it equals, the least id that links reach, and to how many different texts it links.

    The links are those of ``near_pairs``; only those between small classes are written one by one. A shingle that one text
    of a guard alone has is in no intersection. So texts of one guard with as many shingles and the same ones in common with others
    are a kind: they link to the same texts, and one of them is compared for all, with their number as its weight. Kinds whose prefixes hold the
    same shingles are a class, and classes meet where their prefixes share one, once, so a kind
    goes to each class it may link to instead of to each of its shingles. Small classes are compared
    pair by pair. Larger ones meet in blocks of two pieces, bounded in kinds and in shingles, each a
    task's group that gives counts and a forest. Counts combine before the shuffle.
    Null texts are empty ones; texts without words are one representative without links. Rows that repeat an
    id stay rows of their own; where their texts differ and the id is least of both, it stands for the one with
    the least digest. Rows without an id give none, other columns don't count, and empty tables give no rows.
    """
    spark, paths, done = docs.sparkSession, [], []
    membership, distinct = representatives(docs.where(F.col(doc_id).isNotNull()), doc_id, text, paths)
    membership, distinct = stored(membership), stored(distinct, paths)
    digest = lambda n, part: F.sha2(F.concat_ws(",", F.hex("guard"), n, F.col(part).cast("string")), 256)
    texts = stored(prefixes(distinct.where(F.col("texts") > TEXTS), least).withColumn("kind", F.unhex(digest(F.col("n").cast("string"), "common"))), paths)
    kinds = stored(texts.groupBy("kind").agg(F.min("representative").alias("owner"), F.count("*").alias("weight")), paths)
    firsts = texts.join(kinds.select(F.col("owner").alias("representative"), "weight"), "representative")
    own = stored(firsts.select(digest(F.lit(""), "prefix").alias("class"), "representative", "guard", "n", "weight", "prefix", "common"), paths)
    classes = own.groupBy("class").agg(F.first("guard").alias("guard"), F.first("prefix").alias("prefix"), F.count("*").alias("rows"), F.sum(F.size("common")).alias("mass"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    pieces = F.ceil(F.greatest(F.col("rows") / ROWS, F.col("mass") / MASS)).cast("int")
    classes = stored(classes.withColumn("pieces", pieces), paths)
    keys = classes.withColumn("s", F.explode("prefix")).drop("prefix", "mass")
    a, b = keys.alias("a"), keys.alias("b")
    sizes = (F.col("a.hi") >= F.col("b.lo") * F.lit(least) - 1e-9) & (F.col("b.hi") >= F.col("a.lo") * F.lit(least) - 1e-9)
    across = a.join(b, (F.col("a.guard") == F.col("b.guard")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.class") < F.col("b.class")) & sizes)
    across = across.select(*[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in ("class", "rows", "pieces")]).distinct()
    within = classes.where("rows > 1").select(*[F.col(c).alias(f"{x}_{c}") for x in "ab" for c in ("class", "rows", "pieces")])
    met = stored(across.unionByName(within), paths)
    number = F.pmod(F.xxhash64("representative"), F.col("pieces").cast("bigint")).cast("int")
    members = stored(own.join(classes.select("class", "pieces"), "class").select("class", number.alias("piece"), "representative", "n", "weight", "common"), paths)
    few = F.col("a_rows") * F.col("b_rows") <= FEW

    # Few: pairs are made and judged where the classes' rows meet.
    x, y = (members.select(*[F.col(c).alias(f"{k}_{c}") for c in ("class", "representative", "n", "weight", "common")]) for k in "ab")
    pairs = met.where(few).select("a_class", "b_class").join(x, "a_class").join(y, "b_class")
    pairs = pairs.where((F.col("a_class") != F.col("b_class")) | (F.col("a_representative") < F.col("b_representative")))
    both = F.size(F.array_intersect("a_common", "b_common"))
    pairs = pairs.where(let(both, lambda both: F.try_divide(both, F.col("a_n") + F.col("b_n") - both)) >= least).select("a_representative", "a_weight", "b_representative", "b_weight")
    one = F.lit(1).cast("bigint")
    pairs = pairs.unionByName(_few(distinct, least).select(F.col("a").alias("a_representative"), one.alias("a_weight"), F.col("b").alias("b_representative"), one.alias("b_weight")))
    end = lambda x, y: F.struct(F.col(f"{x}_representative").alias("representative"), F.col(f"{y}_weight").alias("links"), F.col(f"{y}_representative").alias("parent"))
    small = pairs.select(F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("x.*")

    # Many: a block for each two pieces of the classes.
    block = ["a_class", "a_piece", "b_class", "b_piece"]
    blocks = met.where(~few).select("a_class", "b_class", "b_pieces", F.explode(F.sequence(F.lit(0), F.col("a_pieces") - 1)).alias("a_piece"))
    blocks = blocks.select("a_class", "b_class", "a_piece", F.explode(F.sequence(F.lit(0), F.col("b_pieces") - 1)).alias("b_piece"))
    blocks = blocks.where("a_class != b_class or a_piece <= b_piece")
    same = (F.col("a_class") == F.col("b_class")) & (F.col("a_piece") == F.col("b_piece"))
    sides = blocks.select(*block, F.col("a_class").alias("class"), F.col("a_piece").alias("piece"), F.when(same, "both").otherwise("left").alias("side"))
    sides = sides.unionByName(blocks.where(~same).select(*block, F.col("b_class").alias("class"), F.col("b_piece").alias("piece"), F.lit("right").alias("side")))
    rows = sides.join(members, ["class", "piece"]).drop("class", "piece")
    kind = f"representative {distinct.schema['representative'].dataType.simpleString()}, links bigint, parent {distinct.schema['representative'].dataType.simpleString()}"
    large = rows.groupBy(*block).applyInPandas(lambda g: _met(g, least), kind)

    # Texts of a kind link to each other too, if what they have in common is enough.
    inner = F.size("common") / (2 * F.col("n") - F.size("common")) >= least
    alike = own.where("weight > 1").select(F.col("representative").alias("owner"), F.when(inner, F.col("weight") - 1).otherwise(0).alias("inner"))
    alike = texts.select("representative", "kind").join(kinds.select("kind", "owner"), "kind").join(alike, "owner").select("representative", "owner", "inner")
    alike = stored(alike)
    found = stored(small.unionByName(large), done)
    links = stored(found.groupBy("representative").agg(F.sum("links").alias("links"))).withColumnRenamed("representative", "owner")
    component = connected_components(found, "representative", "parent").withColumnsRenamed({"id": "owner", "component": "family"})
    for path in [*paths, *done]:
        remove(spark, path)
    out = membership.join(alike, "representative", "left").withColumn("owner", F.coalesce("owner", "representative"))
    out = out.join(component, "owner", "left").join(links, "owner", "left")
    family = F.coalesce("family", F.when(F.col("inner") > 0, F.col("owner")), "representative")
    total = F.coalesce("links", F.lit(0)) + F.coalesce("inner", F.lit(0))
    return out.select("doc_id", "representative", family.alias("family"), total.cast("bigint").alias("links"))


def leaders(articles: DataFrame, claim_id: str = "claim_id", rank: str = "rank", url: str = "url", text: str = "text", partial: str = "is_partial", limit: int = ARTICLES, usable: str | DataFrame | None = None, paths: list[str] | None = None) -> DataFrame:
    """(claim_id, rank, url, leader_url): whose evidence each article reuses; null for leaders.

    Articles are visited complete ones first, then by rank; one that has a leader's canonical
    URL or is a near duplicate of it follows the first such leader. It is a greedy pass, no
    transitive closure, over at most ``limit`` articles a claim, folded within one array.
    Where ``usable`` is given, a column or a table (claim_id, rank) of those that are, an article without it leads no other. Digests go through the
    shuffle; only texts whose guard another text of their claim has are read again and cut
    into shingles, which are kept as 64-bit hashes.
    """
    from clarion.functions.urls import canonical_online

    digest = lambda words: F.unhex(F.sha2(F.array_join(words, " "), 256))
    named = [F.col(claim_id).alias("claim_id"), F.col(rank).alias("rank"), F.col(url).alias("url")]
    made = let(terms(F.col(text)), lambda w: F.struct(digest(w).alias("same"), F.unhex(guards(F.col(text), w)).alias("guard")))
    own = articles.select(*named, F.col(partial).alias("partial"), canonical_online(F.col(url)).alias("canonical"), made.alias("_made"), (F.col(usable) if isinstance(usable, str) else F.lit(True)).alias("usable"))
    own = own.select("claim_id", "rank", "url", "partial", "canonical", "_made.same", "_made.guard", "usable")
    if isinstance(usable, DataFrame):
        own = own.drop("usable").join(usable.select("claim_id", "rank").distinct().withColumn("usable", F.lit(True)), ["claim_id", "rank"], "left").na.fill(False, ["usable"])
    own = own.withColumn("_n", F.row_number().over(Window.partitionBy("claim_id").orderBy("rank", "url"))).where(F.col("_n") <= limit)
    peers = Window.partitionBy("claim_id", "guard")
    own = stored(own.withColumn("_contested", F.min("same").over(peers) != F.max("same").over(peers)), paths)
    asked = own.where("_contested").select("claim_id", "rank", "url", "same")
    # A filter by the digest would become a key of the join and fold every text, so what is cut says whether it is the text.
    hashed = lambda words: F.array_distinct(F.transform(shingles(words), lambda x: F.xxhash64(x)))
    made = let(terms(F.col("_text")), lambda w: F.when(digest(w) == F.col("same"), hashed(w)))
    cut = articles.select(*named, F.col(text).alias("_text")).join(asked, ["claim_id", "rank", "url"]).select("claim_id", "rank", "url", "same", made.alias("shingles"))
    cut = cut.groupBy("claim_id", "rank", "url", "same").agg(F.max("shingles").alias("shingles"))
    own = own.join(cut, ["claim_id", "rank", "url", "same"], "left")
    fields = ["partial", "rank", "url", "canonical", "same", "guard", "shingles", "usable"]
    lists = own.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("all"))
    kind = "array<struct<rank:{r},url:string,leader:string,canonical:string,same:binary,guard:binary,shingles:array<bigint>,usable:boolean>>".format(r=own.schema["rank"].dataType.simpleString())

    def follows(x: Column, y: Column) -> Column:
        near = (x["guard"] == y["guard"]) & (F.coalesce(jaccard(x["shingles"], y["shingles"]), F.lit(0.0)) >= LEAST)
        return y["leader"].isNull() & y["usable"] & ((x["canonical"] == y["canonical"]) | (x["same"] == y["same"]) | near)

    def step(acc: Column, x: Column) -> Column:
        leader = F.try_element_at(F.filter(acc, lambda y: follows(x, y)), F.lit(1))["url"]
        item = F.struct(x["rank"], x["url"], leader.alias("leader"), x["canonical"], x["same"], x["guard"], x["shingles"], x["usable"])
        return F.concat(acc, F.array(item).cast(kind))

    folded = lists.select("claim_id", F.explode(F.aggregate("all", F.array().cast(kind), step)).alias("x"))
    return folded.select("claim_id", "x.rank", "x.url", F.col("x.leader").alias("leader_url"))
