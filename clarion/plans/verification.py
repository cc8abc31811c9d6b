"""The whole verification over many claims: claims, hits and articles in, verdicts and sources out.

Models are providers: ``embed`` adds a vector to a DataFrame with a text column and keeps its other columns,
``infer`` adds logits to one with premise and hypothesis. Both see distinct texts
only. Every step is keyed by claim_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from clarion.functions.lineage import remove, stored
from clarion.functions.scores import cosine, length
from clarion.functions.text import let, terms, token_estimate
from clarion.functions.urls import canonical_online, host, matched_domain, profile
from clarion.operators import chunking, claims as claim_ops, duplicates, retrieval, verdicts

Provider = Callable[[DataFrame], DataFrame]
#: Articles read and pairs inferred per claim.
READ, PAIRS = 8, 24
#: Tasks a core, or more where more partitions are set, that cut articles: the longest step by far, which files of a shuffle would deal to few tasks.
TASKS = 4


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _hashed(texts: pd.Series) -> pd.Series:
    """A stand-in for an embedding model: signed hashed counts of words, of unit length. The words of a batch are counted together."""
    words = [(t or "").lower().split() for t in texts]
    h = np.fromiter(map(zlib.crc32, map(str.encode, chain.from_iterable(words))), np.int64)
    row = np.repeat(np.arange(len(words)), np.array([len(ws) for ws in words], np.int64))
    n = np.bincount(row * 128 + h % 64 + 64 * (h >> 31), minlength=128 * len(words)).reshape(len(words), 2, 64)
    return pd.Series([v / (np.linalg.norm(v) or 1) for v in (n[:, 1] - n[:, 0]).astype(np.float32)])


def hashed_embedding(df: DataFrame) -> DataFrame:
    return df.withColumn("vector", _hashed("text"))


def embedded(df: DataFrame, embed: Provider, text: str, into: str) -> DataFrame:
    """``df`` with the vector of ``text``; equal texts are embedded once."""
    distinct = embed(df.select(F.col(text).alias("text")).distinct()).select(F.col("text").alias(text), F.col("vector").alias(into))
    return df.join(distinct, text)


def verify(claims: DataFrame, hits: DataFrame, articles: DataFrame, infer: Provider, embed: Provider = hashed_embedding, policy: dict | None = None, tokens: Callable[[Column], Column] = token_estimate, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, sources).

    claims: claim_id, text, reference_ts. hits: claim_id, ix, url, title, content, score.
    articles: url, text, provenance, is_partial, published_at, original_source.
    results: claim_id, verdict, error, sources, found, read, used, independent_origins. A claim whose hits
    could not be read at all has the error readingIncomplete and no verdict. A claim that a reviewed entry
    of ``catalog`` settles has that entry's verdict; it is neither searched nor voted on and has no sources.
    """
    policy = policy or verdicts.BASELINE
    c = claims.withColumn("context", claim_ops.context(F.col("text"), F.col("reference_ts")))
    if catalog is not None:
        matches = claim_ops.catalog_matches(c.select("claim_id", "text", "context.kind", "context.start"), catalog)
        settled = stored(matches.join(catalog.select(F.col("id").alias("entry_id"), "verdict"), "entry_id").select("claim_id", "verdict"))
        rest = lambda df: df.join(settled, "claim_id", "left_anti")
        results, sources = verify(rest(claims), rest(hits), articles, infer, embed, policy, tokens)
        none = {k: F.lit(0).cast(results.schema[k].dataType) for k in ("sources", "found", "read", "used", "independent_origins")}
        done = settled.withColumns({"error": F.lit(None).cast("string")} | none)
        return results.unionByName(done), sources
    spark, paths = claims.sparkSession, []
    known = c.select("claim_id", F.col("text").alias("claim"), "context", tokens(F.col("text")).alias("claim_tokens"))
    ranked = retrieval.ranked_articles(hits, claims.select("claim_id", "text"), paths=paths)
    ranked = stored(ranked.select("claim_id", "url", "position"), paths)
    chosen = ranked.where(F.col("position") <= READ).select("claim_id", "url", F.col("position").alias("rank"))
    asked = F.coalesce(F.array_distinct(terms(F.col("claim"))), F.array().cast("array<string>"))
    chosen = chosen.join(known.select("claim_id", "claim_tokens", asked.alias("asked")), "claim_id")
    read = stored(articles.where("text is not null").join(chosen.hint("shuffle_hash"), "url"), paths)

    # An article's passages stay one list in one row, where they are scored, ranked and grown; their texts are shuffled to be embedded once and to meet what was chosen.
    passage, article = ["claim_id", "rank", "ix"], ["claim_id", "rank"]
    dealt = read.select(*article, "text", "claim_tokens", "asked").repartition(max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *article)
    made, kept = chunking.window_lists(dealt, "text", "claim_tokens")
    digests = lambda p: F.transform(p, lambda x: F.unhex(F.sha2(x["text"], 256)))
    scores = let(kept, lambda p: F.struct(p["text"].alias("passages"), digests(p).alias("digests"), retrieval.scores_of_own(p["folded"], F.col("asked")).alias("lexical")))
    cut = made.select(*article, "claim_tokens", scores.alias("s")).select(*article, "claim_tokens", "s.*")
    cut = stored(cut.withColumn("candidate", retrieval.candidates_of_own(F.col("lexical"))), paths)
    listed = lambda *names: cut.select(*article, F.explode(F.filter(F.arrays_zip("candidate", F.transform("candidate", lambda _, i: i).alias("ix"), *names), lambda x: x["candidate"])).alias("x")).select(*article, "x.*")
    texts = listed("digests", "passages").select(F.col("digests").alias("digest"), F.col("passages").alias("text")).dropDuplicates(["digest"])
    vectors = stored(embed(texts).select("digest", "vector", length(F.col("vector")).alias("length")), paths)
    asked = embedded(known.select("claim_id", "claim"), embed, "claim", "claim_vector").select("claim_id", "claim_vector", length(F.col("claim_vector")).alias("claim_length"))
    both = listed("digests", "lexical").withColumnRenamed("digests", "digest")
    similarity = cosine(F.col("vector"), F.col("claim_vector"), F.col("length"), F.col("claim_length"))
    scored = both.join(vectors, "digest").join(asked, "claim_id").select(*passage, "lexical", F.round(similarity, 6).alias("similarity"))
    top = retrieval.fused(scored, article, small=True).where(F.col("position") <= retrieval.KEPT)
    top = stored(top.groupBy(*article).agg(F.collect_list(F.struct("position", "ix", "similarity")).alias("chosen")), paths)
    room = F.greatest(F.lit(1), 509 - F.col("claim_tokens"))
    grown = cut.select(*article, "claim_tokens", "passages").join(top.hint("shuffle_hash"), article)
    grown = grown.select(*article, F.explode(retrieval.expanded_of_own(F.col("passages"), F.col("chosen"), room, tokens)).alias("x")).select(*article, "x.*")
    grown = stored(grown, paths)

    # Republications reuse their leader's evidence; only leaders are inferred, PAIRS in all.
    led = stored(duplicates.leaders(read, usable=grown, paths=paths), paths)
    own = grown.join(led.where("leader_url is null").select("claim_id", "rank"), ["claim_id", "rank"], "left_semi")
    own = own.join(read.select("claim_id", "rank", "url", "is_partial"), ["claim_id", "rank"])
    counts = own.groupBy("claim_id", "is_partial", "rank").agg(F.count("*").alias("pairs"))
    before = F.sum("pairs").over(Window.partitionBy("claim_id").orderBy("is_partial", "rank"))
    kept = counts.withColumn("upto", before).where(F.col("upto") <= PAIRS).select("claim_id", "rank")
    asked = own.join(kept, ["claim_id", "rank"], "left_semi").join(known.select("claim_id", "claim"), "claim_id")
    asked = asked.select("claim_id", "rank", "url", "ix", F.col("position"), F.col("expanded").alias("premise"), F.col("claim").alias("hypothesis"), "similarity")
    judged = verdicts.judged(infer(asked), temperature=policy["temperature"])
    judged = stored(judged.select("claim_id", "rank", "url", "position", "label", "confidence", "similarity", F.col("premise").alias("text")), paths)
    labels = verdicts.article_labels(judged, ["claim_id", "rank", "url"], ix="position", minimum=policy["minimum"])
    evidence = judged.groupBy("claim_id", "rank").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "label", "confidence", "text"))), lambda x: F.struct(x["label"], x["confidence"])).alias("evidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("said"),
    )  # at most KEPT passages an article

    facts = read.select("claim_id", "rank", "url", "provenance", "is_partial", "published_at", "original_source")
    leaders_ = labels.join(evidence, ["claim_id", "rank"]).join(facts.drop("url"), ["claim_id", "rank"]).join(known.select("claim_id", "context"), "claim_id")
    aligned = claim_ops.alignment(F.col("context.kind"), F.col("context.start"), F.col("context.end"), F.col("published_at"), F.concat_ws(" ", "said", "excerpt"))
    domain = let(host(F.col("url")), lambda h: F.coalesce(matched_domain(h), h, F.lit("")))
    own_origin = let(host(F.col("url")), lambda h: let(F.coalesce(matched_domain(h), h, F.lit("")), lambda d: profile(F.when(d == "gov.br", h).otherwise(d)).editorial_origin))
    origin = F.coalesce(canonical_online(F.col("original_source")), own_origin)
    leaders_ = leaders_.withColumns({"temporal_alignment": aligned, "domain": domain, "origin": origin}).withColumn("duplicate_of", F.lit(None).cast("string"))
    columns = ["claim_id", "rank", "url", "domain", "label", "confidence", "similarity", "excerpt", "stance", "evidence", "provenance", "is_partial", "temporal_alignment", "origin", "duplicate_of"]
    leaders_ = leaders_.select(*columns)
    shared = leaders_.select("claim_id", F.col("url").alias("duplicate_of"), "label", "confidence", "similarity", "excerpt", "stance", "evidence", "temporal_alignment", "origin")
    copies = led.where("leader_url is not null").select("claim_id", "rank", F.col("leader_url").alias("duplicate_of")).join(facts, ["claim_id", "rank"]).join(shared, ["claim_id", "duplicate_of"]).withColumn("domain", domain)
    sources = stored(leaders_.unionByName(copies.select(*columns)))
    ready = sources.withColumn("eligible", verdicts.eligible(F.col("is_partial"), F.col("provenance"), F.col("temporal_alignment"), F.col("duplicate_of")))

    found = ranked.groupBy("claim_id").agg(F.count("*").alias("found"))
    seen = read.groupBy("claim_id").agg(F.count("*").alias("read"))
    base = claims.select("claim_id").join(found, "claim_id", "left").join(seen, "claim_id", "left").na.fill(0, ["found", "read"])
    base = stored(base)
    for path in paths:
        remove(spark, path)
    verdict = verdicts.verdicts(base, ready, policy["minimum"], policy["single"], hits="found")
    more = verdicts.diagnostics(base, ready, "found", "read", minimum=policy["minimum"], single=policy["single"])
    error = F.when((F.col("found") > 0) & (F.col("read") == 0), "readingIncomplete")
    results = verdict.join(more, "claim_id").withColumn("error", error)
    results = results.select("claim_id", F.when(F.col("error").isNull(), F.col("verdict")).alias("verdict"), "error", "sources", "found", "read", "used", "independent_origins")
    return results, sources
