"""Gold records: validation, leaks between splits, components that must stay together, packing to targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clarion.functions.urls import canonical_offline
from clarion.operators.graph import connected_components
from clarion.operators.ranks import ranked
from clarion.operators.verdicts import VERDICTS

TARGETS = {"train": 600, "calibration": 300, "test": 300}


def record_errors(records: DataFrame, require_reviewed: bool = False) -> DataFrame:
    """(id, error): the first rule that each record breaks, null where none; repeated ids are an error of each.

    records: id, claim, event_id, family_id, reference_date, review_status, reviewers, verdict,
    split, evidence (id, url, text), sufficient_evidence_sets, pairs (premise, hypothesis, label).
    """
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit("")) == ""
    counts = records.groupBy("id").agg(F.count("*").alias("_same"))
    rows = records.join(counts, "id", "left")
    reviewed = F.coalesce(c("review_status") == "reviewed", F.lit(False))
    ids = F.transform("evidence", lambda e: e["id"])
    sets = c("sufficient_evidence_sets")
    bad_sets = (F.coalesce(F.size(sets), F.lit(0)) <= 0) | F.exists(sets, lambda s: (F.size(s) == 0) | (F.size(F.array_except(s, ids)) > 0))
    bad_evidence = F.exists("evidence", lambda e: ~F.coalesce(e["url"].startswith("https://"), F.lit(False)) | (F.coalesce(e["text"], F.lit("")) == ""))
    pair = lambda p: ~F.coalesce(p["label"].isin("entailment", "neutral", "contradiction"), F.lit(False)) | (F.coalesce(p["premise"], F.lit("")) == "") | (F.coalesce(p["hypothesis"], F.lit("")) == "")
    yes = lambda x: F.coalesce(x, F.lit(False))
    rules = [
        (blank("id") | (c("_same") > 1), "id"), (blank("claim") | blank("event_id") | blank("family_id"), "grouping"),
        (F.lit(require_reviewed) & ~reviewed, "pending"),
        (reviewed & (~yes(c("verdict").isin(*VERDICTS)) | blank("reference_date")), "verdict"),
        (reviewed & c("reference_date").try_cast("timestamp").isNull(), "date"),
        (reviewed & (F.coalesce(F.size(F.array_distinct("reviewers")), F.lit(0)) < 2), "review"),
        (reviewed & c("verdict").isin("CONFIRMADO", "CONTRADITO", "DIVERGENTE") & yes(bad_sets), "sufficiency"),
        (reviewed & yes(bad_evidence), "evidence"), (reviewed & yes(F.exists("pairs", pair)), "pair"),
        (~blank("split") & ~yes(c("split").isin(*TARGETS, "regression")), "split"),
    ]
    error = F.coalesce(*[F.when(bad, said) for bad, said in rules])
    return rows.select("id", error.alias("error"))


def group_keys(records: DataFrame) -> DataFrame:
    """(id, split, key): the event, family and canonical URLs of each record."""
    urls = F.transform(F.concat(F.coalesce(F.transform("evidence", lambda e: e["url"]), F.array().cast("array<string>")), F.array("source_url")), canonical_offline)
    keys = F.concat(F.array(F.concat(F.lit("event:"), "event_id"), F.concat(F.lit("family:"), "family_id")), F.transform(F.filter(urls, lambda u: u.isNotNull()), lambda u: F.concat(F.lit("url:"), u)))
    return records.select("id", "split", F.explode(F.array_distinct(keys)).alias("key")).where("key is not null")


def leaks(keys: DataFrame) -> DataFrame:
    """(key, splits, records) of keys that occur under several splits: an aggregation, no self-join."""
    agg = keys.where("split is not null").groupBy("key").agg(F.array_sort(F.collect_set("split")).alias("splits"), F.count_distinct("id").alias("records"))
    return agg.where(F.size("splits") > 1)


def components(keys: DataFrame, id_: str = "id", key: str = "key") -> DataFrame:
    """(id, component): records that share keys, directly or through others; component is the least id.

    Each record is linked to the least record of each of its keys, never to all of them.
    """
    low = keys.groupBy(key).agg(F.min(id_).alias("_low"))
    edges = keys.join(low, key).select(F.col(id_).alias("src"), F.col("_low").alias("dst"))
    linked = connected_components(edges)
    ids = keys.select(F.col(id_).alias("id")).distinct()
    return ids.join(linked, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def packed(components: DataFrame, targets: dict[str, int] | None = None) -> DataFrame:
    """(id, component, split): whole components dealt to splits, largest first, to the one with most relative room.

    Only the histogram of component sizes comes to the driver. Components of equal size are
    alike to the packing, so each size's share of every split is found there, and components
    take their split by rank. Raises ValueError where the sizes allow no exact packing.
    """
    targets = targets or TARGETS
    spark = components.sparkSession
    sizes = components.groupBy("component").agg(F.count("*").alias("size"))
    histogram = sizes.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    if sum(r["size"] * r["n"] for r in histogram) != sum(targets.values()):
        raise ValueError(f"packing needs exactly {sum(targets.values())} records")
    left, ranges = dict(targets), []
    for r in histogram:
        dealt = dict.fromkeys(targets, 0)
        for _ in range(r["n"]):
            room = [s for s in targets if left[s] >= r["size"]]
            if not room:
                raise ValueError("component sizes prevent an exact packing")
            s = max(room, key=lambda s: left[s] / targets[s])
            left[s] -= r["size"]
            dealt[s] += 1
        first = 0
        for s, n in dealt.items():
            if n:
                ranges.append((r["size"], first, first + n, s))
                first += n
    plan = spark.createDataFrame(ranges, "size bigint, first bigint, last bigint, split string")
    dealt = ranked(sizes, ["size"], [F.xxhash64("component").asc(), F.asc("component")])
    chosen = dealt.join(F.broadcast(plan), "size").where("rank >= first and rank < last").select("component", "split")
    return components.join(chosen, "component").select("id", "component", "split")


def split_counts(records: DataFrame) -> DataFrame:
    """(split, n, digest): records per split, and a digest of each that no order changes."""
    digest = F.sum(F.xxhash64(F.to_json(F.struct(*sorted(records.columns)))).cast("decimal(38,0)"))
    return records.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count("*").alias("n"), F.sha2(digest.cast("string"), 256).alias("digest"))


def fingerprints(records: DataFrame, digits: int = 3) -> DataFrame:
    """(split, n, digest): SHA-256 of each split's records as JSON with sorted keys, in one fixed order.

    Records are hashed one by one, those whose ids' MD5 begins with the same ``digits`` are hashed
    together in the order of their ids, and then the groups in their order. So a digest depends
    on every byte and on nothing else, and a task holds the digests of one group in 16 ** digits.
    """
    own = records.select(F.coalesce("split", F.lit("unassigned")).alias("split"), F.col("id"), F.sha2(F.to_json(F.struct(*sorted(records.columns))), 256).alias("h"))
    groups = own.groupBy("split", F.substring(F.md5("id"), 1, digits).alias("b")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "h"))).alias("all"))
    groups = groups.select("split", "b", "n", F.sha2(F.array_join(F.transform("all", lambda x: x["h"]), ""), 256).alias("h"))
    each = groups.groupBy("split").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("b", "h"))).alias("all"))
    return each.select("split", "n", F.sha2(F.array_join(F.transform("all", lambda x: x["h"]), ""), 256).alias("digest"))
