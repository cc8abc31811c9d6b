"""Audits of data and runs: labelled pairs, search leaks, domains, run summaries, file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clarion.functions.scores import LABELS
from clarion.operators.ranks import at_rank


def pair_audit(pairs: DataFrame, premise: str = "sentence1", hypothesis: str = "sentence2", label: str = "gold_label", labels: tuple[str, ...] = LABELS) -> DataFrame:
    """One row: rows, a count per label, invalid labels, empty sides, distinct and repeated pairs."""
    t = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    pair = F.sha2(F.concat(t(premise), F.lit("\0"), t(hypothesis)), 256)
    # Equal pairs meet once, with their counts: no distinct aggregate over all rows.
    per = pairs.groupBy(pair.alias("_pair")).agg(
        F.count("*").alias("n"), *[F.count_if(t(label) == x).alias(x) for x in labels], F.count_if(~t(label).isin(*labels)).alias("invalid"),
        F.count_if(t(premise) == "").alias("empty_premise"), F.count_if(t(hypothesis) == "").alias("empty_hypothesis"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *[total(x) for x in labels], total("invalid"), total("empty_premise"), total("empty_hypothesis"), F.count("*").alias("unique_pairs"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_pairs"))


def leak_audit(hits: DataFrame, inside, query: str = "query", seconds: str = "seconds") -> DataFrame:
    """(query, results, outside, least, mean, most): how many results a search gave outside the asked domains."""
    return hits.groupBy(query).agg(F.count("*").alias("results"), F.count_if(~inside).alias("outside"), F.min(seconds).alias("least"), F.avg(seconds).alias("mean"), F.max(seconds).alias("most"))


def usable_domains(extracts: DataFrame, domain: str = "domain", usable: str = "usable") -> DataFrame:
    """(domain, urls, usable): whether any page of a domain gave a usable text."""
    return extracts.groupBy(domain).agg(F.count("*").alias("urls"), F.bool_or(usable).alias("usable"))


def run_stats(runs: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by…, n, least, mean, upper_median, most): of an even number the upper middle value.

    The median is a rank, found by histograms of each group (``ranks.at_rank``), not by
    collecting or sorting its values.
    """
    n = runs.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.avg(value).alias("mean"), F.max(value).alias("most"))
    median = at_rank(runs, by, value, F.floor(F.col("n") / 2), "upper_median")
    median = median.withColumn("upper_median", F.col("upper_median").cast(runs.schema[value].dataType))
    medians = median.toDF(*[f"_{c}" for c in by], "upper_median")
    same = [n[c].eqNullSafe(medians[f"_{c}"]) for c in by]
    return n.join(medians, same, "left").select(*by, "n", "least", "mean", "upper_median", "most")


def gate_summary(lines: DataFrame, variant: str = "variant", stage: str = "stage") -> DataFrame:
    """(variant, lines, least_free_disk_mb, most_resident_mb, heaviest_stage, first_stage) of measured runs (with seq)."""
    return lines.groupBy(variant).agg(
        F.count("*").alias("lines"), F.min("free_disk_mb").alias("least_free_disk_mb"), F.max("peak_resident_mb").alias("most_resident_mb"),
        F.max_by(stage, F.struct(F.col("peak_resident_mb"), -F.col("seq"))).alias("heaviest_stage"), F.min_by(stage, "seq").alias("first_stage"),
    )


def by_length(lines: DataFrame, variant: str, tokens: str, value: str, lengths: tuple[int, ...]) -> DataFrame:
    """(variant, t<length>…): the greatest ``value`` of each variant at each length in tokens; null where none was measured."""
    return lines.groupBy(variant).agg(*[F.max(F.when(F.col(tokens) == n, F.col(value))).alias(f"t{n}") for n in lengths])


def manifest_errors(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem): manifest entries (path, sha256) without a file or with other content. ``files``: path, content."""
    seen = files.select("path", F.sha2("content", 256).alias("found"))
    both = manifest.select("path", F.lower("sha256").alias("sha256")).join(seen, "path", "left")
    return both.select("path", F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "changed").alias("problem")).where("problem is not null")


def triaged(models: DataFrame, native: str, catalog: str = "filter=pt,text-classification") -> DataFrame:
    """Models (id, tags, sources, config) worth a look: of the catalog or a native lineage, or named so; with why."""
    listed = F.array_contains("sources", catalog)
    lineage = F.exists("sources", lambda s: s.startswith("base_model="))
    spoken = F.arrays_overlap("tags", F.array(F.lit("pt"), F.lit("portuguese")))
    named = F.to_json(F.struct("id", "tags")).rlike(native)
    reason = F.when(listed, "catalog").when(lineage, "lineage").when(spoken & named, "name")
    return models.withColumn("reason", reason).where("reason is not null").withColumn("three_labels", F.coalesce(F.size(F.map_keys("id2label")) == 3, F.lit(False)))


def training_errors(epochs: DataFrame, reported: DataFrame) -> DataFrame:
    """(problem): where a reported best epoch (epoch, f1, loss; one row) is not the best of ``epochs``."""
    best = epochs.agg(F.max_by(F.struct("epoch", "f1", "loss"), F.struct(F.round("f1", 12), -F.col("loss"), -F.col("epoch"))).alias("b"), F.max("f1").alias("f1"), F.min("loss").alias("loss"))
    both = reported.select(F.struct("epoch", "f1", "loss").alias("r")).join(F.broadcast(best))  # one row each
    rules = [(F.col("r.epoch") != F.col("b.epoch"), "epoch"), (F.abs(F.col("r.f1") - F.col("b.f1")) > 1e-12, "f1"), (F.abs(F.col("r.loss") - F.col("b.loss")) > 1e-12, "loss")]
    return both.select(F.explode(F.filter(F.array(*[F.when(bad, said) for bad, said in rules]), lambda x: x.isNotNull())).alias("problem"))
