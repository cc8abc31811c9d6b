"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fold_of(doc_id: str, folds: int):
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, doc_id: str = "doc_id", text: str = "text",
) -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``per_class`` rows of each label outside fold ``held``, and the labels' totals there.

    The sample takes the ids with the least hash, so it is the same at every run. Rows with
    a null or conflicting label or a null text do not take part; texts are taken whole, and
    of rows that repeat an id the least text. What comes to the driver is two counts; what
    is broadcast is at most twice ``per_class`` ids.
    """
    y = labels.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).alias("y"), F.max(label).alias("top"))
    y = y.where((F.col("y") == F.col("top")) & F.col("y").isin(0, 1) & (fold_of("_id", folds) != held)).select("_id", F.col("y").cast("int").alias("y"))
    totals = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}
    picks = None
    for k in (0, 1):
        own = y.where(F.col("y") == k).orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picks = own if picks is None else picks.unionByName(own)
    own = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).where("text is not null")
    joined = own.join(F.broadcast(picks), F.col("_doc") == F.col("_id")).groupBy("_id", "y").agg(F.min("text").alias("text"))
    return joined.select("text", "y"), totals
