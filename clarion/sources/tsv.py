"""Tab-separated sources. Quiz files are split at tabs as they stand; quotes are ordinary characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clarion.functions.urls import canonical_offline
from clarion.operators.ranks import ranked

# Columns of the quiz files, in their order.
FACT = ("id", "url", "source", "date", "reason", "summary", "title", "binary", "subject", "author")
QUESTION = ("id", "title", "source", "binary", "reason", "author", "link")


def _split(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """Lines with as many fields as ``columns`` or more; carriage returns at line ends go."""
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    lines = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= len(columns))
    return lines.select(*[F.col("p")[i].alias(c) for i, c in enumerate(columns)])


def facts(spark: SparkSession, path: str) -> DataFrame:
    """Quiz facts without the header, rows of too few fields dropped."""
    return _split(spark, path, FACT).where("lower(id) <> 'id'")


def questions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Questions of the day. ``strict`` drops rows whose id is no number (the header, broken records); else all lines count."""
    rows = _split(spark, path, QUESTION)
    return rows.where(F.col("id").rlike(r"^\s*\d+\s*$")) if strict else rows


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs: sentence1, sentence2, gold_label. Raises ValueError where a column is missing."""
    rows = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')
    if missing := {"sentence1", "sentence2", "gold_label"} - set(rows.columns):
        raise ValueError(f"missing columns: {sorted(missing)}")
    return rows


def training_pairs(rows: DataFrame, labels: tuple[str, ...] = ("entailment", "neutral", "contradiction"), n: int | None = None, seed: int = 0) -> DataFrame:
    """Pairs with a known label and two sides; with ``n`` that many, drawn by ``seed``."""
    t = lambda c: F.btrim(F.coalesce(F.col(c), F.lit("")))
    kept = rows.where(F.col("gold_label").isin(*labels) & (t("sentence1") != "") & (t("sentence2") != ""))
    return kept if n is None else kept.orderBy(F.xxhash64(F.lit(seed), "sentence1", "sentence2", "gold_label")).limit(n)


def length_batches(rows: DataFrame, length: str, size: int, order: list[str], parts: int = 1) -> DataFrame:
    """``rows`` with ``batch``: runs of ``size`` rows of like length, counted within ranges of the length.

    Ranges may be cut into ``parts`` by the order's hash; only the last batch of each may be
    shorter. ``order`` must tell rows of equal length apart for batches to be the same each time.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(parts))
    own = rows.withColumn("_bucket", F.floor(F.log2(F.col(length) + 1)).cast("int")).withColumn("_part", part)
    made = ranked(own, ["_bucket", "_part"], [F.asc(length), *[F.asc(c) for c in order]], "_k").withColumn("_k", F.floor(F.col("_k") / size))
    return made.withColumn("batch", F.concat_ws("-", "_bucket", "_part", "_k")).drop("_bucket", "_part", "_k")


def import_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Gold candidates from a quiz file with header (ID, Título, URL, Binário, Data, Assunto): all pending."""
    rows = spark.read.csv(path, sep="\t", header=True, encoding="UTF-8")
    bare = {c.lstrip("﻿"): c for c in rows.columns}
    get = lambda name: F.btrim(F.coalesce(F.col(f"`{bare[name]}`"), F.lit(""))) if name in bare else F.lit("")
    url = get("URL")
    family = F.substring(F.sha2(canonical_offline(url), 256), 1, 16)
    return rows.where((get("Título") != "") & url.startswith("https://")).select(
        F.concat(F.lit("quiz-"), get("ID")).alias("id"), get("Título").alias("claim"), url.alias("source_url"), family.alias("event_id"), family.alias("family_id"),
        get("Data").alias("source_date_suggestion"), get("Assunto").alias("topic"), F.lit("pending").alias("review_status"),
        F.when(get("Binário") == "FARSA", "CONTRADITO").otherwise("CONFIRMADO").alias("candidate_verdict"),
    )
