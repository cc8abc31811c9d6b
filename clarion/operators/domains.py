"""Hosts against a table of domains, and the URLs that pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.urls import canonical_host, suffixes


def match(df: DataFrame, host: str, domains: DataFrame, entry: str = "domain", into: str = "matched") -> DataFrame:
    """``df`` with the longest of ``domains`` that its host equals or ends with after a dot (null without one).

    The suffix test becomes an equi-join: each distinct host is exploded into its suffixes
    once, and only (host, entry) pairs are joined back.
    """
    hosts = df.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    tails = hosts.select("_host", F.explode(suffixes(canonical_host(F.col("_host")))).alias("_tail"))
    known = domains.select(F.col(entry).alias("_entry"), canonical_host(F.col(entry)).alias("_tail"))
    best = tails.join(known, "_tail").groupBy("_host").agg(F.max_by("_entry", F.struct(F.length("_tail"), F.col("_entry"))).alias(into))
    return df.join(best, F.col(host) == F.col("_host"), "left").drop("_host")


def within(df: DataFrame, host: str, domains: DataFrame, entry: str = "domain") -> DataFrame:
    """The rows whose host is under any entry: a semi join."""
    known = domains.select(canonical_host(F.col(entry)).alias("_tail"))
    hosts = df.select(F.col(host).alias("_host")).distinct()
    hit = hosts.select("_host", F.explode(suffixes(canonical_host(F.col("_host")))).alias("_tail")).join(known, "_tail", "left_semi")
    return df.join(hit.select("_host").distinct(), F.col(host) == F.col("_host"), "left_semi")


def first_allowed(df: DataFrame, keys: list[str], order: list[Column], ok: Column, limit: int = 5) -> DataFrame:
    """Filters, then keeps the first ``limit`` rows of each key in order; none for a limit of 0 or less."""
    if limit <= 0:
        return df.limit(0)
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.where(ok).withColumn("_n", n).where(F.col("_n") <= limit).drop("_n")
