"""Ranks within keys of any size, by sample sort: no task sees all rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.lineage import free_name, stored

#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
ROW_BITS = 33
#: Keys whose first places are broadcast, at most; more meet their rows in a shuffle.
BROADCAST_ROWS = 500_000
#: Buckets of a histogram between its ends.
BUCKETS = 256


def ranked(df: DataFrame, keys: list[str], order: list[Column], into: str = "rank", total: str | None = None) -> DataFrame:
    """``df`` with each row's rank from 0 among the rows of its ``keys`` in ``order``, and with ``total`` their number.

    Rows are dealt to ranges of (keys, order) found by sampling, so a key with most of the
    rows lies in many ranges, sorted, and written. A row's place in all of them is its place
    in its range and the sizes of the ranges before, one number a range; its rank is how far
    that is from its key's first place. Null keys are a key. Rows that tie in ``order`` share
    a range and take their ranks in an order that is not fixed: end ``order`` in something unique.
    """
    at, part, first, size = (free_name(x, df.columns) for x in ("_at", "_part", "_first", "_size"))
    by = [*[F.asc_nulls_first(k) for k in keys], *order]
    spark = df.sparkSession
    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(at, ROW_BITS).cast("int"))
    before, offsets = 0, []
    for r in rows.groupBy(part).count().orderBy(part).collect():  # a row for each range
        offsets.append((r[part], before))
        before += r["count"]
    starts = spark.createDataFrame(offsets, f"`{part}` int, `{first}` bigint")
    placed = rows.join(F.broadcast(starts), part).withColumn(at, F.col(first) + F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop(part, first)
    if not keys:
        return placed.select(*df.columns, F.col(at).alias(into), *([F.lit(before).cast("bigint").alias(total)] if total else []))
    names = [free_name(f"_k{i}", df.columns) for i in range(len(keys))]
    heads = placed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.min(at).alias(first), F.count("*").alias(size))
    heads = stored(heads)
    if heads.count() <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    same = [placed[k].eqNullSafe(heads[n]) for k, n in zip(keys, names)]
    found = placed.join(heads, same)
    return found.select(*df.columns, (F.col(at) - F.col(first)).alias(into), *([F.col(size).alias(total)] if total else []))


def ranked_in_task(df: DataFrame, keys: list[str], order: list[Column], into: str = "rank", total: str | None = None) -> DataFrame:
    """The same for keys that are known to be small, such as one article's passages: a window each, nothing written."""
    w = Window.partitionBy(*keys)
    out = df.withColumn(into, (F.row_number().over(w.orderBy(*order)) - 1).cast("bigint"))
    return out.withColumn(total, F.count("*").over(w)) if total else out


def at_rank(df: DataFrame, by: list[str], value: str, rank: Column, into: str = "value") -> DataFrame:
    """(by…, into): of each group the value at ``rank`` (from 0, an expression over its count ``n``) of its values in order, nulls left out.

    Radix selection: a histogram of each group between its ends, which combines before the
    shuffle, tells the bucket that holds the rank; what lies in that bucket is the next round's
    input, until it holds one value. A task sees a histogram of a group, never its values.
    Both ends of a range are buckets of their own, so that each round ends sooner than the
    one before, infinities and NaN (the greatest) too. Groups without values have no row.
    """
    names = [f"_g{k}" for k in range(len(by))] or ["_g0"]
    keys = [F.col(c).alias(n) for c, n in zip(by, names)] or [F.lit(0).alias("_g0")]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    v, lo, hi = F.col("_v"), F.col("_lo"), F.col("_hi")
    ends = rows.groupBy(*names).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count("*").alias("n"))
    state = stored(ends.select(*names, "_lo", "_hi", rank.cast("bigint").alias("_r")))
    while True:
        open_ = state.where("_lo < _hi")
        if open_.isEmpty():
            break
        right = [f"{n}_" for n in names]
        near = open_.toDF(*right, "_lo", "_hi", "_r")
        if near.count() <= BROADCAST_ROWS:
            near = F.broadcast(near)
        held = rows.join(near, [rows[n].eqNullSafe(near[m]) for n, m in zip(names, right)]).where((v >= lo) & (v <= hi))
        share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)  # halves, so that no difference overflows
        middle = F.when(F.isnan(share), 1).otherwise(F.least(F.lit(BUCKETS), 1 + F.floor(share * BUCKETS)))
        bucket = F.when(v == lo, 0).when(v == hi, BUCKETS + 1).otherwise(middle).cast("int")
        counts = held.groupBy(*names, bucket.alias("_b")).agg(F.count("*").alias("_c"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.max("_r").alias("_r"))
        upto = F.sum("_c").over(Window.partitionBy(*names).orderBy("_b"))  # BUCKETS + 2 rows at most
        chosen = counts.withColumn("_to", upto).where((F.col("_to") > F.col("_r")) & (F.col("_to") - F.col("_c") <= F.col("_r")))
        chosen = chosen.select(*names, "_lo", "_hi", (F.col("_r") - F.col("_to") + F.col("_c")).alias("_r"))
        state = stored(state.where("not (_lo < _hi)").unionByName(chosen))
    return state.select(*[F.col(n).alias(c) for c, n in zip(by, names)], F.col("_lo").alias(into))
