"""The quota as a stream: per month the lanes' counters and the last accepted minute.

``follow`` decides micro-batches of any size: the bounded fold of the batch form goes on from
a small table of months, and the rest of a micro-batch is joined to its outcome. ``reserved``
is one stateful operator, for micro-batches whose months fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clarion.functions.lineage import remove
from clarion.operators.quota import BURST, LIMITS, STATE, decided, fold_batches


def reserved(requests: DataFrame, limits: dict[str, int] | None = None, burst: int = BURST) -> DataFrame:
    """(request_id, period, lane, minute, accepted, reason) of a stream of (request_id, ts, lane).

    Within a micro-batch requests are taken by (ts, request_id); batches count as they
    arrive. The reservation precedes the search, so a failed search refunds nothing.
    State is four numbers per month, kept until the checkpoint is dropped.
    """
    limits = limits or LIMITS
    own = requests.select(
        F.col("request_id"), F.col("ts"), F.col("lane"), F.date_format("ts", "yyyy-MM").alias("period"), F.floor(F.unix_seconds("ts") / 60).cast("bigint").alias("minute")
    )
    kind = own.schema["request_id"].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out, after = fold_batches(batches, state.get if state.exists else (0, 0, -1, 0), limits, burst)
        state.update(after)
        yield out.assign(period=key[0])[["request_id", "period", "lane", "minute", "accepted", "reason"]]

    return own.groupBy("period").applyInPandasWithState(
        step, f"request_id {kind}, period string, lane string, minute bigint, accepted boolean, reason string",
        "production bigint, evaluation bigint, minute bigint, burst bigint", "append", GroupStateTimeout.NoTimeout,
    )


def follow(requests: DataFrame, path: str, limits: dict[str, int] | None = None, burst: int = BURST) -> StreamingQuery:
    """Decides what a stream of (request_id, ts, lane) has now; ``decisions`` reads them from ``path``.

    ``path`` is a folder that driver and executors share. Within a micro-batch requests are
    taken by (ts, request_id); micro-batches count as they arrive. Each writes its decisions
    and the state after it to folders of its number, and reads the state of the one before:
    one that is run again after a failure overwrites what it had written and decides the same.
    Called again with the same ``path``, it goes on where it stopped.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(STATE).parquet(f"{path}/state/{n - 1}") if n else spark.createDataFrame([], STATE)
        written: list[str] = []
        out, after = decided(batch, before, limits, burst, paths=written)
        out.write.mode("overwrite").parquet(f"{path}/decisions/batch={n}")
        after.coalesce(1).write.mode("overwrite").parquet(f"{path}/state/{n}")
        for old in [*written, *([f"{path}/state/{n - 2}"] if n > 1 else [])]:
            remove(spark, old)

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def decisions(spark, path: str) -> DataFrame:
    """(request_id, period, minute, lane, accepted, reason, batch) of all requests so far."""
    return spark.read.parquet(f"{path}/decisions")
