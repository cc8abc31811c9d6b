"""Search results and paged catalogs as Spark data sources, with a pluggable client.

``client`` names a function ``module:name`` that executors import. For searches it takes
(query, parameters) and returns (status, results); for paged catalogs it takes an address
and returns (status, rows, next address or None). Without a network a client can read
stored answers, which is how batch runs replay a frozen corpus.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HITS = "query string, rank int, title string, url string, content string, score double, published_date string, status int"
#: Results of one search at most, and statuses that are tried once more.
MOST = 20
#: Tasks a core that walk through addresses; pages, and characters of their rows, that a walk hands on at once.
WALKS, SENT, LONG = 4, 1000, 1 << 20


def _client(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Query(InputPartition):
    text: str


class SearchSource(DataSource):
    """``spark.read.format("clarion_search").options(client=…, queries=json list, parameters=json)``: a partition per query."""

    @classmethod
    def name(cls) -> str:
        return "clarion_search"

    def schema(self) -> str:
        return HITS

    def reader(self, schema) -> DataSourceReader:
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.client = options["client"]
        self.queries = json.loads(options["queries"])
        self.parameters = json.loads(options.get("parameters", "{}"))

    def partitions(self):
        return [Query(q) for q in self.queries]

    def read(self, partition) -> Iterator[tuple]:
        """Hits of one query; a timeout or server error is tried once more, a refused key or spent quota never."""
        ask = _client(self.client)
        for attempt in (0, 1):
            status, results = ask(partition.text, self.parameters)
            if status == 408 or status >= 500:
                if attempt == 0:
                    continue
            break
        if status // 100 != 2:
            yield (partition.text, None, None, None, None, None, None, status)
            return
        for k, r in enumerate(results[:MOST]):
            yield (partition.text, k, r.get("title"), r.get("url"), r.get("content"), r.get("score"), r.get("published_date"), status)


@dataclass
class Address(InputPartition):
    start: str


class PagedSource(DataSource):
    """``spark.read.format("clarion_paged").options(client=…, starts=json list, pages=n)``: (start, page, row as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "clarion_paged"

    def schema(self) -> str:
        return "start string, page int, row string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    def __init__(self, options):
        self.client = options["client"]
        self.starts = json.loads(options["starts"])
        self.pages = int(options.get("pages", "0"))
        self.retries, self.pause = int(options.get("retries", "3")), float(options.get("pause", "1"))

    def partitions(self):
        return [Address(s) for s in self.starts]

    def read(self, partition) -> Iterator[tuple]:
        """Rows of all pages of one start; an address that isn't there is an error."""
        for page, status, rows, _ in _followed(_client(self.client), partition.start, self.pages, self.retries, self.pause):
            if status == 404:
                raise RuntimeError(f"{partition.start}: status {status}")
            for r in rows:
                yield (partition.start, page, json.dumps(r, sort_keys=True))


def _followed(ask, at: str | None, pages: int, retries: int, pause: float) -> Iterator[tuple[int, int, list, str | None]]:
    """(page, status, rows, next address) of ``at`` and what follows it, at most ``pages`` of them unless 0; 404 is never tried again and ends an address."""
    page = 0
    while at and (not pages or page < pages):
        for attempt in range(retries):
            status, rows, after = ask(at)
            if status // 100 == 2 or status == 404:
                break
            time.sleep(pause * 2**attempt)
        if status == 404:
            rows, after = [], None
        elif status // 100 != 2:
            raise RuntimeError(f"{at}: status {status}")
        yield page, status, rows, after
        at, page = after, page + 1


def followed(starts: DataFrame, client: str, pages: int = 0, retries: int = 3, pause: float = 1.0) -> DataFrame:
    """(start, page, status, rows, next) of every page of a table of addresses, followed in tasks.

    starts: start, and where a walk goes on also ``at``, the address to begin with, and
    ``page``, its number. rows are JSON texts; next is the address after the page, null after
    the last. Null addresses have no pages. With ``pages`` a walk stops after so many; ``unfinished`` has what is left.
    Addresses are dealt anew to WALKS tasks a core, as a small table lies in one file or one
    partition; pages are handed on SENT at a time, or fewer where their rows are long.
    """
    again = "at" in starts.columns
    own = starts.select("start", F.col("at" if again else "start").alias("at"), (F.col("page") if again else F.lit(0)).cast("int").alias("page"))
    own = own.repartition(WALKS * starts.sparkSession.sparkContext.defaultParallelism)
    names = ["start", "page", "status", "rows", "next"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]

    def sent(cells):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*cells), kinds)], names=names)

    def walk(batches):
        ask, held, size = _client(client), [], 0
        for batch in batches:
            for start, at, first in zip(*(c.to_pylist() for c in batch.columns)):
                for page, status, rows, after in _followed(ask, at, pages, retries, pause):
                    texts = [json.dumps(r, sort_keys=True) for r in rows]
                    held.append((start, first + page, status, texts, after))
                    size += sum(map(len, texts))
                    if len(held) >= SENT or size >= LONG:
                        yield sent(held)
                        held, size = [], 0
        if held:
            yield sent(held)

    return own.mapInArrow(walk, "start string, page int, status int, rows array<string>, next string")


def unfinished(found: DataFrame) -> DataFrame:
    """(start, at, page): where walks that ``followed`` stopped go on."""
    last = found.groupBy("start").agg(F.max_by(F.struct("next", "page"), "page").alias("x"))
    return last.where("x.next is not null").select("start", F.col("x.next").alias("at"), (F.col("x.page") + 1).alias("page"))


def replayed(queries: DataFrame, stored: DataFrame, order: str = "position") -> DataFrame:
    """HITS of each distinct ``query`` of ``queries`` from stored results (query, title, url, content, score, published_date and an order).

    The first MOST results of a query count. A query without stored results has status 404 and a row of nulls.
    """
    ranked = stored.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order)) - 1).where(F.col("rank") < MOST)
    columns = ["rank", "title", "url", "content", "score", "published_date"]
    both = queries.select("query").distinct().join(ranked.select("query", *columns), "query", "left")
    return both.select("query", *columns, F.when(F.col("rank").isNull(), 404).otherwise(200).alias("status"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SearchSource)
    spark.dataSource.register(PagedSource)
