"""Token ids as Parquet list columns that can be read in part.

Rows are in ascending id order over all files. Ids are dictionary encoded, document ids
and lengths delta encoded; row groups and pages are small, and each page's least and
greatest values are in the page index, so a reader of a few documents, or of lengths
alone, skips the rest.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clarion.functions.lineage import extended, shared_dir
from clarion.llm import tokens

END = 2
#: Writer settings: sizes in bytes; the second format version has delta encodings.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
}
#: Pieces that a worker remembers here; with 300,000 a fifth more of them are encoded again.
REMEMBERED = 450_000


def write(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", split: str | None = tokens.SPACED, end: int = END) -> None:
    """Writes (part, place, doc_id, n_tokens, ids) to ``path``: parts are files in id order, places rows in a part.

    Each document's ids end with ``end``; a null or empty text has only that. Rows of equal
    ids stand together, in the order of their texts' hashes; null ids come first.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    last = int(end).to_bytes(4, "little")

    def scan(batches):
        encode = tokens.encoder(tokenizer, split, REMEMBERED).encode_all
        part, place = TaskContext.get().partitionId(), 0
        for batch in tokens.parts(batches):
            ids = [x + last for x in encode(batch.column(1).to_pylist())]
            sizes = np.array([len(x) // 4 for x in ids], dtype=np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), batch.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), values)],
                names=["part", "place", "doc_id", "n_tokens", "ids"],
            )
            place += n

    head = own.sparkSession.createDataFrame([], "part int, place bigint").schema
    schema = extended(head, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_tokens int, ids array<int>")
    ordered.mapInArrow(scan, schema).write.options(**LAYOUT).parquet(path)


def lengths(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens): the ids' pages are not read."""
    return spark.read.parquet(path).select("doc_id", "n_tokens")


def select(spark: SparkSession, path: str, where: Column) -> DataFrame:
    """(doc_id, ids) of the documents that ``where`` (over doc_id or n_tokens) asks for; other pages are skipped."""
    return spark.read.parquet(path).where(where).select("doc_id", "ids")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), all from the ids that the files hold."""
    rows = spark.read.parquet(path).select("part", "place", "doc_id", "ids")

    def measure(batches):
        for batch in batches:
            lists = batch.column(3)
            values = lists.values.to_numpy().astype("<u4", copy=False)
            cut = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(cut).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "place", "doc_id", "n_tokens", "ids_crc32"])

    rows = rows.mapInArrow(measure, extended(rows.drop("ids").schema, "n_tokens bigint, ids_crc32 bigint"))
    # One row per file: how many ids the files before it hold.
    parts = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place")) - F.col("n_tokens")
    return rows.withColumn("own", own).join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Writes ``docs`` to ``path`` (a new folder of the shared directory if none is given) and returns ``positions``."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return positions(spark, path)
