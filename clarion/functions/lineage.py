"""Cutting lineage and finding a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one that the session set, or in local mode a temporary one.

    On a cluster a temporary folder would be another one on every machine, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clarion-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Writes inside drop their shuffle files when they end, not whenever the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(stem: str, *taken: list[str]) -> str:
    """``stem``, with underscores after it until no column of ``taken`` has that name in any case."""
    used = {c.lower() for columns in taken for c in columns}
    while stem.lower() in used:
        stem += "_"
    return stem


def stored(df: DataFrame, paths: list[str] | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to a new folder of the shared directory and read it back.

    Like ``checkpoint()`` it cuts the lineage and survives lost executors, but the
    file is columnar and compressed, so later reads take only the columns they use.
    The folder is appended to ``paths``, for a caller that removes it in the end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.options(**options).parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared directory that no DataFrame still in use reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` followed by the fields of ``ddl``; the given one stays as it is."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
