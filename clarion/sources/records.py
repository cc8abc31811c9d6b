"""JSON records: lines with a fixed schema, the catalog, the policy, label orders, measured runs in logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from clarion.operators.verdicts import BASELINE, policy_valid

EVIDENCE = "array<struct<id:string,url:string,text:string>>"
GOLD = (
    "id string, claim string, event_id string, family_id string, reference_date string, review_status string, reviewers array<string>, verdict string, "
    f"split string, source_url string, evidence {EVIDENCE}, sufficient_evidence_sets array<array<string>>, "
    "pairs array<struct<premise:string,hypothesis:string,label:string>>"
)
PREDICTION = f"id string, verdict string, error string, confidence double, elapsed_seconds double, search_calls int, found_articles int, evidence {EVIDENCE}"
OBSERVATION = (
    "id string, found_articles int, error string, sources array<struct<origin_group:string,provenance:string,is_partial:boolean,temporal_alignment:string,"
    "duplicate_of:string,passages:array<struct<id:string,url:string,text:string,logits:array<double>>>>>"
)
CATALOG = (
    "id string, claim string, entities array<string>, eventYear int, verdict string, url string, title string, excerpt string, publishedAt string, "
    "status string, reviewerIDs array<string>"
)
POLICY = (
    "version string, modelVersion string, temperature double, minimumConfidence double, singleSourceMinimumConfidence double, calibrated boolean, calibrationDigest string"
)


def read_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Records of a JSON-lines file; blank lines are none. The schema is given, never inferred."""
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line, keys sorted, nulls left out."""
    df.select(*sorted(df.columns)).write.mode("errorifexists").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def save_state(df: DataFrame, path: str) -> None:
    """Replaces the saved state (a game, a chosen question) by ``df``."""
    df.coalesce(1).write.mode("overwrite").parquet(path)


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The saved state; no rows where nothing was saved."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed entries (a JSON array) with their positions; a missing or broken file is an empty catalog."""
    columns = "id string, position bigint, claim string, entities array<string>, event_year int, verdict string, url string, title string, excerpt string, published_at string, status string, reviewer_ids array<string>"
    if not exists(spark, path):
        return spark.createDataFrame([], columns)
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(f'{a}:{b}' for a, b in (x.strip().split(' ', 1) for x in CATALOG.split(', ')))}>>")).alias("position", "e"))
    return rows.where("e.id is not null").select("e.id", F.col("position").cast("bigint").alias("position"), "e.claim", "e.entities", F.col("e.eventYear").alias("event_year"), "e.verdict", "e.url", "e.title", "e.excerpt", F.col("e.publishedAt").alias("published_at"), "e.status", F.col("e.reviewerIDs").alias("reviewer_ids"))


#: What a policy sets.
SET = ("version", "temperature", "minimum", "single", "calibrated")


def policies(rows: DataFrame, model_version: str) -> DataFrame:
    """``rows`` with the fields of POLICY as ``in_force``: each row's policy if it is valid for the model, else the baseline."""
    given = rows.select(
        *[c for c in rows.columns if c not in StructType.fromDDL(POLICY).names], "version", F.col("modelVersion").alias("model_version"), "temperature",
        F.col("minimumConfidence").alias("minimum"), F.col("singleSourceMinimumConfidence").alias("single"), "calibrated", F.col("calibrationDigest").alias("digest"),
    )
    own = F.struct(*[F.col(k) for k in SET])
    base = F.struct(*[F.lit(BASELINE[k]).cast(given.schema[k].dataType).alias(k) for k in SET])
    return given.withColumn("in_force", F.when(policy_valid(given, model_version), own).otherwise(base)).drop(*SET, "model_version", "digest")


def policy(spark: SparkSession, path: str | None, model_version: str) -> dict:
    """The policy of a JSON file if it is valid for the model, else the baseline. One row comes to the driver."""
    if path is None:
        return dict(BASELINE)
    found = policies(spark.read.schema(POLICY).json(path, multiLine=True), model_version).limit(1).collect()
    return found[0]["in_force"].asDict() if found else dict(BASELINE)


def ordered_labels(text: Column) -> Column:
    """Labels in the order of their ids from ``{"0": "entailment", …}``; null unless they are the three, each once."""
    pairs = F.array_sort(F.transform(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: F.struct(e["key"].try_cast("int").alias("k"), F.lower(e["value"]).alias("v"))))
    labels = F.transform(pairs, lambda e: e["v"])
    return F.when(F.array_sort(labels) == F.array(*[F.lit(x) for x in ("contradiction", "entailment", "neutral")]), labels)


def label_order(spark: SparkSession, text: str) -> list[str]:
    """``ordered_labels`` of one text. Raises ValueError unless they are the three."""
    labels = spark.range(1).select(ordered_labels(F.lit(text)).alias("v")).first()["v"]
    if labels is None:
        raise ValueError(f"not the three labels: {text}")
    return labels


def structured_lines(spark: SparkSession, path: str, prefix: str, schema: str) -> DataFrame:
    """Records of log lines ``… PREFIX {json}``; other lines and broken JSON go."""
    lines = spark.read.text(path).select(F.regexp_extract("value", rf"{prefix}\s+(\{{.*\}})\s*$", 1).alias("j")).where("j <> ''")
    return lines.select(F.from_json("j", schema).alias("r")).where("r is not null").select("r.*")


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length) of files, paths relative to ``path``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.substring_index("path", "/", -1).alias("path"), "content", "length")


def report_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """A Markdown table row per row: one column ``value`` that ``write.text`` takes."""
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
