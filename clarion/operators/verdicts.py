"""From passages to article labels, from sources to votes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.scores import best_label, softmax
from clarion.functions.text import clip

# The baseline policy and the verdicts.
BASELINE = {"version": "evidence-v2-baseline", "temperature": 1.0, "minimum": 0.50, "single": 0.50, "calibrated": False}
VERDICTS = ("CONFIRMADO", "CONTRADITO", "DIVERGENTE", "SEM_INFORMACAO", "NAO_ENCONTRADO")


def judged(passages: DataFrame, logits: str = "logits", temperature: float = 1.0) -> DataFrame:
    """``passages`` with entailment, neutral, contradiction, label (neutral wins ties) and confidence of its label."""
    p = passages.withColumn("_p", softmax(F.col(logits), temperature))
    e, n, c = F.col("_p")[0], F.col("_p")[1], F.col("_p")[2]
    label = best_label(e, n, c)
    confidence = F.when(label == "neutral", n).when(label == "entailment", e).otherwise(c)
    return p.withColumns({"entailment": e, "neutral": n, "contradiction": c, "label": label, "confidence": confidence}).drop("_p")


def eligible(partial: Column, provenance: Column, alignment: Column, duplicate_of: Column) -> Column:
    """Complete, no search snippet, of the claim's time, and no duplicate."""
    return ~F.coalesce(partial, F.lit(False)) & (F.coalesce(provenance, F.lit("")) != "searchSnippet") & (F.coalesce(alignment, F.lit("")) == "compatible") & duplicate_of.isNull()


def article_labels(passages: DataFrame, keys: list[str], ix: str = "ix", minimum: float = 0.50) -> DataFrame:
    """One row per article of judged passages: label, confidence, similarity, excerpt, stance and passages.

    The surest directional passage at ``minimum`` or above labels the article, the first of
    ties; without one it is neutral and shows its most similar passage.
    """
    directional = (F.col("label") != "neutral") & (F.col("confidence") >= minimum)
    pick = F.struct("label", "confidence", "similarity", clip(F.col("text")).alias("text"))
    best = F.max_by(F.when(directional, pick), F.when(directional, F.struct(F.col("confidence"), (-F.col(ix)).alias("_i"))))
    most = F.max_by(pick, F.struct(F.col("similarity"), (-F.col(ix)).alias("_i")))
    agg = passages.groupBy(*keys).agg(
        best.alias("b"), most.alias("m"),
        F.bool_or(directional & (F.col("label") == "entailment")).alias("s"), F.bool_or(directional & (F.col("label") == "contradiction")).alias("r"),
        F.count("*").alias("passages"),
    )
    shown = F.coalesce("b", "m")
    stance = F.when(F.col("s") & F.col("r"), "mixed").when(F.col("s"), "supports").when(F.col("r"), "refutes").otherwise("insufficient")
    return agg.select(
        *keys, F.coalesce("b.label", F.lit("neutral")).alias("label"), shown.confidence.alias("confidence"), shown.similarity.alias("similarity"),
        shown["text"].alias("excerpt"), stance.alias("stance"), "passages",
    )


def stance_of(label: Column, stance: Column | None = None) -> Column:
    by_label = F.when(label == "entailment", "supports").when(label == "contradiction", "refutes").otherwise("insufficient")
    return by_label if stance is None else F.coalesce(stance, by_label)


def votes(sources: DataFrame, minimum: float = 0.50) -> DataFrame:
    """(claim_id, url, origin, label, confidence): a vote per directional passage of an eligible source.

    ``sources``: claim_id, url, origin, eligible, stance, confidence, evidence (array of
    (label, confidence)). Without passages its stance votes, a mixed one twice. Narrow.
    """
    each = F.filter(F.coalesce("evidence", F.array().cast("array<struct<label:string,confidence:double>>")), lambda x: (x["label"] != "neutral") & (x["confidence"] >= minimum))
    own = F.col("confidence").cast("double")
    vote = lambda name: F.struct(F.lit(name).alias("label"), own.alias("confidence"))
    none = F.array().cast("array<struct<label:string,confidence:double>>")
    stance = F.concat(
        F.when(F.col("stance").isin("supports", "mixed"), F.array(vote("entailment"))).otherwise(none),
        F.when(F.col("stance").isin("refutes", "mixed"), F.array(vote("contradiction"))).otherwise(none),
    )
    chosen = F.when(F.size(F.coalesce("evidence", none)) > 0, each).when(own >= minimum, stance).otherwise(none)
    cast = chosen.cast("array<struct<label:string,confidence:double>>")
    return sources.where("eligible").select("claim_id", "url", "origin", F.explode(cast).alias("v")).select("claim_id", "url", "origin", "v.label", "v.confidence")


def verdicts(claims: DataFrame, sources: DataFrame, minimum: float = 0.50, single: float = 0.50, hits: str | None = None) -> DataFrame:
    """(claim_id, verdict, sources, origins_single) for every claim, also those without sources.

    No majority decides: one opposing vote makes a verdict divergent. Where all votes at
    ``minimum`` have one origin, only those at ``single`` count. Whether there is one origin
    is min = max, so one combinable aggregation does it. ``hits``: a column of ``claims``
    with the number of search hits; with hits but no source there is no information.
    """
    cast = votes(sources, minimum)
    strong = F.col("confidence") >= single
    per = cast.groupBy("claim_id").agg(
        (F.min("origin") == F.max("origin")).alias("one"),
        *[F.bool_or(F.col("label") == k).alias(k) for k in ("entailment", "contradiction")],
        *[F.bool_or((F.col("label") == k) & strong).alias(f"{k}_strong") for k in ("entailment", "contradiction")],
    )
    counts = sources.groupBy("claim_id").agg(F.count("*").alias("sources"))
    rows = claims.join(counts, "claim_id", "left").join(per, "claim_id", "left")
    yes = lambda k: F.coalesce(F.when(F.col("one"), F.col(f"{k}_strong")).otherwise(F.col(k)), F.lit(False))
    found = F.coalesce("sources", F.lit(0))
    empty = F.lit("NAO_ENCONTRADO") if hits is None else F.when(F.coalesce(F.col(hits), F.lit(0)) > 0, "SEM_INFORMACAO").otherwise("NAO_ENCONTRADO")
    verdict = (
        F.when(found == 0, empty).when(yes("entailment") & yes("contradiction"), "DIVERGENTE")
        .when(yes("entailment"), "CONFIRMADO").when(yes("contradiction"), "CONTRADITO").otherwise("SEM_INFORMACAO")
    )
    return rows.select("claim_id", verdict.alias("verdict"), found.cast("bigint").alias("sources"), F.coalesce("one", F.lit(False)).alias("one_origin"))


def contributing(sources: DataFrame, minimum: float = 0.50, single: float = 0.50) -> DataFrame:
    """(claim_id, url, origin) of the sources whose votes count, each once."""
    cast = votes(sources, minimum)
    w = Window.partitionBy("claim_id")
    one = F.min("origin").over(w) == F.max("origin").over(w)
    return cast.withColumn("_one", one).where(~F.col("_one") | (F.col("confidence") >= single)).select("claim_id", "url", "origin").distinct()


def diagnostics(claims: DataFrame, sources: DataFrame, found: str, read: str, limitations: DataFrame | None = None, **policy: float) -> DataFrame:
    """(claim_id, found, read, used, independent_origins, limitations): ``limitations`` (claim_id, limitation) sorted, distinct."""
    used = contributing(sources, **policy).groupBy("claim_id").agg(F.count_distinct("url").alias("used"), F.count_distinct("origin").alias("independent_origins"))
    out = claims.join(used, "claim_id", "left")
    if limitations is not None:
        out = out.join(limitations.groupBy("claim_id").agg(F.array_sort(F.collect_set("limitation")).alias("limitations")), "claim_id", "left")
    else:
        out = out.withColumn("limitations", F.array().cast("array<string>"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select("claim_id", zero(found).alias("found"), zero(read).alias("read"), zero("used").alias("used"), zero("independent_origins").alias("independent_origins"), F.coalesce("limitations", F.array().cast("array<string>")).alias("limitations"))


def policy_valid(p: DataFrame, model_version: str) -> Column:
    """Whether a policy row may replace the baseline: its model, calibrated, ranges, digest."""
    c = F.col
    return F.coalesce(
        (c("model_version") == model_version) & c("calibrated") & (c("version") != "") & c("temperature").between(0.049, 21.0)
        & c("minimum").between(0.5, 1.0) & (c("single") >= c("minimum")) & (c("single") <= 1.0) & c("digest").rlike("^[a-f0-9]{64}$"),
        F.lit(False),
    )
