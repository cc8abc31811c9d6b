"""Evaluation: evidence checks, confusion, ratios with intervals, calibration, policy choice, release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clarion.functions.lineage import stored
from clarion.functions.scores import LABELS, ratio, softmax
from clarion.functions.text import collapse
from clarion.functions.urls import canonical_offline
from clarion.operators.ranks import at_rank
from clarion.operators.verdicts import VERDICTS

DIRECTIONAL = ("CONFIRMADO", "CONTRADITO")
#: Thresholds of the policy grid: 19 steps of 0.025 from 0.5.
STEPS, STEP = 19, 0.025


def coverage_errors(gold: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """(id, problem): gold without or with several predictions, and predictions without gold; empty when all is well."""
    g = gold.groupBy(key).agg(F.count("*").alias("g"))
    p = predictions.groupBy(key).agg(F.count("*").alias("p"))
    both = g.join(p, key, "full_outer")
    problem = F.when(F.col("p").isNull(), "missing").when(F.col("g").isNull(), "unknown").when(F.col("p") > 1, "repeated").when(F.col("g") > 1, "repeated_gold")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def verified_evidence(gold: Column, predicted: Column) -> Column:
    """Ids of annotated evidence (id, url, text) whose span a predicted passage of that id and URL holds."""
    norm = lambda t: F.lower(collapse(t))

    def held(g: Column) -> Column:
        return F.exists(
            predicted,
            lambda p: (p["id"] == g["id"]) & (F.length(p["text"]) > 0) & norm(p["text"]).contains(norm(g["text"])) & (canonical_offline(p["url"]) == canonical_offline(g["url"])),
        )

    return F.array_distinct(F.transform(F.filter(gold, held), lambda g: g["id"]))


def matched_spans(gold: DataFrame, passages: DataFrame) -> DataFrame:
    """(span_id, passage_id): gold spans (span_id, url, text) that a passage (passage_id, url, text) of the same page holds.

    Case and runs of white space don't count, nor do addresses' variants. The inner words of
    a span are whole words of whatever holds it, so a span and its passages meet by the
    canonical URL and the inner word that the fewest passages of that URL have, as one 64-bit
    hash, so that a passage's words are shuffled as numbers; addresses and texts are
    joined to the pairs that met and compared whole, and hashes that fall together only let more pairs meet. Spans of one or two words have no inner
    word and meet all passages of their URL. Null texts and addresses match nothing, empty passages neither.
    """
    norm = F.lower(collapse(F.col("text")))
    g = gold.select("span_id", canonical_offline(F.col("url")).alias("page"), norm.alias("span")).where("page is not null and span is not null")
    p = passages.select("passage_id", canonical_offline(F.col("url")).alias("page"), norm.alias("passage")).where("page is not null and passage <> ''")
    g, p = stored(g.withColumn("g", F.monotonically_increasing_id())), stored(p.withColumn("p", F.monotonically_increasing_id()))
    words = F.split("span", " ")
    keyed = lambda a: F.transform(F.array_distinct(a), lambda w: F.xxhash64("page", w))
    inner = g.select("g", F.explode_outer(keyed(F.slice(words, F.lit(2), F.greatest(F.lit(0), F.size(words) - 2)))).alias("word"))
    asked = inner.where("word is not null").select("word").distinct()
    held = p.select("p", F.explode(keyed(F.split("passage", " "))).alias("word")).join(asked, "word", "left_semi")
    held = stored(held)
    counts = held.groupBy("word").agg(F.count("*").alias("c"))
    # A word that no passage of the page has is the rarest: such a span meets nothing.
    key = inner.join(counts, "word", "left").groupBy("g").agg(F.min(F.when(F.col("word").isNotNull(), F.struct(F.coalesce("c", F.lit(0)).alias("c"), "word"))).alias("key"))
    by_word = key.where("key.c > 0").select("g", F.col("key.word").alias("word")).join(held, "word").select("g", "p")
    by_page = g.join(key.where("key is null").select("g"), "g", "left_semi").select("g", "page").join(p.select("p", "page"), "page").select("g", "p")
    met = by_word.unionByName(by_page)
    both = met.join(g, "g").join(p.withColumnRenamed("page", "shown"), "p")
    return both.where((F.col("page") == F.col("shown")) & F.contains("passage", "span")).select("span_id", "passage_id").distinct()


def sufficient(sets: Column, ids: Column) -> Column:
    """Whether any annotated set lies within ``ids``."""
    return F.coalesce(F.exists(sets, lambda s: F.size(F.array_except(s, ids)) == 0), F.lit(False))


def scored(gold: DataFrame, predictions: DataFrame) -> DataFrame:
    """A row per case: id, expected, actual (ERROR for failed ones), sufficient, correct, annotated, confidence, elapsed_seconds, search_calls.

    gold: id, verdict, evidence, sufficient_evidence_sets. predictions: id, verdict, error,
    confidence, evidence, elapsed_seconds, search_calls. A directional or divergent verdict
    is correct only with sufficient evidence.
    """
    p = predictions.select("id", "verdict", "error", "confidence", F.col("evidence").alias("shown"), "elapsed_seconds", "search_calls").withColumnRenamed("verdict", "given")
    both = gold.select("id", F.col("verdict").alias("expected"), "evidence", "sufficient_evidence_sets").join(p, "id")
    actual = F.when(F.coalesce("error", F.lit("")) != "", "ERROR").otherwise(F.col("given"))
    both = both.withColumn("actual", actual).withColumn("sufficient", sufficient(F.col("sufficient_evidence_sets"), verified_evidence(F.col("evidence"), F.coalesce("shown", F.array().cast(both.schema["evidence"].dataType)))))
    needs = F.col("actual").isin(*DIRECTIONAL, "DIVERGENTE")
    return both.select(
        "id", "expected", "actual", "sufficient", ((F.col("actual") == F.col("expected")) & (~needs | F.col("sufficient"))).alias("correct"),
        (F.size(F.coalesce("sufficient_evidence_sets", F.array().cast("array<array<string>>"))) > 0).alias("annotated"), "confidence", "elapsed_seconds", "search_calls",
    )


def confusion(cases: DataFrame, expected: str = "expected", actual: str = "actual", values: tuple[str, ...] = VERDICTS) -> DataFrame:
    """A row per expected value with a count per actual one and ERROR, zeros included."""
    spark = cases.sparkSession
    counts = cases.groupBy(expected).pivot(actual, [*values, "ERROR"]).count()
    all_ = spark.createDataFrame([(v,) for v in values], f"{expected} string")
    return all_.join(counts, expected, "left").na.fill(0)


def macro_f1(cases: DataFrame, expected: str = "expected", actual: str = "actual", values: tuple[str, ...] = VERDICTS) -> Column:
    """Mean F1 over ``values`` as an aggregate expression; a value that is nowhere counts 0."""
    total = F.lit(0.0)
    for v in values:
        tp = F.count_if((F.col(expected) == v) & (F.col(actual) == v))
        off = F.count_if((F.col(expected) == v) != (F.col(actual) == v))
        total = total + F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + off), F.lit(0.0))
    return total / len(values)


def report(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row (per ``by``) with all measures of ``scored`` cases: a single aggregation, and the latency's rank by histograms."""
    by = by or []
    c = F.col
    directional = c("actual").isin(*DIRECTIONAL)
    resolvable = c("expected").isin(*DIRECTIONAL)
    known = directional & c("confidence").isNotNull() & ~F.isnan(F.coalesce(c("confidence"), F.lit(0.0)))
    per = [ratio(F.count_if((c("actual") == v) & c("correct")), F.count_if(c("actual") == v)).alias(f"precision_{v.lower()}") for v in DIRECTIONAL]
    out = cases.groupBy(*by).agg(
        F.count("*").alias("n"), macro_f1(cases).alias("macro_f1"),
        ratio(F.count_if(c("correct")), F.count("*")).alias("accuracy"),
        ratio(F.count_if(directional & c("correct")), F.count_if(directional)).alias("directional_precision"), *per,
        ratio(F.count_if(directional), F.count("*")).alias("total_coverage"),
        ratio(F.count_if(resolvable & directional), F.count_if(resolvable)).alias("resolvable_coverage"),
        ratio(F.count_if(c("sufficient")), F.count_if(c("annotated"))).alias("evidence_recall"),
        F.when(F.count_if(known) > 0, F.count_if(known & (c("confidence") >= 0.85) & ~c("correct"))).alias("high_confidence_errors"),
        F.avg("search_calls").alias("mean_search_calls"), F.count_if(c("actual") == "ERROR").alias("failures"),
    )
    rank = F.ceil(c("n") * 19 / 20) - 1
    late = at_rank(cases, by, "elapsed_seconds", rank, "latency_p95").toDF(*[f"_{k}" for k in by], "latency_p95")
    same = [out[k].eqNullSafe(late[f"_{k}"]) for k in by] or F.lit(True)  # one row each without groups
    both = out.join(late, same, "left").drop(*[f"_{k}" for k in by])
    last = ["mean_search_calls", "failures"]
    return both.select(*[k for k in both.columns if k not in [*last, "latency_p95"]], "latency_p95", *last)


def class_metrics(pairs: DataFrame, truth: str = "truth", predicted: str = "predicted", values: tuple[str, ...] = LABELS) -> DataFrame:
    """(label, precision, recall, f1, support): one aggregation, then a row per label."""
    parts = []
    for v in values:
        t, p = F.col(truth) == v, F.col(predicted) == v
        parts.append(F.struct(F.lit(v).alias("label"), F.count_if(t & p).alias("tp"), F.count_if(p).alias("said"), F.count_if(t).alias("support")))
    rows = pairs.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return rows.select("label", zero(F.col("tp"), F.col("said")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2.0 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")


def temperatures(n: int = 601) -> list[float]:
    """exp(-3 + i / 100) for i below ``n``, then 1."""
    import math

    return [math.exp(-3 + i * 0.01) for i in range(n)] + [1.0]


def losses(observations: DataFrame, candidates: list[float] | None = None, logits: str = "logits", label: str = "label") -> DataFrame:
    """(position, temperature, loss): mean negative log likelihood of each candidate, summed map-side."""
    ts = temperatures() if candidates is None else candidates
    grid = F.posexplode(F.array(*[F.lit(float(t)) for t in ts])).alias("position", "temperature")
    right = F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(label)).cast("int")
    z = F.col(logits)
    # Differences to the greatest logit, once per record: what is left per candidate are plain numbers.
    gaps = [(z[i] - F.array_max(z)).alias(f"z{i}") for i in range(len(LABELS))]
    rows = observations.where(right > 0).select(*gaps, (z[right - 1] - F.array_max(z)).alias("own")).select("z0", "z1", "z2", "own", grid)
    t = F.col("temperature")
    p = F.exp(F.col("own") / t) / (F.exp(F.col("z0") / t) + F.exp(F.col("z1") / t) + F.exp(F.col("z2") / t))
    return rows.groupBy("position", "temperature").agg(F.avg(-F.log(F.greatest(F.lit(1e-15), p))).alias("loss"))


def fitted_temperature(observations: DataFrame, candidates: list[float] | None = None, digits: int = 12) -> DataFrame:
    """(temperature, loss_before, loss_after, observations): the candidate of least loss, the first of ties."""
    ls = losses(observations, candidates)
    return ls.agg(
        F.min_by("temperature", F.struct(F.round("loss", digits), F.col("position"))).alias("temperature"),
        F.min(F.when(F.col("temperature") == 1.0, F.col("loss"))).alias("loss_before"), F.min("loss").alias("loss_after"),
    )


def offline_verdict(minimum: Column, single: Column, temperature: float = 1.0) -> Column:
    """Verdict of a record (error, found_articles, sources) at two thresholds, as an expression.

    Here ties of a passage go to the first label, unlike in the online vote.
    """
    names = F.array(*[F.lit(x) for x in LABELS])

    def passages(source: Column) -> Column:
        def vote(p: Column) -> Column:
            probabilities = softmax(p["logits"], temperature)
            top = F.array_max(probabilities)
            return F.struct(F.element_at(names, F.array_position(probabilities, top).cast("int")).alias("label"), top.alias("score"), source["origin_group"].alias("origin"))

        usable = ~F.coalesce(source["is_partial"], F.lit(False)) & (F.coalesce(source["provenance"], F.lit("")) != "searchSnippet") & (F.coalesce(source["temporal_alignment"], F.lit("")) == "compatible") & source["duplicate_of"].isNull()
        none = F.array().cast("array<struct<label:string,score:double,origin:string>>")
        return F.when(usable, F.transform(source["passages"], vote)).otherwise(none)

    cast = F.filter(F.flatten(F.transform("sources", passages)), lambda v: (v["label"] != "neutral") & (v["score"] >= minimum))
    one = F.size(F.array_distinct(F.transform(cast, lambda v: v["origin"]))) == 1
    kept = F.filter(cast, lambda v: v["score"] >= F.when(one, single).otherwise(minimum))
    yes = lambda k: F.exists(kept, lambda v: v["label"] == k)
    nothing = (F.coalesce("found_articles", F.lit(0)) == 0) & (F.coalesce(F.size("sources"), F.lit(0)) <= 0)
    return (
        F.when(F.coalesce("error", F.lit("")) != "", "ERROR").when(nothing, "NAO_ENCONTRADO").when(yes("entailment") & yes("contradiction"), "DIVERGENTE")
        .when(yes("entailment"), "CONFIRMADO").when(yes("contradiction"), "CONTRADITO").otherwise("SEM_INFORMACAO")
    )


def policy_grid(gold: DataFrame, records: DataFrame, temperature: float = 1.0, steps: int = STEPS) -> DataFrame:
    """(i, j, minimum, single, macro_f1, accuracy, coverage, precision) for all i <= j: one shuffle of counts.

    Every record is judged at every grid point where it lies; only (i, j) and counts are shuffled.
    gold: id, verdict; here a case is correct by its verdict.
    """
    grid = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(steps) for j in range(i, steps)]
    both = records.join(gold.select("id", F.col("verdict").alias("expected")), "id").withColumn("g", F.explode(F.array(*grid)))
    at = lambda k: F.lit(0.5) + F.col(f"g.{k}") * STEP
    both = both.select(F.col("g.i").alias("i"), F.col("g.j").alias("j"), "expected", offline_verdict(at("i"), at("j"), temperature).alias("actual"))
    return _grid_report(both)


def _grid_report(both: DataFrame) -> DataFrame:
    """The measures of judged cases (i, j, expected, actual) at every grid point."""
    directional, resolvable, right = F.col("actual").isin(*DIRECTIONAL), F.col("expected").isin(*DIRECTIONAL), F.col("actual") == F.col("expected")
    zero = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), F.count_if(b)), F.lit(0.0))
    return both.groupBy("i", "j").agg(
        macro_f1(both).alias("macro_f1"), zero(right, F.lit(True)).alias("accuracy"), zero(directional & resolvable, resolvable).alias("coverage"), zero(directional & right, directional).alias("precision"),
    ).select("i", "j", (F.lit(0.5) + F.col("i") * STEP).alias("minimum"), (F.lit(0.5) + F.col("j") * STEP).alias("single"), "macro_f1", "accuracy", "coverage", "precision")


def strongest_votes(passages: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(id, origin_group, label, score): the greatest score of each claim, origin and label; a maximum combines before the shuffle.

    passages: id, origin_group, is_partial, provenance, temporal_alignment, duplicate_of, logits. Unusable and neutral ones cast no vote.
    """
    usable = ~F.coalesce("is_partial", F.lit(False)) & (F.coalesce("provenance", F.lit("")) != "searchSnippet") & (F.coalesce("temporal_alignment", F.lit("")) == "compatible") & F.col("duplicate_of").isNull()
    own = passages.where(usable).select("id", "origin_group", softmax(F.col("logits"), temperature).alias("p")).withColumn("score", F.array_max("p"))
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), F.array_position("p", F.col("score")).cast("int"))
    return own.withColumn("label", label).where("label <> 'neutral'").groupBy("id", "origin_group", "label").agg(F.max("score").alias("score"))


def policy_grid_of_votes(gold: DataFrame, claims: DataFrame, votes: DataFrame, steps: int = STEPS) -> DataFrame:
    """``policy_grid`` from ``strongest_votes``: no record is gathered, however many passages a claim has.

    claims: id, found_articles, error. Whether all votes at a minimum have one origin, and the greatest
    score of either label there, decide every grid point of that minimum.
    """
    level = lambda k: F.lit(0.5) + F.col(k) * STEP
    cast = votes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).where(F.col("score") >= level("i"))
    origin = F.struct(F.col("origin_group").isNull().alias("none"), F.coalesce("origin_group", F.lit("")).alias("name"))
    best = lambda k: F.max(F.when(F.col("label") == k, F.col("score")))
    per = cast.groupBy("id", "i").agg((F.min(origin) == F.max(origin)).alias("one"), best("entailment").alias("_yes"), best("contradiction").alias("_no"))
    grid = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(steps) for j in range(i, steps)]
    cases = claims.join(gold.select("id", F.col("verdict").alias("expected")), "id").withColumn("g", F.explode(F.array(*grid)))
    both = cases.select("id", "found_articles", "error", "expected", F.col("g.i").alias("i"), F.col("g.j").alias("j")).join(per, ["id", "i"], "left")
    bound = F.when(F.col("one"), level("j")).otherwise(level("i"))
    yes, no = (F.coalesce(F.col(k) >= bound, F.lit(False)) for k in ("_yes", "_no"))
    actual = (
        F.when(F.coalesce("error", F.lit("")) != "", "ERROR").when(F.coalesce("found_articles", F.lit(0)) == 0, "NAO_ENCONTRADO").when(yes & no, "DIVERGENTE")
        .when(yes, "CONFIRMADO").when(no, "CONTRADITO").otherwise("SEM_INFORMACAO")
    )
    return _grid_report(both.select("i", "j", "expected", actual.alias("actual")))


def selected_policy(grid: DataFrame, precision: float = 0.9, coverage: float = 0.7) -> DataFrame:
    """The best grid point that meets both targets: macro F1, accuracy, coverage, precision, then the first; no row if none does."""
    ok = grid.where((F.col("precision") >= precision) & (F.col("coverage") >= coverage))
    order = [F.round(c, 12) for c in ("macro_f1", "accuracy", "coverage", "precision")]
    return ok.orderBy(*[F.desc_nulls_last(o) for o in order], "i", "j").limit(1)


def gate_errors(r: Column) -> Column:
    """What keeps a release report (a struct) from promotion, as an array of codes; empty promotes.

    budget: and measure: are followed by the name of each device over its budget, or without storage or repeated runs.
    """
    value = lambda side, name: F.coalesce(r[side][name], F.lit(0.0))
    no = lambda name: ~F.coalesce(r[name], F.lit(False))
    fields = ("name", "peak_ram_mb", "p95_seconds", "free_storage_mb", "repeated")
    none = F.array().cast("array<struct<name:string,peak_ram_mb:double,p95_seconds:double,free_storage_mb:double,repeated:boolean>>")
    devices = F.coalesce(F.transform(r["devices"], lambda d: F.struct(*[d[k].alias(k) for k in fields])), none)
    number = lambda d: F.coalesce(F.regexp_extract(d["name"], r"iPhone\s+(\d+)", 1).try_cast("int"), F.lit(0))
    over = lambda d: (F.coalesce(d["peak_ram_mb"], F.lit(float("inf"))) >= 1000) | (F.coalesce(d["p95_seconds"], F.lit(float("inf"))) > 15)
    bare = lambda d: (F.coalesce(d["free_storage_mb"], F.lit(0.0)) == 0) | ~F.coalesce(d["repeated"], F.lit(False))
    named = lambda code, bad: F.transform(F.filter(devices, bad), lambda d: F.concat(F.lit(code + ":"), F.coalesce(d["name"], F.lit("?"))))
    rules = [
        ((F.coalesce(r["blind_test_claims"], F.lit(0)) < 300) | (F.coalesce(r["blind_test_sha256"], F.lit("")) == ""), "blindTest"),
        (value("candidate", "directional_precision") < 0.90, "precision"),
        (value("candidate", "resolvable_coverage") < 0.70, "coverage"),
        (value("candidate", "accuracy") <= value("baseline", "accuracy"), "noGain"),
        (value("candidate", "total_coverage") < value("baseline", "total_coverage") - 0.03, "coverageLoss"),
        (no("tokenizer_parity") | no("model_parity"), "parity"),
        (no("critical_regressions"), "regressions"),
        (~F.exists(devices, lambda d: d["name"] == "iPhone 13") | ~F.exists(devices, lambda d: number(d) > 13), "devices"),
    ]
    last = [((F.coalesce(r["model_sha256"], F.lit("")) == "") | (F.coalesce(r["policy_version"], F.lit("")) == ""), "versions")]
    codes = lambda some: F.array(*[F.when(bad, code) for bad, code in some])
    return F.filter(F.concat(codes(rules), named("budget", over), named("measure", bare), codes(last)), lambda x: x.isNotNull())


def stability(pairs: DataFrame, group: str = "grupo", predicted: str = "predicted", allowed: str = "correct") -> DataFrame:
    """(group, n, stable, stable_correct): whether all variants of a family get one label, and the right one."""
    return pairs.groupBy(group).agg(
        F.count("*").alias("n"), (F.min(predicted) == F.max(predicted)).alias("stable"),
        ((F.min(predicted) == F.max(predicted)) & F.bool_and(allowed)).alias("stable_correct"),
    )


def threshold_sweep(rows: DataFrame, score: str, truth: str, thresholds: list[float], by: list[str]) -> DataFrame:
    """(by…, threshold, n, hits): how often ``score >= threshold`` agrees with ``truth``."""
    each = rows.select(*by, F.col(score).alias("s"), F.col(truth).alias("t"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    return each.groupBy(*by, "threshold").agg(F.count("*").alias("n"), F.count_if((F.col("s") >= F.col("threshold")) == F.col("t")).alias("hits"))


def label_order(probes: DataFrame, logits: str = "logits", expected: str = "expected") -> DataFrame:
    """(order) permutations of the labels under which every probe's greatest logit has its expected label."""
    from itertools import permutations

    names = [F.struct(F.lit(",".join(p)).alias("order"), F.array(*[F.lit(x) for x in p]).alias("names")) for p in permutations(LABELS)]
    each = probes.select(F.col(logits).alias("z"), F.col(expected).alias("e"), F.explode(F.array(*names)).alias("p"))
    said = F.element_at(F.col("p.names"), F.array_position("z", F.array_max("z")).cast("int"))
    return each.groupBy(F.col("p.order").alias("order")).agg(F.bool_and(said == F.col("e")).alias("ok")).where("ok").select("order")


def best_epoch(epochs: DataFrame, epoch: str = "epoch", f1: str = "f1", loss: str = "loss") -> DataFrame:
    """(epoch, f1, loss) of greatest F1 to twelve digits, then least loss, then the first."""
    return epochs.orderBy(F.desc(F.round(f1, 12)), F.asc(loss), F.asc(epoch)).limit(1).select(epoch, f1, loss)


def training_pairs(records: DataFrame) -> DataFrame:
    """(id, premise, hypothesis, label) of the pairs of reviewed train and calibration records; no other split takes part."""
    rows = records.where(F.col("split").isin("train", "calibration") & (F.col("review_status") == "reviewed"))
    return rows.select("id", F.explode("pairs").alias("p")).select("id", "p.premise", "p.hypothesis", "p.label").where(F.col("label").isin(*LABELS))


def missing_labels(pairs: DataFrame) -> DataFrame:
    """(label) of the three that no pair has; a training set must have none."""
    all_ = pairs.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    return all_.join(pairs.select("label").distinct(), "label", "left_anti")


def negation_coverage(claims: DataFrame, negations: DataFrame, key: str = "claim_id") -> DataFrame:
    """(claims, skipped): how many claims have no automatic negation."""
    both = claims.select(key).join(negations.select(key).distinct().withColumn("_has", F.lit(True)), key, "left")
    return both.agg(F.count("*").alias("claims"), F.count_if(F.col("_has").isNull()).alias("skipped"))


def tagged(parts: dict[str, DataFrame], into: str = "part") -> DataFrame:
    """The rows of all ``parts``, which have the same columns, with the name of each row's part."""
    out = None
    for name, df in parts.items():
        own = df.withColumn(into, F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def same_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(only_left, only_right): how many distinct keys one side alone has; both 0 where the sets are equal."""
    seen = tagged({"l": left.select(key), "r": right.select(key)}).groupBy(key).agg(F.bool_or(F.col("part") == "l").alias("l"), F.bool_or(F.col("part") == "r").alias("r"))
    return seen.agg(F.count_if(~F.col("r")).alias("only_left"), F.count_if(~F.col("l")).alias("only_right"))


def class_summary(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(n, accuracy, macro_f1, weighted_loss) of rows (truth, predicted, p by the order of LABELS); nulls where there are none.

    The loss of a row is the logarithm of its true label's probability, weighted by the label.
    """
    names = F.array(*[F.lit(x) for x in LABELS])
    own = F.element_at("p", F.array_position(names, F.col("truth")).cast("int"))
    w = F.coalesce(*[F.when(F.col("truth") == k, F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
    of = lambda x: F.try_divide(2.0 * F.count_if((F.col("truth") == x) & (F.col("predicted") == x)), F.count_if(F.col("truth") == x) + F.count_if(F.col("predicted") == x))
    f1 = sum((F.coalesce(of(x), F.lit(0.0)) for x in LABELS[1:]), F.coalesce(of(LABELS[0]), F.lit(0.0))) / len(LABELS)
    return rows.agg(F.count("*").alias("n"), F.try_divide(F.count_if(F.col("truth") == F.col("predicted")).cast("double"), F.count("*")).alias("accuracy"), f1.alias("macro_f1"), F.try_divide(F.sum(-F.log(F.greatest(F.lit(1e-15), own)) * w), F.sum(w)).alias("weighted_loss"))
