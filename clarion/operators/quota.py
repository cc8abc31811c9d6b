"""Search requests: validation, the body sent on, and the monthly quota as a fold in arrival order.

A request is accepted if its lane has room in the month and fewer than ``burst`` requests
of its minute were accepted; rejected ones change nothing. The decision depends on all
earlier ones, so it is a fold, but a bounded one: in a minute only the first ``burst``
requests of each lane can be accepted. Those candidates alone are folded, per month; how
many requests a month has doesn't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LIMITS = {"production": 800, "evaluation": 200}
BURST = 30

# What a search asks of its provider.
SEARCH = {
    "search_depth": "basic", "max_results": 20, "include_answer": False, "auto_parameters": False, "include_raw_content": False,
    "include_images": False, "include_image_descriptions": False, "include_usage": True, "include_published_date": True,
    "chunks_per_source": 3, "language": "pt", "filter_by_language": True, "include_domains_mode": "restrict",
}


def request_status(method: Column, content_type: Column, body: Column, configured: Column | None = None, key_ok: Column | None = None) -> Column:
    """(status, code) of a request; the first check that fails decides, 200 and null pass.

    ``body`` is binary. Lengths are counted in code points. ``key_ok``: null without a key.
    """
    text = F.try_validate_utf8(body.cast("string"))
    parsed = F.try_parse_json(text)
    query = F.btrim(F.try_variant_get(parsed, "$.query", "string"))
    typed = F.schema_of_variant(F.coalesce(F.try_variant_get(parsed, "$.query", "variant"), F.parse_json(F.lit("null"))))
    kind = F.coalesce(F.lower(content_type), F.lit(""))
    fail = lambda status, code: F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
    return (
        F.when(~F.coalesce(method == "POST", F.lit(False)), fail(405, "method_not_allowed"))
        .when(~F.coalesce(configured if configured is not None else F.lit(True), F.lit(False)), fail(503, "configuration"))
        .when(~kind.startswith("application/json"), fail(400, "invalid_body"))
        .when(F.octet_length(body) > 8192, fail(413, "invalid_body"))
        .when(parsed.isNull(), fail(400, "invalid_body"))
        .when(query.isNull() | (typed != "STRING"), fail(400, "invalid_query"))
        .when(~F.length(query).between(1, 200), fail(400, "invalid_query"))
        .when(~F.coalesce(key_ok if key_ok is not None else F.lit(True), F.lit(True)), fail(403, "unauthorized"))
        .otherwise(F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("code")))
    )


def key_matches(given: Column, secret: Column) -> Column:
    """Whether a request's key is the server's, compared by digests; false where the server has none."""
    return F.coalesce((F.sha2(given, 256) == F.sha2(secret, 256)) & (secret != ""), F.lit(False))


def search_body(body: Column, domains: Column) -> Column:
    """What is sent on for a valid request: its query and the server's own parameters; dates only if they exist."""
    v = F.try_parse_json(body)
    get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    topic = F.when(get("topic") == "news", "news").otherwise("general")
    start = get("start_date")
    real = start.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.date_format(F.try_to_date(start, "yyyy-MM-dd"), "yyyy-MM-dd") == start, F.lit(False))
    return F.struct(
        F.btrim(get("query")).alias("query"), *[F.lit(x).alias(k) for k, x in SEARCH.items()], domains.alias("include_domains"), topic.alias("topic"),
        F.when((topic == "general") & (get("country") == "brazil"), "brazil").alias("country"),
        F.when((topic == "news") & (get("time_range") == "year"), "year").alias("time_range"), F.when(real, start).alias("start_date"),
    )


def error_code(status: Column, header: Column | None = None) -> Column:
    """Meaning of a provider's status: quota_exceeded, rate_limited, a timeout that may be tried again, or failed."""
    by_status = (
        F.when(status.isin(432, 433), "quota_exceeded").when(status == 429, "rate_limited").when(status == 401, "unauthorized")
        .when(status == 408, "timeout").when(status >= 500, "unavailable").when(~status.between(200, 299), "failed")
    )
    return by_status if header is None else F.coalesce(header, by_status)


#: What a month carries on: of each lane how many are accepted, of the month its last accepted minute and how many of that minute.
STATE = "period string, lane string, used bigint, minute bigint, in_minute bigint"


def _fold(rows: pd.DataFrame, state: pd.DataFrame, limits: dict[str, int], burst: int) -> tuple[list[tuple[int, int]], dict[str, int], int, int]:
    """(place, lane's count) of the accepted candidates of one month, in order; then the month's counts, minute and count of that minute."""
    used, minute, in_minute, out = dict.fromkeys(limits, 0), -1, 0, []
    if len(state):
        used.update((k, int(n)) for k, n in zip(state["lane"], state["used"]) if k in limits)
        minute, in_minute = int(state["minute"].iloc[0]), int(state["in_minute"].iloc[0])
    for k, (lane, m) in enumerate(zip(rows["lane"], rows["minute"])):
        if used[lane] < limits[lane] and (m != minute or in_minute < burst):
            in_minute = in_minute + 1 if m == minute else 1
            minute = int(m)
            used[lane] += 1
            out.append((k, used[lane]))
    return out, used, minute, in_minute


def decided(
    requests: DataFrame, state: DataFrame, limits: dict[str, int] | None = None, burst: int = BURST, ts: str = "ts", request_id: str = "request_id", lane: str = "lane", paths: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """What ``reserved`` gives for requests that come after those of ``state`` (columns of STATE), and the state after them.

    Of a batch too, only the first ``burst`` of a minute and lane can be accepted: those that
    follow find the minute or the lane as full as the last of these did. ``paths`` gets the
    written folders, for a caller that removes them.
    """
    from clarion.functions.lineage import stored

    limits = limits or LIMITS
    own = requests.select(
        F.col(request_id).alias("request_id"), F.col(ts).alias("ts"), F.date_format(F.col(ts), "yyyy-MM").alias("period"),
        F.floor(F.unix_seconds(F.col(ts)) / 60).cast("bigint").alias("minute"), F.col(lane).alias("lane"), F.struct(F.col(ts).alias("ts"), F.col(request_id).alias("id")).alias("seq"),
    )
    first = F.row_number().over(Window.partitionBy("period", "minute", "lane").orderBy("seq"))
    candidates = own.where(F.col("lane").isin(*limits) & F.col("ts").isNotNull()).withColumn("_n", first).where(F.col("_n") <= burst)
    # At most burst rows per minute and lane: a month is bounded whatever its traffic.
    candidates = candidates.select("period", "minute", "lane", "request_id", "ts")
    id_type = own.schema["request_id"].dataType.simpleString()

    def fold(key: tuple, rows: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ts", "request_id"], kind="stable").reset_index(drop=True)
        got, used, minute, in_minute = _fold(rows, before, limits, burst)
        accepted = rows.loc[[k for k, _ in got], ["request_id", "lane", "ts"]].assign(used=[n for _, n in got], minute=None, in_minute=None)
        after = pd.DataFrame({"request_id": None, "lane": list(used), "ts": pd.NaT, "used": list(used.values()), "minute": minute, "in_minute": in_minute})
        out = pd.concat([accepted.astype(object), after.astype(object)], ignore_index=True).assign(period=key[0])
        return out[["request_id", "period", "lane", "ts", "used", "minute", "in_minute"]]

    folded = candidates.groupBy("period").cogroup(state.groupBy("period")).applyInPandas(fold, f"request_id {id_type}, period string, lane string, ts timestamp, used bigint, minute bigint, in_minute bigint")
    folded = stored(folded, paths)
    accepted, after = folded.where(F.col("minute").isNull()), folded.where(F.col("minute").isNotNull()).select("period", "lane", "used", "minute", "in_minute")
    full = F.coalesce(*[F.when(F.col("lane") == k, F.lit(n)) for k, n in limits.items()], F.lit(0))
    # A lane's last accepted request, or none if it was full before these.
    ends = accepted.where(F.col("used") == full).select("period", "lane", F.struct("ts", F.col("request_id").alias("id")).alias("end"))
    closed = state.where(F.col("used") >= full).select("period", "lane", F.lit(True).alias("_closed"))
    rows = own.join(accepted.select("request_id", F.lit(True).alias("_ok")), "request_id", "left").join(ends, ["period", "lane"], "left").join(closed, ["period", "lane"], "left")
    exhausted = (full == 0) | F.coalesce("_closed", F.lit(False)) | F.coalesce(F.col("seq") > F.col("end"), F.lit(False))
    ok = F.coalesce("_ok", F.lit(False))
    reason = F.when(ok, None).when(exhausted, "quota_exceeded").otherwise("rate_limited").alias("reason")
    return rows.select("request_id", "period", "minute", "lane", ok.alias("accepted"), reason), after


def reserved(requests: DataFrame, limits: dict[str, int] | None = None, burst: int = BURST, ts: str = "ts", request_id: str = "request_id", lane: str = "lane") -> DataFrame:
    """(request_id, period, minute, lane, accepted, reason): reason is quota_exceeded or rate_limited.

    Requests arrive in the order of (ts, request_id), which must be unique. Months are of
    UTC, a minute is 60 seconds of the epoch. A lane that ``limits`` lacks accepts nothing,
    and a request without a time is not accepted.
    At most the sum of the limits is accepted per month, and that is all that is joined back.
    """
    return decided(requests, requests.sparkSession.createDataFrame([], STATE), limits, burst, ts, request_id, lane)[0]


def session_caps(calls: DataFrame, session: str, kind: str, order: list[Column], caps: dict[str, int] | None = None) -> DataFrame:
    """The calls of a session that its budget allows: 3 searches and 24 pairs, the first in order."""
    caps = caps or {"search": 3, "pair": 24}
    n = F.row_number().over(Window.partitionBy(session, kind).orderBy(*order))
    most = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in caps.items()], F.lit(0))
    return calls.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def session_deadlines(calls: DataFrame, session: str, kind: str, order: list[Column], at: Column, network: float = 11.0, total: float = 15.0, reserve: float = 0.15) -> DataFrame:
    """``calls`` with ``refused``: why a session's call is not made, null for those that are.

    ``at`` is the call's seconds since the session began. Searches end with the network's time,
    all else with the total less a reserve; of the calls in time ``session_caps`` counts the first.
    """
    late = F.when(F.col(kind) == "search", at >= network).otherwise(at >= total - reserve)
    own = calls.withColumn("_late", F.coalesce(late, F.lit(True)))
    n = F.sum(F.when(~F.col("_late"), 1).otherwise(0)).over(Window.partitionBy(session, kind).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    most = F.when(F.col(kind) == "search", 3).otherwise(24)
    return own.withColumn("refused", F.when(F.col("_late"), "deadlineExceeded").when(n > most, F.concat(F.col(kind), F.lit("BudgetExceeded")))).drop("_late")


def fold_batches(batches: Iterator[pd.DataFrame], state: tuple[int, int, int, int], limits: dict[str, int], burst: int) -> tuple[pd.DataFrame, tuple[int, int, int, int]]:
    """One step of the streaming form: decisions for a month's new requests, and the state after them."""
    rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "request_id"], kind="stable")
    production, evaluation, minute, count = state
    used = {"production": production, "evaluation": evaluation}
    out = []
    for rid, lane, m in zip(rows["request_id"], rows["lane"], rows["minute"]):
        room = used.get(lane, 0) < limits.get(lane, 0)
        ok = room and (m != minute or count < burst)
        if ok:
            count = count + 1 if m == minute else 1
            minute = m
            used[lane] += 1
        out.append((rid, lane, int(m), ok, None if ok else "rate_limited" if room else "quota_exceeded"))
    return pd.DataFrame(out, columns=["request_id", "lane", "minute", "accepted", "reason"]), (used["production"], used["evaluation"], int(minute), int(count))
