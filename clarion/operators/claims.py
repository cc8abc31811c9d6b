"""Claims: length check, sentences, temporal context, search queries, temporal alignment.

Times are instants; days begin at midnight of ``ZONE``. The session time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clarion.functions.text import fold, let, sentences, truncate
from clarion.functions.urls import search_domains

ZONE = "America/Sao_Paulo"
LEAST, MOST, QUERY = 15, 1000, 200

# Words of dependence, attribution and time; month names.
DEPENDENT = r"^(ele|ela|eles|elas|isso|isto|esse|essa|esses|essas|por isso|além disso|também)\b"
COMPOUND = r"\s(?:e|mas|porém|enquanto)\s+(?:a|o|os|as|um|uma)\s+\p{Lu}[\p{L}]+\s"
ATTRIBUTION = r"\b(diz|disse|afirma|afirmou|alega|alegou|segundo|de acordo com)\b"
NEAR_DAY = r"\b(hoje|ontem)\b"
DATE = r"\b(\d{1,2})/(\d{1,2})/(20\d{2}|19\d{2})\b"
YEAR = r"\b((?:19|20)\d{2})\b"
CURRENT = r"\b(atualmente|atual|agora|e presidente|preside|ocupa o cargo|esta no cargo)\b"
RECENT = r"\b(recentemente|nesta semana|esta semana|ultimos dias|acabou de)\b"
NEGATIONS = ("não", "nunca", "jamais", "nem")
MONTHS = (
    "janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro",
)


def validity(text: Column) -> Column:
    """(status, characters missing or in excess) of a claim: empty, tooShort, tooLong or valid."""
    n = F.length(F.btrim(text))
    return F.struct(
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n < LEAST, "tooShort").when(n > MOST, "tooLong").otherwise("valid").alias("status"),
        F.when(F.coalesce(n, F.lit(0)) == 0, 0).when(n < LEAST, LEAST - n).when(n > MOST, n - MOST).otherwise(0).alias("delta"),
    )


def candidates(text: Column) -> Column:
    """The distinct sentences of a claim in order; without any, the claim itself."""
    found = F.array_distinct(sentences(text))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.btrim(text)))


def needs_rephrasing(text: Column, strict: bool = False) -> Column:
    """Whether a sentence leans on another one, or joins two statements.

    The words of dependence are looked for in folded text, where the two that have accents
    never occur; ``strict`` folds them as well.
    """
    pattern = DEPENDENT.replace("além", "alem").replace("também", "tambem") if strict else DEPENDENT
    return F.exists(candidates(text), lambda s: fold(s).rlike(pattern) | s.rlike(COMPOUND))


def _day(at: Column, days: int = 0) -> Column:
    """Midnight of ``at``'s day in ZONE, ``days`` later."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(at, ZONE)) + F.make_dt_interval(F.lit(days)), ZONE)


def context(text: Column, reference: Column) -> Column:
    """(kind, start, end, attributed) of a claim made at ``reference``; the first rule that holds decides.

    A date that doesn't exist counts as its year. The text is folded once and searched once for each pattern.
    """
    part = lambda k: F.nullif(F.regexp_extract(text, DATE, k), F.lit("")).cast("int")
    date = F.when(text.rlike(DATE), F.try_make_timestamp(part(3), part(2), part(1), F.lit(0), F.lit(0), F.lit(0)))
    year = F.nullif(F.regexp_extract(text, YEAR, 1), F.lit("")).cast("int")
    found = F.struct(fold(text).alias("lower"), date.alias("date"), F.try_make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("begin"))
    return let(found, lambda x: _context(x["lower"], x["date"], x["begin"], reference))


def _context(lower: Column, date: Column, begin: Column, reference: Column) -> Column:
    day = F.when(lower.contains("ontem"), _day(reference, -1)).otherwise(_day(reference))
    utc = lambda local: F.to_utc_timestamp(local, ZONE)

    def window(kind: str, start: Column, end: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), lower.rlike(ATTRIBUTION).alias("attributed"))

    none = F.lit(None).cast("timestamp")
    return (
        F.when(lower.rlike(NEAR_DAY), window("recent", day, _day(day, 1)))
        .when(date.isNotNull(), window("historical", utc(date), utc(date + F.make_dt_interval(F.lit(1)))))
        .when(begin.isNotNull(), window("historical", utc(begin), utc(begin + F.make_ym_interval(F.lit(1)))))
        .when(lower.rlike(CURRENT), window("current", _day(reference, -30), reference))
        .when(lower.rlike(RECENT), window("recent", _day(reference, -7), reference))
        .otherwise(window("timeless", none, none))
    )


def alignment(kind: Column, start: Column, end: Column, published: Column, text: Column) -> Column:
    """compatible, incompatible or unknown: whether a text published then can speak of the claim's time.

    A historical claim's own year (of a window over 300 days) or date in the text makes it compatible.
    """
    local = F.from_utc_timestamp(start, ZONE)
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(local))
    words = F.concat(F.dayofmonth(local).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(local).cast("string"))
    said = fold(text)
    dated = said.contains(F.date_format(local, "dd/MM/yyyy")) | said.contains(F.date_format(local, "yyyy-MM-dd")) | said.contains(fold(words))
    long = (F.unix_seconds(end) - F.unix_seconds(start)) > 300 * 86400
    named = (long & text.contains(F.year(local).cast("string"))) | dated
    return (
        F.when(kind == "timeless", "compatible").when(published.isNull(), "unknown")
        .when((kind == "historical") & F.coalesce(named, F.lit(False)), "compatible")
        .when(F.coalesce(published < start, F.lit(False)) | F.coalesce(published > end, F.lit(False)), "incompatible")
        .otherwise("compatible")
    )


def planned(text: Column, kind: Column, start: Column, reference: Column) -> Column:
    """The searches of a claim: an array of (kind, text), texts distinct and not empty, the first of equal ones kept."""
    day = F.concat(F.lit("em "), F.date_format(F.from_utc_timestamp(start, ZONE), "yyyy-MM-dd"))
    named = F.when(start.isNull(), text).otherwise(F.regexp_replace(text, F.lit(r"(?iu)\b(hoje|ontem)\b"), F.coalesce(day, F.lit(""))))
    today = F.date_format(F.from_utc_timestamp(reference, ZONE), "yyyy-MM-dd")

    def made(whole: Column) -> Column:
        primary = truncate(whole, QUERY)
        suffix = F.right(whole, F.lit(QUERY))
        rest = F.when(suffix.contains(" "), F.regexp_replace(suffix, r"^[^ ]* ", "")).otherwise(suffix)
        contextual = (
            F.when(F.length(whole) > QUERY, rest)
            .when(kind == "current", F.concat(truncate(whole, 175), F.lit(" "), today))
            .otherwise(primary)
        )
        return F.array(
            F.struct(F.lit("descriptive").alias("kind"), primary.alias("text")),
            F.struct(F.lit("contextual").alias("kind"), truncate(contextual, QUERY).alias("text")),
            F.struct(F.lit("factCheck").alias("kind"), F.concat(truncate(whole, 188), F.lit(" checagem")).alias("text")),
        )

    own = lambda q: let(F.transform(q, lambda x: x["text"]), lambda t: F.filter(q, lambda x, i: (x["text"] != "") & (F.array_position(t, x["text"]) == i + 1)))
    return let(let(named, made), own)


def negated(text: Column, verb: Column) -> Column:
    """The claim's negation: its first negating word taken out, else one set before the first verb, else null.

    ``verb`` is a tagger's place of the first verb among the words, from 0; null where it is unknown.
    """
    words = F.split(text, r"\s+")
    at = F.array_position(F.transform(words, lambda w: F.lower(w).isin(*NEGATIONS)), True)
    without = F.concat(F.slice(words, F.lit(1), (at - 1).cast("int")), F.slice(words, (at + 1).cast("int"), F.size(words)))
    inside = verb.between(0, F.size(words) - 1)
    with_ = F.concat(F.slice(words, F.lit(1), F.greatest(verb, F.lit(0))), F.array(F.lit(NEGATIONS[0])), F.slice(words, F.greatest(verb, F.lit(0)) + 1, F.size(words)))
    return F.array_join(F.when(at > 0, without).when(inside, with_), " ")


def query_plan(claims: DataFrame, claim_id: str = "claim_id", text: str = "text", reference: str = "reference_ts") -> DataFrame:
    """(claim_id, ordinal, kind, text, domains): the searches of each claim. Each text is worked on once; all narrow, no shuffle."""
    c = claims.select(F.col(claim_id).alias("claim_id"), F.col(text).alias("text"), F.col(reference).alias("reference_ts"))
    c = c.withColumn("context", context(F.col("text"), F.col("reference_ts")))
    rows = c.select("claim_id", F.posexplode(planned(F.col("text"), F.col("context.kind"), F.col("context.start"), F.col("reference_ts"))).alias("ordinal", "q"))
    return rows.select("claim_id", "ordinal", "q.kind", "q.text", search_domains(F.col("q.kind")).alias("domains"))


def first_query(text: Column) -> Column:
    """The first sentence of a claim, cut to the length of a search."""
    return truncate(F.coalesce(F.try_element_at(candidates(text), F.lit(1)), F.lit("")), QUERY)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rank-limited before the shuffle."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def catalog_matches(claims: DataFrame, catalog: DataFrame) -> DataFrame:
    """(claim_id, entry_id) of historical claims (claim_id, text, kind, start) that a reviewed entry settles.

    Entries (id, claim, entities, event_year, verdict, url, excerpt, status, reviewer_ids, position)
    match by year and equal term sequence, an equi-join; of several the first by position counts.
    """
    from clarion.functions.text import terms
    from clarion.functions.urls import allowed

    own = claims.where("kind = 'historical' and start is not null").select(
        "claim_id", fold(F.col("text")).alias("folded"), F.year(F.from_utc_timestamp("start", ZONE)).alias("event_year"), terms(F.col("text")).alias("terms")
    )
    entry = catalog.where(
        (F.col("status") == "reviewed") & (F.size(F.array_distinct("reviewer_ids")) >= 2) & F.col("verdict").isin("CONFIRMADO", "CONTRADITO")
        & allowed(F.col("url")) & F.length("excerpt").between(1, 300)
    ).select("id", "position", "event_year", "entities", terms(F.col("claim")).alias("terms"))
    both = own.join(entry, ["event_year", "terms"]).where(F.forall("entities", lambda e: F.col("folded").contains(fold(e))))
    return both.groupBy("claim_id").agg(F.min_by("id", F.struct("position", "id")).alias("entry_id"))
