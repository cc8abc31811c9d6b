"""URL expressions. Invalid URLs give null parts, never an error."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from clarion.functions.text import let

# The allowed domains, the fact-check domains, display names.
ALLOWLIST = (
    "g1.globo.com", "oglobo.globo.com", "folha.uol.com.br", "estadao.com.br", "cnnbrasil.com.br", "veja.abril.com.br",
    "valor.globo.com", "exame.com", "r7.com", "terra.com.br", "metropoles.com", "poder360.com.br", "gauchazh.clicrbs.com.br",
    "correiobraziliense.com.br", "agenciabrasil.ebc.com.br", "otempo.com.br", "www.band.com.br", "ge.globo.com", "aosfatos.org",
    "www.agencialupa.org", "bbc.com", "dw.com", "elpais.com", "apnews.com", "gov.br", "agenciagov.ebc.com.br", "camara.leg.br",
    "senado.leg.br", "stf.jus.br", "tse.jus.br", "who.int",
)
FACT_CHECK = ("aosfatos.org", "www.agencialupa.org", "g1.globo.com", "estadao.com.br")
NAMES = {
    "g1.globo.com": "G1", "aosfatos.org": "Aos Fatos", "agencialupa.org": "Lupa", "agenciabrasil.ebc.com.br": "Agência Brasil",
    "bbc.com": "BBC", "who.int": "OMS", "camara.leg.br": "Câmara dos Deputados", "senado.leg.br": "Senado Federal",
    "tse.jus.br": "Tribunal Superior Eleitoral", "stf.jus.br": "Supremo Tribunal Federal",
}


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    """Lower-case host without trailing dots; null where there is none."""
    return let(F.regexp_replace(F.lower(part(url, "HOST")), r"\.+$", ""), lambda h: F.when(h != "", h))


def canonical_host(value: Column) -> Column:
    """A host without trailing dots and without one leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"\.+$", ""), r"^www\.", "")


def suffixes(value: Column) -> Column:
    """All domain suffixes of a host, longest first: ``a.b.c``, ``b.c``, ``c``."""
    each = lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return let(F.split(value, r"\."), each)


def canonical_online(url: Column) -> Column:
    """No fragment, lower-case host without ``www.``, no tracking parameters, no slashes at the ends.

    Other query parameters stay in their order; a URL that can't be parsed stays as it is.
    """
    query = part(url, "QUERY")
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(utm_|(fbclid|gclid)(=|$))")), "&")
    clean = F.concat(
        part(url, "PROTOCOL"), F.lit("://"), F.coalesce(F.concat(part(url, "USERINFO"), F.lit("@")), F.lit("")),
        F.replace(F.lower(part(url, "HOST")), F.lit("www."), F.lit("")), F.coalesce(F.concat(F.lit(":"), port(url)), F.lit("")),
        F.coalesce(part(url, "PATH"), F.lit("")), F.when(F.coalesce(kept, F.lit("")) != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")),
    )
    return F.coalesce(F.regexp_replace(clean, "^/+|/+$", ""), url)


def canonical_offline(url: Column) -> Column:
    """Scheme, lower-case authority without one leading ``www.``, path without trailing slashes; no query or fragment."""
    authority = F.regexp_replace(F.lower(part(url, "AUTHORITY")), r"^www\.", "")
    return F.concat(part(url, "PROTOCOL"), F.lit("://"), authority, F.regexp_replace(F.coalesce(part(url, "PATH"), F.lit("")), "/+$", ""))


def port(url: Column) -> Column:
    return F.nullif(F.regexp_extract(part(url, "AUTHORITY"), r":(\d+)$", 1), F.lit(""))


def secure(url: Column) -> Column:
    """HTTPS without user information."""
    return F.coalesce((F.lower(part(url, "PROTOCOL")) == "https") & part(url, "USERINFO").isNull(), F.lit(False))


def base_domain(value: Column) -> Column:
    return F.substring_index(value, ".", -2)


def same_family(a: Column, b: Column) -> Column:
    """Equal hosts, one under the other, or equal in their last two labels; one leading ``www.`` doesn't count."""
    a, b = canonical_host(a), canonical_host(b)
    return (a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)) | (base_domain(a) == base_domain(b))


def profile(domain: Column) -> Column:
    """(name, kind, editorial_origin, specialties) of a domain."""
    return let(F.replace(domain, F.lit("www."), F.lit("")), _profile)


def _profile(clean: Column) -> Column:
    named = F.create_map(*[F.lit(x) for x in chain.from_iterable(NAMES.items())])
    primary = clean.endswith("gov.br") | clean.endswith("leg.br") | clean.endswith("jus.br") | (clean == "who.int")
    return F.struct(
        F.coalesce(F.try_element_at(named, clean), clean).alias("name"),
        F.when(primary, "primary").when(clean.isin("aosfatos.org", "agencialupa.org"), "factCheck").otherwise("journalism").alias("kind"),
        F.when(clean.endswith("globo.com"), "grupo-globo").when(clean.endswith("ebc.com.br"), "ebc").otherwise(clean).alias("editorial_origin"),
        F.when(clean == "who.int", F.array(F.lit("saude"))).when(clean == "tse.jus.br", F.array(F.lit("eleicoes"))).otherwise(F.array().cast("array<string>")).alias("specialties"),
    )


def search_domains(kind: Column) -> Column:
    """Domains a search is restricted to: the fact-check ones, or all, sorted."""
    return F.when(kind == "factCheck", F.array(*[F.lit(d) for d in FACT_CHECK])).otherwise(F.array(*[F.lit(d) for d in sorted(ALLOWLIST)]))


def matched_domain(value: Column, entries: tuple[str, ...] = ALLOWLIST) -> Column:
    """The longest entry that a host equals or ends with after a dot, as written; null without one.

    One leading ``www.`` doesn't count on either side. The entries are a short fixed list,
    so they are literals of the plan; a table of entries is joined by ``operators.domains``.
    """
    known = {}
    for e in entries:
        known.setdefault(e.lower().rstrip(".").removeprefix("www."), e)
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    found = F.filter(suffixes(canonical_host(value)), lambda s: F.map_contains_key(table, s))
    return let(F.try_element_at(found, F.lit(1)), lambda s: F.try_element_at(table, s))


def allowed(url: Column, entries: tuple[str, ...] = ALLOWLIST) -> Column:
    """HTTPS, no user information, and a host under an entry; false for invalid URLs."""
    return F.coalesce(secure(url) & matched_domain(host(url), entries).isNotNull(), F.lit(False))
