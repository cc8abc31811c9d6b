"""Rules for passages and pages: what is no prose, what looks blocked, paid for, or noisy."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from clarion.functions.text import collapse, fold, folded_text, let

# Phrases of navigation and footers, patterns of bylines, dates, times, credits, paywalls, noise, blocked pages and article links, least sizes.
NAVIGATION = (
    "navegue direto pelo app", "mais lidas", "leia também", "leia mais", "veja também", "continua depois da publicidade",
    "compartilhe", "últimas notícias", "pular para o conteúdo", "todos os direitos reservados", "receba as principais notícias",
    "assine a newsletter", "newsletter", "clique aqui", "web stories",
)
CHROME = (
    r"\bPor\s+\p{Lu}[\p{L}'-]+(?:\s+(?:d[aeo]s?\s+)?\p{Lu}[\p{L}'-]+)*\*?",
    r"\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    r"\b\d{1,2}h\d{2}\b",
    r"\b\d{1,2}:\d{2}\b",
    r"\b(?:Atualizado|Publicado)(?:\s+em)?\b",
    r"\b(?:Foto|Fotos|Imagem|Imagens|Crédito|Créditos|Arte|Ilustração|Legenda|Reprodução|Divulgação)\s*:.*$",
)
# What each of these patterns can't match without, one of them: most texts have none.
CHROME_NEEDS = (("Por",), ("/",), ("h",), (":",), ("Atualizado", "Publicado"), (":",))
EDGES = " —–-•|,;:"
LEAST_CHARACTERS, LEAST_WORDS = 40, 5
PAYWALL = (
    r"(?iu)(assine (já|agora|para continuar)|conteúdo exclusivo para assinantes|para continuar lendo|acesso ilimitado|"
    r"subscribe to continue|subscriber(s)? only|register to continue|paywall|you('| a)ve reached your (free )?(article )?limit|"
    r"crie sua conta gratuita|faça login para continuar)"
)
NOISE = (
    r"(?iu)(leia também|leia mais|veja também|matérias relacionadas|compartilhe|compartilhar no|newsletter|assine a newsletter|"
    r"todos os direitos reservados|política de privacidade|termos de uso|siga (o|a) .* no (instagram|twitter|facebook)|"
    r"menu principal|pular para o conteúdo)"
)
EMPTY_ROOT = r'''(?i)<div id="(root|app|__next)"\s*>\s*</div>'''
BLOCK_MARKERS = (
    "unusual traffic", "captcha", "verify you are a human", "are you a robot", "automated queries", "anomaly", "blocked",
    "access denied", "rate limit",
)
FIXTURE_MARKS = r"(?i)^(Por|Foto|Leia tamb[éÉ]m|Compartilhe|Publicado em)"
NO_ARTICLE = (
    r"(?i)(/tag/|/tags/|/busca|/search|/login|/assine|/assinatura|/newsletter|/video/|/videos/|/podcast|/ao-vivo|/live|#|"
    r"javascript:|/sobre|/politica-de-privacidade|/termos|/contato|mailto:|\.pdf$|\.jpg$|\.png$)"
)
ARTICLE_HINT = r"(-.*-.*-)|(\d{5,})|(/20\d{2}[/-]\d{1,2}[/-])"


def _phrases(folded: Column) -> Column:
    """Whether any phrase of navigation is in a folded text. Plain searches over its bytes cost less than one pattern of all."""
    return reduce(or_, [folded.contains(folded_text(p)) for p in NAVIGATION])


def _title(text: Column, folded: Column) -> Column:
    return folded.startswith("title:") | (text.contains(" | ") & ~F.rtrim(text).rlike(r"[.!?…]$"))


def page_title(text: Column) -> Column:
    """A bar between parts and no closing punctuation, or an explicit mark."""
    return _title(text, fold(text))


def navigation(text: Column) -> Column:
    return _phrases(fold(text))


def structural(paragraph: Column) -> Column:
    """Whether a paragraph is a page title or navigation, before passages are cut. It is folded once, not once a phrase."""
    return let(collapse(paragraph), lambda t: let(fold(t), lambda f: _title(t, f) | _phrases(f)))


def without_chrome(text: Column) -> Column:
    """Bylines, dates, times, publication marks and credits taken out, then loose punctuation at the ends."""

    def out(text: Column, at: int) -> Column:
        if at == len(CHROME):
            return F.btrim(collapse(text), F.lit(EDGES))
        needed = reduce(or_, [text.contains(x) for x in CHROME_NEEDS[at]])
        return let(F.when(needed, F.regexp_replace(text, CHROME[at], " ")).otherwise(text), lambda t: out(t, at + 1))

    return let(text, lambda t: out(t, 0))


def reason(text: Column, folded: Column) -> Column:
    """Why a collapsed passage is no evidence by its text and what it folds to, the first rule that holds; null keeps it.

    Each step's text is computed once, and the patterns run only over what is long enough. Words are parted by
    one space each by then, so there are too few where no space follows the last that is allowed.
    """
    few = lambda b: (F.length(b) < LEAST_CHARACTERS) | (F.substring_index(b, " ", LEAST_WORDS - 1) == b)
    too_short = (F.length(text) < LEAST_CHARACTERS) | let(without_chrome(text), few)
    return F.when(_title(text, folded), "pageTitle").when(_phrases(folded), "navigation").when(too_short, "tooShort")


def rejection(passage: Column, has_verb: Column | None = None) -> Column:
    """Why a passage is no evidence, the first rule that holds; null keeps it.

    ``has_verb`` is a nullable boolean of a tagger; unknown (the default) rejects nothing.
    """
    verb = F.lit(None).cast("boolean") if has_verb is None else has_verb
    return F.coalesce(let(collapse(passage), lambda t: let(fold(t), lambda f: reason(t, f))), F.when(~verb, "noVerb"))


def short_or_marked(line: Column, ascii_words: bool = False) -> Column:
    """The plainer rule of fixtures: short lines, and lines that begin like navigation.

    A mark is a word of its own. ``ascii_words`` counts only ASCII letters, digits and the
    underscore as parts of words, as RE2 does: "Porñ" then begins with the word "Por".
    """
    end = r"(?![A-Za-z0-9_])" if ascii_words else r"(?![\p{L}\p{M}\p{N}_])"
    return (F.length(line) < LEAST_CHARACTERS) | line.rlike(FIXTURE_MARKS + end)


def blocked(status: Column, body: Column) -> Column:
    """Why a fetched page is not the page asked for; null is none."""
    lower = F.lower(body)
    marker = F.lit(None).cast("string")
    for m in reversed(BLOCK_MARKERS):
        marker = F.when(lower.contains(m), F.lit(f"marker:{m}")).otherwise(marker)
    return F.coalesce(F.when(status != 200, F.concat(F.lit("status:"), status.cast("string"))), marker, F.when(F.length(body) < 1500, F.lit("short")))


def noise(text: Column) -> Column:
    """How often a text has phrases of navigation and footers."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NOISE))


def needs_scripts(html: Column) -> Column:
    """Pages that show nothing without scripts: short, an empty root, or hardly any text in paragraphs."""
    inside = F.regexp_extract_all(html, F.lit(r"(?s)<p[^>]*>(.*?)</p>"), F.lit(1))
    total = F.aggregate(inside, F.lit(0), lambda n, p: n + F.length(p))
    return (F.length(html) < 3000) | html.rlike(EMPTY_ROOT) | ((total < 150) & (F.length(html) > 20000))


def paywalled(html: Column, texts: list[Column], least: int = 200) -> Column:
    """An extracted text asks to subscribe, or all of them are short and the page does."""
    said = F.lit(False)
    short = F.lit(True)
    for t in texts:
        said = said | F.coalesce(t.rlike(PAYWALL), F.lit(False))
        short = short & (F.coalesce(F.length(t), F.lit(0)) < least)
    return said | (short & F.coalesce(html.rlike(PAYWALL), F.lit(False)))


def better_extract(a: Column, b: Column, least: int = 200) -> Column:
    """Which of two extracts wins: long enough, then less noise, then more characters."""

    def key(t: Column) -> Column:
        n = F.coalesce(F.length(t), F.lit(0))
        return F.when(n >= least, F.struct(F.lit(1).alias("ok"), (-noise(t)).alias("quiet"), n.alias("chars"))).otherwise(F.struct(F.lit(-1).alias("ok"), F.lit(0).alias("quiet"), F.lit(0).alias("chars")))

    x, y = key(a), key(b)
    return F.when((x["ok"] == -1) & (y["ok"] == -1), "none").when(x > y, "a").when(y > x, "b").otherwise("tie")
