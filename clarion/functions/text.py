"""Text expressions: folding, terms, names, sentences, lengths, shingles. All run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

# What a term and a name are, where a sentence ends.
TERM = r"[\p{L}\p{N}]+(?:[.,]\d+)?"
NAME = r"(?U)(?=\p{Lu})\b\p{Lu}[\p{L}\p{N}]+\b"  # a capital is looked for first: the test for a word's edge costs more
SENTENCE_END = r"(?<=[.!?])\s+"

# Words that searches leave out, and words that change what a sentence claims.
STOP_WORDS = (
    "a", "o", "as", "os", "de", "da", "do", "das", "dos", "em", "no", "na", "nos", "nas", "para", "por", "com", "sem", "sobre",
    "e", "ou", "que", "se", "um", "uma", "uns", "umas", "ao", "aos", "à", "às", "é", "foi", "ser", "sua", "seu", "suas", "seus",
    "após", "última", "último", "novo", "nova",
)
QUALIFIERS = (
    "nao", "nunca", "jamais", "sem", "diz", "disse", "afirma", "afirmou", "alega", "alegou", "pode", "podem", "poderia",
    "comprovou", "provou", "todos", "todas", "nenhum", "nenhuma", "apenas",
)


def _accents() -> tuple[str, str]:
    """Lower-case letters of U+00C0 to U+024F that decompose, and what they decompose to."""
    pairs = {}
    for code in range(0xC0, 0x250):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFD", letter)[0]
        if len(letter) == 1 and base != letter:
            pairs[letter] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTS = _accents()


def fold(text: Column) -> Column:
    """Lower case without diacritics; letters that don't decompose (such as the German sharp s) stay."""
    return let(text, lambda t: F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(F.lower(t), *ACCENTS)))  # ASCII needs no table


def folded_text(text: str) -> str:
    """``fold`` of a constant."""
    return text.lower().translate(str.maketrans(*ACCENTS))


def terms(text: Column) -> Column:
    """Folded words and numbers; a decimal part stays with its number."""
    return folded_terms(fold(text))


def folded_terms(folded: Column) -> Column:
    """The terms of what ``fold`` has made of a text. White space collapsed before makes no other terms."""
    return F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))


def names(text: Column) -> Column:
    """Capitalised words of two letters or more, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(NAME), F.lit(0))))


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    runs = ("  ", "\t", "\n", "\x0b", "\f", "\r")  # where there is none, nothing is to be replaced
    return let(text, lambda t: F.trim(F.when(reduce(or_, [t.contains(x) for x in runs]), F.regexp_replace(t, r"\s+", " ")).otherwise(t)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """At least as many tokens as a text can have: a third of its characters, or its words."""
    return F.greatest(F.ceil(F.length(text) / 3).cast("int"), word_count(text))


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences; a mark followed by white space ends one."""
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")  # not F.trim itself: it would take an index as what to trim


def truncate(text: Column, limit: int) -> Column:
    """``text`` cut at the last white space within ``limit`` characters, or hard where there is none."""
    head = F.substring(text, 1, limit)
    cut = F.trim(F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1))
    return F.when(F.length(text) <= limit, text).when(cut == "", head).otherwise(cut)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; inside a function over an array it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(words: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` words; of fewer words, the distinct words."""

    def runs(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.array_distinct(F.when(F.size(w) >= size, made).otherwise(w))

    return let(words, runs)


def protected(words: Column) -> Column:
    """Sorted qualifiers and numbers with their neighbours: two texts that differ here are no duplicates."""

    def marked(words: Column) -> Column:
        each = F.transform(
            words,
            lambda w, i: F.when(w.isin(*QUALIFIERS), w).when(
                w.rlike(r"\p{N}"), F.array_join(F.slice(words, F.greatest(i, F.lit(1)), F.when(i == 0, 2).otherwise(3)), " ")
            ),
        )
        return F.array_sort(F.filter(each, lambda w: w.isNotNull()))

    return let(words, marked)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; null of two empty arrays."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def keywords(text: Column, stop_words: tuple[str, ...] = STOP_WORDS, limit: int = 8) -> Column:
    """The first ``limit`` words that are no stop words (full stops and commas at their ends aside), joined by spaces."""
    words = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~F.btrim(F.lower(w), F.lit(".,")).isin(*stop_words))
    return F.array_join(F.slice(words, 1, limit), " ")


def clip(text: Column, limit: int = 300) -> Column:
    """At most ``limit`` characters, the last one an ellipsis where text was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 1), F.lit("…"))).otherwise(text)


def label_allowed(label: Column, allowed: Column) -> Column:
    """Whether ``label`` is one of the labels of ``allowed``, which are parted by slashes."""
    return F.array_contains(F.transform(F.split(allowed, "/"), lambda x: F.lower(F.trim(x))), F.lower(label))
