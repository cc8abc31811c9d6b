"""Passages within a token budget, with one sentence of overlap: an order-dependent fold per text, so an Arrow UDF."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clarion.functions.lineage import extended
from clarion.functions.passages import structural
from clarion.functions.text import collapse, fold, let

_END = re.compile(r"[.!?]\s+")
#: Characters whose passages a worker holds at once, but for one text.
HELD = 1 << 20


def estimate(text: str) -> int:
    """At least as many tokens as a text can have: a third of its characters, or its words."""
    return max(-(-len(text) // 3), len(text.split()))


def _sentences(text: str) -> list[str]:
    """Stripped non-empty sentences; a mark followed by white space ends one. Looking for the mark costs less than looking behind each space."""
    cuts = [(m.start() + 1, m.end()) for m in _END.finditer(text)]
    parts = [text[a:b].strip() for a, b in zip([0, *[b for _, b in cuts]], [*[a for a, _ in cuts], len(text)])] if cuts else [text.strip()]
    return [s for s in parts if s]


def _fits(budget: int, tokens: Callable[[str], int]) -> Callable[[str], bool]:
    """Whether a text is within the budget; of the default estimate, words are only counted where there can be too many."""
    if tokens is not estimate:
        return lambda t: tokens(t) <= budget
    return lambda t: len(t) <= 3 * budget and (len(t) < 2 * budget or len(t.split()) <= budget)


def _filled(units: list[str], budget: int, tokens: Callable[[str], int], overlap: bool) -> list[str]:
    """Units gathered greedily while they fit; with ``overlap`` a piece begins with the last unit of the one before if both fit. The default estimate is kept as running counts."""
    pieces: list[str] = []
    held: list[str] = []
    plain, most = tokens is estimate, 3 * budget
    chars = words = c = w = 0
    for unit in units:
        before = c, w
        if plain:
            c, w = len(unit), len(unit.split())
        if held:
            if (chars + 1 + c <= most and words + w <= budget) if plain else tokens(" ".join([*held, unit])) <= budget:
                held.append(unit)
                chars, words = chars + 1 + c, words + w
                continue
            pieces.append(" ".join(held))
            last = held[-1]
            if overlap and ((before[0] + 1 + c <= most and before[1] + w <= budget) if plain else tokens(f"{last} {unit}") <= budget):
                held, chars, words = [last, unit], before[0] + 1 + c, before[1] + w
                continue
        held, chars, words = [unit], c, w
    return [*pieces, " ".join(held)] if held else pieces


def _halves(word: str, fits: Callable[[str], bool]) -> Iterator[str]:
    """A word too long for the budget, in pieces found by halving."""
    while word:
        n = len(word)
        while n > 1 and not fits(word[:n]):
            n = max(1, n // 2)
        yield word[:n]
        word = word[n:]


def _words(text: str, budget: int, tokens: Callable[[str], int]) -> list[str]:
    fits = _fits(budget, tokens)
    return _filled([u for w in text.split() for u in ([w] if fits(w) else _halves(w, fits))], budget, tokens, overlap=False)


def passages(paragraphs: list[str], budget: int, tokens: Callable[[str], int] = estimate) -> list[str]:
    """Passages of at most ``budget`` tokens. Each paragraph begins with the last sentence of what came before."""
    fits = _fits(budget, tokens)
    out: list[str] = []
    before = ""  # the passage whose last sentence comes first
    for p in paragraphs:
        overlap = _sentences(before)[-1:] if before else []
        body = f"{overlap[0]} {p}" if overlap else p
        if fits(body):
            made = [body]
        elif len(found := _sentences(body)) > 1:
            made = _filled([u for s in found for u in ([s] if fits(s) else _words(s, budget, tokens))], budget, tokens, overlap=True)
        else:
            made = _words(body, budget, tokens)
        if made:
            out += made
            before = made[-1]
    return out


def paragraphs(text: Column) -> Column:
    """Trimmed lines that are neither empty, page titles nor navigation. Runs in the JVM."""
    return F.filter(F.transform(F.split(text, r"[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}]+"), lambda x: F.btrim(x)), lambda p: (p != "") & ~structural(p))


def chunked(docs: DataFrame, text: str = "text", budget: int = 512, tokens: Callable[[str], int] = estimate, budgets: str | None = None, into: str = "passage") -> DataFrame:
    """``docs`` without ``text``, a row per passage: ``ix`` from 0 and the passage. Texts without passages give no row.

    ``budgets`` names a column with a budget per row; ``tokens`` is called in tasks.
    """
    limit = F.col(budgets) if budgets else F.lit(budget)
    cut = lambda p, b: passages(p, max(1, b), tokens)
    made = _cut(docs, text, paragraphs(F.col(text)), limit.cast("int"), cut)
    return made.select(*[c for c in docs.columns if c != text], F.posexplode("_p").alias("ix", into))


def _cuts(batches, names: list[str], cut: Callable[[list[str], int], list[str]]):
    """Batches of paragraphs, budget and other columns with the passages of HELD characters at a time."""
    for batch in batches:
        found, at, size = [], 0, 0
        for k, (p, b) in enumerate(zip(batch.column(0), batch.column(1))):
            p = p.as_py() or []
            found.append(cut(p, b.as_py()))
            size += sum(map(len, p))
            if size >= HELD or k + 1 == batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.slice(at, len(found)).columns[2:], pa.array(found, pa.list_(pa.string()))], names=[*names, "_p"])
                found, at, size = [], k + 1, 0


def _cut(docs: DataFrame, text: str, parts: Column, limit: Column, cut: Callable[[list[str], int], list[str]]) -> DataFrame:
    """``docs`` without ``text``, with the passages ``_p`` of its ``parts``; a worker makes those of HELD characters at a time."""
    rest = [c for c in docs.columns if c != text]
    own = docs.select(parts.alias("_parts"), limit.alias("_limit"), *rest)
    return own.mapInArrow(lambda batches: _cuts(batches, rest, cut), extended(own.select(*rest).schema, "_p array<string>"))


def window_lists(docs: DataFrame, text: str, claim_tokens: str, first: int = 126, model: int = 509, tokens: Callable[[str], int] = estimate) -> tuple[DataFrame, Column]:
    """``docs`` without ``text``, and of each row the list of its passages of ``first`` tokens, cut again to what the claim leaves of ``model``, unfit ones out: (text, folded)."""
    from clarion.functions.passages import reason

    def cut(p: list[str], room: int) -> list[str]:
        room = max(1, room)
        fits = _fits(room, tokens)
        return [y for x in passages(p, first, tokens) for y in ([x] if fits(x) else passages([x], room, tokens))]

    made = _cut(docs, text, paragraphs(F.col(text)), (F.lit(model) - F.col(claim_tokens)).cast("int"), cut)
    judged = lambda x: let(collapse(x), lambda t: let(fold(t), lambda f: F.struct(x.alias("text"), f.alias("folded"), reason(t, f).isNull().alias("kept"))))
    return made, F.filter(F.transform("_p", judged), lambda x: x["kept"])


def windows(docs: DataFrame, text: str, claim_tokens: str, first: int = 126, model: int = 509, tokens: Callable[[str], int] = estimate) -> DataFrame:
    """The passages of ``window_lists``, a row each; ``ix`` counts what is left."""
    made, kept = window_lists(docs, text, claim_tokens, first, model, tokens)
    return made.select(*[c for c in docs.columns if c != text], F.posexplode(kept).alias("ix", "_x")).select(*[c for c in docs.columns if c != text], "ix", "_x.text")  # of a column, Spark would judge all passages once more to leave out empty lists
