"""Toxicity by a weighted lexicon and an Aho-Corasick automaton.

Texts are folded first: compatibility forms, case, marks and zero-width characters of all
scripts, look-alike letters and digits that stand for letters. The lexicon (whole words and word beginnings) is learned from
labelled rows: entries are taken greedily by how many toxic rows they explain that no
earlier entry does, so the other words of copied toxic texts do not get in. Exception
phrases (an entry with a neighbour, or a longer word under a beginning) cancel the match
they cover where they occur in harmless rows. The weights found are summed, normalised
by the text's length, and turned into a probability by logistic regression.
"""

from __future__ import annotations

import heapq
import math
import unicodedata
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from clarion.functions.lineage import extended, stored
from clarion.llm.labels import fold_of, training_rows

FOLDS, HELD = 5, 0
#: Labelled rows of each class that the lexicon is learned from, at most; each is taken whole.
PER_CLASS = 6000
#: An entry is in that many toxic rows, with at least that weight and that likelihood ratio (chance gives 16 about once in 15,000 words).
MIN_ROWS, MIN_WEIGHT, MIN_RATIO, PREFIXES = 4, 1.0, 16.0, range(4, 9)
#: Entries that explain a toxic row, at most, before it no longer counts.
COVER = 3
#: Rows that a task gathers before it hands them on.
EMITTED = 20_000

# Letters of other scripts that look like Latin ones, and digits or signs used for letters.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнαοερτικνυ", "aeopcyxijsdhkmtbhaoeptiknu"))
SUBSTITUTES = dict(zip("01345789@$", "oieastbgas"))


class _Fold(dict):
    """What a lower-case, decomposed character becomes: letters and digits stay, marks and invisible characters go, others part words."""

    def __missing__(self, code: int):
        ch = chr(code)
        category = unicodedata.category(ch)
        self[code] = None if category in ("Mn", "Me", "Cf") else ch if ch.isalnum() or category == "Mc" else " "
        return self[code]


FOLD = _Fold({ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES | {"ς": "σ"}).items()})


def fold(text: str | None) -> str:
    """Folded words, a space before and after each; of a text without words one space.

    Compatibility forms (full width, ligatures) and accented letters are decomposed, then
    case, marks and zero-width characters go in every script; look-alikes and digits last.
    """
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    words = text.lower().translate(FOLD).split()
    return f" {' '.join(words)} " if words else " "


class Lexicon:
    """Matches folded texts. Entries begin with a space; one that also ends with it is a whole word."""

    def __init__(self, entries: dict[str, float], exceptions: list[str], coefficients: list[float]):
        self.coefficients = coefficients
        self.automaton = ahocorasick.Automaton()
        for e, w in entries.items():
            self.automaton.add_word(e, (len(e), w))
        for e in exceptions:
            self.automaton.add_word(e, (len(e), 0.0))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, folded: str) -> dict[int, float]:
        """Weight by the place where a word begins: the heaviest entry there, none under an exception."""
        best: dict[int, float] = {}
        if not len(self.automaton):
            return best
        spared = []
        for end, (n, w) in self.automaton.iter(folded):
            start = end - n + 1
            if w:
                best[start] = max(w, best.get(start, w))
            else:
                spared.append((start, end))
        for a, b in spared:
            for k in [k for k in best if a <= k < b]:
                del best[k]
        return best

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight found: its logarithm, and per hundred words of a text counted with twenty more."""
        folded = fold(text)
        total = sum(self.found(folded).values())
        return math.log1p(total), 100 * total / (folded.count(" ") + 19)

    def score(self, text: str | None) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _signature(words: list[str], frequent: set[str]) -> list[int]:
    """Two min-hashes over words that are not frequent; near copies mostly share both."""
    own = [w.encode() for w in words if w not in frequent] or [w.encode() for w in words]
    return [min((zlib.crc32(w, seed) for w in own), default=0) for seed in (1, 2)]


def _of(words: list[str]) -> set[str]:
    """The entries that a row of these words could have: whole words and word beginnings."""
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in PREFIXES if len(w) >= k}


def _ratio(m: int, n_pos: int, n: int, n_neg: int) -> float:
    """Likelihood ratio (G) of a word in ``m`` of the toxic and ``n`` of the harmless rows against equal shares."""
    p = (m + n) / (n_pos + n_neg)
    cells = ((m, n_pos * p), (n_pos - m, n_pos * (1 - p)), (n, n_neg * p), (n_neg - n, n_neg * (1 - p)))
    return 2 * sum(k * math.log(k / e) for k, e in cells if k)


def _weight(m: int, n_pos: int, n: int, n_neg: int) -> float:
    """Log ratio of the shares of toxic and harmless rows that have an entry; 0 where chance could explain it."""
    w = math.log((m + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))
    return w if _ratio(m, n_pos, n, n_neg) >= MIN_RATIO else 0.0


def _cover(weights: dict[str, float], where: dict[str, set[int]], rows: set[int]) -> dict[str, float]:
    """Greedy cover of the toxic rows; of entries that explain the same rows the longer, more specific one comes first."""
    heap = [(-len(where[e]) * w, -len(e), e) for e, w in weights.items()]
    heapq.heapify(heap)
    left, out, times = set(rows), {}, Counter()
    stems: dict[str, list[str]] = defaultdict(list)
    while heap:
        gain, _, e = heapq.heappop(heap)
        # A form of a word that has an entry is of use only in other rows.
        word = e.strip()
        kin = [f for f in stems[word[: PREFIXES[0]]] if f.strip().startswith(word) or word.startswith(f.strip())]
        gained = len((where[e] & left).difference(*(where[f] for f in kin)))
        if gained < MIN_ROWS:
            continue
        if gained * weights[e] < -gain - 1e-9:
            heapq.heappush(heap, (-gained * weights[e], -len(e), e))
            continue
        out[e] = weights[e]
        stems[word[: PREFIXES[0]]].append(e)
        times.update(where[e])
        left -= {i for i in where[e] if times[i] >= COVER}
    return out


def _emit(rows: DataFrame, of, schema: str) -> DataFrame:
    """What ``of`` yields for each row, a tuple of values; of a row of nothing, nothing. At most EMITTED rows and one text's are held."""
    fields = StructType.fromDDL(schema).fields
    types = [{"bigint": pa.int64(), "double": pa.float64()}.get(f.dataType.simpleString(), pa.string()) for f in fields]

    def scan(batches):
        flushed = lambda out: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=[f.name for f in fields])
        for batch in batches:
            out = []
            for i in range(len(batch)):
                out += of({name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)})
                if len(out) >= EMITTED:
                    yield flushed(out)
                    out = []
            yield flushed(out)

    return rows.mapInArrow(scan, schema)


def _counted(rows: DataFrame, of) -> DataFrame:
    """(entry, n): in how many rows each entry of the set that ``of`` gives is. Tasks hand on sums over at most EMITTED entries and one text's."""

    def scan(batches):
        counts = Counter()
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["entry", "n"])
        for batch in batches:
            for i in range(len(batch)):
                counts.update(of({name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}))
                if len(counts) >= EMITTED:
                    yield flushed()
                    counts.clear()
        yield flushed()

    return rows.mapInArrow(scan, "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n"))


def _entries(rows: DataFrame) -> dict[str, float]:
    """Entries and weights from rows (id, text, y): counted in tasks, chosen on the driver.

    Near copies among the toxic rows count once, else the other words of a copied text would
    look toxic. The driver gets words of over a quarter of the rows, entries of MIN_ROWS
    toxic rows or more, and the rows of those that pass; all are bounded by the sample.
    """
    n = rows.count()
    words = lambda r: sorted(set(fold(r["text"]).split()))
    frequent = {r["entry"] for r in _counted(rows, words).where(F.col("n") * 4 > n).collect()}
    signs = _emit(rows.where("y = 1"), lambda r: [(r["id"], *_signature(words(r), frequent))], "id bigint, a bigint, b bigint")
    pos = {r["id"] for r in signs.groupBy("a", "b").agg(F.min("id").alias("id")).collect()}  # at most a number per toxic row of the sample
    n_pos, n_neg = len(pos), n - rows.where("y = 1").count()
    toxic, harmless = rows.where("y = 1"), rows.where("y = 0")
    own = _emit(toxic, lambda r: [(e,) for e in _of(words(r))] if r["id"] in pos else [], "entry string").groupBy("entry").agg(F.count("*").alias("m")).where(F.col("m") >= MIN_ROWS)
    own = {r["entry"]: r["m"] for r in own.collect()}  # each is in MIN_ROWS toxic rows of the sample at least
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(own))
    other = _counted(harmless, lambda r: _of(words(r)) & sent.value)
    other = {r["entry"]: r["n"] for r in other.collect()}
    sent.destroy()  # workers drop it with their next task
    weights = {e: w for e, m in own.items() if (w := _weight(m, n_pos, other.get(e, 0), n_neg)) >= MIN_WEIGHT}
    passed = rows.sparkSession.sparkContext.broadcast(frozenset(weights))
    where = _emit(toxic, lambda r: [(e, r["id"]) for e in _of(words(r)) & passed.value] if r["id"] in pos else [], "entry string, id bigint")
    where = where.groupBy("entry").agg(F.collect_list("id").alias("ids")).collect()
    passed.destroy()
    return _cover(weights, {r["entry"]: set(r["ids"]) for r in where}, pos)


def _phrases(lexicon: Lexicon, text: str) -> set[str]:
    """The words under an entry in a text, and their pairs with a neighbour."""
    folded = fold(text)
    out = set()
    for k in lexicon.found(folded):
        end = folded.index(" ", k + 1)
        out.add(folded[k : end + 1])
        if end + 1 < len(folded):
            out.add(folded[k : folded.index(" ", end + 1) + 1])
        if k:
            out.add(folded[folded.rindex(" ", 0, k) : end + 1])
    return out


def _exceptions(entries: dict[str, float], rows: DataFrame) -> list[str]:
    """Words under an entry, and pairs with a neighbour, that harmless rows have and toxic ones hardly do."""
    sent = rows.sparkSession.sparkContext.broadcast((entries, [], []))
    each = _emit(rows, lambda r: [(p, r["y"]) for p in _phrases(_lexicon(sent), r["text"])], "phrase string, y bigint")
    counts = each.groupBy("phrase").agg(F.sum("y").alias("m"), F.count_if(F.col("y") == 0).alias("n"))
    found = sorted(r["phrase"] for r in counts.where("n >= 3 and n > 4 * m").collect())
    sent.destroy()
    return found


def _logistic(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Intercept and slopes by ridge-damped Newton steps; the slopes are never negative."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (y - p) - 0.1 * b
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    b[1:] = np.maximum(b[1:], 0)
    return b.tolist()


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, doc_id: str = "doc_id", text: str = "text") -> tuple[dict, list, list]:
    """(entries, exceptions, coefficients) from at most ``per_class`` rows of each label outside the held-out fold.

    Without toxic or without harmless rows the lexicon is empty and every score is the share
    of toxic labels. Texts are folded, counted and measured in tasks; the driver gets words,
    numbers of rows and figures. See ``training_rows`` for nulls, conflicts and repeated ids.
    """
    rows, totals = training_rows(docs, labels, "toxic", FOLDS, HELD, per_class, doc_id, text)
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    prior = math.log(share / (1 - share))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("id"), "text", F.col("y").cast("bigint").alias("y")))
    if rows.select("y").distinct().count() < 2:
        return {}, [], [prior, 0.0, 0.0]
    entries = _entries(rows)
    exceptions = _exceptions(entries, rows) if entries else []
    sent = docs.sparkSession.sparkContext.broadcast((entries, exceptions, []))
    measured = _emit(rows, lambda r: [(*_lexicon(sent).features(r["text"]), r["y"])], "x double, z double, y bigint")
    # Two figures and a label a row; sorted, so that the fit doesn't depend on how tasks ended.
    got = np.array(sorted(tuple(r) for r in measured.collect()), dtype=float)
    sent.destroy()
    y = got[:, 2]
    a, b, c = _logistic(got[:, :2], y)
    # The sample has another share of toxic rows than the labels; the intercept is moved to theirs.
    a += prior - math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return entries, exceptions, [a, b, c]


@lru_cache(maxsize=1)
def _lexicon(model: Broadcast) -> Lexicon:
    return Lexicon(*model.value)


def scores(docs: DataFrame, model: tuple[dict, list, list], text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being toxic; null and empty texts get that of a text without matches.

    The broadcast model holds at most an entry per ``MIN_ROWS`` training rows and their exceptions.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text), [*docs.columns, into]

    def scan(batches):
        lexicon = _lexicon(sent)
        for batch in batches:
            got = [lexicon.score(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=names)

    return docs.mapInArrow(scan, extended(docs.schema, f"`{into}` double"))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); its other columns don't matter.

    Null, empty and blank texts get the score of a text without matches; equal texts get equal
    scores, and repeated rows and ids a result each. A null id is in the held-out fold. No
    rows give no result; without labels of both kinds every score is the share of toxic ones.
    """
    own = docs.select("doc_id", "text")
    return scores(own, learn(own, labels, per_class)).select(
        "doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
