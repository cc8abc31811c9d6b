"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting passes over the features again and again; each step fits a shallow tree
on one binned feature (or one pair) and adds it to that feature's lookup table. A score
is then a sum of table entries, added for whole batches at once.
"""

from __future__ import annotations

import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clarion.functions.lineage import extended
from clarion.llm.labels import fold_of, training_rows

FOLDS, HELD = 3, 1
#: Labelled rows of each class that the model is fitted on, at most; each is taken whole.
PER_CLASS = 5000
BINS, ROUNDS, RATE, PAIRS, PAIR_ROUNDS, PAIR_BINS = 32, 150, 0.15, 6, 60, 8

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "long_words", "short_words", "distinct_words",
    "top_word", "repeated_next", "upper", "digits", "spaces", "newlines", "period_comma", "symbols", "bars", "bangs",
    "non_ascii", "entropy", "words_end_symbol", "upper_words", "repeated_lines", "line_length", "compressed", "distinct_pairs",
)
_UPPER = np.arange(65, 91)
_DIGITS = np.arange(48, 58)
_SYMBOLS = np.array([ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"])


def features(text: bytes | None) -> list[float]:
    """Figures of one UTF-8 text; null, empty and blank texts give zeros but for those of their bytes."""
    text = text or b""
    n = len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    words = text.split()
    w = max(len(words), 1)
    sizes = np.array([len(x) for x in words] or [0])
    distinct = set(words)
    # The share of the most frequent word, from hashed counts: no dictionary of a long text's words.
    codes = np.array([hash_ & 4095 for hash_ in map(zlib.crc32, words)] or [0])
    pairs = codes[1:] * 4096 + codes[:-1]
    lines = [x for x in text.split(b"\n") if x]
    p = count[count > 0] / max(n, 1)
    share = lambda at: float(count[at].sum()) / max(n, 1)
    return [
        math.log1p(n), math.log1p(len(words)), float(sizes.mean()), float(sizes.std()), float((sizes > 12).mean()),
        float((sizes < 4).mean()), len(distinct) / w, float(np.bincount(codes).max()) / w,
        float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0, share(_UPPER), share(_DIGITS), share([32, 9]),
        share([10]), share([44, 46]), share(_SYMBOLS), share([124]), share([33, 63]), float(count[128:].sum()) / max(n, 1),
        float(-(p * np.log2(p)).sum()), sum(x[-1] in b"!?#$%&*|" for x in words) / w,
        sum(x.isupper() and len(x) > 1 for x in words) / w, 1 - len(set(lines)) / max(len(lines), 1),
        math.log1p(n / max(len(lines), 1)), len(zlib.compress(text, 1)) / max(n, 1), len(np.unique(pairs)) / max(len(pairs), 1),
    ]


class Model:
    """Lookup tables over bins: one per feature, one per chosen pair."""

    def __init__(self, prior: float):
        self.intercept = prior
        self.edges: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.pairs: list[tuple[int, int, np.ndarray]] = []

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]
        for b, table in zip(bins, self.tables):
            total += table[b]
        for f, g, table in self.pairs:
            total += table[self.coarse[f][bins[f]], self.coarse[g][bins[g]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton values per bin of the best tree of ``depth`` over sums of gradients and curvatures."""
    damp = 1.0
    out = np.full(len(g), g.sum() / (h.sum() + damp))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + damp) + gr**2 / (hr + damp)
    gain[(hl < 2) | (hr < 2)] = -1
    k = int(gain.argmax())
    if gain[k] <= g.sum() ** 2 / (h.sum() + damp) + 1e-9:
        return out
    return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1), _tree(g[k + 1 :], h[k + 1 :], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a pair's grid into four quadrants."""
    damp = 2.0
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, at = -1.0, (0, 0)
    a, b = cg[:-1, :-1], ch[:-1, :-1]
    parts = [
        (a, b), (cg[:-1, -1:] - a, ch[:-1, -1:] - b), (cg[-1:, :-1] - a, ch[-1:, :-1] - b),
        (cg[-1, -1] - cg[:-1, -1:] - cg[-1:, :-1] + a, ch[-1, -1] - ch[:-1, -1:] - ch[-1:, :-1] + b),
    ]
    gain = sum(x**2 / (y + damp) for x, y in parts)
    at = np.unravel_index(int(gain.argmax()), gain.shape)
    best = float(gain[at])
    values = np.empty_like(g)
    i, j = at[0] + 1, at[1] + 1
    for (r, c), (x, y) in zip(((slice(None, i), slice(None, j)), (slice(None, i), slice(j, None)), (slice(i, None), slice(None, j)), (slice(i, None), slice(j, None))), parts):
        values[r, c] = x[at] / (y[at] + damp)
    return best, values


def fit(x: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """Cyclic boosting over all features, then over the pairs that explain most of what is left."""
    m = Model(prior)
    if len(set(y.tolist())) < 2:
        return m
    base = math.log(y.sum() / (len(y) - y.sum()))
    total = np.full(len(y), base)
    bins = []
    for f in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        m.edges.append(e)
        m.tables.append(np.zeros(len(e) + 1))
        # The coarser bins of a pair are runs of a feature's own bins.
        m.coarse.append(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1))
        bins.append(np.searchsorted(e, x[:, f], "right"))

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            g, h = slopes()
            size = len(m.tables[f])
            step = RATE * _tree(np.bincount(b, g, size), np.bincount(b, h, size))
            m.tables[f] += step
            total += step[b]
    cells = [m.coarse[f][b] for f, b in enumerate(bins)]

    def grid(f, g_, h_, k):
        cell = cells[f] * PAIR_BINS + cells[k]
        shape = (PAIR_BINS, PAIR_BINS)
        return cell, np.bincount(cell, g_, PAIR_BINS**2).reshape(shape), np.bincount(cell, h_, PAIR_BINS**2).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_quadrants(*grid(f, g, h, k)[1:])[0], f, k) for f, k in combinations(range(len(bins)), 2)), reverse=True)
    m.pairs = [(f, k, np.zeros((PAIR_BINS, PAIR_BINS))) for _, f, k in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for f, k, table in m.pairs:
            g, h = slopes()
            cell, gg, hh = grid(f, g, h, k)
            step = RATE * _quadrants(gg, hh)[1]
            table += step
            total += step.ravel()[cell]
    # The sample has other shares of the classes than the labels; the intercept is moved to theirs.
    m.intercept = prior
    return m


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of at most ``per_class`` rows of each label outside the held-out fold.

    Their features are computed in tasks; twice ``per_class`` short rows come to the driver.
    """
    rows, totals = training_rows(docs, labels, "quality", FOLDS, HELD, per_class)

    def measure(batches):
        for batch in batches:
            x = [features(t) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    got = rows.mapInArrow(measure, "x array<double>, y int").collect()
    share = (totals.get(1, 0) + 0.5) / (sum(totals.values()) + 1)
    prior = math.log(share / (1 - share))
    if not got:
        return Model(prior)
    # A fixed order: the fit doesn't depend on how tasks ended.
    got = sorted((tuple(r["x"]), r["y"]) for r in got)
    return fit(np.array([g[0] for g in got]), np.array([g[1] for g in got], dtype=float), prior)


def scores(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of being of good quality; null texts count as empty."""
    at, names = docs.columns.index(text), [*docs.columns, into]

    def scan(batches):
        for batch in batches:
            x = np.array([features(t) for t in batch.column(at).cast(pa.binary()).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(x))], names=names)

    return docs.mapInArrow(scan, extended(docs.schema, f"`{into}` double"))


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); its other columns don't matter.

    Null, empty and blank texts get a score like any other; equal texts get equal scores, and
    repeated rows and ids a result each. A null id is in fold 0. No rows give no result;
    without labels of both kinds every score is the share of good ones.
    """
    own = docs.select("doc_id", "text")
    return scores(own, learn(own, labels, per_class)).select(
        "doc_id", (fold_of("doc_id", FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
