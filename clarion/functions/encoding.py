"""Token-id arrays as models take them: special tokens, truncation, padding. Array functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MOST = 512


def _head(ids: Column, n: Column | int) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(F.lit(0), F.lit(n) if isinstance(n, int) else n))


def single(ids: Column, begin: int, end: int, most: int = MOST) -> Column:
    """begin, ids, end; ids are cut so that both special tokens stay."""
    return F.concat(F.array(F.lit(begin)), _head(ids, most - 2), F.array(F.lit(end)))


def pair(premise: Column, hypothesis: Column, begin: int, separator: int, most: int = MOST) -> Column:
    """(ids, mask, segments) of begin premise separator hypothesis separator; the premise gives way first."""
    h = _head(hypothesis, most - 3)
    p = _head(premise, F.lit(most - 3) - F.size(h))
    ids = F.concat(F.array(F.lit(begin)), p, F.array(F.lit(separator)), h, F.array(F.lit(separator)))
    segments = F.concat(F.array_repeat(F.lit(0), F.size(p) + 2), F.array_repeat(F.lit(1), F.size(h) + 1))
    return F.struct(ids.alias("ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("mask"), segments.alias("segments"))


def fitted(ids: Column, length: int, pad: int = 0) -> Column:
    """Exactly ``length`` ids: cut, or padded at the end."""
    return F.concat(_head(ids, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(length) - F.size(ids))))


def labelled(names: Column, probabilities: Column) -> Column:
    """A map of label to probability, by place."""
    return F.map_from_arrays(names, probabilities)
