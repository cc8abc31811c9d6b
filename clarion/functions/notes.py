"""What a reader is told about a source, an answer or an error, as codes that a user interface words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from clarion.functions.text import clip

STRONG = 0.85
# Errors after which trying again can help, and those after which it can't.
RETRIABLE = (
    "noConnection", "searchRequestFailed", "deadlineExceeded", "searchBudgetExceeded", "inferenceBudgetExceeded", "searchRateLimited", "readingIncomplete",
)
FINAL = ("searchQuotaExceeded", "modelLoadFailed", "claimNeedsSelection", "claimNeedsRephrasing")


def evidence_note(duplicate_of: Column, partial: Column, alignment: Column, stance: Column) -> Column:
    """Why a source counts or not; the first that holds."""
    return (
        F.when(duplicate_of.isNotNull(), "sameOrigin").when(partial, "partial").when(alignment == "incompatible", "otherPeriod").when(alignment == "unknown", "periodUnknown")
        .when(stance == "mixed", "mixed").when(stance == "insufficient", "insufficient").otherwise("complete")
    )


def confidence_note(confidence: Column) -> Column:
    return F.when(confidence >= STRONG, "strong").otherwise("limited")


def retriable(error: Column) -> Column:
    """Null for unknown errors and for none."""
    return F.when(error.isin(*RETRIABLE), True).when(error.isin(*FINAL), False)


def shown_excerpt(excerpt: Column, limit: int = 300) -> Column:
    """The trimmed excerpt, cut with an ellipsis beyond ``limit`` characters."""
    return clip(F.regexp_replace(excerpt, r"^\s+|\s+$", ""), limit)
