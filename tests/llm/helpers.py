"""Small tables for the operators' tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, ids=None, extra=None):
    """Documents of texts; ``extra`` adds columns, name to DDL type and value."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    for name, (kind, value) in (extra or {}).items():
        df = df.withColumn(name, F.lit(value).cast(kind))
    return df


CLASHES = {k: ("string", "x") for k in ("_matches", "_keep", "_score", "_id", "score", "fp", "node", "n_words", "d", "h", "part", "added", "key", "_part", "y")}
#: Null, empty, blank, short, very long, repeated, non-Latin and broken-looking texts.
ODD = [None, "", "   \n\t", "a", "word " * 3000, "x" * 50_000, "Ünïcödé ЖЖЖ 漢字 ✨", "same text here", "same text here", "a\x00b\x1cc", "<|endoftext|> and more"]


def words(rng: random.Random, n: int, vocabulary: int = 60) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def one(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
