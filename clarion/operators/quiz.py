"""Quiz facts: grading, answers, report, the question of a day, a round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Words for an answer.
TRUE_WORDS = ("fato", "verdade", "verdadeiro", "certo", "real", "verdadeira")
FALSE_WORDS = ("farsa", "falso", "mentira", "enganoso", "fake", "falsa")


def is_true(binary: Column) -> Column:
    return F.coalesce(binary.isin("true", "FATO"), F.lit(False))


def graded(binary: Column, said_true: Column) -> Column:
    """Whether the answer is right; null for a skipped one."""
    return F.when(said_true.isNull(), F.lit(None).cast("boolean")).otherwise(is_true(binary) == said_true)


def answer(text: Column) -> Column:
    """fato or farsa for their synonyms, else the trimmed lower-case word."""
    word = F.lower(F.btrim(F.regexp_replace(text, r"^\s+|\s+$", "")))
    return F.when(word.isin(*TRUE_WORDS), "fato").when(word.isin(*FALSE_WORDS), "farsa").otherwise(word)


def report(facts: DataFrame, answers: DataFrame, fact_id: str = "fact_id") -> DataFrame:
    """(fact_id, outcome): hit, miss or skip of every chosen fact; ``answers``: (fact_id, correct)."""
    last = answers.groupBy(fact_id).agg(F.bool_or("correct").alias("correct"))
    return facts.join(last, fact_id, "left").select(fact_id, F.when(F.col("correct").isNull(), "skip").when(F.col("correct"), "hit").otherwise("miss").alias("outcome"))


def counters(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    return outcomes.groupBy(*(by or [])).agg(*[F.count_if(F.col("outcome") == k).alias(f"{k}s" if k != "miss" else "misses") for k in ("hit", "miss", "skip")])


def daily(questions: DataFrame, days: DataFrame, question_id: str = "question_id", day: str = "day") -> DataFrame:
    """(day, question_id): one question per day, the same at every run, none without questions.

    Questions are numbered in the order of a hash; a day draws a number, so days join by
    equality. Numbers are dealt in parts by the hash's range, no single task sees all.
    """
    key = F.md5(F.col(question_id).cast("string"))
    own = questions.select(F.col(question_id), key.alias("_h"), F.substring(key, 1, 3).alias("_p"))  # 4096 ranges of the hash
    sizes = own.groupBy("_p").agg(F.count("*").alias("_c"))
    first = sizes.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_first"))  # 4096 rows at most
    place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", question_id)) - 1
    numbered = own.withColumn("_k", place).join(first, "_p").select(question_id, (F.col("_first") + F.col("_k")).alias("_n"))
    total = questions.agg(F.count("*").alias("_total"))
    drawn = days.select(day).distinct().join(F.broadcast(total)).where("_total > 0")  # one row
    number = F.conv(F.substring(F.md5(F.col(day).cast("string")), 1, 12), 16, 10).cast("bigint")
    return drawn.select(day, (number % F.col("_total")).alias("_n")).join(numbered, "_n").select(day, question_id)


def round_of(facts: DataFrame, seed: int, n: int = 10, fact_id: str = "fact_id") -> DataFrame:
    """``n`` facts in an order drawn by ``seed``; a top-n, so only n rows of each partition are kept."""
    return facts.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(fact_id).cast("string"))), fact_id).limit(n)
