"""The route cascade: which episodes answer a question, by position, by name, by lost name and by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens

MOST_REFERENCES, MOST_SPAN = 3, 6
ROUTES = ["sequence", "fact", "ledger", "lexical"]


# What a number behind # may count instead of turns of this thread, and words for a turn.
FOREIGN = ("issue", "pr", "pull", "ticket", "bug", "gh")
TURN = ("turn", "message", "episode", "seq")
_N = "(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]{1,9})"


def sequence_references(questions: DataFrame) -> DataFrame:
    """(question_id, thread_id, seq) named by a question as #12, #12-15, 'turn 1,345' or 'the 345th turn': at most three
    references of at most six episodes. A # that counts somebody else's issues is none."""
    words = "|".join(TURN)
    text = F.regexp_replace("text", rf"(?i)\b(?:{'|'.join(FOREIGN)}) ?#[0-9]+", " ")
    found = F.regexp_extract_all(text, F.lit(rf"(?i)((?:#|\b(?:{words})s? #?){_N}(?: ?[-–] ?#?{_N})?|\b{_N}(?:st|nd|rd|th) (?:{words})\b)"), F.lit(1))
    ref = questions.select("question_id", "thread_id", F.explode(F.slice(F.array_distinct(F.transform(found, lambda r: F.regexp_replace(r, ",", ""))), 1, MOST_REFERENCES)).alias("ref"))
    low = F.regexp_extract("ref", r"([0-9]+)", 1).cast("long")
    high = F.coalesce(F.expr("try_cast(nullif(regexp_extract(ref, '[-–] ?#?([0-9]+)', 1), '') AS BIGINT)"), low)
    spans = ref.select("question_id", "thread_id", low.alias("a"), F.least(high, low + MOST_SPAN - 1).alias("b")).where("a >= 1 and b >= a")
    return spans.select("question_id", "thread_id", F.explode(F.sequence("a", "b")).alias("seq")).distinct()


def named(questions: DataFrame, names: Column) -> DataFrame:
    """(question_id, thread_id, name) of the names that a question's text holds."""
    return questions.select("question_id", "thread_id", F.explode(F.array_distinct(names)).alias("name"))


def latest(found: DataFrame, most: int, route: str) -> DataFrame:
    """The newest places of each name, as candidates of one route."""
    order = Window.partitionBy("question_id", "name").orderBy(F.desc("seq"))
    rows = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    return rows.groupBy("question_id", "thread_id", "seq").agg(F.min("_r").cast("long").alias("rank")).withColumn("route", F.lit(route))


def cascade(candidates: DataFrame, episodes: DataFrame, most: int, budget: int) -> DataFrame:
    """Pages of each question: candidates (question_id, thread_id, seq, rank, route) in the order of routes, then rank,
    then newest; an episode counts for its first route. The first `most` pages stay while their tokens fit."""
    place = F.array_position(F.array(*[F.lit(r) for r in ROUTES]), F.col("route"))
    first = candidates.withColumn("place", place).groupBy("question_id", "thread_id", "seq").agg(F.min(F.struct("place", "rank", "route")).alias("best"))
    pages = first.join(episodes.select("thread_id", "seq", approx_tokens(F.col("content")).alias("tokens")), ["thread_id", "seq"])
    order = Window.partitionBy("question_id").orderBy("best.place", "best.rank", F.desc("seq"))
    ranked = pages.withColumn("page", F.row_number().over(order).cast("long")).withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("page") <= most) & (F.col("used") <= budget)).select("question_id", "page", "seq", F.col("best.route").alias("route"), "used")
