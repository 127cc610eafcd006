"""Searches and facts as they stood when a receipt was written, and receipts against what their search finds again.

Postings and facts carry the interval in which they are seen, so that a snapshot is a condition of a join and no state is
rebuilt. A receipt at `at_seq` sees what came before it and wasn't removed before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import terms_of


def seen(from_: str, until: str, at: str = "at_seq") -> Column:
    return (F.col(from_) < F.col(at)) & (F.col(until).isNull() | (F.col(until) >= F.col(at)))


def postings_at(episodes: DataFrame) -> DataFrame:
    """(thread_id, seq, content, removed_at) -> (thread_id, term, seq, until): one row per distinct term of an episode. Null
    and empty texts have none; a null removed_at stays open."""
    terms = F.explode(F.array_distinct(terms_of(F.col("content"))))
    return episodes.select("thread_id", terms.alias("term"), "seq", F.col("removed_at").alias("until"))


def searched(receipts: DataFrame, postings: DataFrame, most: int) -> DataFrame:
    """receipts (receipt_id, thread_id, at_seq, terms) -> (receipt_id, seq, rank): the `most` newest episodes that have every
    term of the receipt and are seen at its snapshot. Receipts without terms find nothing.

    Candidates come from the term that is rarest in the thread; only these meet the other terms, by thread, term and place.
    """
    asked = receipts.select("receipt_id", "thread_id", "at_seq", F.array_distinct("terms").alias("terms"))
    each = asked.select("receipt_id", "thread_id", "at_seq", F.explode("terms").alias("term"))
    held = postings.join(each.select("thread_id", "term").distinct(), ["thread_id", "term"], "left_semi")
    spread = held.groupBy("thread_id", "term").agg(F.count("*").alias("n"))
    first = each.join(spread, ["thread_id", "term"], "left").groupBy("receipt_id", "thread_id", "at_seq").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))["term"].alias("term"))
    hits = first.join(held, ["thread_id", "term"]).where(seen("seq", "until")).select("receipt_id", "thread_id", "seq", F.col("term").alias("via"))
    others = each.select("receipt_id", "thread_id", "term")
    open_ = hits.join(others, ["receipt_id", "thread_id"]).where("term <> via")
    lacking = open_.join(held.select("thread_id", "term", "seq"), ["thread_id", "term", "seq"], "left_anti").select("receipt_id", "seq")
    newest = Window.partitionBy("receipt_id").orderBy(F.desc("seq"))
    found = hits.select("receipt_id", "seq").distinct().join(lacking, ["receipt_id", "seq"], "left_anti")
    return found.withColumn("rank", F.row_number().over(newest).cast("long")).where(F.col("rank") <= most)


def replayed(receipts: DataFrame, recorded: DataFrame, again: DataFrame) -> DataFrame:
    """One row for each receipt: pages recorded, pages found again at its snapshot, those recorded but not found (`missing`)
    or found but not recorded (`extra`), how many have another rank, and whether all is the same."""
    a = recorded.select("receipt_id", "seq", F.col("rank").alias("was"))
    b = again.select("receipt_id", "seq", F.col("rank").alias("now"))
    both = a.join(b, ["receipt_id", "seq"], "full").groupBy("receipt_id").agg(F.count("was").alias("pages"), F.count("now").alias("again"), F.count_if(F.col("now").isNull()).alias("missing"), F.count_if(F.col("was").isNull()).alias("extra"), F.count_if(F.col("was") != F.col("now")).alias("moved"))
    counts = ["pages", "again", "missing", "extra", "moved"]
    out = receipts.select("receipt_id", "thread_id", "at_seq").join(both, "receipt_id", "left").fillna(0, counts)
    return out.withColumn("same", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("moved") == 0))


def facts_at(receipts: DataFrame, facts: DataFrame) -> DataFrame:
    """receipts (receipt_id, thread_id, at_seq, key) -> the fact of that key seen at the snapshot: the one of the user if there
    is one, else the newest proposal. Facts (thread_id, key, value, authority, valid_from, valid_to); one is still seen by a
    receipt at valid_to itself, as the statement that closed it isn't before the receipt."""
    rows = receipts.join(facts.select("thread_id", "key", "value", "authority", "valid_from", "valid_to"), ["thread_id", "key"]).where(seen("valid_from", "valid_to"))
    best = rows.groupBy("receipt_id", "thread_id", "at_seq", "key").agg(F.max(F.struct((F.col("authority") == "user").alias("u"), "valid_from", "value")).alias("b"))
    return best.select("receipt_id", "thread_id", "at_seq", "key", F.col("b.value").alias("value"), F.col("b.valid_from").alias("valid_from"), F.when(F.col("b.u"), "SUPPORTED").otherwise("PROPOSED").alias("phase"))
