"""Facts with validity intervals, their lookups, and the two-lane law of authority."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed


def revisions(stated: DataFrame) -> DataFrame:
    """(thread_id, key, seq, value) -> facts valid on [valid_from, valid_to): restatements of the current value are no
    revisions, and a new value closes the one before."""
    order = Window.partitionBy("thread_id", "key").orderBy("seq")
    changed = stated.withColumn("_p", F.lag("value").over(order)).where(F.col("_p").isNull() | (F.col("_p") != F.col("value")))
    return changed.select("thread_id", "key", "value", F.col("seq").alias("valid_from"), F.lead("seq").over(order).alias("valid_to"))


def current(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("valid_to").isNull()).select("thread_id", "key", "value", "valid_from")


def as_of(facts: DataFrame, seq: int) -> DataFrame:
    return facts.where((F.col("valid_from") <= seq) & (F.col("valid_to").isNull() | (F.col("valid_to") > seq))).select("thread_id", "key", "value", "valid_from")


def last_changed(facts: DataFrame, n: int) -> DataFrame:
    """The n keys of each thread whose current value is newest."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("valid_from"), "key")
    return current(facts).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("thread_id", "rank", "key", "value")


def with_previous(facts: DataFrame) -> DataFrame:
    """Current and previous value of each key that has both."""
    order = Window.partitionBy("thread_id", "key").orderBy("valid_from")
    rows = facts.withColumn("previous", F.lag("value").over(order))
    return rows.where(F.col("valid_to").isNull() & F.col("previous").isNotNull()).select("thread_id", "key", "value", "previous")


def by_name(facts: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """For each asked key (thread_id, key), up to n facts, current ones first, then the newest."""
    order = Window.partitionBy("thread_id", "key").orderBy(F.col("valid_to").isNotNull(), F.desc("valid_from"))
    return facts.join(asked, ["thread_id", "key"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("thread_id", "key", "rank", "value", "valid_from")


def two_lanes(stated: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(thread_id, key, seq, value, authority) -> facts under the law of authority, with the columns to carry along.

    A statement equal to the supported value changes nothing. One of the assistant that equals an open proposal
    changes nothing either. Else it becomes a fact (SUPPORTED if the user's, PROPOSED if not), closes open proposals,
    and closes the supported value only if it is the user's. Closed facts are HISTORICAL.

    No fold is needed: the supported value is what the user said last; between two changes of it the open proposal is the
    assistant's last statement that differs from it; and a fact is closed by the next that may close it.
    """
    norm, user = collapsed(F.col("value")), F.col("authority") == "user"
    key = Window.partitionBy("thread_id", "key").orderBy("seq")
    before = key.rowsBetween(Window.unboundedPreceding, -1)
    rows = stated.withColumn("norm", norm).withColumn("supported", F.last(F.when(user, F.col("norm")), ignorenulls=True).over(before))
    other = ~F.col("norm").eqNullSafe(F.col("supported"))
    rows = rows.where(other).withColumn("epoch", F.count_if(user).over(key.rowsBetween(Window.unboundedPreceding, 0)))
    lane = Window.partitionBy("thread_id", "key", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    proposed = F.last(F.when(~user, F.col("norm")), ignorenulls=True).over(lane)
    made = rows.withColumn("proposed", proposed).where(user | ~F.col("norm").eqNullSafe(F.col("proposed")))
    behind = key.rowsBetween(1, Window.unboundedFollowing)
    closed = F.when(user, F.first(F.when(user, F.col("seq")), ignorenulls=True).over(behind)).otherwise(F.lead("seq").over(key))
    rows = made.withColumn("valid_to", closed)
    phase = F.when(F.col("valid_to").isNotNull(), "HISTORICAL").when(user, "SUPPORTED").otherwise("PROPOSED")
    return rows.select("thread_id", "key", "value", "authority", phase.alias("phase"), F.col("seq").alias("valid_from"), "valid_to", *(carry or []))


def frontier(facts: DataFrame, budget: int) -> DataFrame:
    """Current facts of each thread, newest first, taken while they fit: one that doesn't is skipped, later ones may
    still fit. The fold's state is a sum and the taken keys."""
    cost = F.length(F.concat_ws(" ", "key", "value"))
    rows = current(facts).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("valid_from")).alias("o"), "key", cost.cast("long").alias("cost")))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("keys"))
    taken = F.aggregate("rows", start, lambda acc, x: F.when(acc["used"] + x["cost"] <= budget, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["keys"], F.array(x["key"])).alias("keys"))).otherwise(acc))
    return rows.select("thread_id", taken.alias("t")).select("thread_id", F.col("t.used").alias("used"), F.array_join("t.keys", ",").alias("keys"))


def differing(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Stored facts whose authority or value isn't what the archive gives; an authority that was raised is told first."""
    right = derived.select("thread_id", "key", "valid_from", F.col("authority").alias("_a"), F.col("value").alias("_v"))
    rows = stored.join(right, ["thread_id", "key", "valid_from"]).where((F.col("authority") != F.col("_a")) | (F.col("value") != F.col("_v")))
    return rows.select("thread_id", "key", "valid_from", F.when(F.col("authority") != F.col("_a"), "authority").otherwise("value").alias("fault"))


def name_index(facts: DataFrame, without: list[DataFrame]) -> DataFrame:
    """(thread_id, name, key, part, value, phase, valid_from): facts by key and by value; facts whose source (thread_id,
    valid_from) is in one of the tables of `without` are left out."""
    for sources in without:
        facts = facts.join(sources, ["thread_id", "valid_from"], "left_anti")
    parts = F.array(F.struct(F.lower("key").alias("name"), F.lit("key").alias("part")), F.struct(F.lower("value").alias("name"), F.lit("value").alias("part")))
    return facts.select("thread_id", F.explode(parts).alias("p"), "key", "value", "phase", "valid_from").select("thread_id", "p.name", "key", "p.part", "value", "phase", "valid_from")


def lookup(index: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Up to n facts of each thread for each asked name: by key in any phase, by value only supported ones; those first,
    then the newest."""
    order = Window.partitionBy("thread_id", "name").orderBy(F.col("phase") != "SUPPORTED", F.desc("valid_from"), "key", "part")
    hits = index.join(asked.select("name").distinct(), "name").where((F.col("part") == "key") | (F.col("phase") == "SUPPORTED"))
    return hits.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("thread_id", "name", "rank", "key", "part", "value", "valid_from")


def frontier_lanes(rows: DataFrame, size: int) -> DataFrame:
    """(thread_id, key, valid_from, kind_no, pinned, cost): the order in which facts are shown, cut where the sum of costs
    passes `size`: running sums, no collected lists."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("pinned"), "kind_no", F.desc("valid_from"), "key")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("used", F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where(F.col("used") <= size).select("thread_id", "rank", "key", "used")
