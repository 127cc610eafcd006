"""The loss ledger: names of a window that its summary no longer contains, and what can be asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def name_entries(names: DataFrame, span: int) -> DataFrame:
    """One entry per (thread, window, name), with the newest place."""
    rows = names.withColumn("no", F.floor((F.col("seq") - 1) / span).cast("long"))
    return rows.groupBy("thread_id", "no", "name", "kind").agg(F.max("seq").alias("seq"))


def split_by_summary(entries: DataFrame, summary_names: DataFrame) -> DataFrame:
    """Entries with `kept`: whether the window's summary still has the name."""
    there = summary_names.select("thread_id", "no", "name", "kind").distinct().withColumn("_in", F.lit(True))
    return entries.join(there, ["thread_id", "no", "name", "kind"], "left").withColumn("kept", F.coalesce("_in", F.lit(False))).drop("_in")


def ledger_of(capsules: DataFrame, losses: DataFrame, base: int) -> DataFrame:
    """Losses in each capsule's range: the interval join as an equi-join on leaf numbers."""
    spread = capsules.select("thread_id", "level", "no", F.explode(F.sequence(F.floor((F.col("from_seq") - 1) / base), F.floor((F.col("to_seq") - 1) / base))).alias("leaf"))
    return spread.join(losses.withColumnRenamed("no", "leaf"), ["thread_id", "leaf"]).groupBy("thread_id", "level", "no").agg(F.count("*").alias("losses"), F.countDistinct("name").alias("names"))


def newest(losses: DataFrame) -> DataFrame:
    """The last place of each lost name of a thread."""
    return losses.groupBy("thread_id", "name").agg(F.max("seq").alias("seq"), F.count("*").alias("times"))


def digest(losses: DataFrame, in_view: DataFrame, most: int) -> DataFrame:
    """Up to `most` newest lost names of each thread that the view doesn't show."""
    rest = newest(losses).join(in_view.select("thread_id", "name").distinct(), ["thread_id", "name"], "left_anti")
    order = Window.partitionBy("thread_id").orderBy(F.desc("seq"), "name")
    return rest.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("thread_id", "rank", "name", "seq")


def stop_names(names: DataFrame, horizon: int, share: float, least: int) -> DataFrame:
    """Names in more than max(least, share of the last `horizon` episodes) episodes of their thread."""
    head = names.groupBy("thread_id").agg(F.max("seq").alias("head"))
    recent = names.join(head, "thread_id").where(F.col("seq") > F.col("head") - horizon)
    counts = recent.groupBy("thread_id", "name").agg(F.countDistinct("seq").alias("hits"), F.max("head").alias("head"))
    limit = F.greatest(F.lit(least), F.floor(F.least(F.lit(horizon), F.col("head")) * F.lit(share)))
    return counts.where(F.col("hits") > limit).select("thread_id", "name", "hits")
