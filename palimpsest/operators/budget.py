"""Token budgets: skip-fit and stop-fit fills, trims, shares, and gaps-and-islands of coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens

# Shares of the budget, in percent.
SHARES = {"header": 4, "facts": 20, "capsules": 18, "pages": 18}


def allocate(budgets: DataFrame) -> DataFrame:
    """Whole tokens per slot; what rounding and the shares leave goes to recent episodes."""
    slots = [F.floor(F.col("budget") * F.lit(p) / F.lit(100)).cast("long").alias(name) for name, p in SHARES.items()]
    rows = budgets.select("budget", *slots)
    return rows.withColumn("recent", F.col("budget") - F.col("header") - F.col("facts") - F.col("capsules") - F.col("pages"))


def recent_fill(episodes: DataFrame, budget: int, extra: int = 4) -> DataFrame:
    """Newest first, an episode that no longer fits is skipped and older ones may still fit. A fold over one thread's
    costs (numbers, no texts)."""
    cost = (approx_tokens(F.col("content")) + extra).alias("cost")
    rows = episodes.select("thread_id", (-F.col("seq")).alias("o"), cost).groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("o", "cost"))).alias("rows"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("oldest"))
    step = lambda acc, x: F.when(acc["used"] + x["cost"] <= budget, F.struct((acc["used"] + x["cost"]).alias("used"), (acc["n"] + 1).alias("n"), (-x["o"]).alias("oldest"))).otherwise(acc)
    return rows.select("thread_id", F.aggregate("rows", start, step).alias("f")).select("thread_id", "f.used", "f.n", "f.oldest")


def fill_with_omitted(rows: DataFrame, most: int) -> DataFrame:
    """(thread_id, o, key, cost): in order of (o, key), what fits is taken and what doesn't is counted. A fold over the costs
    of one thread's live facts (numbers, no texts)."""
    lists = rows.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("o", "key", "cost"))).alias("rows"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("used"), zero.alias("shown"), zero.alias("omitted"))
    take = lambda a, x: F.struct((a["used"] + x["cost"]).alias("used"), (a["shown"] + 1).alias("shown"), a["omitted"].alias("omitted"))
    leave = lambda a: F.struct(a["used"].alias("used"), a["shown"].alias("shown"), (a["omitted"] + 1).alias("omitted"))
    done = lists.select("thread_id", F.aggregate("rows", start, lambda a, x: F.when(a["used"] + x["cost"] <= most, take(a, x)).otherwise(leave(a))).alias("f"))
    return done.select("thread_id", "f.used", "f.shown", "f.omitted")


def prefix(episodes: DataFrame, budget: int) -> DataFrame:
    """Oldest first up to the first episode that doesn't fit (each costs one more after the first): a running sum."""
    order = Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cost = approx_tokens(F.col("content")) + F.when(F.col("seq") > 1, 1).otherwise(0)
    used = episodes.select("thread_id", "seq", F.sum(cost).over(order).alias("used"))
    return used.where(F.col("used") <= budget).groupBy("thread_id").agg(F.max("seq").alias("to_seq"), F.max("used").alias("used"))


def suffix(episodes: DataFrame, budget: int) -> DataFrame:
    """Drop the oldest episodes until the rest fits: a running sum from the end."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    used = episodes.select("thread_id", "seq", F.sum(approx_tokens(F.col("content"))).over(order).alias("used"))
    return used.where(F.col("used") <= budget).groupBy("thread_id").agg(F.min("seq").alias("from_seq"), F.max("used").alias("used"))


def proportional(rows: DataFrame, size: str, budget: int, *keys: str) -> DataFrame:
    """Shares of a budget in proportion to sizes, in whole tokens; sizes that fit together are kept."""
    whole = F.sum(size).over(Window.partitionBy(*keys))
    return rows.withColumn("share", F.when(whole <= budget, F.col(size)).otherwise(F.floor(F.col(size) * budget / whole)).cast("long"))


def islands(states: DataFrame) -> DataFrame:
    """(thread_id, seq, state) -> maximal runs of equal state."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    new = F.when(F.lag("state").over(order).eqNullSafe(F.col("state")), 0).otherwise(1)
    runs = states.select("thread_id", "seq", "state", new.alias("new")).withColumn("run", F.sum("new").over(order))
    return runs.groupBy("thread_id", "run").agg(F.first("state").alias("state"), F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq")).drop("run")
