"""Packets: what is shown of a thread under a token budget, lane by lane.

Lanes are filled in order. A lane has its share of the budget and what the lanes before it left, and takes its items in rank
order up to the first that doesn't fit. Within a lane that is a running sum, and one number a thread and budget goes from
lane to lane, so no thread's items are ever collected. The last lane shows, for a question, the newest episodes that have
those of its names which are not in view yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import KINDS
from ..sources.tables import stored
from .budget import SHARES

LANES = ("header", "facts", "capsules", "recent", "pages")
_MOST = (1 << 63) - 1


def share(budget: Column, lane: str) -> Column:
    """Whole tokens of a lane's own; recent episodes have what the other shares leave."""
    part = lambda p: F.floor(budget * p / 100).cast("long")
    if lane in SHARES:
        return part(SHARES[lane])
    rest = budget
    for p in SHARES.values():
        rest = rest - part(p)
    return rest


def fill(items: DataFrame, state: DataFrame, lane: str) -> tuple[DataFrame, DataFrame]:
    """(items taken, state after the lane). items: (thread_id, rank, cost, ...), or with their budget if they differ by it;
    state: (thread_id, budget, spare)."""
    keys = ["thread_id", "budget"] if "budget" in items.columns else ["thread_id"]
    order = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = items.withColumn("upto", F.sum("cost").over(order))
    caps = state.select("thread_id", "budget", (share(F.col("budget"), lane) + F.col("spare")).alias("cap"))
    taken = stored(summed.join(caps, keys).where(F.col("upto") <= F.col("cap")).drop("cap").withColumn("lane", F.lit(lane)), "lane")
    used = taken.groupBy("thread_id", "budget").agg(F.max("upto").alias("used"))
    after = caps.join(used, ["thread_id", "budget"], "left").select("thread_id", "budget", (F.col("cap") - F.coalesce("used", F.lit(0))).alias("spare"))
    return taken, stored(after, "spare")


def compiled(lanes: dict[str, DataFrame], threads: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(thread_id, budget, lane, rank, seq, text, cost, upto) of all that the lanes take for every thread and budget, and
    what is left (thread_id, budget, spare). lanes: name -> (thread_id, rank, seq, text, cost) in the order they are filled;
    ranks of a lane are distinct within a thread."""
    state = stored(threads.select("thread_id").distinct().join(F.broadcast(budgets)).withColumn("spare", F.lit(0).cast("long")), "spare")
    out = None
    for lane, items in lanes.items():
        taken, state = fill(items, state, lane)
        taken = taken.select("thread_id", "budget", "lane", "rank", "seq", "text", "cost", "upto")
        out = taken if out is None else out.unionByName(taken)
    return out, state


def pages(asked: DataFrame, view: DataFrame, places: DataFrame, episodes: DataFrame) -> DataFrame:
    """(thread_id, budget, rank, seq, text) for the names that a thread's question (thread_id, query_seq, name, kind) has and
    its view (thread_id, budget, name) hasn't: the newest episode before the question that has the name. Decisive kinds come
    first, then longer names; an episode is shown once."""
    threads = view.select("thread_id", "budget").distinct()
    open_ = asked.join(threads, "thread_id").join(view.select("thread_id", "budget", "name").distinct(), ["thread_id", "budget", "name"], "left_anti")
    newest = asked.select("thread_id", "query_seq", "name").distinct().join(places.select("thread_id", "seq", "name"), ["thread_id", "name"]).where("seq < query_seq").groupBy("thread_id", "name").agg(F.max("seq").alias("seq"))
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = open_.join(newest, ["thread_id", "name"]).groupBy("thread_id", "budget", "seq").agg(F.min(F.struct(kind, -F.length("name"), "name")).alias("o"))
    order = Window.partitionBy("thread_id", "budget").orderBy("o", "seq")
    return best.withColumn("rank", F.row_number().over(order)).join(episodes.select("thread_id", "seq", F.col("content").alias("text")), ["thread_id", "seq"]).select("thread_id", "budget", "rank", "seq", "text")


def packet(items: DataFrame) -> DataFrame:
    """One row a thread and budget: items, tokens (a sum that saturates), and the digest of its text, lane after lane. A
    packet is bounded by its budget."""
    lane = F.array_position(F.array(*[F.lit(x) for x in LANES]), F.col("lane"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(lane, "rank", "text"))), lambda x: x["text"]), "\n")
    return items.groupBy("thread_id", "budget").agg(F.count("*").alias("items"), saturating_sum(F.col("cost")).alias("tokens"), F.sha2(text, 256).alias("hash"))


def saturating_sum(size: Column) -> Column:
    """The sum of positive sizes, or the largest long where it doesn't fit one."""
    positive = F.when(size > 0, size)
    return F.when(F.count(positive) == 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.try_sum(positive), F.lit(_MOST)))
