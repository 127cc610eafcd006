"""Scans, hash chain, count windows and statistics of an episode archive."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, epistemic
from ..sources.tables import stored

GENESIS = "archive:"


def tail(episodes: DataFrame, n: int) -> DataFrame:
    """The last n episodes of each thread."""
    last = Window.partitionBy("thread_id").orderBy(F.desc("seq"))
    return episodes.withColumn("_r", F.row_number().over(last)).where(F.col("_r") <= n).drop("_r")


def keyset_page(rows: DataFrame, keys: list[str], after: tuple, size: int) -> DataFrame:
    """The page behind a cursor, with one row more than its size as the sign that there is a next one."""
    behind, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, after):
        behind |= equal & (F.col(key) > F.lit(value))
        equal &= F.col(key) == F.lit(value)
    return rows.where(behind).orderBy(*keys).limit(size + 1)


def record(seq: Column, role: Column, content: Column) -> Column:
    """The chained record: JSON with keys in byte order."""
    return F.to_json(F.struct(F.sha2(content, 256).alias("content_hash"), role.alias("role"), seq.alias("seq")))


def chained(episodes: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Episodes with prev_hash and hash. hash_i = sha256(hash_(i-1) || record_i) is sequential within a thread, so threads
    are brought together and sorted by Spark and read as a stream that carries one hash: linear in a thread's length, with
    no thread in memory. With stored heads (thread_id, head_hash), a thread that has one goes on from there."""
    rec = episodes.select("thread_id", "seq", record(F.col("seq"), F.col("role"), F.col("content")).alias("record"))
    none = F.lit(None).cast("string")
    rec = rec.withColumn("head_hash", none) if heads is None else rec.join(heads.select("thread_id", "head_hash"), "thread_id", "left").select("thread_id", "seq", "record", "head_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, last = None, ""
        for batch in batches:
            before, after = [], []
            for t, r, head in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if t != thread or not last:
                    thread, last = t, head or hashlib.sha256(f"{GENESIS}{t}".encode()).hexdigest()
                before.append(last)
                last = hashlib.sha256((last + r).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(before, pa.string()), pa.array(after, pa.string())], ["thread_id", "seq", "record", "prev_hash", "hash"])

    return rec.repartition("thread_id").sortWithinPartitions("thread_id", "seq").mapInArrow(run, "thread_id long, seq long, record string, prev_hash string, hash string")


def heads_of(chain: DataFrame) -> DataFrame:
    """(thread_id, head_seq, head_hash) of the links."""
    return chain.groupBy("thread_id").agg(F.max("seq").alias("head_seq"), F.max_by("hash", "seq").alias("head_hash"))


def checkpoints_of(chain: DataFrame, every: int = 4096) -> DataFrame:
    """(thread_id, seq, hash) of every so many links: what is stored, so that verification can start anywhere."""
    return chain.where(F.col("seq") % every == 0).select("thread_id", "seq", "hash")


def verify_from(chain: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Per stored checkpoint (thread_id, seq, hash): whether the chain has that hash there, and the wrong and broken links
    from it up to the next one. A segment is verified without those before it."""
    at = F.max("mark").over(Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    marks = checkpoints.select("thread_id", "seq", F.col("hash").alias("stored"))
    rows = chain.join(marks, ["thread_id", "seq"], "left").withColumn("mark", F.when(F.col("stored").isNotNull(), F.col("seq")))
    before = Window.partitionBy("thread_id").orderBy("seq")
    rows = rows.select("thread_id", F.coalesce(at, F.lit(0)).alias("from_seq"), (F.sha2(F.concat("prev_hash", "record"), 256) != F.col("hash")).alias("wrong"), F.coalesce((F.lag("hash").over(before) != F.col("prev_hash")) | (F.lag("seq").over(before) != F.col("seq") - 1), F.lit(False)).alias("broken"), F.coalesce(F.col("stored") != F.col("hash"), F.lit(False)).alias("differs"))
    return rows.groupBy("thread_id", "from_seq").agg(F.count("*").alias("links"), F.count_if("wrong").alias("wrong"), F.count_if("broken").alias("broken"), F.bool_or("differs").alias("differs"))


def appended(episodes: DataFrame, heads: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows (thread_id, ts, role, content) to append: numbered behind their thread's head (thread_id, head_seq), those that
    the archive already has (same thread, ts, role and content) left out, so that appending twice adds nothing."""
    there = episodes.select("thread_id", "ts", "role", F.sha2("content", 256).alias("h"))
    new = incoming.withColumn("h", F.sha2("content", 256)).join(there, ["thread_id", "ts", "role", "h"], "left_anti")
    order = Window.partitionBy("thread_id").orderBy("ts", "role", "h")
    rows = new.dropDuplicates(["thread_id", "ts", "role", "h"]).withColumn("_r", F.row_number().over(order))
    return rows.join(heads, "thread_id", "left").select("thread_id", (F.coalesce("head_seq", F.lit(0)) + F.col("_r")).alias("seq"), "ts", "role", "content")


def verify_chain(chain: DataFrame) -> DataFrame:
    """Per thread: links, links whose hash is wrong, breaks of the order or of prev_hash. Each link is checked by itself
    and continuity by its predecessor, so a long thread is verified in parallel up to one sort."""
    before = Window.partitionBy("thread_id").orderBy("seq")
    prior = F.coalesce(F.lag("hash").over(before), F.sha2(F.concat(F.lit(GENESIS), F.col("thread_id").cast("string")), 256))
    step = F.col("seq") - F.coalesce(F.lag("seq").over(before), F.lit(0))
    rows = chain.select("thread_id", "seq", "hash", (F.sha2(F.concat("prev_hash", "record"), 256) != F.col("hash")).alias("wrong"), ((step != 1) | (prior != F.col("prev_hash"))).alias("broken"))
    return rows.groupBy("thread_id").agg(F.count("*").alias("links"), F.count_if("wrong").alias("wrong"), F.count_if("broken").alias("broken"), F.max_by("hash", "seq").alias("head_hash"))


def checkpoint_as_of(chain: DataFrame, every: int) -> DataFrame:
    """Each episode with the latest checkpoint (a multiple of `every`) not after it, by a window, without a join."""
    at = Window.partitionBy("thread_id").orderBy("seq")
    mark = F.when(F.col("seq") % every == 0, F.struct("seq", "hash"))
    last = F.last(mark, ignorenulls=True).over(at)
    return chain.select("thread_id", "seq", last["seq"].alias("checkpoint_seq"), last["hash"].alias("checkpoint_hash"))


def windows(episodes: DataFrame, span: int) -> DataFrame:
    """Sealed tumbling count windows: only those with all `span` episodes."""
    rows = episodes.groupBy("thread_id", F.floor((F.col("seq") - 1) / span).cast("long").alias("no"))
    full = rows.agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count("*").alias("episodes"), F.sum(approx_tokens(F.col("content"))).alias("tokens"))
    return full.where(F.col("episodes") == span)


def hierarchy(episodes: DataFrame, base: int, fan_out: int, levels: int) -> DataFrame:
    """Sealed windows of all levels; level k has base * fan_out**k episodes. The episodes are read once, for the leaves, which
    are written; upper levels are sums of these."""
    leaves = stored(windows(episodes, base), "leaves").withColumn("level", F.lit(0))
    out, below = leaves, leaves
    for k in range(1, levels):
        above = below.groupBy("thread_id", F.floor(F.col("no") / fan_out).cast("long").alias("no")).agg(F.min("from_seq").alias("from_seq"), F.max("to_seq").alias("to_seq"), F.sum("episodes").alias("episodes"), F.sum("tokens").alias("tokens"), F.count("*").alias("_n"))
        below = above.where(F.col("_n") == fan_out).drop("_n").withColumn("level", F.lit(k))
        out = out.unionByName(below)
    return out


def children(capsules: DataFrame, fan_out: int) -> DataFrame:
    """Parent and child windows, joined on equal numbers instead of on containment."""
    parent = capsules.select("thread_id", "level", F.col("no"), F.col("from_seq").alias("parent_from"), F.col("to_seq").alias("parent_to"))
    child = capsules.select("thread_id", (F.col("level") + 1).alias("level"), F.floor(F.col("no") / fan_out).cast("long").alias("no"), F.col("from_seq").alias("child_from"), F.col("to_seq").alias("child_to"))
    return parent.join(child, ["thread_id", "level", "no"])


def thread_stats(episodes: DataFrame) -> DataFrame:
    roles = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("user", "assistant", "system")]
    return episodes.groupBy("thread_id").agg(F.count("*").alias("episodes"), *roles, F.max("seq").alias("head_seq"), F.sum(approx_tokens(F.col("content"))).alias("tokens"), F.min("seq").alias("first_seq"))


def labelled(episodes: DataFrame) -> DataFrame:
    return episodes.select("thread_id", "seq", approx_tokens(F.col("content")).alias("tokens"), epistemic(F.col("role")).alias("epistemic"))


def nearest_speaker(episodes: DataFrame, wanted: str, within: int) -> DataFrame:
    """For each episode the nearest earlier one of the wanted role at most `within` before it, or null: an as-of join as
    a window."""
    before = Window.partitionBy("thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when(F.col("role") == wanted, F.col("seq")), ignorenulls=True).over(before)
    return episodes.select("thread_id", "seq", F.when(F.col("seq") - near <= within, near).alias("speaker_seq"))


def nearest_in_direction(episodes: DataFrame, wanted: str, within: int, forward: bool) -> DataFrame:
    """The nearest episode of the wanted role in one direction, at most `within` away. Removed episodes are stepped over; a
    missing number ends the walk: runs of consecutive numbers are islands, and the walk stays in its own."""
    base = Window.partitionBy("thread_id").orderBy("seq")
    island = episodes.withColumn("island", F.col("seq") - F.row_number().over(base))
    order = Window.partitionBy("thread_id", "island").orderBy(F.desc("seq") if forward else F.col("seq")).rowsBetween(Window.unboundedPreceding, -1)
    near = F.last(F.when((F.col("role") == wanted) & ~F.col("removed"), F.col("seq")), ignorenulls=True).over(order)
    return island.select("thread_id", "seq", F.when(F.abs(F.col("seq") - near) <= within, near).alias("near_seq"))


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(order).alias(f"first_{order}"), F.count("*").alias("n"))


def histogram(episodes: DataFrame, slices: int) -> DataFrame:
    """Episodes over equal slices of their thread, by exact integer bucketing."""
    head = F.max("seq").over(Window.partitionBy("thread_id"))
    rows = episodes.select(F.floor((F.col("seq") - 1) * slices / head).cast("long").alias("slice"))
    return rows.groupBy("slice").agg(F.count("*").alias("n"))
