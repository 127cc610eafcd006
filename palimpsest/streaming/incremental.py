"""Streaming forms of the archive's derived tables. Each gives, over a finished stream, what its batch form gives.

Threads are independent, so every stream is keyed by thread; episodes come with their seq, and what arrives twice is
dropped by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import approx_tokens

_LEAF = "thread_id long, no long, from_seq long, to_seq long, episodes long, tokens long"
_FACT = "thread_id long, key string, value string, valid_from long, previous string"


def sealed_windows(episodes: DataFrame, span: int) -> DataFrame:
    """Count windows, put out once each, when their last episode has come; state: the open windows' sums."""

    def seal(key, frames: Iterator[pd.DataFrame], state: GroupState):
        open_ = {} if not state.exists else {int(k): [int(x) for x in v.split(",")] for k, v in (p.split(":") for p in state.get[0].split(";") if p)}
        out = []
        for frame in frames:
            for seq, tokens in frame[["seq", "tokens"]].itertuples(index=False):
                no = (seq - 1) // span
                n, cost = open_.get(no, [0, 0])
                open_[no] = [n + 1, cost + tokens]
                if n + 1 == span:
                    out.append((key[0], no, no * span + 1, (no + 1) * span, span, open_.pop(no)[1]))
        state.update((";".join(f"{k}:{a},{b}" for k, (a, b) in open_.items()),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _LEAF.split(", ")])

    rows = episodes.dropDuplicates(["thread_id", "seq"]).select("thread_id", "seq", approx_tokens(F.col("content")).alias("tokens"))
    return rows.groupBy("thread_id").applyInPandasWithState(seal, _LEAF, "open string", "append", GroupStateTimeout.NoTimeout)


def revisions(stated: DataFrame) -> DataFrame:
    """(thread_id, key, seq, value) -> one row per change of a key's value, with the value before; state: that value and
    its seq. Statements older than the state are late and change nothing."""

    def follow(key, frames: Iterator[pd.DataFrame], state: GroupState):
        seq, value = state.get if state.exists else (0, None)
        out = []
        for at, said in pd.concat(list(frames)).sort_values("seq")[["seq", "value"]].itertuples(index=False):
            if at > seq and said != value:
                out.append((key[0], key[1], said, at, value))
                value = said
            seq = max(seq, at)
        state.update((int(seq), value))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _FACT.split(", ")])

    return stated.groupBy("thread_id", "key").applyInPandasWithState(follow, _FACT, "seq long, value string", "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and their values per type and hour, with a watermark for late ones."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, length: str = "24 hours", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events per type in sliding windows, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("events")).select("event_type", F.col("w.start").alias("from_ts"), "events")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events less than `gap` apart, put out once the watermark has passed their end."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("events"))
    return rows.select("user_id", "from_ts", "to_ts", "events")


def once(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without what arrives twice; state is kept only as long as the watermark allows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, name: str, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drain a stream into a Parquet table and read it; restarting with the same checkpoint adds nothing twice."""
    query = stream.writeStream.format("parquet").queryName(name).option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or one Parquet table, as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
