"""The law of authority as a stream: statements come in any order within a delay and twice, facts open and close.

State of a key of a thread: the supported value and the open proposal with their places (one value), and statements that
wait for their time (a list). A statement waits until the watermark has passed its time, then all that wait are applied in
order of their place; what is at or before the last place applied has been seen. A key that nothing was said about for
`idle` loses its state by a timer of its own; the next statement of it opens a fact anew.

FactTable does the same for streams in which very many keys move at once: its state are tables, and a batch is a few windows
over all of them instead of questions key by key. It knows no `idle`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import collapsed
from ..operators import facts

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE = "thread_id long, key string, event string, seq long, value string, authority string, at long"
_ROW = Row(*(c.split()[0] for c in CHANGE.split(", ")))
_HEAD = "last long, said long, supported string, supported_seq long, proposed string, proposed_seq long"


class Head(NamedTuple):
    """What a key holds: the last place applied, the time of it, and both lanes."""

    last: int = 0
    said: int = 0
    supported: str | None = None
    supported_seq: int | None = None
    proposed: str | None = None
    proposed_seq: int | None = None


def step(head: Head, seq: int, said: int, norm: str, value: str, user: bool) -> tuple[Head, list[tuple]]:
    """The head after a statement, and the changes (event, seq of the fact, value, authority, at) that it makes."""
    head = head._replace(last=seq, said=max(head.said, said))
    if norm == head.supported or (not user and norm == head.proposed):
        return head, []
    closes = ([head.supported_seq] if user and head.supported is not None else []) + ([head.proposed_seq] if head.proposed is not None else [])
    changes = [("closed", c, None, None, seq) for c in closes] + [("opened", seq, value, "user" if user else "assistant", seq)]
    if user:
        return head._replace(supported=norm, supported_seq=seq, proposed=None, proposed_seq=None), changes
    return head._replace(proposed=norm, proposed_seq=seq), changes


class Committer(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", _HEAD)
        self.waiting = handle.getListState("waiting", "seq long, said long, norm string, value string, user boolean")

    def _apply(self, key, passed: int) -> list[tuple]:
        head = Head(*self.head.get()) if self.head.exists() else Head()
        rows = sorted(tuple(r) for r in self.waiting.get())
        out = []
        for seq, said, norm, value, user in (r for r in rows if r[1] <= passed):
            if seq > head.last:
                head, changes = step(head, seq, said, norm, value, user)
                out += [(*key, *c) for c in changes]
        late = [r for r in rows if r[1] > passed]
        if late:
            self.waiting.put(late)
        else:
            self.waiting.clear()
        if head.last:
            self.head.update(tuple(head))
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        new = [(r["seq"], r["said"], r["norm"], r["value"], r["user"]) for r in rows if r["said"] >= passed]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(r[1] for r in new))  # one a key and batch: all that wait by then are applied in order
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        out = self._apply(key, timerValues.getCurrentWatermarkInMs())
        if self.idle_ms is not None and self.head.exists():
            head = Head(*self.head.get())
            if at >= head.said + self.idle_ms and not self.waiting.exists():
                self.head.clear()
            else:
                self.handle.registerTimer(head.said + self.idle_ms)
        return (_ROW(*r) for r in out)

    def close(self) -> None:
        pass


def committed(stated: DataFrame, delay: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """(thread_id, key, seq, value, authority, ts) as a stream -> changes of facts: opened with value and authority, or closed
    at the place of the statement that closes them. Needs the state store ROCKS_DB. Statements that come later than `delay`
    are dropped; a null key or value states nothing."""
    said = (F.unix_millis("ts")).alias("said")
    rows = stated.where("key is not null and value is not null").withWatermark("ts", delay).select("thread_id", "key", "ts", "seq", said, collapsed(F.col("value")).alias("norm"), "value", (F.col("authority") == "user").alias("user"))
    return rows.groupBy("thread_id", "key").transformWithState(Committer(idle_ms), CHANGE, "append", "EventTime")


def facts_of(changes: DataFrame) -> DataFrame:
    """Changes as facts with phases and intervals, as two_lanes gives them."""
    opened, closed = F.col("event") == "opened", F.col("event") == "closed"
    rows = changes.groupBy("thread_id", "key", F.col("seq").alias("valid_from")).agg(F.max(F.when(opened, F.col("value"))).alias("value"), F.max(F.when(opened, F.col("authority"))).alias("authority"), F.min(F.when(closed, F.col("at"))).alias("valid_to"))
    phase = F.when(F.col("valid_to").isNotNull(), "HISTORICAL").when(F.col("authority") == "user", "SUPPORTED").otherwise("PROPOSED")
    return rows.select("thread_id", "key", "value", "authority", phase.alias("phase"), "valid_from", "valid_to")


_SAID = "thread_id long, key string, seq long, value string, authority string, ts timestamp"
_MADE = "thread_id long, key string, value string, authority string, phase string, valid_from long, valid_to long, last long"


class FactTable:
    """Facts that batches of statements are committed to, each batch once.

    A batch leaves three tables under its number: the statements that wait, the facts made or carried on (closed ones, and open
    ones, of which a key has at most one in each lane), and the mark that time has passed. It reads those of the batch before, so
    one that comes again gives the same tables again. The open facts of a key are all that the law needs to know of its past:
    as statements before the new ones they lead to the same lanes. A batch reads and writes all open facts.
    """

    def __init__(self, spark: SparkSession, path: str, delay_ms: int):
        self.spark, self.path, self.delay_ms = spark, path.rstrip("/"), delay_ms
        self.number = -1  # the last batch that is done

    def _of(self, number: int, what: str, schema: str) -> DataFrame:
        if number < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{number:012d}/{what}")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Commit the batch after number - 1. Statements are (thread_id, key, seq, value, authority, ts); those behind the mark of
        the batches before are late and dropped; a null key or value states nothing."""
        at, keys = f"{self.path}/{number:012d}", ["thread_id", "key"]
        before = self._of(number - 1, "mark", "passed long").first()
        passed = before["passed"] if before else None
        new = batch.where("key is not null and value is not null").select(*[c.split()[0] for c in _SAID.split(", ")])
        if passed is not None:
            new = new.where(F.unix_millis("ts") >= passed)
        newest = batch.where("key is not null and value is not null").agg(F.max(F.unix_millis("ts")).alias("n")).first()["n"]
        marks = [m for m in (passed, newest - self.delay_ms if newest is not None else None) if m is not None]
        mark = max(marks, default=None)
        self.spark.createDataFrame([(mark,)] if marks else [], "passed long").coalesce(1).write.mode("overwrite").parquet(f"{at}/mark")
        waiting = self._of(number - 1, "waiting", _SAID).union(new)
        due = F.unix_millis("ts") <= F.lit(mark).cast("long")
        waiting.where(~F.coalesce(due, F.lit(False))).write.mode("overwrite").parquet(f"{at}/waiting")
        held = self._of(number - 1, "facts/open=true", _MADE).select(*keys, F.col("valid_from").alias("seq"), "value", "authority", "last")
        said = waiting.where(due).select(*keys, "seq", "value", "authority", F.lit(None).cast("long").alias("last"))
        # what is at or before the last place applied has been seen; what comes twice counts once
        of = Window.partitionBy(*keys)
        rows = held.union(said).withColumn("_seen", F.max("last").over(of)).where("last is not null or _seen is null or seq > _seen")
        rows = rows.withColumn("_n", F.row_number().over(of.orderBy("seq", F.col("last").isNull(), "value", "authority")))
        rows = rows.withColumn("_before", F.lag("seq").over(of.orderBy("_n"))).where("_before is null or _before <> seq")
        rows = rows.withColumn("last", F.max(F.greatest(F.coalesce("_seen", F.lit(0)), "seq")).over(of)).drop("_seen", "_n", "_before")
        made = facts.two_lanes(rows, ["last"]).withColumn("open", F.col("valid_to").isNull())
        made.write.mode("overwrite").partitionBy("open").parquet(f"{at}/facts")
        for open_ in ("true", "false"):  # a folder that no row went to is an empty table
            self.spark.createDataFrame([], _MADE).write.mode("append").parquet(f"{at}/facts/open={open_}")
        self.number = number

    def read(self) -> DataFrame:
        """All facts so far, as two_lanes gives them."""
        closed = [self._of(n, "facts/open=false", _MADE) for n in range(self.number + 1)]
        out = self._of(self.number, "facts/open=true", _MADE)
        for more in closed:
            out = out.union(more)
        return out.drop("last")


def commit_stream(stream: DataFrame, table: FactTable, checkpoint: str) -> None:
    """Drain a stream of statements into the table; a batch that comes again after a restart changes nothing."""
    query = stream.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
