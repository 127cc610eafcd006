"""Tables that batches are merged into, each batch once.

A table is a folder of buckets (hash of the keys) and a log. A batch is aggregated by key first, then only the buckets it
touches are read, merged and written anew beside the old ones; the log row of a new version names the folder of every
bucket and the last batch of every source, and writing it is the commit. So a batch that comes again after a restart
changes nothing, a version stays readable while the next is made, and what a failed attempt wrote is in no version. A
version that another writer has committed meanwhile makes the commit fail instead of being lost.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version long, bucket int, folder string, source string, batch long"


@dataclass(frozen=True)
class Rule:
    """How values of a column meet: sum, min, max, newest (the one of greatest `by`; on a tie what is there stays), oldest
    (the one of least `by`; on a tie what is there stays), overwrite (the last batch's)."""

    how: str
    by: str | None = None


def _merged(name: str, rule: Rule) -> Column:
    """One value of a key's rows. _round is 0 for what is there and 1 for the batch; nulls never win."""
    c, there = F.col(name), F.col(name).isNotNull()
    if rule.how in ("sum", "min", "max"):
        return {"sum": F.sum, "min": F.min, "max": F.max}[rule.how](c)
    if rule.how == "newest":
        return F.max_by(c, F.when(there, F.struct(F.col(rule.by), -F.col("_round"), c)))
    if rule.how == "oldest":
        return F.min_by(c, F.when(there, F.struct(F.col(rule.by), F.col("_round"), c)))
    if rule.how == "overwrite":
        return F.max_by(c, F.when(there, F.struct("_round", c)))
    raise ValueError(rule.how)


class MergedTable:
    """A versioned table of `schema` under `path`, one row for each `keys`, its other columns merged by `rules`.

    A column that another rule orders by must have a rule as well (max for newest, min for oldest). Null keys are keys.
    Every bucket of a version is one folder; the log has one row a bucket and version, so it grows with the number of
    batches and not with their size.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], rules: dict[str, Rule], buckets: int = 16):
        self.spark, self.path, self.keys, self.rules, self.buckets = spark, path.rstrip("/"), keys, rules, buckets
        self.schema = spark.createDataFrame([], schema).schema
        if {*keys, *rules} != set(self.schema.names):
            raise ValueError("every column is a key or has a rule")

    def _log(self, version: int, rows: list[tuple]) -> None:
        """The commit: the folder of a version is written once, or not at all."""
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/log/{version:012d}")

    def versions(self) -> dict[int, tuple[dict[int, str], dict[str, int]]]:
        """version -> (bucket -> folder, source -> last batch). An uncommitted version has no files that are read."""
        start = self.spark.createDataFrame([(0, None, None, None, None)], _LOG)
        start.coalesce(1).write.mode("ignore").parquet(f"{self.path}/log/{0:012d}")
        out: dict[int, tuple[dict[int, str], dict[str, int]]] = {}
        for r in self.spark.read.schema(_LOG).option("recursiveFileLookup", "true").parquet(f"{self.path}/log").collect():
            folders, batches = out.setdefault(r["version"], ({}, {}))
            if r["bucket"] is not None:
                folders[r["bucket"]] = r["folder"]
            if r["source"] is not None:
                batches[r["source"]] = r["batch"]
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        versions = self.versions()
        folders = [*versions[max(versions) if version is None else version][0].values()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int, source: str = "") -> bool:
        """Merge a batch of rows of the table's columns; whether it was new. Numbers of a source ascend."""
        versions = self.versions()
        now = max(versions)
        folders, batches = versions[now]
        if number <= batches.get(source, -1):
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        merge = lambda rows: rows.groupBy(*self.keys).agg(*[_merged(c, r).alias(c) for c, r in self.rules.items()])
        incoming = merge(batch.select(*self.schema.names, F.lit(1).alias("_round"))).withColumn("_bucket", bucket)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        incoming.write.partitionBy("_bucket").parquet(f"{folder}-in")
        incoming = self.spark.read.parquet(f"{folder}-in")
        touched = [r["_bucket"] for r in incoming.select("_bucket").distinct().collect()]  # at most `buckets`
        there = [folders[b] for b in touched if b in folders]
        rows = incoming.select(*self.schema.names, F.lit(1).alias("_round"))
        if there:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(*there).withColumn("_round", F.lit(0)))
        merge(rows).withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(folder)
        folders = folders | {b: f"{folder}/_bucket={b}" for b in touched}
        batches = batches | {source: number}
        log = [(now + 1, b, f, None, None) for b, f in folders.items()] + [(now + 1, None, None, s, n) for s, n in batches.items()]
        self._log(now + 1, log)
        return True


def merge_stream(stream: DataFrame, table: MergedTable, checkpoint: str, source: str = "") -> None:
    """Drain a stream of the table's rows into it; after a restart from the same checkpoint no batch is merged twice."""
    query = stream.writeStream.foreachBatch(lambda batch, number: table.apply(batch, number, source) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
