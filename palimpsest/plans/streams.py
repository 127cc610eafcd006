"""Queries whose rows come through streams and merges, and equal what SQL gives over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash
from ..operators import archive, atomize
from ..sources.episodes import CONV_SQL, conversation_episodes, table, talk_episodes
from ..sources.tables import shared_folder, stored
from ..streaming import commit, incremental, merge
from .catalogue import CHAIN_SQL
from .extraction import COMMIT_SQL
from .registry import query

FILES = 4


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def in_files(rows: DataFrame, file, path: str) -> str:
    """Rows as one file after the other, by their number `file`: what a stream that reads one a trigger gets."""
    rows = stored(rows.withColumn("_file", file), "arriving")
    for i in range(FILES):
        rows.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(path)
    return path


@query(f"WITH RECURSIVE {COMMIT_SQL} SELECT * FROM fact")
def streamed_facts(spark, d):
    """The law of authority as a stream with state: statements come in four batches, every fifth one a batch late, every
    seventh twice; the facts are those of the batch form."""
    e = stored(talk_episodes(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "talk")
    said = atomize.statements(atomize.corrected(atomize.drafts(e))).join(e.select("thread_id", "seq", "ts"), ["thread_id", "seq"])
    first, last = e.agg(F.unix_seconds(F.min("ts")).alias("a"), F.unix_seconds(F.max("ts")).alias("b")).first()
    share = max(1, ((last or 0) - (first or 0)) // FILES + 1)
    said = said.select("thread_id", "key", "seq", "value", "authority", "ts")
    file = F.floor((F.unix_seconds("ts") - F.lit(first or 0)) / share).cast("int")
    late = F.least(file + F.when(F.col("seq") % 5 == 0, 1).otherwise(0), F.lit(FILES - 1))
    # a last statement, far ahead, lets the watermark pass all others
    end = spark.createDataFrame([(-1, "end", 1, "end", "user", (last or 0) + 10 * share)], "thread_id long, key string, seq long, value string, authority string, ts long").withColumn("ts", F.timestamp_seconds("ts"))
    rows = said.withColumn("file", late).union(said.where("seq % 7 = 0").withColumn("file", F.lit(FILES - 1))).union(end.withColumn("file", F.lit(FILES - 1)))
    rows = stored(rows.withColumn("file", F.col("file").cast("int")), "arriving")
    path, checkpoint = _folder(spark, "statements"), _folder(spark, "commits")
    table_ = commit.FactTable(spark, _folder(spark, "facts"), FILES * share * 1000)
    for i in range(FILES):  # each time the stream goes on from where it ended
        rows.where(F.col("file") == i).drop("file").write.mode("append").parquet(path)
        commit.commit_stream(spark.readStream.schema(rows.drop("file").schema).parquet(path), table_, checkpoint)
    return table_.read().where("thread_id >= 0")


COUNTERS = "event_type string, n long, total double, first_ts timestamp, last_ts timestamp, last_user long, top_value double"


@query("WITH e AS (SELECT *, event_id % 4 AS f FROM events) SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS total, min(ts) AS first_ts, max(ts) AS last_ts, arg_max(user_id, (ts, user_id)) AS last_user, max(value) FILTER (f = (SELECT max(f) FROM e e2 WHERE e2.event_type = e.event_type)) AS top_value FROM e GROUP BY 1")
def merged_counters(spark, d):
    """Counters that four batches of a stream are merged into (sum, min, max, newest wins, overwrite), with the stream
    restarted from an older checkpoint in between: batches that come again change nothing."""
    e = table(spark, d, "events").select("event_type", "ts", "user_id", "value", "event_id")
    path = in_files(e, (F.col("event_id") % FILES).cast("int"), _folder(spark, "events"))
    stream = incremental.file_stream(spark, path)
    rows = stream.select("event_type", F.lit(1).cast("long").alias("n"), F.round(F.col("value") * 100).alias("total"), F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), F.col("user_id").alias("last_user"), F.col("value").alias("top_value"))
    rules = {"n": merge.Rule("sum"), "total": merge.Rule("sum"), "first_ts": merge.Rule("min"), "last_ts": merge.Rule("max"), "last_user": merge.Rule("newest", "last_ts"), "top_value": merge.Rule("overwrite")}
    counters = merge.MergedTable(spark, _folder(spark, "counters"), COUNTERS, ["event_type"], rules, 4)
    merge.merge_stream(rows, counters, _folder(spark, "one"))
    merge.merge_stream(rows, counters, _folder(spark, "two"))  # a checkpoint that knows of no batch
    return counters.read()


@query(CHAIN_SQL + " SELECT thread_id, seq, hash FROM fold WHERE seq > 0")
def chain_in_batches(spark, d):
    """A chain that three batches are appended to, each from the heads stored after the one before, which are themselves
    merged: it is the chain of all episodes."""
    e = stored(conversation_episodes(spark, d), "episodes").withColumn("part", F.least(F.floor((F.col("seq") - 1) / 2), F.lit(2)))
    rules = {"head_seq": merge.Rule("max"), "head_hash": merge.Rule("newest", "head_seq")}
    heads = merge.MergedTable(spark, _folder(spark, "heads"), "thread_id long, head_seq long, head_hash string", ["thread_id"], rules, 4)
    out = None
    for part in range(3):
        links = stored(archive.chained(e.where(F.col("part") == part), heads.read()), "links")
        heads.apply(archive.heads_of(links), part)
        out = links if out is None else out.union(links)
    return out.select("thread_id", "seq", "hash")


@query(CHAIN_SQL + """, link AS (SELECT f.thread_id, f.seq, lag(f.hash) OVER (PARTITION BY f.thread_id ORDER BY f.seq) AS prev, f.hash FROM fold f),
bad AS (SELECT thread_id, seq, seq % 7 = 5 AS wrong, seq % 11 = 6 AND seq > 1 AS broken FROM link WHERE seq > 0),
seg AS (SELECT *, ((seq - 1) // 4) * 4 AS from_seq FROM bad)
SELECT thread_id, from_seq, count(*) AS links, count(*) FILTER (wrong OR broken) AS wrong, count(*) FILTER (broken) AS broken, coalesce(bool_or(seq % 4 = 0 AND seq % 8 = 0), false) AS differs FROM seg GROUP BY 1, 2""")
def chain_segments_verified(spark, d):
    """Segments between stored checkpoints, verified each by itself, over a chain with faults planted: records changed at
    every seventh place from 5, prev_hash exchanged at every eleventh from 6, every other checkpoint stored wrong."""
    chain = stored(archive.chained(conversation_episodes(spark, d)), "links")
    marks = archive.checkpoints_of(chain, 4).withColumn("hash", F.when(F.col("seq") % 8 == 0, F.lit("0")).otherwise(F.col("hash")))
    record = F.when(F.col("seq") % 7 == 5, F.concat("record", F.lit(" "))).otherwise(F.col("record"))
    prev = F.when((F.col("seq") % 11 == 6) & (F.col("seq") > 1), F.lit("0")).otherwise(F.col("prev_hash"))
    return archive.verify_from(chain.withColumns({"record": record, "prev_hash": prev}), marks)


@query("""SELECT event_id, sha256('{"meta":{"k":' || json_extract_string(props, '$.k') || ',"tags":[1,2.5,true,null]},"type":"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}') AS hash, true AS same FROM events""")
def canonical_digests(spark, d):
    """Digests of events as JSON, written in two orders of keys with other spaces, numbers and escapes: both are the same."""
    e = table(spark, d, "events")
    user, inner = F.col("user_id").cast("string"), F.regexp_extract("props", r"\{(.*)\}", 1)
    one = F.concat(F.lit('{"user": '), user, F.lit('.0, "type": "'), "event_type", F.lit('", "meta": {"tags": [1, 2.50, true, null], '), inner, F.lit("}}"))
    two = F.concat(F.lit('{ "meta" : { '), inner, F.lit(' ,"tags":[ 1.0,25e-1,true,null ]}, "\\u0074ype":"'), "event_type", F.lit('","user":'), user, F.lit(" }"))
    rows = e.select("event_id", canonical_hash(one).alias("hash"), canonical_hash(two).alias("other"))
    return rows.select("event_id", "hash", (F.col("hash") == F.col("other")).alias("same"))
