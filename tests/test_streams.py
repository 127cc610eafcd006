"""Streams with state and merges: what comes late, twice, or after a restart."""

import datetime
import random

import pyspark.sql.functions as F
import pytest

from palimpsest.operators import archive, facts
from palimpsest.streaming import commit, incremental, merge

STATED = "thread_id long, key string, seq long, value string, authority string, ts timestamp"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def drained(spark, tmp_path, files, delay, idle_ms=None):
    path = str(tmp_path / "in")
    for rows in files:
        spark.createDataFrame(rows, STATED).coalesce(1).write.mode("append").parquet(path)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", commit.ROCKS_DB)
    stream = incremental.file_stream(spark, path)
    out = incremental.run_to_table(commit.committed(stream, delay, idle_ms), "commit", str(tmp_path / "out"), str(tmp_path / "check"))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return out.where("thread_id > 0")


def said(seq, value, who="user", key="k", minute=None, thread=1):
    return (thread, key, seq, value, who, at(seq if minute is None else minute))


END = (-1, "end", 1, "end", "user", at(100_000))


def test_commit_law_late_and_doubled(spark, tmp_path):
    files = [
        [said(3, "b"), said(1, "a", "assistant"), said(1, "a", "assistant"), said(9, "z", key="other")],
        [said(2, "a ", "assistant"), said(4, "c", "assistant"), said(3, "b"), said(6, "d")],
        [said(5, "B"), (1, None, 7, "x", "user", at(7)), (1, "k", 8, None, "user", at(8)), END],
    ]
    got = commit.facts_of(drained(spark, tmp_path, files, "30 minutes"))
    whole = {r[:5] for f in files for r in f if r[0] > 0 and r[1] and r[3]}
    want = facts.two_lanes(spark.createDataFrame(sorted(whole), "thread_id long, key string, seq long, value string, authority string"))
    columns = ["key", "value", "authority", "phase", "valid_from", "valid_to"]
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)
    assert got.count() == 5


def test_too_late_is_dropped_and_idle_state_goes(spark, tmp_path):
    hour = 60
    files = [
        [said(1, "a", minute=0), said(1, "a", key="busy", minute=0)],
        [said(2, "a", key="busy", minute=3 * hour), said(9, "x", key="tick", minute=4 * hour)],
        [said(3, "late", minute=1)],  # behind the watermark
        [said(10, "y", key="tick", minute=30 * hour)],
        [said(11, "z", key="tick", minute=31 * hour)],
        [said(4, "a", minute=32 * hour), END],  # the same value again, but nothing is known of it any more
    ]
    got = drained(spark, tmp_path, files, "10 minutes", idle_ms=5 * hour * 60_000)
    assert sorted((r["event"], r["seq"], r["value"]) for r in got.where("key = 'k'").collect()) == [("opened", 1, "a"), ("opened", 4, "a")]
    assert got.where("key = 'busy'").count() == 1


def test_step_is_the_law():
    head, changes = commit.step(commit.Head(), 1, 0, "a", "A", True)
    assert changes == [("opened", 1, "A", "user", 1)]
    head, changes = commit.step(head, 2, 0, "b", "b", False)
    assert changes == [("opened", 2, "b", "assistant", 2)] and head.supported == "a"
    assert commit.step(head, 3, 0, "b", "b", False)[1] == [] and commit.step(head, 3, 0, "a", "a", True)[1] == []
    head, changes = commit.step(head, 3, 0, "b", "b", True)
    assert changes == [("closed", 1, None, None, 3), ("closed", 2, None, None, 3), ("opened", 3, "b", "user", 3)] and head.proposed is None


RULES = {"n": merge.Rule("sum"), "low": merge.Rule("min"), "seq": merge.Rule("max"), "value": merge.Rule("newest", "seq"), "last": merge.Rule("overwrite")}
COLUMNS = "k string, n long, low long, seq long, value string, last string"


def merged(spark, path):
    return merge.MergedTable(spark, str(path), COLUMNS, ["k"], RULES, buckets=3)


def rows_of(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=repr)


def test_a_batch_counts_once(spark, tmp_path):
    one = spark.createDataFrame([("a", 1, 5, 5, "five", "x"), ("a", 2, 3, 3, "three", "y"), (None, 1, 1, 1, "nil", None)], COLUMNS)
    two = spark.createDataFrame([("a", 4, 9, 4, "four", "z"), ("b", 1, 2, 2, None, "w"), (None, 1, 7, 1, "tie", None)], COLUMNS)
    table = merged(spark, tmp_path)
    assert rows_of(table) == [] and table.apply(one, 0) and not table.apply(one, 0)
    assert table.apply(two, 1) and not table.apply(one, 0) and not table.apply(two, 1)
    want = [("a", 7, 3, 5, "five", "z"), ("b", 1, 2, 2, None, "w"), (None, 2, 1, 1, "nil", None)]
    assert rows_of(table) == sorted(want, key=repr)
    assert rows_of(merged(spark, tmp_path)) == rows_of(table)  # after a restart
    assert rows_of(table, 1)[0][:2] == ("a", 3) and rows_of(table, 0) == []
    assert table.apply(one, 0, "another source") and rows_of(table)[0][1] == 10


def test_a_failed_attempt_leaves_no_trace(spark, tmp_path):
    table = merged(spark, tmp_path)
    batch = spark.createDataFrame([("a", 1, 1, 1, "v", "l")], COLUMNS)
    table.apply(batch, 0)
    table._log, kept = lambda *_: (_ for _ in ()).throw(OSError("lost")), table._log
    with pytest.raises(OSError):
        table.apply(batch, 1)
    assert rows_of(table) == [("a", 1, 1, 1, "v", "l")]
    table._log = kept
    assert table.apply(batch, 1) and rows_of(table) == [("a", 2, 1, 1, "v", "l")]
    with pytest.raises(Exception, match="(?i)exists"):  # another writer was first
        table._log(2, [(2, None, None, "", 9)])


def test_a_stream_restarts(spark, tmp_path):
    path, table = str(tmp_path / "in"), merged(spark, tmp_path / "t")
    write = lambda n: spark.createDataFrame([("a", n, n, n, str(n), str(n))], COLUMNS).coalesce(1).write.mode("append").parquet(path)
    write(1), write(2)
    stream = incremental.file_stream(spark, path)
    merge.merge_stream(stream, table, str(tmp_path / "c"))
    write(4)
    merge.merge_stream(stream, table, str(tmp_path / "c"))
    merge.merge_stream(stream, table, str(tmp_path / "c"))
    assert rows_of(table) == [("a", 7, 1, 4, "4", "4")]
    merge.merge_stream(stream, table, str(tmp_path / "lost"))  # a lost checkpoint: all batches come again
    assert rows_of(table) == [("a", 7, 1, 4, "4", "4")]


def test_chain_goes_on_from_heads(spark):
    e = spark.createDataFrame([(t, i, "user", f"{t} {i}") for t in (1, 2) for i in range(1, 10)] + [(3, 1, "user", "new")], "thread_id long, seq long, role string, content string")
    whole = archive.chained(e)
    first = archive.chained(e.where("seq < 5 and thread_id < 3"))
    rest = archive.chained(e.where("seq >= 5 or thread_id = 3"), archive.heads_of(first))
    key = lambda df: sorted((r["thread_id"], r["seq"], r["hash"]) for r in df.collect())
    assert key(first.union(rest)) == key(whole)
    marks = archive.checkpoints_of(whole, 4)
    assert marks.count() == 4
    fine = archive.verify_from(whole, marks)
    assert fine.count() == 7 and fine.where("wrong > 0 or broken > 0 or differs").count() == 0
    bad = whole.withColumn("record", F.when((F.col("seq") == 6) & (F.col("thread_id") == 1), "{}").otherwise(F.col("record")))
    assert [(r["thread_id"], r["from_seq"]) for r in archive.verify_from(bad, marks).where("wrong > 0").collect()] == [(1, 4)]


def test_fact_table_is_the_law(spark, tmp_path):
    """Batches of statements that are late and doubled, one batch that comes again: the facts of all that wasn't too late."""
    rng = random.Random(8)
    rows = [said(i, rng.choice("abcAB ") + rng.choice(["", " "]), rng.choice(["user", "assistant"]), rng.choice("kl"), thread=rng.randint(1, 3)) for i in range(1, 200)]
    files = [[] for _ in range(5)]
    for r in rows:
        for _ in range(rng.choice([1, 1, 2])):
            files[min(4, r[2] // 40 + rng.choice([0, 0, 1]))].append(r)
    files[2] += [(1, None, 90, "x", "user", at(90)), (1, "k", 91, None, "user", at(91))]
    table = commit.FactTable(spark, str(tmp_path / "t"), 80 * 60_000)
    for n, f in enumerate(files):
        rng.shuffle(f)
        table.apply(spark.createDataFrame(f, STATED), n)
        if n == 2:
            table.apply(spark.createDataFrame(f, STATED), n)
    waits = table.read().count()
    table.apply(spark.createDataFrame([said(1, "too late"), END], STATED), 5)
    want = facts.two_lanes(spark.createDataFrame([r[:5] for r in rows], "thread_id long, key string, seq long, value string, authority string"))
    columns = ["thread_id", "key", "value", "authority", "phase", "valid_from", "valid_to"]
    got = table.read().where("thread_id > 0")
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(map(tuple, want.select(columns).collect()), key=repr)
    assert 0 < waits < got.count()
