import pytest

from palimpsest.operators import replay


def test_search_at_a_snapshot(spark):
    e = spark.createDataFrame([(1, 1, "red fox", None), (1, 2, "red hen", 4), (1, 3, None, None), (1, 5, "Red red fox hen", None), (2, 1, "red fox", None), (1, 4, "", None)], "thread_id long, seq long, content string, removed_at long")
    r = spark.createDataFrame([(10, 1, 2, ["red"]), (11, 1, 4, ["red"]), (12, 1, 5, ["red"]), (13, 1, 9, ["red", "fox", "red"]), (14, 1, 9, []), (15, 1, 9, ["absent", "red"]), (16, 2, 9, ["fox", "red"]), (17, 1, 9, None)], "receipt_id long, thread_id long, at_seq long, terms array<string>")
    found = replay.searched(r, replay.postings_at(e), 2)
    rows = {}
    for x in found.orderBy("receipt_id", "rank").collect():
        rows.setdefault(x["receipt_id"], []).append(x["seq"])
    assert rows == {10: [1], 11: [2, 1], 12: [1], 13: [5, 1], 16: [1]}
    recorded = found.where("receipt_id <> 11").union(spark.createDataFrame([(11, 1, 1), (14, 1, 1)], "receipt_id long, seq long, rank long"))
    verdict = {x["receipt_id"]: (x["missing"], x["extra"], x["moved"], x["same"]) for x in replay.replayed(r, recorded, found).collect()}
    assert len(verdict) == 8
    assert verdict[11] == (0, 1, 1, False) and verdict[14] == (1, 0, 0, False) and verdict[17] == (0, 0, 0, True)
    assert all(verdict[i][3] for i in (10, 12, 13, 15, 16))


def test_facts_at_a_snapshot(spark):
    f = spark.createDataFrame([(1, "k", "a", "user", 1, 5), (1, "k", "b", "user", 5, None), (1, "k", "c", "assistant", 3, 5)], "thread_id long, key string, value string, authority string, valid_from long, valid_to long")
    r = spark.createDataFrame([(i, 1, i, "k") for i in (1, 2, 4, 5, 6)], "receipt_id long, thread_id long, at_seq long, key string")
    assert {(x["receipt_id"], x["value"], x["phase"]) for x in replay.facts_at(r, f).collect()} == {(2, "a", "SUPPORTED"), (4, "a", "SUPPORTED"), (5, "a", "SUPPORTED"), (6, "b", "SUPPORTED")}
    assert replay.facts_at(r.where("receipt_id > 99"), f).collect() == []


@pytest.mark.parametrize("empty", ["receipts", "postings"])
def test_empty_tables(spark, empty):
    e = spark.createDataFrame([(1, 1, "red fox", None)], "thread_id long, seq long, content string, removed_at long").where("1 = 0" if empty == "postings" else "true")
    r = spark.createDataFrame([(10, 1, 2, ["red"])], "receipt_id long, thread_id long, at_seq long, terms array<string>").where("1 = 0" if empty == "receipts" else "true")
    assert replay.searched(r, replay.postings_at(e), 2).collect() == []
