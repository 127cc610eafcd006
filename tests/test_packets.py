import pyspark.sql.functions as F

from palimpsest.operators import packets


def items(spark, rows):
    return spark.createDataFrame([(t, r, r * 10, f"{t}-{r}", c) for t, r, c in rows], "thread_id long, rank long, seq long, text string, cost long")


def test_lanes_pass_on_what_they_leave(spark):
    threads = spark.createDataFrame([(1,), (1,), (2,)], "thread_id long")
    budgets = spark.createDataFrame([(100,), (1000,)], "budget long")
    lanes = {"header": items(spark, [(1, 1, 3), (2, 1, 5)]), "facts": items(spark, [(1, 1, 20), (1, 2, 1), (1, 3, 1), (2, 1, 25), (2, 2, 1)]), "capsules": items(spark, []), "recent": items(spark, [(1, 1, 58), (1, 2, 1)])}
    out, left = packets.compiled(lanes, threads, budgets)
    got = sorted((r["thread_id"], r["lane"], r["rank"]) for r in out.where("budget = 100").collect())
    # thread 1: header 3 of 4, facts 20 + 1 of 21 (the third doesn't fit), recent 58 of 40 + 18; thread 2's header is too long,
    # its first fact takes 25 of 24: nothing
    assert got == [(1, "facts", 1), (1, "facts", 2), (1, "header", 1), (1, "recent", 1)]
    assert {(r["thread_id"], r["spare"]) for r in left.where("budget = 100").collect()} == {(1, 0), (2, 82)}
    assert out.where("budget = 1000").count() == 3 + 1 + 2 + 1 + 2


def test_pages_show_what_is_not_in_view(spark):
    asked = spark.createDataFrame([(1, 9, "ada", "entity"), (1, 9, "12 ms", "number"), (1, 9, "seen", "code"), (1, 9, "unknown", "code")], "thread_id long, query_seq long, name string, kind string")
    view = spark.createDataFrame([(1, 100, "seen"), (1, 200, "12 ms")], "thread_id long, budget long, name string")
    places = spark.createDataFrame([(1, 2, "ada"), (1, 4, "ada"), (1, 3, "12 ms"), (1, 10, "12 ms"), (1, 1, "seen")], "thread_id long, seq long, name string")
    episodes = spark.createDataFrame([(1, i, f"text {i}") for i in range(1, 11)], "thread_id long, seq long, content string")
    out = packets.pages(asked, view, places, episodes).orderBy("budget", "rank").collect()
    assert [(r["budget"], r["rank"], r["seq"], r["text"]) for r in out] == [(100, 1, 3, "text 3"), (100, 2, 4, "text 4"), (200, 1, 1, "text 1"), (200, 2, 4, "text 4")]


def test_sums_saturate(spark):
    df = spark.createDataFrame([(1, 2**62), (1, 2**62), (1, -5), (2, -1), (3, 7), (3, None)], "k long, n long")
    got = dict(map(tuple, df.groupBy("k").agg(packets.saturating_sum(F.col("n")).alias("s")).collect()))
    assert got == {1: 2**63 - 1, 2: 0, 3: 7}
