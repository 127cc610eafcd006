"""Operators on small inputs with known answers, and their streaming forms."""

import pyspark.sql.functions as F

from palimpsest.functions import names
from palimpsest.functions.text import search_terms, slug
from palimpsest.operators import archive, atomize, budget, capsules, evidence, facts, receipts
from palimpsest.plans.catalogue import SPAN
from palimpsest.sources.episodes import event_episodes
from palimpsest.streaming import incremental

DATA = "/root/testdata/sf0.001"


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_chain_finds_tampering(spark):
    e = spark.createDataFrame([(1, i, "user", f"text {i}") for i in range(1, 7)], "thread_id long, seq long, role string, content string")
    chain = archive.chained(e)
    assert collected(archive.verify_chain(chain).select("links", "wrong", "broken")) == [(6, 0, 0)]
    changed = chain.withColumn("record", F.when(F.col("seq") == 3, "{}").otherwise(F.col("record")))
    assert collected(archive.verify_chain(changed).select("links", "wrong", "broken")) == [(6, 1, 0)]
    missing = chain.where("seq <> 4")
    assert collected(archive.verify_chain(missing).select("links", "wrong", "broken")) == [(5, 0, 1)]


def test_two_lanes(spark):
    said = [(1, "k", 1, "a", "assistant"), (1, "k", 2, "a", "assistant"), (1, "k", 3, "b", "user"), (1, "k", 4, "c", "assistant"), (1, "k", 5, "b", "user"), (1, "k", 6, "d", "user")]
    out = facts.two_lanes(spark.createDataFrame(said, "thread_id long, key string, seq long, value string, authority string"))
    got = collected(out.select("valid_from", "value", "phase", "valid_to"))
    # the restatement at 5 equals the supported value: it leaves even the open proposal alone
    assert got == [(1, "a", "HISTORICAL", 3), (3, "b", "HISTORICAL", 6), (4, "c", "HISTORICAL", 6), (6, "d", "SUPPORTED", None)]


def test_skip_fit_and_stop_fit_differ(spark):
    e = spark.createDataFrame([(1, 1, "x" * 20), (1, 2, "x" * 200), (1, 3, "x" * 20)], "thread_id long, seq long, content string")
    assert collected(budget.recent_fill(e, 30).select("n", "oldest")) == [(2, 1)]
    assert collected(budget.suffix(e, 30).select("from_seq")) == [(3,)]


def test_terms_and_slugs(spark):
    df = spark.range(1).select(search_terms(F.lit("Where did the Rain in Spain-town fall? rain tea, a tea")).alias("t"), slug(F.lit("The deploy window of the North is now 5"), 4).alias("s"))
    r = df.first()
    assert r["t"] == ["rain", "spain-town", "fall", "tea"]
    assert r["s"] == "deploy-window-north-now"


def test_numbers_are_retained_after_rounding(spark):
    pairs = [(2.5, 3.0, True), (2.44, 2.4, True), (2.44, 2.5, False), (7.0, 7.0, True)]
    df = spark.createDataFrame(pairs, "a double, b double, want boolean")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", evidence.retained(F.col("a"), F.col("b"))).collect())


def test_empty_tables(spark):
    e = spark.createDataFrame([], "thread_id long, seq long, role string, content string")
    assert collected(archive.verify_chain(archive.chained(e))) == []
    assert collected(archive.windows(e, 4)) == []
    assert collected(budget.recent_fill(e, 10)) == []


def test_streams_equal_batch(spark, tmp_path):
    episodes = event_episodes(spark, DATA)
    files = str(tmp_path / "episodes")
    episodes.select("thread_id", "seq", "content", "event_type").orderBy("seq").repartitionByRange(3, "seq").write.parquet(files)
    stream = incremental.file_stream(spark, files)
    leaves = incremental.run_to_table(incremental.sealed_windows(stream, SPAN), "leaves", str(tmp_path / "leaves"), str(tmp_path / "c1"))
    assert collected(leaves.select("thread_id", "no", "from_seq", "to_seq", "episodes", "tokens")) == collected(archive.windows(episodes, SPAN))
    stated = lambda df: df.select("thread_id", F.col("event_type").alias("key"), "seq", F.length("content").cast("string").alias("value"))
    changes = incremental.run_to_table(incremental.revisions(stated(incremental.file_stream(spark, files, 3))), "changes", str(tmp_path / "changes"), str(tmp_path / "c2"))
    assert collected(changes.select("thread_id", "key", "value", "valid_from")) == collected(facts.revisions(stated(episodes)).select("thread_id", "key", "value", "valid_from"))


def test_name_lexer(spark):
    from palimpsest.functions.names import name_places, name_rows

    cases = {
        "Paid $1,200.50 for 3 GB and 31 items, 45 more in 1999": [("1200.5", "number"), ("3 gb", "number"), ("45", "number")],
        "on 2024-03-05, March 7, 2023, 9 Sept 2022, May 2021 and 3/4/2020": [("2024-03-05", "date"), ("2023-03-07", "date"), ("2022-09-09", "date"), ("2021-05", "date"), ("2020-03-04", "date")],
        "We met Ada Lovelace. Ada knows. But then Grace's idea": [("ada lovelace", "entity"), ("grace", "entity")],
        'she said "the quick brown Fox jumps over it" to src/main.py and fooBar, `a b`': [("the quick brown fox jumps over", "quote"), ("src/main.py", "code"), ("foobar", "code"), ("a b", "code")],
        "\u27e8#12 Ada Lovelace\u27e9 p50 v2 3.14.1": [("3.14", "number")],
        "5% of 50ms": [("5 %", "number"), ("50 ms", "number")],
        "": [],
        None: [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, content string")
    rows = sorted((r["id"], r["start"], r["name"], r["kind"]) for r in name_places(df, ["id"]).collect())
    for i, (text, want) in enumerate(cases.items()):
        assert [(n, k) for j, _, n, k in rows if j == i] == want, text
    one = spark.createDataFrame([(1, "Ada Lovelace wrote 99 ms here")], "id long, content string")
    assert [(r["name"], r["start"]) for r in name_rows(one, ["id"], most=1).collect()] == [("99 ms", 19)]
    long = spark.createDataFrame([(1, '"' + "word " * 200_000), (2, "a." * 100_000)], "id long, content string")
    assert name_places(long, ["id"]).where("kind = 'quote'").collect() == []


def test_rules_and_corrections(spark):
    from palimpsest.operators import atomize

    said = [
        (1, 1, "user", "My name is Ada Lovelace. The deploy window is now 09:30."),
        (1, 2, "assistant", "My name is Bob Stone. Remember that the budget is 40 usd."),
        (1, 3, "user", "One ground rule: never send mail. It is not 09:30, but 10:15."),
        (1, 4, "tool", "The deploy window is now 11:00."),
        (1, 5, "user", "Actually, that was odd."),
        (1, 6, "user", "I live in Port of Spain now. the weather is nice."),
        (1, 7, "user", None),
    ]
    found = atomize.drafts(spark.createDataFrame(said, "thread_id long, seq long, role string, content string"))
    got = sorted((r["seq"], r["rule"], r["key"], r["value"]) for r in found.collect())
    assert got == [
        (1, "fact.copula", "fact.deploy-window", "09:30"),
        (1, "identity.name", "identity.name", "Ada Lovelace"),
        (2, "remember", "fact.budget", "40 usd"),
        (3, "correction.not-but", "correction.10-15", "10:15"),
        (3, "rule", "rule.send-mail", "never: send mail"),
        (5, "correction.bare", "correction.odd", "that was odd"),
        (6, "user.location", "user.location", "Port of Spain"),
    ]
    fixed = {r["seq"]: r["key"] for r in atomize.corrected(found).where("rule = 'correction.not-but'").collect()}
    assert fixed == {3: "fact.deploy-window"}
    facts_ = facts.two_lanes(atomize.statements(atomize.corrected(found)))
    window = sorted((r["value"], r["phase"]) for r in facts_.where("key = 'fact.deploy-window'").collect())
    assert window == [("09:30", "HISTORICAL"), ("10:15", "SUPPORTED")]


def test_long_thread_chains_in_linear_time(spark):
    n = 200_000
    e = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("thread_id"), F.col("id").alias("seq"), F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))
    assert collected(archive.verify_chain(archive.chained(e)).select("links", "wrong", "broken")) == [(n, 0, 0)]


def test_walk_to_the_nearest_stops_at_a_hole(spark):
    rows = [(1, 1, "user", False), (1, 2, "tool", False), (1, 4, "assistant", False), (1, 5, "user", True), (1, 6, "assistant", False)]
    e = spark.createDataFrame(rows, "thread_id long, seq long, role string, removed boolean")
    assert collected(archive.nearest_in_direction(e, "user", 12, False).select("seq", "near_seq")) == [(1, None), (2, 1), (4, None), (5, None), (6, None)]
    assert collected(archive.nearest_in_direction(e, "assistant", 12, True).select("seq", "near_seq")) == [(1, None), (2, None), (4, 6), (5, 6), (6, None)]


def test_sequence_references(spark):
    from palimpsest.operators.router import sequence_references

    asked = [(1, 7, "#12-40 and turn 3"), (2, 7, "issue #9, PR #8"), (3, 7, "345 apples"), (4, 7, "#5 #5 #6 #7 #8"), (5, 7, "messages 1,345 – 1,346, the 21st turn; seq 9"), (6, 7, "3rd place, turnover 12")]
    got = sequence_references(spark.createDataFrame(asked, "question_id long, thread_id long, text string"))
    assert sorted((r["question_id"], r["seq"]) for r in got.collect()) == [(1, s) for s in (3, 12, 13, 14, 15, 16, 17)] + [(4, 5), (4, 6), (4, 7), (5, 9), (5, 21), (5, 1345), (5, 1346)]


def test_bundle_round_trip(spark, tmp_path):
    import pytest

    from palimpsest.sources import bundle

    rows = spark.createDataFrame([(1, "a", None), (2, "b\n", 1.5)], "id long, text string, x double")
    path = str(tmp_path / "out")
    bundle.export({"rows": rows, "none": rows.where("id > 9")}, path)
    back = bundle.load(spark, path)
    assert collected(back["rows"]) == collected(rows) and collected(back["none"]) == []
    rows.limit(1).write.mode("append").json(f"{path}/rows")
    with pytest.raises(ValueError, match="manifest"):
        bundle.load(spark, path)
    assert collected(bundle.unresolved(rows, "id", rows.where("id = 1"), "id").select("id")) == [(2,)]


def test_event_time_streams_equal_batch(spark, tmp_path):
    """Windows that the watermark has closed equal the batch form; what comes twice counts once; a restart adds nothing."""
    from palimpsest.plans import measures

    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    files = str(tmp_path / "events")
    events.union(events.where("event_id % 10 = 0")).repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(files)
    paths = [str(tmp_path / x) for x in ("out", "check")]
    for _ in range(2):
        got = collected(incremental.run_to_table(incremental.once(incremental.file_stream(spark, files), ["event_id"], "60 days").select("event_id"), "once", *paths))
    assert got == collected(events.select("event_id"))
    plain = str(tmp_path / "plain")
    events.coalesce(1).write.parquet(plain)  # files in no order would make late events
    for name, make, query in (("slides", incremental.sliding, measures.sliding_days), ("sessions", incremental.sessions, measures.event_sessions)):
        out = incremental.run_to_table(make(incremental.file_stream(spark, plain)), name, str(tmp_path / name), str(tmp_path / f"{name}-c"))
        rows, whole = set(collected(out)), set(collected(query(spark, DATA)))
        assert rows <= whole and len(rows) > 0.7 * len(whole), (name, len(rows), len(whole))
    hours = incremental.run_to_table(incremental.hourly(incremental.file_stream(spark, plain)).select("event_type", "window.start", "n"), "hours", str(tmp_path / "hours"), str(tmp_path / "hours-c"))
    want = set(collected(events.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", "w.start", "n")))
    assert set(collected(hours)) <= want and hours.count() > 0.9 * len(want)


def _spoken(spark, *said):
    return spark.createDataFrame([(1, i + 1, role, text) for i, (role, text) in enumerate(said)], "thread_id long, seq long, role string, content string")


def test_rules_take_the_words_around_their_cues(spark):
    cases = [
        ("user", "Hi, my name is Ines de Castro and I am late.", "identity.name", "identity.name", "Ines de Castro"),
        ("user", "I’ve just moved to Port Louis.", "user.location", "user.location", "Port Louis"),
        ("assistant", "My name is Ada.", None, None, None),
        ("user", "Please remember that the beta budget is 40 usd.", "remember", "fact.beta-budget", "40 usd"),
        ("user", "Remember, tea at noon", "remember", "fact.tea-at-noon", "tea at noon"),
        ("user", "Don't ever deploy on Friday!", "rule", "rule.deploy-on-friday", "never: deploy on Friday!"),
        ("user", "Nevermore is a poem", None, None, None),
        ("assistant", "We decided to ship version 3.", "decision.stated", "decision.ship-version-3", "ship version 3"),
        ("user", "They use tabs for the build files.", "decision.use-for", "decision.build-files", "tabs"),
        ("user", "TODO call Omar", "task", "task.call-omar", "call Omar"),
        ("user", "yesterday Vera Lind now works at Graz Labs.", "person.employer", "person.vera-lind.employer", "Graz Labs"),
        ("user", "We moved to Graz", None, None, None),
        ("user", "Our deploy window is currently 09:30.", "fact.copula", "fact.deploy-window", "09:30"),
        ("user", "The weather is fine.", None, None, None),
        ("user", "The plan is " + "very " * 40 + "late in 2024.", None, None, None),
        ("tool", "My name is Ada.", None, None, None),
    ]
    got = {}
    for r in atomize.drafts(_spoken(spark, *[c[:2] for c in cases])).where("probe = 0").collect():
        got.setdefault(r["seq"], []).append((r["rule"], r["key"], r["value"]))
    for i, (_, text, *want) in enumerate(cases):
        assert got.get(i + 1) == ([tuple(want)] if want[0] else None), text


def test_corrections_of_corrections(spark):
    for links in range(1, 6):
        said = [("user", "The deploy window is now 09:00.")] + [("user", f"Not {8 + i:02}:00, but {9 + i:02}:00.") for i in range(1, links + 1)]
        out = facts.two_lanes(atomize.statements(atomize.corrected(atomize.drafts(_spoken(spark, *said)))))
        assert collected(out.where("phase = 'SUPPORTED'").select("key", "value")) == [("fact.deploy-window", f"{9 + links:02}:00")]
        assert out.where("phase = 'HISTORICAL'").count() == links


def test_corrections_find_what_is_held_now(spark):
    said = [
        ("user", "The deploy window is 9:30."),
        ("assistant", "Not 9:30, but 9:45."),  # a proposal: 9:30 stays
        ("user", "Not 9:45, but 9:50."),  # nobody holds 9:45
        ("user", "Not 9:30, but 10:15."),
        ("user", "Not 9:30, but 11:00."),  # overtaken
        ("user", "The lunch window is 10:15."),
        ("user", "Not 10:15, but 12:00."),  # two keys hold it: the newer one
        ("user", "The dinner window is 7:00. Not 7:00, but 8:00."),  # a key is stated once an episode
        ("user", "Not 7:00, but 8:30."),
    ]
    out = atomize.corrected(atomize.drafts(_spoken(spark, *said))).where("supersedes is not null")
    keys = [(r["seq"], r["key"]) for r in out.orderBy("seq").collect()]
    assert keys == [(2, "fact.deploy-window"), (3, "correction.9-50"), (4, "fact.deploy-window"), (5, "correction.11-00"), (7, "fact.lunch-window"), (8, "fact.dinner-window"), (9, "fact.dinner-window")]


def test_no_corrections_and_empty(spark):
    assert atomize.corrected(atomize.drafts(_spoken(spark, ("user", "The plan is B2.")))).count() == 1
    e = spark.createDataFrame([], "thread_id long, seq long, role string, content string")
    assert atomize.corrected(atomize.drafts(e)).count() == 0


def _leaf_lines(spark, rows):
    return spark.createDataFrame(rows, "thread_id long, no long, ordinal long, tier int, seq long, until long, to_seq long, line string")


def test_sequential_root_prunes_and_cuts(spark):
    rows = [
        (1, 0, 1, 0, 1, 9, 8, "hour: 9 <1>"), (1, 0, 2, 2, 2, None, 8, "hello"), (1, 0, 3, 1, 3, None, 8, "never late"),
        (1, 1, 1, 0, 9, None, 16, "hour: 10 <9>"), (1, 1, 2, 2, 10, None, 16, "hello"), (1, 1, 3, 2, 11, None, 16, "bye"),
        (2, 0, 1, 2, 1, None, 8, "x"),
    ]
    out = capsules.sequential_root(_leaf_lines(spark, rows))
    got = {}
    for r in out.orderBy("thread_id", "root", "ordinal").collect():
        got.setdefault((r["thread_id"], r["root"]), []).append(r["line"])
    assert got == {(1, 0): ["hour: 9 <1>", "never late", "hello"], (1, 1): ["hour: 10 <9>", "never late", "hello", "bye"], (2, 0): ["x"]}
    # whatever a writer gives is cut mechanically
    shout = capsules.sequential_root(_leaf_lines(spark, rows), lambda root, leaf: [x._replace(line=x.line.upper()) for x in [*leaf, *root]], most=4, tokens=lambda s: len(s.split()))
    assert [r["line"] for r in shout.where("thread_id = 1 and root = 1").orderBy("ordinal").collect()] == ["HOUR: 10 <9>"]
    assert capsules.sequential_root(_leaf_lines(spark, [])).count() == 0


def test_a_long_thread_of_leaves_is_one_stream(spark):
    leaves = spark.range(100_000).select(F.lit(1).cast("long").alias("thread_id"), F.col("id").alias("no"), F.lit(1).cast("long").alias("ordinal"), F.lit(2).alias("tier"), F.col("id").alias("seq"), F.concat(F.lit("line "), (F.col("id") % 50).cast("string")).alias("line"))
    out = capsules.sequential_root(leaves, capsules.newest(4))
    assert out.count() == 400_000 - 6
    assert [r["line"] for r in out.where("root = 99999").orderBy("ordinal").collect()] == ["line 49", "line 48", "line 47", "line 46"]


def test_collections_by_words(spark):
    cases = [
        ("List all 12 open notes of the archive", ("list", 12, "open")),
        ("Compare every one of the three red budgets: really all 9?", ("compare", 3, "red budgets")),
        ("Please list the owners of boats in the conversation", ("list", None, "boats")),
        ("I saw 7 notes, each on rain", ("each", 7, "on rain")),
        ("all all", ("all", None, "")),
        ("What is it?", (None, None, "")),
        ("", (None, None, "")),
        (None, (None, None, None)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string").select("i", *receipts.collection(F.col("t")))
    got = [(r["cue"], r["required"], r["subject"]) for r in df.orderBy("i").collect()]
    assert [g if g[0] else (*g[:2], w[2]) for g, (_, w) in zip(got, cases)] == [w for _, w in cases]


def test_covering_needs_all_words_before_the_question(spark):
    q = spark.createDataFrame([(1, 1, 10, "alpha budgets"), (2, 1, 10, ""), (3, 2, 10, "alpha")], "question_id long, thread_id long, query_seq long, subject string")
    rows = spark.createDataFrame([(1, 2, "fact.alpha-budget"), (1, 3, "Budgets and alphas"), (1, 4, "alpha"), (1, 4, "budget"), (1, 11, "alpha budget"), (3, 1, "alpha budget")], "thread_id long, source_seq long, text string")
    assert collected(receipts.covering(q, rows)) == [(1, 2), (1, 3)]


def test_relations_and_wordings(spark):
    said = ["Ada is not the owner of the Red Boat.", "Bruno does never own a kite", "Vera lived in Graz!", "The cat is in the hat", "Nothing here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i long, t string").select("i", receipts.relation(F.col("t")).alias("r")).where("r is not null").select("i", "r.*")
    assert collected(df) == [(0, "owner", "ada", "red boat", True), (1, "owner", "bruno", "kite", True), (2, "location", "vera", "graz", False), (3, "location", "cat", "hat", False)]
    claims = ["All 4 red notes were found.", "There are 12 of them", "exactly 3", "Overall 3 were found"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(claims)], "i long, t string").select("i", receipts.safe_wording(F.col("t")).alias("t"))
    assert [t for _, t in collected(out)] == ["I found 4 red notes.", "I found 12 of them", "I found 3", "Overall 3 were found"]


def test_names_need_no_shuffle(spark):
    e = _spoken(spark, ("user", "Ada Lovelace paid $40 for src/main.py on 3rd Mar 2024, \"a very fine day\" it was. It's 12 ms."), ("user", None))
    found = names.name_places(e, ["thread_id", "seq"])
    assert "Exchange" not in found._jdf.queryExecution().toString()
    got = [(r["kind"], r["name"], r["start"]) for r in found.orderBy("start").collect()]
    text = e.first()["content"]
    want = [("entity", "ada lovelace", "Ada"), ("number", "40", "$40"), ("code", "src/main.py", "src"), ("date", "2024-03-03", "3rd"), ("quote", "a very fine day", '"a'), ("number", "12 ms", "12 ms")]
    assert got == [(k, n, text.index(at)) for k, n, at in want]


def test_mark_and_sweep(spark):
    edges = [("r", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("r", "a"), (None, "z"), ("z", None)]
    marked = evidence.reachable(spark.createDataFrame(edges, "parent string, child string"), spark.createDataFrame([("r",), ("r",), (None,)], "node string"))
    assert collected(marked) == [("a",), ("b",), ("c",), ("r",)]
    blobs = spark.createDataFrame([(h, 1) for h in "abcxyz"], "hash string, size long")
    stay, go = evidence.swept(blobs, marked)
    assert collected(stay.select("hash")) == [("a",), ("b",), ("c",)] and collected(go.select("hash")) == [("x",), ("y",), ("z",)]
    assert evidence.reachable(spark.createDataFrame([], "parent string, child string"), spark.createDataFrame([], "node string")).count() == 0


def test_nearest_of_mixed_vectors(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (200, [1.0, 0.1, 0.0]), (None, [1.0, 0.0])]
    out = evidence.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100, 2)
    assert [(q, r, v) for q, r, v, _ in collected(out)] == [(100, 1, 1), (100, 2, 2), (200, 1, 3)]
