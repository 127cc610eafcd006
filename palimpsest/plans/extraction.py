"""Queries over what people say: sentences, facts by rules, corrections, authority, and the facts' index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import sentences, sentences_sql
from ..operators import atomize, facts
from ..sources.episodes import CITIES, CONV_SQL, PEOPLE, TALK_SQL, conversation_episodes, numbered, table, talk_episodes
from ..sources.tables import stored
from .registry import query, two_lane_sql

DRAFTS_SQL = f"{TALK_SQL}, {atomize.drafts_sql('talk')}"
FIXED_SQL = f"{DRAFTS_SQL}, {atomize.corrected_sql()}"
COMMIT_SQL = FIXED_SQL + f""", said AS (SELECT thread_id, key, seq, arg_min(value, (sentence, probe, no)) AS value, CASE WHEN arg_min(role, (sentence, probe, no)) = 'assistant' THEN 'assistant' ELSE 'user' END AS authority FROM fixed GROUP BY 1, 2, 3),
{two_lane_sql('said')}"""


def talk_drafts(spark, d) -> DataFrame:
    return atomize.drafts(talk_episodes(spark, d))


def talk_facts(spark, d, episodes: DataFrame | None = None) -> DataFrame:
    """The facts of the episodes, as a written table."""
    found = atomize.drafts(episodes if episodes is not None else talk_episodes(spark, d))
    return stored(facts.two_lanes(atomize.statements(atomize.corrected(found))), "facts")


@query(f"WITH {TALK_SQL}, s AS (SELECT thread_id, seq, {sentences_sql('content')} AS l FROM talk) SELECT thread_id, seq, unnest(generate_series(1, len(l))) - 1 AS sentence, unnest(l) AS text FROM s WHERE len(l) > 0")
def talk_sentences(spark, d):
    return talk_episodes(spark, d).select("thread_id", "seq", F.posexplode(sentences(F.col("content"))).alias("sentence", "text"))


@query(f"WITH {DRAFTS_SQL} SELECT thread_id, seq, role, sentence, probe, no, rule, kind, key, value, supersedes, confidence FROM draft")
def rule_drafts(spark, d):
    return talk_drafts(spark, d)


@query(f"WITH {DRAFTS_SQL} SELECT rule, role, count(*) AS drafts, count(DISTINCT key) AS keys FROM draft GROUP BY 1, 2")
def rule_eligibility(spark, d):
    """How often each rule fires for each role: the user-only ones never for an assistant."""
    return talk_drafts(spark, d).groupBy("rule", "role").agg(F.count("*").alias("drafts"), F.countDistinct("key").alias("keys"))


@query(f"WITH {DRAFTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, seq ORDER BY sentence, probe, no) AS r, count(*) OVER (PARTITION BY thread_id, seq) AS n FROM draft) SELECT thread_id, seq, rule, key, n > 1 AS overflow FROM r WHERE r <= 1")
def rule_drafts_bounded(spark, d):
    return atomize.bounded(talk_drafts(spark, d), 1).select("thread_id", "seq", "rule", "key", "overflow")


@query(f"WITH RECURSIVE {FIXED_SQL} SELECT thread_id, seq, sentence, probe, no, key, value, supersedes FROM fixed WHERE supersedes IS NOT NULL")
def corrections_resolved(spark, d):
    return atomize.corrected(talk_drafts(spark, d)).where("supersedes is not null").select("thread_id", "seq", "sentence", "probe", "no", "key", "value", "supersedes")


@query(f"WITH RECURSIVE {COMMIT_SQL} SELECT * FROM fact")
def committed_facts(spark, d):
    """From text to facts: rules, corrections, first draft of a key, and the law of authority."""
    return talk_facts(spark, d)


@query(f"WITH RECURSIVE {COMMIT_SQL}, stored AS (SELECT thread_id, key, valid_from, CASE WHEN valid_from % 11 = 0 THEN 'user' ELSE authority END AS authority, CASE WHEN valid_from % 13 = 0 THEN value || '!' ELSE value END AS value FROM fact) SELECT s.thread_id, s.key, s.valid_from, CASE WHEN s.authority <> f.authority THEN 'authority' ELSE 'value' END AS fault FROM stored s JOIN fact f USING (thread_id, key, valid_from) WHERE s.authority <> f.authority OR s.value <> f.value")
def authority_replay(spark, d):
    """Stored facts (here: tampered with at every 11th and 13th place) against those that the episodes give anew."""
    again = talk_facts(spark, d)
    stored = again.select("thread_id", "key", "valid_from", F.when(F.col("valid_from") % 11 == 0, "user").otherwise(F.col("authority")).alias("authority"), F.when(F.col("valid_from") % 13 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")).alias("value"))
    return facts.differing(stored, again)


@query(f"WITH {TALK_SQL}, c AS (SELECT thread_id, seq, content, substr(content, 4, 9) || CASE WHEN event_id % 3 = 0 THEN '~' ELSE '' END AS quote FROM talk WHERE role = 'assistant' UNION ALL SELECT thread_id, seq, content, left(content, 6) FROM talk WHERE role = 'assistant' AND event_id % 2 = 0) SELECT thread_id, seq, count(*) AS came, count(*) FILTER (instr(content, quote) > 0) AS verbatim, count(*) = count(*) FILTER (instr(content, quote) > 0) AND count(*) <= 1 AS complete FROM c GROUP BY 1, 2")
def model_candidates(spark, d):
    """Candidates from outside (here: cut out of assistant turns, every third one changed) must quote word for word."""
    e = talk_episodes(spark, d)
    said = e.where("role = 'assistant'")
    one = said.select("thread_id", "seq", F.concat(F.substring("content", 4, 9), F.when(F.col("event_id") % 3 == 0, "~").otherwise("")).alias("quote"))
    two = said.where("event_id % 2 = 0").select("thread_id", "seq", F.left("content", F.lit(6)).alias("quote"))
    return atomize.quoted_candidates(one.union(two), e, 1)


INDEX_SQL = COMMIT_SQL + """, revoked AS (SELECT thread_id, seq FROM talk WHERE removed), unread AS (SELECT thread_id, seq FROM talk WHERE event_id % 17 = 0),
able AS (SELECT * FROM fact f WHERE NOT EXISTS (SELECT 1 FROM revoked r WHERE r.thread_id = f.thread_id AND r.seq = f.valid_from) AND NOT EXISTS (SELECT 1 FROM unread u WHERE u.thread_id = f.thread_id AND u.seq = f.valid_from)),
idx AS (SELECT thread_id, lower(key) AS name, key, 'key' AS part, value, phase, valid_from FROM able UNION ALL SELECT thread_id, lower(value), key, 'value', value, phase, valid_from FROM able)"""


def fact_index(spark, d) -> DataFrame:
    """Facts by key and by value, without those of removed episodes and of episodes whose extraction is incomplete."""
    e = talk_episodes(spark, d)
    source = lambda c: e.where(c).select("thread_id", F.col("seq").alias("valid_from"))
    return facts.name_index(talk_facts(spark, d), [source("removed"), source("event_id % 17 = 0")])


@query(f"WITH RECURSIVE {INDEX_SQL} SELECT * FROM idx")
def fact_name_index(spark, d):
    return fact_index(spark, d)


_ASKED = [*(p.lower() for p in PEOPLE), *(c.lower() for c in CITIES), "identity.name", "user.location", "fact.deploy-window"]


@query(f"WITH RECURSIVE {INDEX_SQL}, asked AS (SELECT unnest([{', '.join(repr(a) for a in _ASKED)}]) AS name), r AS (SELECT i.*, row_number() OVER (PARTITION BY thread_id, name ORDER BY phase <> 'SUPPORTED', valid_from DESC, key, part) AS rank FROM idx i JOIN asked USING (name) WHERE part = 'key' OR phase = 'SUPPORTED') SELECT thread_id, name, rank, key, part, value, valid_from FROM r WHERE rank <= 3")
def facts_by_asked_name(spark, d):
    """For each asked name, in every thread: facts with that key, and supported ones with that value."""
    asked = spark.createDataFrame([(a,) for a in _ASKED], "name string")
    return facts.lookup(fact_index(spark, d), asked, 3)


@query(f"WITH RECURSIVE {COMMIT_SQL} SELECT DISTINCT thread_id, phase, split_part(key, '.', 1) AS area FROM fact")
def fact_areas_by_phase(spark, d):
    return talk_facts(spark, d).select("thread_id", "phase", F.split_part("key", F.lit("."), F.lit(1)).alias("area")).distinct()


@query(f"WITH RECURSIVE {COMMIT_SQL}, p AS (SELECT thread_id, count(*) FILTER (phase = 'SUPPORTED') AS supported, count(*) FILTER (phase = 'PROPOSED') AS proposed, count(*) FILTER (phase = 'HISTORICAL') AS historical FROM fact GROUP BY 1), m AS (SELECT thread_id, count(*) AS episodes, count(*) FILTER (removed) AS removed, max(seq) AS head_seq, min(seq) FILTER (role = 'assistant') AS first_assistant, count(DISTINCT role) AS roles FROM talk GROUP BY 1) SELECT m.*, coalesce(supported, 0) AS supported, coalesce(proposed, 0) AS proposed, coalesce(historical, 0) AS historical FROM m LEFT JOIN p USING (thread_id)")
def thread_memory(spark, d):
    """Statistics of a thread: episodes, removals, facts by phase, first turn of the assistant."""
    e = talk_episodes(spark, d)
    base = e.groupBy("thread_id").agg(F.count("*").alias("episodes"), F.count_if("removed").alias("removed"), F.max("seq").alias("head_seq"), F.min(F.when(F.col("role") == "assistant", F.col("seq"))).alias("first_assistant"), F.countDistinct("role").alias("roles"))
    phases = talk_facts(spark, d).groupBy("thread_id").agg(*[F.count_if(F.col("phase") == p).alias(p.lower()) for p in ("SUPPORTED", "PROPOSED", "HISTORICAL")])
    return base.join(phases, "thread_id", "left").fillna(0, ["supported", "proposed", "historical"])


@query(f"WITH RECURSIVE {COMMIT_SQL}, c AS (SELECT thread_id, key, arg_max(value, valid_from) FILTER (phase = 'SUPPORTED') AS current, arg_max(value, valid_from) FILTER (phase = 'HISTORICAL' AND authority = 'user') AS previous, max(valid_from) FILTER (phase = 'SUPPORTED') AS changed FROM fact GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY changed DESC, key) AS rank FROM c WHERE current IS NOT NULL AND previous IS NOT NULL) SELECT thread_id, key, current, previous, changed FROM r WHERE rank <= 3")
def talk_historical_pairs(spark, d):
    """Current and previous values of the three keys changed last; proposals were never true and aren't previous."""
    f = talk_facts(spark, d)
    live, past = F.col("phase") == "SUPPORTED", (F.col("phase") == "HISTORICAL") & (F.col("authority") == "user")
    pairs = f.groupBy("thread_id", "key").agg(F.max_by(F.when(live, F.col("value")), F.when(live, F.col("valid_from"))).alias("current"), F.max_by(F.when(past, F.col("value")), F.when(past, F.col("valid_from"))).alias("previous"), F.max(F.when(live, F.col("valid_from"))).alias("changed"))
    order = Window.partitionBy("thread_id").orderBy(F.desc("changed"), "key")
    return pairs.where("current is not null and previous is not null").withColumn("_r", F.row_number().over(order)).where("_r <= 3").select("thread_id", "key", "current", "previous", "changed")


KINDS = ["preference", "decision", "identity", "task", "fact", "correction"]
AREA_KIND = {"rule": "preference", "decision": "decision", "identity": "identity", "task": "task", "correction": "correction"}


@query(f"""WITH RECURSIVE {COMMIT_SQL}, k AS (SELECT *, CASE split_part(key, '.', 1) {' '.join(f"WHEN '{a}' THEN {KINDS.index(k)}" for a, k in AREA_KIND.items())} ELSE {KINDS.index('fact')} END AS kind_no, valid_from % 9 = 0 AS pinned, length(key || ': ' || value) AS cost FROM fact WHERE phase = 'SUPPORTED'),
o AS (SELECT *, row_number() OVER w AS rank, CAST(sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM k WINDOW w AS (PARTITION BY thread_id ORDER BY pinned DESC, kind_no, valid_from DESC, key)) SELECT thread_id, rank, key, used FROM o WHERE used <= 160""")
def frontier_order(spark, d):
    """Supported facts in frontier order (pinned, kind, newest), lane by lane up to an aggregate size."""
    kind = F.create_map(*[F.lit(x) for a, k in AREA_KIND.items() for x in (a, KINDS.index(k))])
    rows = talk_facts(spark, d).where("phase = 'SUPPORTED'").select("thread_id", "key", "valid_from", F.coalesce(kind[F.split_part("key", F.lit("."), F.lit(1))], F.lit(KINDS.index("fact"))).alias("kind_no"), (F.col("valid_from") % 9 == 0).alias("pinned"), F.length(F.concat("key", F.lit(": "), "value")).alias("cost"))
    return facts.frontier_lanes(rows, 160)


# ---- corrections of corrections -----------------------------------------------------------------------------

CHAIN_SQL = """chev AS (SELECT user_id AS thread_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS nth, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS prior, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events),
chtalk AS (SELECT thread_id, seq, CASE WHEN event_id % 23 = 0 THEN 'assistant' ELSE 'user' END AS role, CASE WHEN nth % 6 = 0 THEN 'The ' || event_type || ' ceiling is now ' || CAST(event_id AS VARCHAR) || ' units.' ELSE 'It is not ' || CAST(prior AS VARCHAR) || ' units, but ' || CAST(event_id AS VARCHAR) || ' units.' END AS content FROM chev)"""


def chain_episodes(spark, d) -> DataFrame:
    """Every sixth event of a user and type states a ceiling (the event's number), and each of the up to five behind it
    corrects the one before; every 23rd event is the assistant's, whose corrections are only proposals."""
    kind = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    nth, prior = F.row_number().over(kind) - 1, F.lag("event_id").over(kind)
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", nth.alias("nth"), prior.alias("prior"))
    state = F.concat(F.lit("The "), "event_type", F.lit(" ceiling is now "), F.col("event_id").cast("string"), F.lit(" units."))
    fix = F.concat(F.lit("It is not "), F.col("prior").cast("string"), F.lit(" units, but "), F.col("event_id").cast("string"), F.lit(" units."))
    rows = e.select(F.col("user_id").alias("thread_id"), "ts", "event_id", F.when(F.col("event_id") % 23 == 0, "assistant").otherwise("user").alias("role"), F.when(F.col("nth") % 6 == 0, state).otherwise(fix).alias("content"))
    return numbered(rows, "ts", "event_id")


@query(f"""WITH RECURSIVE {CHAIN_SQL}, {atomize.drafts_sql('chtalk')}, {atomize.corrected_sql()}, said AS (SELECT thread_id, key, seq, arg_min(value, (sentence, probe, no)) AS value, CASE WHEN arg_min(role, (sentence, probe, no)) = 'assistant' THEN 'assistant' ELSE 'user' END AS authority FROM fixed GROUP BY 1, 2, 3),
{two_lane_sql('said')} SELECT * FROM fact""")
def correction_chains(spark, d):
    """Facts of chains of up to five corrections: each is put to the key that the one before was put to, unless that one was
    only proposed."""
    return facts.two_lanes(atomize.statements(atomize.corrected(atomize.drafts(chain_episodes(spark, d)))))


@query(f"WITH RECURSIVE {CHAIN_SQL}, {atomize.drafts_sql('chtalk')}, {atomize.corrected_sql()}, n AS (SELECT thread_id, key, count(*) AS corrections FROM fixed WHERE supersedes IS NOT NULL GROUP BY 1, 2) SELECT split_part(key, '.', 1) = 'fact' AS resolved, corrections, count(*) AS keys FROM n GROUP BY 1, 2")
def correction_depths(spark, d):
    """How many keys took how many corrections, and how many corrections found no key."""
    fixes = atomize.corrected(atomize.drafts(chain_episodes(spark, d))).where("supersedes is not null")
    per_key = fixes.groupBy("thread_id", "key").agg(F.count("*").alias("corrections"))
    return per_key.groupBy((F.split_part("key", F.lit("."), F.lit(1)) == "fact").alias("resolved"), "corrections").agg(F.count("*").alias("keys"))


# ---- rules over conversations -------------------------------------------------------------------------------


@query(f"WITH {CONV_SQL}, {atomize.drafts_sql('conv')} SELECT thread_id, seq, role, sentence, probe, no, rule, kind, key, value, supersedes, confidence FROM draft")
def conversation_drafts(spark, d):
    """The rules over the texts of conversations, which nobody wrote for them."""
    return atomize.drafts(conversation_episodes(spark, d))
