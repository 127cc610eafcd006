"""All queries of the archive side, bound to the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import NAMES_SQL, SEARCH_STOP, approx_tokens, authority, coverage_status, episode_names, slug
from ..functions import names
from ..functions.text import SALIENT_PATTERN, code_names, date_names, salient
from ..operators import archive, budget, evidence, facts, ledger, router, search
from ..sources.episodes import CONV_SQL, EV_SQL, LINE_SQL, ORD_SQL, conversation_episodes, event_episodes, line_episodes, order_episodes, table
from .registry import QUERIES, SQL, TOKENS, query, two_lane_sql

SPAN = 8  # episodes a leaf: users have about 67 events at the smallest scales

# ---- archive ------------------------------------------------------------------------------------------------


@query(f"""WITH {CONV_SQL} SELECT thread_id, seq, {TOKENS} AS tokens, CASE WHEN role = 'assistant' THEN 'PROPOSED' WHEN role IN ('user', 'tool', 'attachment') THEN 'SUPPORTED' ELSE 'NON_AUTHORITATIVE' END AS epistemic FROM conv""")
def episode_labels(spark, d):
    return archive.labelled(conversation_episodes(spark, d))


@query(f"""WITH {CONV_SQL} SELECT thread_id, count(*) AS episodes, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system, max(seq) AS head_seq, CAST(sum({TOKENS}) AS BIGINT) AS tokens, min(seq) AS first_seq FROM conv GROUP BY 1""")
def thread_stats(spark, d):
    return archive.thread_stats(conversation_episodes(spark, d))


@query(f"WITH {EV_SQL} SELECT thread_id, seq, content FROM ev WHERE seq BETWEEN 3 AND 7")
def episode_range(spark, d):
    return event_episodes(spark, d).where(F.col("seq").between(3, 7)).select("thread_id", "seq", "content")


@query(f"WITH {CONV_SQL} SELECT thread_id, seq, role FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS r FROM conv) WHERE r <= 3")
def episode_tail(spark, d):
    return archive.tail(conversation_episodes(spark, d), 3).select("thread_id", "seq", "role")


@query("SELECT o_orderdate, o_orderkey, o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-03-01' OR (o_orderdate = TIMESTAMP '1996-03-01' AND o_orderkey > 100) ORDER BY 1, 2 LIMIT 51")
def keyset_page(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("o_orderdate"), "o_orderkey", "o_custkey")
    return archive.keyset_page(rows, ["o_orderdate", "o_orderkey"], (F.to_timestamp(F.lit("1996-03-01")), 100), 50)


@query(f"WITH {CONV_SQL} SELECT thread_id, seq, left(content, 24) AS head, octet_length(encode(content)) AS bytes, octet_length(encode(content)) > 24 AS truncated FROM conv")
def bounded_projection(spark, d):
    e = conversation_episodes(spark, d)
    size = F.octet_length("content").cast("long")
    return e.select("thread_id", "seq", F.left("content", F.lit(24)).alias("head"), size.alias("bytes"), (size > 24).alias("truncated"))


CHAIN_SQL = f"""WITH RECURSIVE {CONV_SQL}, rec AS (SELECT thread_id, seq, '{{"content_hash":"' || sha256(content) || '","role":"' || role || '","seq":' || CAST(seq AS VARCHAR) || '}}' AS record FROM conv),
fold AS (SELECT thread_id, CAST(0 AS BIGINT) AS seq, sha256('archive:' || CAST(thread_id AS VARCHAR)) AS hash FROM (SELECT DISTINCT thread_id FROM conv)
  UNION ALL SELECT f.thread_id, r.seq, sha256(f.hash || r.record) FROM fold f JOIN rec r ON r.thread_id = f.thread_id AND r.seq = f.seq + 1)"""


@query(CHAIN_SQL + " SELECT thread_id, seq, hash FROM fold WHERE seq > 0")
def chain_links(spark, d):
    return archive.chained(conversation_episodes(spark, d)).select("thread_id", "seq", "hash")


@query(CHAIN_SQL + " SELECT thread_id, count(*) AS links, count(*) FILTER (seq % 5 = 3) AS wrong, count(*) FILTER (seq % 7 = 4) AS broken, max_by(hash, seq) AS head_hash FROM fold WHERE seq > 0 AND seq % 7 <> 3 GROUP BY 1")
def chain_verify(spark, d):
    """A chain with faults planted: every fifth record from the third was changed, every seventh link from the third is gone
    (so that the next one is broken)."""
    chain = archive.chained(conversation_episodes(spark, d))
    changed = chain.withColumn("record", F.when(F.col("seq") % 5 == 3, F.concat("record", F.lit(" "))).otherwise(F.col("record")))
    return archive.verify_chain(changed.where("seq % 7 <> 3"))


@query(CHAIN_SQL + " SELECT a.thread_id, a.seq, max(b.seq) AS checkpoint_seq, max_by(b.hash, b.seq) AS checkpoint_hash FROM fold a LEFT JOIN fold b ON b.thread_id = a.thread_id AND b.seq > 0 AND b.seq % 4 = 0 AND b.seq <= a.seq WHERE a.seq > 0 GROUP BY 1, 2")
def chain_checkpoint_as_of(spark, d):
    return archive.checkpoint_as_of(archive.chained(conversation_episodes(spark, d)), 4)


@query(f"WITH {EV_SQL} SELECT thread_id, (seq - 1) // {SPAN} AS no, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS episodes, CAST(sum({TOKENS}) AS BIGINT) AS tokens FROM ev GROUP BY 1, 2 HAVING count(*) = {SPAN}")
def leaf_windows(spark, d):
    return archive.windows(event_episodes(spark, d), SPAN)


LEAF, FAN, LEVELS = 32, 8, 8
HIERARCHY_SQL = f"""WITH {LINE_SQL}, cap AS ({' UNION ALL '.join(f"SELECT {k} AS level, thread_id, (seq - 1) // {LEAF * FAN**k} AS no, min(seq) AS from_seq, max(seq) AS to_seq, count(*) AS episodes, CAST(sum({TOKENS}) AS BIGINT) AS tokens FROM line GROUP BY 2, 3 HAVING count(*) = {LEAF * FAN**k}" for k in range(LEVELS))})"""


@query(HIERARCHY_SQL + " SELECT * FROM cap")
def capsule_hierarchy(spark, d):
    return archive.hierarchy(line_episodes(spark, d), LEAF, FAN, LEVELS)


@query(HIERARCHY_SQL + " SELECT p.thread_id, p.level, p.no, p.from_seq AS parent_from, p.to_seq AS parent_to, c.from_seq AS child_from, c.to_seq AS child_to FROM cap p JOIN cap c ON c.thread_id = p.thread_id AND c.level = p.level - 1 AND c.from_seq >= p.from_seq AND c.to_seq <= p.to_seq")
def capsule_children(spark, d):
    return archive.children(archive.hierarchy(line_episodes(spark, d), LEAF, FAN, LEVELS), FAN)


@query(f"WITH {EV_SQL} SELECT a.thread_id, a.seq, max(b.seq) AS speaker_seq FROM ev a LEFT JOIN ev b ON b.thread_id = a.thread_id AND b.role = 'user' AND b.seq < a.seq AND b.seq >= a.seq - 12 GROUP BY 1, 2")
def nearest_speaker(spark, d):
    return archive.nearest_speaker(event_episodes(spark, d), "user", 12)


@query(f"WITH {CONV_SQL} SELECT a.thread_id, a.seq, max(b.seq) AS speaker_seq FROM conv a LEFT JOIN conv b ON b.thread_id = a.thread_id AND b.role = 'assistant' AND b.seq < a.seq GROUP BY 1, 2")
def previous_assistant(spark, d):
    return archive.nearest_speaker(conversation_episodes(spark, d), "assistant", 1 << 40)


@query(f"WITH {EV_SQL} SELECT thread_id, event_type, min(seq) AS first_seq, count(*) AS n FROM ev GROUP BY 1, 2")
def first_seen(spark, d):
    return archive.first_seen(event_episodes(spark, d), ["thread_id", "event_type"], "seq")


@query(f"WITH {EV_SQL}, h AS (SELECT *, max(seq) OVER (PARTITION BY thread_id) AS head FROM ev) SELECT (seq - 1) * 12 // head AS slice, count(*) AS n FROM h GROUP BY 1")
def turn_histogram(spark, d):
    return archive.histogram(event_episodes(spark, d), 12)


# ---- names and the ledger ------------------------------------------------------------------------------------


def _names(spark, d):
    return episode_names(event_episodes(spark, d))


def _entries(spark, d):
    """Entries of sealed leaves, split by a summary that shows each leaf's first three episodes."""
    names = _names(spark, d)
    leaves = archive.windows(event_episodes(spark, d), SPAN).select("thread_id", "no")
    entries = ledger.name_entries(names, SPAN).join(leaves, ["thread_id", "no"])
    shown = names.where((F.col("seq") - 1) % SPAN < 3).withColumn("no", F.floor((F.col("seq") - 1) / SPAN).cast("long"))
    return ledger.split_by_summary(entries, shown)


ENTRIES_SQL = f"""WITH {EV_SQL}, {NAMES_SQL},
leaf AS (SELECT thread_id, (seq - 1) // {SPAN} AS no FROM ev GROUP BY 1, 2 HAVING count(*) = {SPAN}),
ent AS (SELECT thread_id, (seq - 1) // {SPAN} AS no, name, kind, max(seq) AS seq FROM nm GROUP BY 1, 2, 3, 4),
split AS (SELECT e.*, EXISTS (SELECT 1 FROM nm s WHERE s.thread_id = e.thread_id AND s.name = e.name AND s.kind = e.kind AND (s.seq - 1) // {SPAN} = e.no AND (s.seq - 1) % {SPAN} < 3) AS kept FROM ent e JOIN leaf USING (thread_id, no)),
loss AS (SELECT thread_id, no, name, kind, seq FROM split WHERE NOT kept)"""


def _losses(spark, d):
    return _entries(spark, d).where("not kept").drop("kept")


@query(f"WITH {EV_SQL}, {NAMES_SQL} SELECT thread_id, seq, name, kind FROM nm")
def episode_name_index(spark, d):
    return _names(spark, d)


@query(ENTRIES_SQL + " SELECT thread_id, no, name, kind, seq FROM loss")
def loss_dropped(spark, d):
    return _losses(spark, d)


@query(ENTRIES_SQL + " SELECT thread_id, no, name, kind, seq FROM split WHERE kept")
def loss_kept(spark, d):
    return _entries(spark, d).where("kept").drop("kept")


@query(ENTRIES_SQL + f", cap AS (SELECT 0 AS level, thread_id, (seq - 1) // {SPAN} AS no, min(seq) AS a, max(seq) AS b FROM ev GROUP BY 2, 3 HAVING count(*) = {SPAN} UNION ALL SELECT 1, thread_id, (seq - 1) // {SPAN * 2}, min(seq), max(seq) FROM ev GROUP BY 2, 3 HAVING count(*) = {SPAN * 2}) SELECT c.thread_id, c.level, c.no, count(*) AS losses, count(DISTINCT l.name) AS names FROM cap c JOIN loss l ON l.thread_id = c.thread_id AND l.seq BETWEEN c.a AND c.b GROUP BY 1, 2, 3")
def ledger_range(spark, d):
    capsules = archive.hierarchy(event_episodes(spark, d), SPAN, 2, 2)
    return ledger.ledger_of(capsules, _losses(spark, d), SPAN)


@query(ENTRIES_SQL + " SELECT thread_id, name, max(seq) AS seq, count(*) AS times FROM loss GROUP BY 1, 2")
def loss_newest_locator(spark, d):
    return ledger.newest(_losses(spark, d))


@query(ENTRIES_SQL + f", head AS (SELECT thread_id, max(seq) AS h FROM ev GROUP BY 1), view AS (SELECT DISTINCT n.thread_id, n.name FROM nm n JOIN head USING (thread_id) WHERE n.seq > h - 10) SELECT thread_id, rank, name, seq FROM (SELECT thread_id, name, seq, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC, name) AS rank FROM (SELECT thread_id, name, max(seq) AS seq FROM loss GROUP BY 1, 2) x WHERE NOT EXISTS (SELECT 1 FROM view v WHERE v.thread_id = x.thread_id AND v.name = x.name)) WHERE rank <= 24")
def lost_name_digest(spark, d):
    shown = archive.tail(event_episodes(spark, d), 10).select("thread_id", "seq")
    view = _names(spark, d).join(shown, ["thread_id", "seq"], "left_semi")
    return ledger.digest(_losses(spark, d), view, 24)


@query(ENTRIES_SQL + " SELECT thread_id, count(*) AS named, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS lost, count(*) FILTER (NOT kept AND NOT EXISTS (SELECT 1 FROM loss l WHERE l.thread_id = split.thread_id AND l.no = split.no AND l.name = split.name AND l.kind = split.kind AND l.seq % 13 <> 5)) AS missing FROM split GROUP BY 1")
def ledger_completeness(spark, d):
    """Every name of a sealed leaf is in its summary or in the ledger: `missing` counts those in neither (here: every 13th
    place was taken out of the ledger)."""
    entries = _entries(spark, d)
    shown = _names(spark, d).where((F.col("seq") - 1) % SPAN < 3).select("thread_id", F.floor((F.col("seq") - 1) / SPAN).cast("long").alias("no"), "name")
    known = shown.union(_losses(spark, d).where("seq % 13 <> 5").select("thread_id", "no", "name"))
    missing = entries.select("thread_id", "no", "name").join(known, ["thread_id", "no", "name"], "left_anti").groupBy("thread_id").agg(F.count("*").alias("missing"))
    rows = entries.groupBy("thread_id").agg(F.count("*").alias("named"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("lost"))
    return rows.join(missing, "thread_id", "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))


@query(f"WITH {EV_SQL}, {NAMES_SQL}, head AS (SELECT thread_id, max(seq) AS h FROM nm GROUP BY 1) SELECT thread_id, name, count(DISTINCT seq) AS hits FROM nm JOIN head USING (thread_id) WHERE seq > h - 50 GROUP BY thread_id, name, h HAVING count(DISTINCT seq) > greatest(1, floor(least(50, h) * 0.02e0))")
def stop_names(spark, d):
    return ledger.stop_names(_names(spark, d), 50, 0.02, 1)


# ---- facts ---------------------------------------------------------------------------------------------------


def _stated(spark, d):
    e = event_episodes(spark, d)
    return e.select("thread_id", F.concat(F.lit("user."), F.col("event_type")).alias("key"), "seq", F.floor(F.col("value") / 10).cast("long").cast("string").alias("value"), authority(F.col("role")).alias("authority"))


FACTS_SQL = f"""WITH {EV_SQL}, st AS (SELECT thread_id, 'user.' || event_type AS key, seq, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS value FROM ev),
ch AS (SELECT *, lag(value) OVER (PARTITION BY thread_id, key ORDER BY seq) AS p FROM st),
fact AS (SELECT thread_id, key, value, seq AS valid_from, lead(seq) OVER (PARTITION BY thread_id, key ORDER BY seq) AS valid_to FROM ch WHERE p IS NULL OR p <> value)"""


def _facts(spark, d):
    return facts.revisions(_stated(spark, d))


@query(FACTS_SQL + " SELECT * FROM fact")
def atoms_scd2(spark, d):
    return _facts(spark, d)


@query(FACTS_SQL + " SELECT thread_id, key, value, valid_from FROM fact WHERE valid_to IS NULL")
def atoms_current(spark, d):
    return facts.current(_facts(spark, d))


@query(FACTS_SQL + " SELECT thread_id, key, value, valid_from FROM fact WHERE valid_from <= 20 AND (valid_to IS NULL OR valid_to > 20)")
def atoms_as_of(spark, d):
    return facts.as_of(_facts(spark, d), 20)


@query(FACTS_SQL + " SELECT thread_id, rank, key, value FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY valid_from DESC, key) AS rank FROM fact WHERE valid_to IS NULL) WHERE rank <= 3")
def atoms_changed_top3(spark, d):
    return facts.last_changed(_facts(spark, d), 3)


@query(FACTS_SQL + " SELECT thread_id, key, value, previous FROM (SELECT *, lag(value) OVER (PARTITION BY thread_id, key ORDER BY valid_from) AS previous FROM fact) WHERE valid_to IS NULL AND previous IS NOT NULL")
def historical_pairs(spark, d):
    return facts.with_previous(_facts(spark, d))


@query(FACTS_SQL + ", asked AS (SELECT DISTINCT user_id AS thread_id, 'user.' || event_type AS key FROM events) SELECT thread_id, key, rank, value, valid_from FROM (SELECT fact.*, row_number() OVER (PARTITION BY thread_id, key ORDER BY valid_to IS NOT NULL, valid_from DESC) AS rank FROM fact JOIN asked USING (thread_id, key)) WHERE rank <= 8")
def atoms_by_name(spark, d):
    asked = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.concat(F.lit("user."), "event_type").alias("key")).distinct()
    return facts.by_name(_facts(spark, d), asked, 8)


@query(f"""WITH RECURSIVE {EV_SQL}, said AS (SELECT thread_id, 'user.' || event_type AS key, seq, CAST(CAST(floor(value / 100) AS BIGINT) AS VARCHAR) AS value, CASE WHEN event_id % 3 = 0 THEN 'assistant' ELSE 'user' END AS authority FROM ev),
{two_lane_sql('said')} SELECT * FROM fact""")
def authority_two_lane(spark, d):
    e = event_episodes(spark, d)
    by = F.when(F.col("event_id") % 3 == 0, "assistant").otherwise("user")
    stated = e.select("thread_id", F.concat(F.lit("user."), F.col("event_type")).alias("key"), "seq", F.floor(F.col("value") / 100).cast("long").cast("string").alias("value"), by.alias("authority"))
    return facts.two_lanes(stated)


@query(FACTS_SQL + ", said AS (SELECT f.thread_id, f.key, f.valid_from FROM fact f) SELECT s.thread_id, s.key, s.valid_from FROM said s JOIN ev ON ev.thread_id = s.thread_id AND ev.seq = s.valid_from WHERE ev.role IN ('assistant', 'tool')")
def authority_replay_tell(spark, d):
    """Facts that claim the user's authority though their source is not the user's."""
    others = event_episodes(spark, d).where(F.col("role").isin("assistant", "tool")).select("thread_id", F.col("seq").alias("valid_from"))
    return _facts(spark, d).join(others, ["thread_id", "valid_from"], "left_semi").select("thread_id", "key", "valid_from")


@query(f"""WITH {ORD_SQL}, m AS (SELECT thread_id, seq, regexp_extract(content, '^The (.+) is now (.+)\\.$', 1) AS subject, regexp_extract(content, '^The (.+) is now (.+)\\.$', 2) AS value FROM ord),
ch AS (SELECT *, lag(value) OVER (PARTITION BY thread_id, subject ORDER BY seq) AS p FROM m)
SELECT thread_id, 'fact.' || replace(subject, ' ', '-') AS key, value, seq AS valid_from, lead(seq) OVER (PARTITION BY thread_id, subject ORDER BY seq) AS valid_to FROM ch WHERE p IS NULL OR p <> value""")
def fact_rule_revisions(spark, d):
    e = order_episodes(spark, d)
    rule = r"^The (.+) is now (.+)\.$"
    stated = e.select("thread_id", "seq", F.concat(F.lit("fact."), slug(F.regexp_extract("content", rule, 1), 5)).alias("key"), F.regexp_extract("content", rule, 2).alias("value"))
    return facts.revisions(stated.where("value <> ''"))


@query(FACTS_SQL + """, c AS (SELECT thread_id, key, valid_from, length(key || ' ' || value) AS cost FROM fact WHERE valid_to IS NULL), o AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY valid_from DESC, key) AS i FROM c),
w AS (SELECT thread_id, list(struct_pack(k := key, c := cost) ORDER BY i) AS rows FROM o GROUP BY 1),
t AS (SELECT thread_id, list_reduce(list_transform(rows, lambda x: struct_pack(used := CAST(x.c AS BIGINT), keys := [x.k])), lambda a, x: CASE WHEN a.used + x.used <= 45 THEN struct_pack(used := a.used + x.used, keys := a.keys || x.keys) ELSE a END, struct_pack(used := CAST(0 AS BIGINT), keys := CAST([] AS VARCHAR[]))) AS f FROM w)
SELECT thread_id, f.used AS used, array_to_string(f.keys, ',') AS keys FROM t""")
def frontier_fill(spark, d):
    return facts.frontier(_facts(spark, d), 45)


# ---- search --------------------------------------------------------------------------------------------------

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in SEARCH_STOP) + ")"
POST_SQL = f"""docs AS (SELECT doc_id, regexp_extract_all(lower(text), '(\\p{{L}}+)', 1) AS t FROM documents), post AS (SELECT doc_id, len(t) AS dl, u.term AS term, count(*) AS tf FROM docs, unnest(t) AS u(term) GROUP BY 1, 2, 3),
raw AS (SELECT item_id AS query_id, regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s.-]', ' ', 'g'), '\\s+') AS w FROM benchmark),
word AS (SELECT query_id, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM raw),
one AS (SELECT query_id, term, min(i) AS i FROM word WHERE length(term) >= 3 AND length(term) < 40 AND term NOT IN {STOP_SQL} GROUP BY 1, 2),
terms AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i) AS r FROM one) WHERE r <= 6)"""


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))


def _posted(spark, d, only=None):
    return search.postings(_docs(spark, d), "doc_id", only=only)


def _terms(spark, d):
    return search.query_terms(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@query(f"WITH {POST_SQL} SELECT query_id, term FROM terms")
def search_term_rows(spark, d):
    return _terms(spark, d)


@query(f"WITH {POST_SQL} SELECT doc_id, dl, term, tf FROM post")
def lexical_postings(spark, d):
    return _posted(spark, d)


@query(f"""WITH {POST_SQL}, size AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT doc_id, dl FROM post)), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))), 6) AS score, count(*) AS matched FROM terms JOIN post USING (term) JOIN df USING (term), size GROUP BY 1, 2)
SELECT query_id, doc_id, score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def bm25_topk(spark, d):
    return search.bm25(_docs(spark, d), _terms(spark, d), "doc_id", 10)


@query(f"WITH {POST_SQL}, need AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1) SELECT query_id, doc_id FROM (SELECT query_id, doc_id, count(*) AS have FROM terms JOIN post USING (term) GROUP BY 1, 2) JOIN need USING (query_id) WHERE have = n")
def search_strict_and(spark, d):
    terms = _terms(spark, d)
    return search.all_terms(_posted(spark, d, terms), terms, "doc_id")


@query(f"""WITH {POST_SQL}, need AS (SELECT query_id, count(*) AS n FROM terms GROUP BY 1), found AS (SELECT query_id, doc_id FROM (SELECT query_id, doc_id, count(*) AS have FROM terms JOIN post USING (term) GROUP BY 1, 2) JOIN need USING (query_id) WHERE have = n),
long AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(term) DESC, term) AS r FROM terms WHERE length(term) >= 5) WHERE r <= 3)
SELECT DISTINCT query_id, doc_id FROM long JOIN post USING (term) WHERE query_id NOT IN (SELECT query_id FROM found)""")
def search_or_fallback(spark, d):
    terms = _terms(spark, d)
    posted = _posted(spark, d, terms)
    return search.any_long_term(posted, terms, "doc_id", search.all_terms(posted, terms, "doc_id"))


ROUTES_SQL = f"WITH {EV_SQL}, route AS (SELECT event_id AS route_id, thread_id, seq FROM ev WHERE event_type = 'view'), closing AS (SELECT event_id - 1 AS route_id FROM ev WHERE event_type = 'error')"


def _routes(spark, d):
    e = event_episodes(spark, d)
    return e.where("event_type = 'view'").select(F.col("event_id").alias("route_id"), "thread_id", "seq"), e.where("event_type = 'error'").select((F.col("event_id") - 1).alias("route_id"))


@query(ROUTES_SQL + " SELECT route_id, thread_id, seq FROM route r WHERE NOT EXISTS (SELECT 1 FROM closing c WHERE c.route_id = r.route_id)")
def routes_effective(spark, d):
    return search.effective(*_routes(spark, d))


# ---- budgets -------------------------------------------------------------------------------------------------


@query("SELECT budget, CAST(floor(budget * 4 / 100) AS BIGINT) AS header, CAST(floor(budget * 20 / 100) AS BIGINT) AS facts, CAST(floor(budget * 18 / 100) AS BIGINT) AS capsules, CAST(floor(budget * 18 / 100) AS BIGINT) AS pages, CAST(budget - floor(budget * 4 / 100) - floor(budget * 20 / 100) - 2 * floor(budget * 18 / 100) AS BIGINT) AS recent FROM (SELECT DISTINCT n_chars AS budget FROM documents)")
def budget_allocate(spark, d):
    return budget.allocate(table(spark, d, "documents").select(F.col("n_chars").alias("budget")).distinct())


@query(f"""WITH {EV_SQL}, w AS (SELECT thread_id, list(struct_pack(used := {TOKENS} + 4, n := CAST(1 AS BIGINT), oldest := seq) ORDER BY seq DESC) AS rows FROM ev GROUP BY 1),
t AS (SELECT thread_id, list_reduce(rows, lambda a, x: CASE WHEN a.used + x.used <= 200 THEN struct_pack(used := a.used + x.used, n := a.n + 1, oldest := x.oldest) ELSE a END, struct_pack(used := CAST(0 AS BIGINT), n := CAST(0 AS BIGINT), oldest := CAST(0 AS BIGINT))) AS f FROM w)
SELECT thread_id, f.used AS used, f.n AS n, f.oldest AS oldest FROM t""")
def recent_fill(spark, d):
    return budget.recent_fill(event_episodes(spark, d), 200)


@query(f"WITH {EV_SQL}, c AS (SELECT thread_id, seq, CAST(sum({TOKENS} + CASE WHEN seq > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id ORDER BY seq) AS BIGINT) AS used FROM ev) SELECT thread_id, max(seq) AS to_seq, max(used) AS used FROM c WHERE used <= 300 GROUP BY 1")
def prefix_truncate(spark, d):
    return budget.prefix(event_episodes(spark, d), 300)


@query(f"WITH {EV_SQL}, c AS (SELECT thread_id, seq, CAST(sum({TOKENS}) OVER (PARTITION BY thread_id ORDER BY seq DESC) AS BIGINT) AS used FROM ev) SELECT thread_id, min(seq) AS from_seq, max(used) AS used FROM c WHERE used <= 300 GROUP BY 1")
def request_trim(spark, d):
    return budget.suffix(event_episodes(spark, d), 300)


@query(f"WITH {EV_SQL}, leaf AS (SELECT thread_id, (seq - 1) // {SPAN} AS no, CAST(sum({TOKENS}) AS BIGINT) AS tokens FROM ev GROUP BY 1, 2 HAVING count(*) = {SPAN}) SELECT thread_id, no, tokens, CAST(CASE WHEN sum(tokens) OVER (PARTITION BY thread_id) <= 500 THEN tokens ELSE tokens * 500 // CAST(sum(tokens) OVER (PARTITION BY thread_id) AS BIGINT) END AS BIGINT) AS share FROM leaf")
def proportional_shares(spark, d):
    leaves = archive.windows(event_episodes(spark, d), SPAN).select("thread_id", "no", "tokens")
    return budget.proportional(leaves, "tokens", 500, "thread_id")


@query(f"WITH {EV_SQL}, r AS (SELECT thread_id, seq, role, row_number() OVER (PARTITION BY thread_id ORDER BY seq) - row_number() OVER (PARTITION BY thread_id, role ORDER BY seq) AS g FROM ev) SELECT thread_id, role AS state, min(seq) AS from_seq, max(seq) AS to_seq FROM r GROUP BY thread_id, role, g")
def reachability_runs(spark, d):
    return budget.islands(event_episodes(spark, d).select("thread_id", "seq", F.col("role").alias("state")))


# ---- receipts ------------------------------------------------------------------------------------------------

STATUS = "CASE WHEN valid_to IS NULL AND role = 'user' THEN 'supported' WHEN valid_to IS NOT NULL AND role = 'user' THEN 'historical' ELSE 'proposed' END"
PLACES_SQL = FACTS_SQL + f", loc AS (SELECT f.thread_id, f.key, f.valid_from AS source_seq, {STATUS} AS status FROM fact f JOIN ev ON ev.thread_id = f.thread_id AND ev.seq = f.valid_from UNION ALL SELECT thread_id, 'user.' || event_type, seq, 'unresolved' FROM ev WHERE event_id % 5 = 0), ranked AS (SELECT *, CASE status WHEN 'supported' THEN 3 WHEN 'historical' THEN 2 WHEN 'proposed' THEN 1 ELSE 0 END AS r FROM loc), place AS (SELECT thread_id, key, source_seq, max_by(status, r) AS status, count(*) AS routes FROM ranked GROUP BY 1, 2, 3)"


def _places(spark, d):
    e = event_episodes(spark, d)
    source = e.select("thread_id", F.col("seq").alias("valid_from"), "role")
    known = _facts(spark, d).join(source, ["thread_id", "valid_from"])
    phase = F.when(F.col("valid_to").isNull(), "SUPPORTED").otherwise("HISTORICAL")
    by = F.when(F.col("role") == "user", "user").otherwise("assistant")
    first = known.select("thread_id", "key", F.col("valid_from").alias("source_seq"), coverage_status(phase, by).alias("status"))
    second = e.where("event_id % 5 = 0").select("thread_id", F.concat(F.lit("user."), F.col("event_type")).alias("key"), F.col("seq").alias("source_seq"), F.lit("unresolved").alias("status"))
    return evidence.strongest(first.union(second))


@query(PLACES_SQL + " SELECT thread_id, key, source_seq, status, routes FROM place")
def coverage_locators(spark, d):
    return _places(spark, d)


@query(PLACES_SQL + ", c AS (SELECT thread_id, count(*) FILTER (status <> 'unresolved') AS located, count(*) FILTER (status = 'supported') AS supported, count(*) FILTER (status = 'historical') AS historical, count(*) FILTER (status = 'unresolved') AS o FROM place GROUP BY 1) SELECT thread_id, located, supported, historical, greatest(o, 5 - supported) AS unresolved, located = 5 AND supported = 5 AND historical = 0 AND greatest(o, 5 - supported) = 0 AS complete FROM c")
def coverage_counts(spark, d):
    return evidence.coverage(_places(spark, d), 5)


@query(f"""WITH {EV_SQL}, n AS (SELECT thread_id, seq, value, lag(value) OVER (PARTITION BY thread_id ORDER BY seq) AS seen FROM ev)
SELECT thread_id, seq, abs(value - seen) < 1e-9 OR abs(floor(value + 0.5e0) - seen) < 1e-9 OR abs(value - floor(seen + 0.5e0)) < 1e-9 OR abs(floor(value * 10e0 + 0.5e0) / 10e0 - seen) < 1e-9 OR abs(value - floor(seen * 10e0 + 0.5e0) / 10e0) < 1e-9 AS retained FROM n WHERE seen IS NOT NULL""")
def claim_numbers_retained(spark, d):
    before = F.lag("value").over(Window.partitionBy("thread_id").orderBy("seq"))
    rows = event_episodes(spark, d).select("thread_id", "seq", "value", before.alias("seen")).where("seen is not null")
    return rows.select("thread_id", "seq", evidence.retained(F.col("value"), F.col("seen")).alias("retained"))


@query(f"WITH {EV_SQL}, {NAMES_SQL} SELECT a.thread_id, a.seq, count(*) AS claims, count(*) FILTER (EXISTS (SELECT 1 FROM nm b WHERE b.thread_id = a.thread_id AND b.name = a.name AND b.seq < a.seq)) AS supported FROM nm a JOIN ev e ON e.thread_id = a.thread_id AND e.seq = a.seq WHERE e.role = 'assistant' GROUP BY 1, 2")
def claim_support(spark, d):
    """Names that an assistant episode states, and how many were stated before it in the thread."""
    names = _names(spark, d)
    said = event_episodes(spark, d).where("role = 'assistant'").select("thread_id", "seq")
    first = names.groupBy("thread_id", "name").agg(F.min("seq").alias("first"))
    rows = names.join(said, ["thread_id", "seq"], "left_semi").join(first, ["thread_id", "name"])
    return rows.groupBy("thread_id", "seq").agg(F.count("*").alias("claims"), F.count_if(F.col("first") < F.col("seq")).alias("supported"))


@query(f"WITH {EV_SQL} SELECT thread_id, seq, seq % 10 = 0 AS removed, CASE WHEN seq % 10 = 0 THEN '[removed ' || substr(sha256(content), 1, 12) || ']' ELSE content END AS content FROM ev")
def removal_redact(spark, d):
    e = event_episodes(spark, d)
    return evidence.removed(e, e.where("seq % 10 = 0")).select("thread_id", "seq", "removed", "content")


@query(f"WITH {EV_SQL}, {NAMES_SQL}, lost AS (SELECT DISTINCT thread_id, name FROM nm WHERE seq % 10 = 0) SELECT nm.thread_id, nm.seq, count(DISTINCT nm.name) AS names FROM nm JOIN ev e ON e.thread_id = nm.thread_id AND e.seq = nm.seq JOIN lost l ON l.thread_id = nm.thread_id AND l.name = nm.name WHERE e.role = 'assistant' AND nm.seq % 10 <> 0 GROUP BY 1, 2")
def removal_echoes(spark, d):
    e = event_episodes(spark, d)
    return evidence.echoes(_names(spark, d), e.where("seq % 10 = 0").select("thread_id", "seq"), e)


@query(ENTRIES_SQL + " SELECT thread_id, no, name, seq, CASE WHEN seq % 10 = 0 THEN 'removal' END AS resolved_by FROM loss")
def removal_resolves_losses(spark, d):
    gone = event_episodes(spark, d).where("seq % 10 = 0").select("thread_id", "seq", F.lit("removal").alias("resolved_by"))
    return _losses(spark, d).join(gone, ["thread_id", "seq"], "left").select("thread_id", "no", "name", "seq", "resolved_by")


SPANS_SQL = "WITH t AS (SELECT page_id, encode(html) AS data FROM pages), s AS (SELECT page_id, data, octet_length(data) AS size, unnest(generate_series(0, (octet_length(data) - 1) // 1024)) AS ordinal FROM t WHERE octet_length(data) > 0)"


def _spans(spark, d):
    return evidence.attachment_spans(table(spark, d, "pages").select("page_id", F.col("html").alias("content")), "page_id", 1024)


@query(SPANS_SQL + " SELECT page_id, ordinal, ordinal * 1024 AS from_byte, least(ordinal * 1024 + 1024, size) AS to_byte, sha256(array_slice(data, ordinal * 1024 + 1, ordinal * 1024 + 1024)) AS hash FROM s")
def attachment_spans(spark, d):
    return _spans(spark, d)


@query("SELECT sha256(text) AS hash, octet_length(encode(text)) AS size, count(*) AS refs, min(doc_id) AS first_ref FROM documents GROUP BY 1, 2")
def blob_references(spark, d):
    return evidence.blobs(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")


@query("""WITH u AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, e AS q FROM u WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 6) AS cosine FROM u JOIN q ON vec_id <> query_id)
SELECT query_id, rank, vec_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def vector_nearest(spark, d):
    return evidence.nearest(table(spark, d, "embeddings"), 100, 5)


@query(FACTS_SQL + f" SELECT thread_id, (valid_from - 1) // {SPAN} AS span, CASE WHEN count(DISTINCT CASE WHEN valid_to IS NULL THEN 'SUPPORTED' ELSE 'HISTORICAL' END) = 1 THEN min(CASE WHEN valid_to IS NULL THEN 'SUPPORTED' ELSE 'HISTORICAL' END) ELSE 'unresolved' END AS phase, count(*) AS facts FROM fact GROUP BY 1, 2")
def span_phase(spark, d):
    rows = _facts(spark, d).select("thread_id", F.floor((F.col("valid_from") - 1) / SPAN).cast("long").alias("span"), F.when(F.col("valid_to").isNull(), "SUPPORTED").otherwise("HISTORICAL").alias("phase"))
    return evidence.agreed_phase(rows)


# ---- measures ------------------------------------------------------------------------------------------------


@query(f"WITH {EV_SQL}, t AS (SELECT event_type, {TOKENS} AS tokens FROM ev), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY tokens) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM t) SELECT event_type, max(tokens) FILTER (r = CAST(ceil(0.5e0 * n) AS BIGINT)) AS p50, max(tokens) FILTER (r = CAST(ceil(0.99e0 * n) AS BIGINT)) AS p99, max(tokens) AS max, max(n) AS n FROM r GROUP BY 1")
def packet_percentiles(spark, d):
    rows = event_episodes(spark, d).select("event_type", approx_tokens(F.col("content")).alias("tokens"))
    return evidence.nearest_rank(rows, "tokens", [0.5, 0.99], "event_type")


@query(f"WITH {EV_SQL} SELECT thread_id, round(regr_slope(CAST({TOKENS} AS DOUBLE), log10(seq)), 6) AS slope, count(*) AS n FROM ev GROUP BY 1 HAVING count(*) > 2")
def residency_slope(spark, d):
    e = event_episodes(spark, d).select("thread_id", approx_tokens(F.col("content")).cast("double").alias("y"), F.log10("seq").alias("x"))
    return e.groupBy("thread_id").agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.count("*").alias("n")).where("n > 2")


@query(f"WITH {EV_SQL} SELECT event_type, round(avg(CASE WHEN role = 'user' THEN 1e0 ELSE 0e0 END), 6) AS rate, count(*) FILTER (value > 100) AS served, count(*) FILTER (value > 100 AND role = 'user') AS needed FROM ev GROUP BY 1")
def routing_precision(spark, d):
    e = event_episodes(spark, d)
    return e.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("role") == "user", 1.0).otherwise(0.0)), 6).alias("rate"), F.count_if(F.col("value") > 100).alias("served"), F.count_if((F.col("value") > 100) & (F.col("role") == "user")).alias("needed"))


@query(f"""SELECT item_id, regexp_matches(lower(text), '{SALIENT_PATTERN.replace("'", "''")}') AS salient, text LIKE '%?%' AS asks FROM benchmark""")
def salient_cues(spark, d):
    return table(spark, d, "benchmark").select("item_id", salient(F.col("text")).alias("salient"), F.contains("text", F.lit("?")).alias("asks"))


@query(f"WITH {CONV_SQL}, l AS (SELECT thread_id, seq, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM conv), r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, line ORDER BY seq, i) AS r, count(*) OVER (PARTITION BY thread_id, line) AS n FROM l) SELECT thread_id, line, seq, i, n FROM r WHERE r = 1")
def distinct_lines(spark, d):
    """The lines of a thread, each whole, with its first place and how often it occurs."""
    rows = conversation_episodes(spark, d).select("thread_id", "seq", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    first = rows.groupBy("thread_id", "line").agg(F.min(F.struct("seq", "i")).alias("at"), F.count("*").alias("n"))
    return first.select("thread_id", "line", F.col("at.seq").alias("seq"), F.col("at.i").cast("long").alias("i"), "n")


# ---- routes --------------------------------------------------------------------------------------------------

QUESTION_SQL = """qu AS (SELECT thread_id AS question_id, thread_id, 'See #' || CAST(5 + thread_id % 7 AS VARCHAR) || '-' || CAST(6 + thread_id % 7 AS VARCHAR) || ' and issue #3: what of build-' || CAST(thread_id % 50 AS VARCHAR) || ' on ' || strftime(min(ts), '%Y-%m-%d') || '?' AS text FROM ev GROUP BY thread_id)"""


def _questions(spark, d):
    e = event_episodes(spark, d)
    no = F.col("thread_id")
    text = F.concat(F.lit("See #"), (5 + no % 7).cast("string"), F.lit("-"), (6 + no % 7).cast("string"), F.lit(" and issue #3: what of build-"), (no % 50).cast("string"), F.lit(" on "), F.date_format("t", "yyyy-MM-dd"), F.lit("?"))
    return e.groupBy("thread_id").agg(F.min("ts").alias("t")).select(F.col("thread_id").alias("question_id"), "thread_id", text.alias("text"))


@query(f"WITH {EV_SQL}, {QUESTION_SQL} SELECT question_id, thread_id, 5 + thread_id % 7 + i AS seq FROM qu, (VALUES (0), (1)) AS v(i)")
def route_sequence(spark, d):
    return router.sequence_references(_questions(spark, d))


CASCADE_SQL = ENTRIES_SQL + f""", {QUESTION_SQL}, asked AS (SELECT DISTINCT question_id, thread_id, unnest(list_concat(regexp_extract_all(text, '([a-z]+-[0-9]+)', 1), regexp_extract_all(text, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1))) AS name FROM qu),
cand AS (SELECT question_id, thread_id, 5 + thread_id % 7 + i AS seq, CAST(1 AS BIGINT) AS rank, 1 AS place FROM qu, (VALUES (0), (1)) AS v(i)
  UNION ALL SELECT question_id, thread_id, seq, min(r), 3 FROM (SELECT a.question_id, a.thread_id, l.seq, row_number() OVER (PARTITION BY a.question_id, a.name ORDER BY l.seq DESC) AS r FROM asked a JOIN loss l ON l.thread_id = a.thread_id AND l.name = a.name) WHERE r <= 4 GROUP BY 1, 2, 3
  UNION ALL SELECT question_id, thread_id, seq, min(r), 4 FROM (SELECT a.question_id, a.thread_id, n.seq, row_number() OVER (PARTITION BY a.question_id, a.name ORDER BY n.seq DESC) AS r FROM asked a JOIN nm n ON n.thread_id = a.thread_id AND n.name = a.name) WHERE r <= 2 GROUP BY 1, 2, 3),
best AS (SELECT question_id, thread_id, seq, min(place * 1000 + rank) AS b FROM cand GROUP BY 1, 2, 3),
pages AS (SELECT question_id, seq, b, row_number() OVER w AS page, CAST(sum({TOKENS}) OVER w AS BIGINT) AS used FROM best JOIN ev USING (thread_id, seq) WINDOW w AS (PARTITION BY question_id ORDER BY b, seq DESC ROWS UNBOUNDED PRECEDING))
SELECT question_id, page, seq, CASE b // 1000 WHEN 1 THEN 'sequence' WHEN 3 THEN 'ledger' ELSE 'lexical' END AS route, used FROM pages WHERE page <= 6 AND used <= 90"""


@query(CASCADE_SQL)
def route_cascade(spark, d):
    """Pages for one question per thread: by position, then by names that summaries lost, then by names at all."""
    questions, episodes = _questions(spark, d), event_episodes(spark, d)
    asked = router.named(questions, F.concat(code_names(F.col("text")), date_names(F.col("text"))))
    position = router.sequence_references(questions).withColumn("rank", F.lit(1).cast("long")).withColumn("route", F.lit("sequence"))
    lost = router.latest(asked.join(_losses(spark, d).select("thread_id", "name", "seq"), ["thread_id", "name"]), 4, "ledger")
    words = router.latest(asked.join(_names(spark, d).select("thread_id", "name", "seq"), ["thread_id", "name"]), 2, "lexical")
    return router.cascade(position.unionByName(lost).unionByName(words), episodes, 6, 90)


@query(f"WITH {names.places_sql('pages', 'page_id', 'html')} SELECT page_id, name, kind, start FROM place")
def page_names(spark, d):
    """Every name of every kind in web pages, with its place."""
    return names.name_places(table(spark, d, "pages"), ["page_id"], "html")


@query(f"""WITH {names.places_sql('pages', 'page_id', 'html')}, f AS (SELECT page_id, name, min(start) AS start, arg_min(kind, start) AS kind FROM place GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY CASE kind WHEN 'quote' THEN 1 WHEN 'number' THEN 2 WHEN 'code' THEN 3 WHEN 'date' THEN 4 ELSE 5 END, start) AS r FROM f) SELECT page_id, name, kind, start FROM r WHERE r <= 3""")
def page_names_capped(spark, d):
    """Each distinct name of a page at its first place; of more than three, the most decisive kinds."""
    return names.name_rows(table(spark, d, "pages"), ["page_id"], "html", 3)


from . import capsules, drafts, extraction, measures, packets, receipts, replays, retrieval, spans, streams  # noqa: E402, F401  they register their queries

__all__ = ["QUERIES", "SQL", "SPAN"]
