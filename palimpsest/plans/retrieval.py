"""Queries over questions: cues, each route, the cascade, and what it can't answer. One question for every thread."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import SEARCH_STOP
from ..operators import router, routes
from ..sources.episodes import CITIES, PEOPLE, TALK_SQL, THEMES, _pick_sql, talk_episodes
from .capsules import LEDGER_SQL, talk_ledger
from .extraction import COMMIT_SQL, fact_index
from .registry import query

ASKED = (
    "What did {p} say in turn {k}?",
    "Where does my {w} budget stand? I told you earlier.",
    "Who is {p}, and what about {c}?",
    "Compare all three {w} budgets of #{k}-{m}.",
    'What was in src/{w}.py, which I called "large but not very stable"?',
    "Did we discuss the zebra crossing before?",
    "What is the ship version?",
    "Where is the {w} invoice that {p} works at {c} Labs for?",
)


def talk_questions(spark, d):
    no = F.col("thread_id")
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(no, F.lit(len(words))) + 1).cast("int"))
    text = pick(ASKED)
    for k, v in {"p": pick(PEOPLE), "c": pick(CITIES), "w": pick(THEMES), "k": (1 + no % 9).cast("string"), "m": (3 + no % 9).cast("string")}.items():
        text = F.replace(text, F.lit("{" + k + "}"), v)
    heads = talk_episodes(spark, d).groupBy("thread_id").agg((F.max("seq") + 1).alias("query_seq"))
    return heads.select(no.alias("question_id"), "thread_id", "query_seq", text.alias("text"))


_text = _pick_sql(ASKED, "thread_id")
for _k, _v in {"p": _pick_sql(PEOPLE, "thread_id"), "c": _pick_sql(CITIES, "thread_id"), "w": _pick_sql(THEMES, "thread_id"), "k": "CAST(1 + thread_id % 9 AS VARCHAR)", "m": "CAST(3 + thread_id % 9 AS VARCHAR)"}.items():
    _text = f"replace({_text}, '{{{_k}}}', {_v})"
QU_SQL = f"qu AS (SELECT thread_id AS question_id, thread_id, max(seq) + 1 AS query_seq, {_text} AS text FROM talk GROUP BY thread_id)"
_m = lambda words: "regexp_matches(lower(text), '" + routes.word_pattern(words) + "')"
STOP_SQL = "(" + ", ".join(f"'{w}'" for w in SEARCH_STOP) + ")"
_TERMS = f"list_slice(list_transform(list_sort(list_transform(list_distinct(list_filter(w, lambda x: length(x) >= 3 AND length(x) < 40 AND x NOT IN {STOP_SQL})), lambda x: struct_pack(i := list_position(w, x), x := x))), lambda s: s.x), 1, 6)"
CUE_SQL = QU_SQL + f""", cue AS (SELECT question_id, thread_id, query_seq, text, contains(text, '?') OR {_m(routes.ASKING)} AS asks, {_m(routes.BACK)} AS back, {_m(routes.FIRST)} AS first_person, {_m(routes.SECOND)} AS second_person, {_TERMS} AS want
  FROM (SELECT *, regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s.-]', ' ', 'g'), '\\s+') AS w FROM qu))"""
QNAMES_SQL = names.places_sql("qu", "question_id, thread_id, query_seq", "text").replace("lex_", "leq_").replace("place AS (", "qplace AS (")
ASKED_SQL = "asked AS (SELECT DISTINCT question_id, thread_id, query_seq, name, kind FROM qplace)"


def asked_names(spark, d):
    return names.name_places(talk_questions(spark, d), ["question_id", "thread_id", "query_seq"], "text").select("question_id", "thread_id", "query_seq", "name", "kind").distinct()


@query(f"WITH {TALK_SQL}, {CUE_SQL} SELECT question_id, asks, back, first_person, second_person, len(want) AS terms FROM cue")
def question_cues(spark, d):
    return talk_questions(spark, d).select("question_id", *routes.cues(F.col("text")))


@query(f"WITH {TALK_SQL}, {QU_SQL}, {QNAMES_SQL}, {ASKED_SQL} SELECT * FROM asked")
def question_names(spark, d):
    return asked_names(spark, d)


@query(f"WITH {TALK_SQL}, {QU_SQL}, r AS (SELECT question_id, thread_id, 1 + thread_id % 5 AS a, 20 + thread_id % 60 AS b FROM qu), e AS (SELECT r.question_id, r.thread_id, t.seq, row_number() OVER (PARTITION BY r.question_id ORDER BY t.seq) AS rank FROM r JOIN talk t ON t.thread_id = r.thread_id AND t.seq BETWEEN a AND b) SELECT *, 'range' AS route FROM e WHERE rank <= 12")
def route_range(spark, d):
    asked = talk_questions(spark, d).select("question_id", "thread_id", (1 + F.col("thread_id") % 5).alias("from_seq"), (20 + F.col("thread_id") % 60).alias("to_seq"))
    return routes.by_range(asked, talk_episodes(spark, d))


SEQ_SQL = QU_SQL + """, seqs AS (SELECT question_id, thread_id, CASE WHEN thread_id % 8 = 0 THEN 1 + thread_id % 9 ELSE 1 + thread_id % 9 + i END AS seq FROM qu, (VALUES (0), (1), (2)) v(i) WHERE (thread_id % 8 = 0 AND i = 0) OR thread_id % 8 = 3)"""
_NEAR = "(SELECT CASE s.role WHEN 'user' THEN min(x.seq) ELSE max(x.seq) END FROM talk x WHERE x.thread_id = s.thread_id AND NOT x.removed AND ((s.role = 'user' AND x.role = 'assistant' AND x.seq BETWEEN s.seq + 1 AND s.seq + 12) OR (s.role = 'assistant' AND x.role = 'user' AND x.seq BETWEEN s.seq - 12 AND s.seq - 1)))"


@query(f"WITH {TALK_SQL}, {SEQ_SQL}, h AS (SELECT q.question_id, s.thread_id, s.seq, s.role FROM seqs q JOIN talk s USING (thread_id, seq)), n AS (SELECT question_id, thread_id, seq, {_NEAR} AS near FROM h s) SELECT * FROM n WHERE near IS NOT NULL")
def route_sequence_neighbours(spark, d):
    """Turns that a question names by number, each with the nearest turn of the other side."""
    hits = router.sequence_references(talk_questions(spark, d))
    return routes.neighbours(hits, talk_episodes(spark, d))


EDGE_SQL = CUE_SQL + """, edge AS (SELECT t.event_id AS edge_id, t.thread_id, t.seq, sha256(CASE WHEN t.event_id % 2 = 0 THEN 'v1|' || lower(trim(regexp_replace(q.text, '\\s+', ' ', 'g'))) ELSE 'v1|other' END) AS digest, sha256(CASE WHEN t.event_id % 3 = 0 THEN t.content || '~' ELSE t.content END) AS content_hash FROM talk t JOIN qu q USING (thread_id) WHERE t.event_id % 5 = 1),
closing AS (SELECT event_id - 4 AS edge_id FROM talk WHERE event_id % 20 = 0),
live AS (SELECT e.* FROM edge e JOIN talk t USING (thread_id, seq) WHERE NOT t.removed AND sha256(t.content) = e.content_hash AND NOT EXISTS (SELECT 1 FROM closing c WHERE c.edge_id = e.edge_id))"""


def talk_edges(spark, d):
    e, q = talk_episodes(spark, d), talk_questions(spark, d)
    digest = F.when(F.col("event_id") % 2 == 0, routes.address_digest(F.col("text"))).otherwise(F.sha2(F.lit("v1|other"), 256))
    content = F.when(F.col("event_id") % 3 == 0, F.concat("content", F.lit("~"))).otherwise(F.col("content"))
    edges = e.where("event_id % 5 = 1").join(q.select("thread_id", "text"), "thread_id").select(F.col("event_id").alias("edge_id"), "thread_id", "seq", digest.alias("digest"), F.sha2(content, 256).alias("content_hash"))
    return edges, e.where("event_id % 20 = 0").select((F.col("event_id") - 4).alias("edge_id"))


@query(f"WITH {TALK_SQL}, {EDGE_SQL} SELECT edge_id, thread_id, seq, digest, content_hash FROM live")
def address_edges(spark, d):
    """Recorded addresses that still hold: not closed, and their witness unchanged and not removed."""
    return routes.effective_addresses(*talk_edges(spark, d), talk_episodes(spark, d)).select("edge_id", "thread_id", "seq", "digest", "content_hash")


@query(f"WITH {TALK_SQL}, {EDGE_SQL} SELECT q.question_id, l.thread_id, l.seq, row_number() OVER (PARTITION BY q.question_id ORDER BY l.seq DESC) AS rank, 'address' AS route FROM live l JOIN qu q ON q.thread_id = l.thread_id AND l.digest = sha256('v1|' || lower(trim(regexp_replace(q.text, '\\s+', ' ', 'g'))))")
def route_address(spark, d):
    return routes.by_address(talk_questions(spark, d), routes.effective_addresses(*talk_edges(spark, d), talk_episodes(spark, d)))


@query(f"WITH {TALK_SQL}, {EDGE_SQL} SELECT e.edge_id, e.thread_id FROM edge e JOIN talk t USING (thread_id, seq) WHERE (t.removed OR EXISTS (SELECT 1 FROM talk x WHERE x.thread_id = e.thread_id AND x.seq = e.seq - 3 AND x.removed)) AND NOT EXISTS (SELECT 1 FROM closing c WHERE c.edge_id = e.edge_id)")
def routes_closed_by_removal(spark, d):
    """Open addresses with a removed episode among their witnesses: the place itself and the third before it."""
    edges, closings = talk_edges(spark, d)
    gone = talk_episodes(spark, d).where("removed").select("thread_id", F.col("seq").alias("witness"))
    witnesses = edges.join(closings, "edge_id", "left_anti").select("edge_id", "thread_id", F.explode(F.array("seq", F.col("seq") - 3)).alias("witness"))
    return witnesses.join(gone, ["thread_id", "witness"], "left_semi").select("edge_id", "thread_id").distinct()


@query(f"WITH {TALK_SQL}, {QU_SQL}, h AS (SELECT q.question_id, t.thread_id, CASE WHEN t.event_id % 29 = 0 THEN q.query_seq ELSE t.seq END AS seq, CASE WHEN t.event_id % 3 = 0 THEN 'no such words' ELSE substr(t.content, 3, 8) END AS quote, t.event_id % 97 AS score FROM talk t JOIN qu q USING (thread_id) WHERE t.event_id % 4 = 1) SELECT h.question_id, h.thread_id, h.seq, h.score, CASE WHEN t.role IS NULL THEN 'missing' WHEN t.removed THEN 'removed' WHEN t.event_id % 31 = 0 THEN 'role' WHEN h.seq >= q.query_seq THEN 'self' WHEN instr(t.content, h.quote) = 0 THEN 'quote' END AS refused FROM h LEFT JOIN qu q USING (question_id) LEFT JOIN talk t ON t.thread_id = h.thread_id AND t.seq = h.seq")
def semantic_hits(spark, d):
    """Hits given as data, each with the reason for refusing it: missing, removed, said by nobody who may be quoted, the
    question itself, misquoted. Some turns are those of a system here."""
    q = talk_questions(spark, d)
    e = talk_episodes(spark, d).withColumn("role", F.when(F.col("event_id") % 31 == 0, "system").otherwise(F.col("role")))
    h = e.where("event_id % 4 = 1").join(q.select("thread_id", "question_id", "query_seq"), "thread_id")
    hits = h.select("question_id", "thread_id", F.when(F.col("event_id") % 29 == 0, F.col("query_seq")).otherwise(F.col("seq")).alias("seq"), F.when(F.col("event_id") % 3 == 0, "no such words").otherwise(F.substring("content", 3, 8)).alias("quote"), (F.col("event_id") % 97).alias("score"))
    return routes.verified_hits(hits, e, q)


FACT_ROUTES = COMMIT_SQL + f""", revoked AS (SELECT thread_id, seq FROM talk WHERE removed), unread AS (SELECT thread_id, seq FROM talk WHERE event_id % 17 = 0),
able AS (SELECT * FROM fact f WHERE NOT EXISTS (SELECT 1 FROM revoked r WHERE r.thread_id = f.thread_id AND r.seq = f.valid_from) AND NOT EXISTS (SELECT 1 FROM unread u WHERE u.thread_id = f.thread_id AND u.seq = f.valid_from)),
idx AS (SELECT thread_id, lower(key) AS name, key, 'key' AS part, value, phase, valid_from FROM able UNION ALL SELECT thread_id, lower(value), key, 'value', value, phase, valid_from FROM able), {QU_SQL}, {QNAMES_SQL}, {ASKED_SQL}"""
_ranked = lambda rows, order: f"SELECT question_id, thread_id, seq, row_number() OVER (PARTITION BY question_id ORDER BY min({order}), seq) AS rank FROM {rows} GROUP BY question_id, thread_id, seq"


def _fact_sql(phase: str, most: int, route: str) -> str:
    return f"WITH RECURSIVE {FACT_ROUTES}, h AS (SELECT a.question_id, a.thread_id, i.valid_from AS seq, row_number() OVER (PARTITION BY a.question_id, a.name ORDER BY i.valid_from DESC, i.key, i.part) AS r FROM asked a JOIN idx i USING (thread_id, name) WHERE i.phase = '{phase}') SELECT *, '{route}' AS route FROM ({_ranked('(SELECT * FROM h WHERE r <= ' + str(most) + ')', 'r')})"


@query(_fact_sql("SUPPORTED", 8, "fact"))
def route_facts(spark, d):
    return routes.by_fact(asked_names(spark, d), fact_index(spark, d), "SUPPORTED", 8, "fact")


@query(_fact_sql("HISTORICAL", 3, "historical"))
def route_historical(spark, d):
    return routes.by_fact(asked_names(spark, d), fact_index(spark, d), "HISTORICAL", 3, "historical")


@query(f"WITH RECURSIVE {LEDGER_SQL}, {QU_SQL}, {QNAMES_SQL}, {ASKED_SQL}, h AS (SELECT question_id, thread_id, l.seq, row_number() OVER (PARTITION BY question_id, a.name ORDER BY l.seq DESC) AS r FROM asked a JOIN (SELECT DISTINCT thread_id, name, seq FROM loss) l USING (thread_id, name)) SELECT *, 'ledger' AS route FROM ({_ranked('(SELECT * FROM h WHERE r <= 4)', 'r')})")
def route_ledger(spark, d):
    return routes.by_loss(asked_names(spark, d), talk_ledger(spark, d))


TPLACES = names.places_sql("talk", "thread_id, seq", "content")


def _attachment(spark, d):
    return routes.by_attachment(asked_names(spark, d), names.name_places(talk_episodes(spark, d), ["thread_id", "seq"]))


@query(f"WITH {TALK_SQL}, {QU_SQL}, {QNAMES_SQL}, {ASKED_SQL}, {TPLACES}, s AS (SELECT question_id, thread_id, a.name, min(p.seq) AS seq FROM asked a JOIN (SELECT DISTINCT thread_id, name, seq FROM place) p USING (thread_id, name) WHERE a.kind = 'code' GROUP BY 1, 2, 3 HAVING count(*) = 1) SELECT *, 'attachment' AS route FROM ({_ranked('s', 'name')})")
def route_attachment(spark, d):
    return _attachment(spark, d)


WORDS_SQL = CUE_SQL + """, have AS (SELECT thread_id, seq, role, list_distinct(regexp_extract_all(lower(content), '(\\p{L}+)', 1)) AS have FROM talk WHERE NOT removed),
lex AS (SELECT c.question_id, c.thread_id, h.seq, row_number() OVER (PARTITION BY c.question_id ORDER BY h.seq DESC) AS rank FROM cue c JOIN have h USING (thread_id) WHERE c.asks AND len(c.want) >= 2 AND len(list_filter(c.want, lambda w: NOT list_contains(h.have, w))) = 0)"""


@query(f"WITH {TALK_SQL}, {WORDS_SQL} SELECT question_id, thread_id, seq, rank, 'lexical' AS route FROM lex WHERE rank <= 2")
def route_lexical(spark, d):
    return routes.by_words(talk_questions(spark, d), talk_episodes(spark, d))


def talk_receipts(spark, d):
    """What each turn of the assistant was shown: the two user turns before it in the archive's numbering."""
    return talk_episodes(spark, d).where("role = 'assistant'").select("thread_id", "seq", F.array(F.col("seq") - 1, F.col("seq") - 2, F.col("seq") - 5).alias("pages"))


@query(f"WITH {TALK_SQL}, {WORDS_SQL}, via AS (SELECT l.question_id, l.thread_id, l.seq AS v FROM lex l JOIN talk t USING (thread_id, seq) WHERE l.rank <= 8 AND t.role = 'assistant'), p AS (SELECT question_id, thread_id, v, v - o AS seq, row_number() OVER (PARTITION BY question_id, v ORDER BY v - o DESC) AS r FROM via, (VALUES (1), (2), (5)) x(o) WHERE v - o >= 1) SELECT *, 'path' AS route FROM ({_ranked('(SELECT * FROM p WHERE r <= 2)', '-seq')})")
def route_path(spark, d):
    hits = routes.by_words(talk_questions(spark, d), talk_episodes(spark, d), 8, 8)
    return routes.by_path(hits, talk_episodes(spark, d), talk_receipts(spark, d))


@query(f"WITH {TALK_SQL}, {WORDS_SQL}, {SEQ_SQL.split(', seqs AS', 1)[0].replace('qu AS', 'qu2 AS')}, seqs AS{SEQ_SQL.split(', seqs AS', 1)[1]} SELECT question_id, thread_id, len(want) AS terms FROM cue c WHERE asks AND back AND len(want) >= 1 AND NOT EXISTS (SELECT 1 FROM lex l WHERE l.question_id = c.question_id AND l.rank <= 2) AND NOT EXISTS (SELECT 1 FROM seqs s JOIN talk t USING (thread_id, seq) WHERE s.question_id = c.question_id)")
def route_fault(spark, d):
    """Questions about the past that neither a position nor the search answers."""
    e, q = talk_episodes(spark, d), talk_questions(spark, d)
    position = router.sequence_references(q).join(e.select("thread_id", "seq"), ["thread_id", "seq"])
    return routes.faults(q, routes.by_words(q, e).select("question_id").union(position.select("question_id")))


REPLY_SQL = f"""lastr AS (SELECT thread_id, arg_max(content, seq) AS content, max(seq) AS seq FROM talk WHERE role = 'assistant' AND NOT removed GROUP BY 1), {names.places_sql('lastr', 'thread_id, seq', 'content').replace('lex_', 'ler_').replace('place AS (', 'rplace AS (')}"""


@query(f"WITH RECURSIVE {FACT_ROUTES.replace(ASKED_SQL, 'asked0 AS (SELECT DISTINCT question_id, thread_id, query_seq, name, kind FROM qplace)')}, {REPLY_SQL}, asked AS (SELECT DISTINCT q.question_id, q.thread_id, q.query_seq, r.name FROM qu q JOIN rplace r USING (thread_id)), h AS (SELECT a.question_id, a.thread_id, i.valid_from AS seq, row_number() OVER (PARTITION BY a.question_id, a.name ORDER BY i.valid_from DESC, i.key, i.part) AS r FROM asked a JOIN idx i USING (thread_id, name) WHERE i.phase = 'SUPPORTED') SELECT *, 'reply' AS route FROM ({_ranked('(SELECT * FROM h WHERE r <= 8)', 'r')})")
def route_reply_names(spark, d):
    """Facts about the names in the last reply."""
    e = talk_episodes(spark, d).where("role = 'assistant' and not removed")
    last = e.groupBy("thread_id").agg(F.max(F.struct("seq", "content"))["content"].alias("content"))
    said = names.name_places(last, ["thread_id"]).select("thread_id", "name").distinct()
    asked = talk_questions(spark, d).select("question_id", "thread_id", "query_seq").join(said, "thread_id")
    return routes.by_fact(asked, fact_index(spark, d), "SUPPORTED", 8, "reply")


CASCADE = f"WITH RECURSIVE {FACT_ROUTES}, {WORDS_SQL.replace(QU_SQL + ', ', '', 1)}, {SEQ_SQL.replace(QU_SQL + ', ', '', 1)}"
_PAGES = """, fh AS (SELECT a.question_id, a.thread_id, i.valid_from AS seq, row_number() OVER (PARTITION BY a.question_id, a.name ORDER BY i.valid_from DESC, i.key, i.part) AS r FROM asked a JOIN idx i USING (thread_id, name) WHERE i.phase = 'SUPPORTED'),
cand AS (SELECT s.question_id, s.thread_id, s.seq, 2 AS place, s.seq AS rank FROM seqs s UNION ALL SELECT question_id, thread_id, seq, 5, rank FROM (SELECT question_id, thread_id, seq, row_number() OVER (PARTITION BY question_id ORDER BY min(r), seq) AS rank FROM fh WHERE r <= 8 GROUP BY 1, 2, 3) UNION ALL SELECT question_id, thread_id, seq, 9, rank FROM lex WHERE rank <= 2),
best AS (SELECT question_id, thread_id, seq, min((place, rank)) AS b FROM cand GROUP BY 1, 2, 3),
pg AS (SELECT question_id, seq, b, CAST(ceil(length(content) / 3.6e0 * 1.1e0) AS BIGINT) AS tokens, row_number() OVER w AS page, CAST(sum(ceil(length(content) / 3.6e0 * 1.1e0)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM best JOIN talk USING (thread_id, seq) WHERE NOT removed WINDOW w AS (PARTITION BY question_id ORDER BY b, seq DESC))"""


def _pages(spark, d, budget, most=None):
    e, q = talk_episodes(spark, d), talk_questions(spark, d)
    position = router.sequence_references(q).select("question_id", "thread_id", "seq", F.col("seq").alias("rank"), F.lit("sequence").alias("route"))
    facts = routes.by_fact(asked_names(spark, d), fact_index(spark, d), "SUPPORTED", 8, "fact")
    return routes.pages([position, facts, routes.by_words(q, e)], e, budget, most=most)


@query(CASCADE + _PAGES + " SELECT question_id, page, seq, CASE b[1] WHEN 2 THEN 'sequence' WHEN 5 THEN 'fact' ELSE 'lexical' END AS route, used FROM pg WHERE page <= 4 AND used - tokens < 1800 - 60")
def page_cascade(spark, d):
    """Pages for each thread's question: by position, by facts, by words, within a budget of tokens and pages."""
    return _pages(spark, d, 1800)


@query(CASCADE + _PAGES + " SELECT question_id, page, seq, CASE b[1] WHEN 2 THEN 'sequence' WHEN 5 THEN 'fact' ELSE 'lexical' END AS route, used FROM pg WHERE page <= 2 AND used - tokens < 90 - 60")
def recall_pages(spark, d):
    """A recall within a reply: the same routes, two pages at most and little room."""
    return _pages(spark, d, 90, 2)
