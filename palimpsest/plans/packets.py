"""Queries over packets that are compiled for every thread and budget."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import approx_tokens
from ..operators import archive, capsules, packets
from ..operators.budget import SHARES
from ..sources.episodes import table, talk_episodes
from ..sources.tables import stored
from .capsules import CAP, ROOT_CAP, ROOT_SQL, SPAN
from .extraction import talk_facts
from .registry import query

BUDGETS, KEEP = (120, 360, 900), 2
_T = "CAST(ceil(length(text) / 3.6e0 * 1.1e0) AS BIGINT)"
_PART = {lane: f"budget * {p} // 100" for lane, p in SHARES.items()}
_PART["recent"] = "budget - " + " - ".join(f"({p})" for p in _PART.values())


def _lane_sql() -> str:
    out, spare = [], "CAST(0 AS BIGINT)"
    for k, lane in enumerate(packets.LANES):
        source = "item" if lane != "pages" else "page"
        on = "i.thread_id = c.thread_id" + (" AND i.budget = c.budget" if lane == "pages" else "")
        if lane == "pages":
            out.append(_PAGES_SQL)
        base = "(SELECT DISTINCT thread_id, b.budget, CAST(0 AS BIGINT) AS spare FROM talk, bud b)" if k == 0 else f"left{k - 1}"
        out.append(f"""cap{k} AS (SELECT thread_id, budget, spare + {_PART[lane]} AS cap FROM {base}),
took{k} AS (SELECT c.thread_id, c.budget, '{lane}' AS lane, i.rank, i.seq, i.text, i.cost, i.upto FROM cap{k} c JOIN {source} i ON {on} AND i.lane = {k} AND i.upto <= c.cap),
left{k} AS (SELECT c.thread_id, c.budget, any_value(cap) - coalesce(max(upto), 0) AS spare FROM cap{k} c LEFT JOIN took{k} t USING (thread_id, budget) GROUP BY 1, 2)""")
    return ",\n".join(out)


_VIEW = " UNION ALL ".join(f"SELECT * FROM took{k}" for k in range(len(packets.LANES) - 1))
_KIND = "list_position([" + ", ".join(f"'{k}'" for k in names.KINDS) + "], kind)"
_PAGES_SQL = f"""view AS (SELECT thread_id, budget, string_agg(text, chr(10) ORDER BY lane, rank) AS text FROM ({_VIEW}) GROUP BY 1, 2),
{names.places_sql("view", "thread_id, budget", "text").replace("lex_", "lek_").replace("place AS (", "seen AS (")},
qn AS (SELECT DISTINCT p.thread_id, query_seq, name, kind FROM place p JOIN (SELECT thread_id, max(seq) AS query_seq FROM talk WHERE role = 'user' AND contains(content, '?') GROUP BY 1) q ON q.thread_id = p.thread_id AND q.query_seq = p.seq),
newest AS (SELECT q.thread_id, q.name, max(p.seq) AS seq FROM (SELECT DISTINCT thread_id, query_seq, name FROM qn) q JOIN place p ON p.thread_id = q.thread_id AND p.name = q.name AND p.seq < q.query_seq GROUP BY 1, 2),
wanted AS (SELECT q.thread_id, v.budget, n.seq, min(({_KIND}, -length(q.name), q.name)) AS o FROM qn q JOIN (SELECT DISTINCT thread_id, budget FROM seen) v USING (thread_id) JOIN newest n ON n.thread_id = q.thread_id AND n.name = q.name WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.thread_id = q.thread_id AND s.budget = v.budget AND s.name = q.name) GROUP BY 1, 2, 3),
page AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY thread_id, budget ORDER BY rank) AS BIGINT) AS upto FROM (SELECT thread_id, budget, 4 AS lane, row_number() OVER (PARTITION BY thread_id, budget ORDER BY o, seq) AS rank, seq, content AS text, CAST(ceil(length(content) / 3.6e0 * 1.1e0) AS BIGINT) + 4 AS cost FROM wanted JOIN talk USING (thread_id, seq)))"""
PACKET_SQL = f"""{ROOT_SQL}, {names.places_sql("talk", "thread_id, seq", "content")}, bud AS (SELECT unnest({list(BUDGETS)}) AS budget), newleaf AS (SELECT thread_id, max(no) AS last FROM leaf GROUP BY 1),
items AS (SELECT thread_id, 0 AS lane, CAST(1 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS seq, 'thread ' || CAST(thread_id AS VARCHAR) || ', ' || CAST(max(seq) AS VARCHAR) || ' turns' AS text FROM talk GROUP BY thread_id
  UNION ALL SELECT thread_id, 1, row_number() OVER (PARTITION BY thread_id ORDER BY valid_from DESC, key), valid_from, key || ': ' || value || ' ⟨#' || CAST(valid_from AS VARCHAR) || '⟩' FROM fact WHERE phase = 'SUPPORTED'
  UNION ALL SELECT thread_id, 2, row_number() OVER (PARTITION BY thread_id ORDER BY part, no, ordinal), seq, line FROM (
    SELECT r.thread_id, 0 AS part, r.root AS no, r.ordinal, x.seq AS seq, x.line AS line FROM root r JOIN (SELECT thread_id, max(root) AS root FROM root JOIN newleaf USING (thread_id) WHERE root <= last - {KEEP} GROUP BY 1) w ON w.thread_id = r.thread_id AND w.root = r.root
    UNION ALL SELECT l.thread_id, 1, l.no, l.ordinal, l.seq, l.line FROM lines l JOIN newleaf USING (thread_id) WHERE l.no > last - {KEEP})
  UNION ALL SELECT t.thread_id, 3, row_number() OVER (PARTITION BY t.thread_id ORDER BY seq DESC), seq, content FROM talk t LEFT JOIN newleaf n ON n.thread_id = t.thread_id WHERE seq > (coalesce(last, -1) + 1) * {SPAN} AND NOT removed),
item AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY thread_id, lane ORDER BY rank) AS BIGINT) AS upto FROM (SELECT *, {_T} + CASE WHEN lane = 3 THEN 4 ELSE 1 END AS cost FROM items)),
{_lane_sql()},
packet AS ({_VIEW} UNION ALL SELECT * FROM took4)"""


def talk_packet(spark, d):
    """All items that are shown of every thread for every budget."""
    e = stored(talk_episodes(spark, d), "talk")
    known = talk_facts(spark, d, e)
    lines = capsules.written_lines(capsules.candidate_lines(e, capsules.supported_at_end(known, SPAN), SPAN), CAP)
    until = known.select("thread_id", capsules.certificate(F.col("key"), F.col("value"), F.col("valid_from")).alias("line"), F.lit(0).alias("tier"), F.col("valid_to").alias("until"))
    lines = stored(lines.join(until, ["thread_id", "line", "tier"], "left").withColumn("to_seq", (F.col("no") + 1) * SPAN), "lines")
    roots = stored(capsules.sequential_root(lines, most=ROOT_CAP), "roots")
    last = stored(archive.windows(e, SPAN).groupBy("thread_id").agg(F.max("no").alias("last")), "last")
    rank = lambda *by: F.row_number().over(Window.partitionBy("thread_id").orderBy(*by)).cast("long").alias("rank")
    lane = lambda rows, more: rows.withColumn("cost", approx_tokens(F.col("text")) + more)
    header = e.groupBy("thread_id").agg(F.max("seq").alias("head")).select("thread_id", F.lit(1).cast("long").alias("rank"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("thread "), F.col("thread_id").cast("string"), F.lit(", "), F.col("head").cast("string"), F.lit(" turns")).alias("text"))
    facts = known.where("phase = 'SUPPORTED'").select("thread_id", rank(F.desc("valid_from"), "key"), F.col("valid_from").alias("seq"), capsules.certificate(F.col("key"), F.col("value"), F.col("valid_from")).alias("text"))
    old = roots.join(last, "thread_id").where(F.col("root") <= F.col("last") - KEEP)
    newest = old.groupBy("thread_id").agg(F.max("root").alias("root"))
    shown = old.join(newest, ["thread_id", "root"]).select("thread_id", F.lit(0).alias("part"), F.col("root").alias("no"), "ordinal", "seq", "line")
    leaves = lines.join(last, "thread_id").where(F.col("no") > F.col("last") - KEEP).select("thread_id", F.lit(1).alias("part"), "no", "ordinal", "seq", "line")
    caps = shown.union(leaves).select("thread_id", rank("part", "no", "ordinal"), "seq", F.col("line").alias("text"))
    recent = e.join(last, "thread_id", "left").where((F.col("seq") > (F.coalesce("last", F.lit(-1)) + 1) * SPAN) & ~F.col("removed")).select("thread_id", rank(F.desc("seq")), "seq", F.col("content").alias("text"))
    budgets = spark.createDataFrame([(b,) for b in BUDGETS], "budget long")
    items, spare = packets.compiled({"header": lane(header, 1), "facts": lane(facts, 1), "capsules": lane(caps, 1), "recent": lane(recent, 4)}, e, budgets)
    view = names.name_places(items, ["thread_id", "budget"], "text").select("thread_id", "budget", "name").distinct()
    places = stored(names.name_places(e, ["thread_id", "seq"]), "places")
    asks = e.where((F.col("role") == "user") & F.contains("content", F.lit("?"))).groupBy("thread_id").agg(F.max("seq").alias("query_seq"))
    asked = places.join(asks, "thread_id").where("seq = query_seq").select("thread_id", "query_seq", "name", "kind").distinct()
    paged, _ = packets.fill(lane(packets.pages(asked, stored(view, "view"), places, e), 4), spare, "pages")
    return items.unionByName(paged.select(*items.columns))


@query(f"WITH RECURSIVE {PACKET_SQL} SELECT thread_id, budget, lane, rank, seq, cost, upto FROM packet")
def packet_items(spark, d):
    """What is shown of each thread for each budget: header, facts, capsules, recent turns, and pages for what a question
    names and the rest doesn't show; each lane passes on what it leaves."""
    return talk_packet(spark, d).select("thread_id", "budget", "lane", "rank", "seq", "cost", "upto")


@query(f"WITH RECURSIVE {PACKET_SQL} SELECT thread_id, budget, count(*) AS items, CAST(sum(cost) AS BIGINT) AS tokens, sha256(string_agg(text, chr(10) ORDER BY list_position(['header', 'facts', 'capsules', 'recent', 'pages'], lane), rank)) AS hash FROM packet GROUP BY 1, 2")
def packets_compiled(spark, d):
    """The packets themselves: items, tokens and digest."""
    return packets.packet(talk_packet(spark, d))
