"""Queries over receipts that are run again at their snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import terms_of
from ..operators import replay
from ..sources.episodes import CONV_SQL, conversation_episodes, talk_episodes
from ..sources.tables import stored
from .extraction import COMMIT_SQL, talk_facts
from .registry import query

MOST = 3
# Every reply asks for one word, or two, of the turn before it, the first in the alphabet. Some turns are removed later, some
# receipts were written from the thread's end instead of their own place, and some lost a page.
REPLAY_SQL = CONV_SQL + """, ep AS (SELECT thread_id, seq, role, list_distinct(regexp_extract_all(lower(content), '(\\p{L}+)', 1)) AS have, CASE WHEN seq % 4 = 1 THEN seq + 3 END AS until FROM conv),
rc AS (SELECT a.thread_id * 1000 + a.seq AS receipt_id, a.thread_id, a.seq AS at_seq, list_slice(list_sort(list_filter(b.have, lambda w: length(w) >= 3)), 1, 1 + a.thread_id % 2) AS terms FROM ep a JOIN ep b ON b.thread_id = a.thread_id AND b.seq = a.seq - 1 WHERE a.role = 'assistant'),
hit AS (SELECT receipt_id, at_seq, seq, until FROM rc JOIN ep USING (thread_id) WHERE len(terms) > 0 AND len(list_filter(terms, lambda w: NOT list_contains(have, w))) = 0),
agn AS (SELECT receipt_id, seq, row_number() OVER (PARTITION BY receipt_id ORDER BY seq DESC) AS rank FROM hit WHERE seq < at_seq AND (until IS NULL OR until >= at_seq) QUALIFY rank <= 3),
fin AS (SELECT receipt_id, seq, row_number() OVER (PARTITION BY receipt_id ORDER BY seq DESC) AS rank FROM hit WHERE until IS NULL QUALIFY rank <= 3),
rec AS (SELECT * FROM agn WHERE receipt_id % 7 <> 0 AND NOT (receipt_id % 5 = 0 AND rank = 1) UNION ALL SELECT * FROM fin WHERE receipt_id % 7 = 0 AND NOT (receipt_id % 5 = 0 AND rank = 1))"""


def _receipts(spark, d):
    e = conversation_episodes(spark, d).withColumn("removed_at", F.when(F.col("seq") % 4 == 1, F.col("seq") + 3))
    words = F.sort_array(F.array_distinct(F.filter(terms_of(F.col("content")), lambda w: F.length(w) >= 3)))
    before = e.select("thread_id", (F.col("seq") + 1).alias("seq"), F.slice(words, 1, (1 + F.col("thread_id") % 2).cast("int")).alias("terms"))
    asked = e.where("role = 'assistant'").join(before, ["thread_id", "seq"])
    receipts = asked.select((F.col("thread_id") * 1000 + F.col("seq")).alias("receipt_id"), "thread_id", F.col("seq").alias("at_seq"), "terms")
    return stored(receipts, "receipts"), stored(replay.postings_at(e), "postings")


@query(f"""WITH {REPLAY_SQL}, c AS (SELECT coalesce(r.receipt_id, a.receipt_id) AS receipt_id, r.rank AS was, a.rank AS now FROM rec r FULL JOIN agn a ON a.receipt_id = r.receipt_id AND a.seq = r.seq),
g AS (SELECT receipt_id, count(was) AS pages, count(now) AS again, count(*) FILTER (now IS NULL) AS missing, count(*) FILTER (was IS NULL) AS extra, count(*) FILTER (was <> now) AS moved FROM c GROUP BY 1)
SELECT rc.receipt_id, thread_id, at_seq, coalesce(pages, 0) AS pages, coalesce(again, 0) AS again, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra, coalesce(moved, 0) AS moved, coalesce(missing + extra + moved, 0) = 0 AS same FROM rc LEFT JOIN g USING (receipt_id)""")
def receipts_replayed(spark, d):
    """Receipts of conversations, searched again at their snapshot; turns removed since don't change them, faults do."""
    receipts, postings = _receipts(spark, d)
    again = stored(replay.searched(receipts, postings, MOST), "again")
    # a writer that looked at the thread's end: what came later is in, what was removed since is out
    end = receipts.where("receipt_id % 7 = 0").withColumn("at_seq", F.lit((1 << 62)))
    recorded = again.where("receipt_id % 7 <> 0").union(replay.searched(end, postings, MOST)).where("not (receipt_id % 5 = 0 and rank = 1)")
    return replay.replayed(receipts, recorded, again)


@query(f"WITH RECURSIVE {COMMIT_SQL}, rc AS (SELECT t.event_id AS receipt_id, t.thread_id, t.seq AS at_seq, k.key FROM talk t JOIN (SELECT DISTINCT thread_id, key FROM fact) k USING (thread_id) WHERE t.role = 'assistant' AND t.event_id % 3 = 0), h AS (SELECT rc.*, f.value, f.valid_from, f.authority = 'user' AS u, row_number() OVER (PARTITION BY receipt_id, rc.key ORDER BY f.authority = 'user' DESC, f.valid_from DESC) AS r FROM rc JOIN fact f ON f.thread_id = rc.thread_id AND f.key = rc.key AND f.valid_from < at_seq AND (f.valid_to IS NULL OR f.valid_to >= at_seq)) SELECT receipt_id, thread_id, at_seq, key, value, valid_from, CASE WHEN u THEN 'SUPPORTED' ELSE 'PROPOSED' END AS phase FROM h WHERE r = 1")
def facts_at_receipts(spark, d):
    """What every third reply could know: the fact of each key of its thread as it stood then."""
    f = stored(talk_facts(spark, d), "facts")
    replies = talk_episodes(spark, d).where("role = 'assistant' and event_id % 3 = 0")
    asked = replies.join(f.select("thread_id", "key").distinct(), "thread_id").select(F.col("event_id").alias("receipt_id"), "thread_id", F.col("seq").alias("at_seq"), "key")
    return replay.facts_at(asked, f)
