"""Smaller queries: sessions and sliding windows over events, reference pages, name ranks, suffixes, validation, hashes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import approx_tokens
from ..operators import archive, budget
from ..sources.episodes import TALK_SQL, table, talk_episodes
from .capsules import LEDGER_SQL, talk_ledger
from .catalogue import POST_SQL
from .extraction import COMMIT_SQL, talk_facts
from .receipts import ALIGNED_SQL, _aligned
from .registry import QUERIES, query
from .retrieval import ASKED_SQL, QNAMES_SQL, QU_SQL, asked_names


@query("WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM g) SELECT user_id, min(ts) AS from_ts, max(ts) AS to_ts, count(*) AS events FROM s GROUP BY user_id, no")
def event_sessions(spark, d):
    """Sessions of a user: events less than six hours apart."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("from_ts"), F.max("ts").alias("to_ts"), F.count("*").alias("events"))
    return rows.select("user_id", "from_ts", "to_ts", "events")


@query("WITH h AS (SELECT event_type, unnest([0, 6, 12, 18]) AS back, date_trunc('hour', ts) - INTERVAL 1 HOUR * (hour(ts) % 6) AS slot FROM events) SELECT event_type, slot - INTERVAL 1 HOUR * back AS from_ts, count(*) AS events FROM h GROUP BY 1, 2")
def sliding_days(spark, d):
    """Events of each type in windows of a day that begin every six hours."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("event_type", F.window("ts", "24 hours", "6 hours").alias("w")).agg(F.count("*").alias("events")).select("event_type", F.col("w.start").alias("from_ts"), "events")


@query(f"WITH {ALIGNED_SQL}, r AS (SELECT doc_id, -1 AS ordinal, sha256(data) AS hash FROM obj UNION ALL SELECT doc_id, ordinal, hash FROM span) SELECT * FROM r WHERE doc_id > 20 OR (doc_id = 20 AND ordinal > 0) ORDER BY doc_id, ordinal LIMIT 101")
def blob_reference_page(spark, d):
    """References to whole objects and to their spans in one order: a page of a hundred behind (20, 0), and one row more."""
    whole = table(spark, d, "documents").where("text <> ''").select("doc_id", F.lit(-1).cast("long").alias("ordinal"), F.sha2("text", 256).alias("hash"))
    return archive.keyset_page(whole.unionByName(_aligned(spark, d).select("doc_id", "ordinal", "hash")), ["doc_id", "ordinal"], (20, 0), 100)


@query(f"WITH {TALK_SQL}, {QU_SQL}, {QNAMES_SQL}, {ASKED_SQL} SELECT question_id, name, kind, row_number() OVER (PARTITION BY question_id ORDER BY CASE kind WHEN 'quote' THEN 1 WHEN 'number' THEN 2 WHEN 'code' THEN 3 WHEN 'date' THEN 4 ELSE 5 END, length(name) DESC, name) AS rank FROM asked")
def question_name_ranks(spark, d):
    """The names of a question, most decisive kinds first, then the longest."""
    place = F.array_position(F.array(*[F.lit(k) for k in names.KINDS]), F.col("kind"))
    order = Window.partitionBy("question_id").orderBy(place, F.desc(F.length("name")), "name")
    return asked_names(spark, d).select("question_id", "name", "kind", F.row_number().over(order).cast("long").alias("rank"))


@query("SELECT doc_id, right(text, CAST(floor(40 * 3.6e0 / 1.1e0) AS INT)) AS suffix FROM documents WHERE text IS NOT NULL")
def bounded_suffixes(spark, d):
    """The longest end of each text that forty tokens hold, in closed form."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.expr("right(text, cast(floor(40 * 3.6D / 1.1D) as int))").alias("suffix"))


@query("SELECT DISTINCT n_chars AS budget, CASE WHEN n_chars < 256 THEN 'too small' WHEN n_chars > 20000 THEN 'too large' WHEN n_chars % 2 = 1 AND n_chars > 10000 THEN 'odd' ELSE 'fine' END AS state FROM documents")
def budget_validation(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select(n.alias("budget"), F.when(n < 256, "too small").when(n > 20000, "too large").when((n % 2 == 1) & (n > 10000), "odd").otherwise("fine").alias("state")).distinct()


@query(f"""WITH {TALK_SQL} SELECT thread_id, seq, sha256('{{' || concat_ws(',', CASE WHEN event_id % 2 = 0 THEN '"evidence":' || CAST(event_id AS VARCHAR) END, CASE WHEN event_id % 3 = 0 THEN '"packet":"' || role || '"' END, '"removed":' || CASE WHEN removed THEN 'true' ELSE 'false' END) || '}}') AS meta_hash FROM talk""")
def meta_hashes(spark, d):
    """A hash over those receipts that an episode has: absent keys aren't in it."""
    e = talk_episodes(spark, d)
    meta = F.struct(F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("evidence"), F.when(F.col("event_id") % 3 == 0, F.col("role")).alias("packet"), "removed")
    return e.select("thread_id", "seq", F.sha2(F.to_json(meta), 256).alias("meta_hash"))


@query("SELECT count(*) FILTER (doc_id IS NULL) AS vectors_without_text, count(*) FILTER (vec_id IS NULL) AS texts_without_vector, count(*) FILTER (doc_id = vec_id) AS both FROM documents FULL JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0) v ON v.vec_id = documents.doc_id")
def vector_orphans(spark, d):
    """Vectors without their text and texts without their vector (here: every seventh vector was lost)."""
    v = table(spark, d, "embeddings").where("vec_id % 7 <> 0").select("vec_id")
    rows = table(spark, d, "documents").select("doc_id").join(v, F.col("doc_id") == F.col("vec_id"), "full_outer")
    return rows.agg(F.count_if(F.col("doc_id").isNull()).alias("vectors_without_text"), F.count_if(F.col("vec_id").isNull()).alias("texts_without_vector"), F.count_if(F.col("doc_id") == F.col("vec_id")).alias("both"))


@query(f"WITH {TALK_SQL}, p AS (SELECT thread_id, seq, [seq - 1, seq - 2, seq - 5] AS pages FROM talk WHERE role = 'assistant'), u AS (SELECT thread_id, seq, unnest(pages) AS page FROM p) SELECT u.thread_id, u.seq, bool_or(t.seq IS NULL OR t.removed) AS unresolved FROM u LEFT JOIN talk t ON t.thread_id = u.thread_id AND t.seq = u.page GROUP BY 1, 2")
def unresolved_receipts(spark, d):
    """Receipts of turns any of whose pages is missing or removed."""
    e = talk_episodes(spark, d)
    pages = e.where("role = 'assistant'").select("thread_id", "seq", F.explode(F.array(F.col("seq") - 1, F.col("seq") - 2, F.col("seq") - 5)).alias("page"))
    there = e.select("thread_id", F.col("seq").alias("page"), "removed")
    return pages.join(there, ["thread_id", "page"], "left").groupBy("thread_id", "seq").agg(F.bool_or(F.coalesce("removed", F.lit(True))).alias("unresolved"))


@query(f"WITH {TALK_SQL}, r AS (SELECT *, seq - row_number() OVER (PARTITION BY thread_id ORDER BY seq) AS island FROM talk WHERE event_id % 13 <> 5) SELECT a.thread_id, a.seq, max(b.seq) AS near_seq FROM r a LEFT JOIN r b ON b.thread_id = a.thread_id AND b.island = a.island AND b.role = 'user' AND NOT b.removed AND b.seq < a.seq AND b.seq >= a.seq - 12 GROUP BY 1, 2")
def nearest_in_direction(spark, d):
    """The nearest turn of the user before each episode: removed ones are stepped over, a missing number ends the walk
    (here: every thirteenth event is missing)."""
    return archive.nearest_in_direction(talk_episodes(spark, d).where("event_id % 13 <> 5"), "user", 12, False)


# ---- packets -------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {LEDGER_SQL}, e AS (SELECT p.thread_id, p.name, p.kind, p.seq, min(p.start) AS start FROM place p GROUP BY 1, 2, 3, 4), d AS (SELECT e.*, lag(seq) OVER (PARTITION BY e.thread_id, e.name ORDER BY seq, e.kind) AS before FROM e), q AS (SELECT d.* FROM d JOIN talk t USING (thread_id, seq) WHERE t.role = 'assistant' AND (before IS NULL OR d.seq - before > 10) AND EXISTS (SELECT 1 FROM loss l WHERE l.thread_id = d.thread_id AND l.name = d.name AND l.seq < d.seq)), r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, seq ORDER BY CASE kind WHEN 'quote' THEN 1 WHEN 'number' THEN 2 WHEN 'code' THEN 3 WHEN 'date' THEN 4 ELSE 5 END, start) AS rank FROM q) SELECT thread_id, seq, rank, name FROM r WHERE rank <= 3")
def unsupported_names(spark, d):
    """Names in a draft (here: each turn of the assistant) that the ten episodes before don't show though the ledger knows
    them: up to three, to be looked up before the draft is released."""
    e = talk_episodes(spark, d)
    every = names.name_places(e, ["thread_id", "seq"]).groupBy("thread_id", "name", "kind", "seq").agg(F.min("start").alias("start"))
    before = F.lag("seq").over(Window.partitionBy("thread_id", "name").orderBy("seq", "kind"))
    drafts = every.withColumn("before", before).join(e.where("role = 'assistant'").select("thread_id", "seq"), ["thread_id", "seq"]).where("before is null or seq - before > 10")
    lost = talk_ledger(spark, d).groupBy("thread_id", "name").agg(F.min("seq").alias("lost_seq"))
    place = F.array_position(F.array(*[F.lit(k) for k in names.KINDS]), F.col("kind"))
    order = Window.partitionBy("thread_id", "seq").orderBy(place, "start")
    rows = drafts.join(lost, ["thread_id", "name"]).where("lost_seq < seq").withColumn("rank", F.row_number().over(order).cast("long"))
    return rows.where("rank <= 3").select("thread_id", "seq", "rank", "name")


@query(f"""WITH RECURSIVE {COMMIT_SQL}, c AS (SELECT thread_id, key, valid_from, CAST(ceil(length(key || ': ' || value || ' ⟨#' || CAST(valid_from AS VARCHAR) || '⟩') / 3.6e0 * 1.1e0) AS BIGINT) + 1 AS cost FROM fact WHERE phase = 'SUPPORTED'),
w AS (SELECT thread_id, list(struct_pack(used := cost, n := CAST(1 AS BIGINT), omitted := CAST(0 AS BIGINT)) ORDER BY valid_from DESC, key) AS rows FROM c GROUP BY 1),
t AS (SELECT thread_id, list_reduce(rows, lambda a, x: CASE WHEN a.used + x.used <= 60 THEN struct_pack(used := a.used + x.used, n := a.n + 1, omitted := a.omitted) ELSE struct_pack(used := a.used, n := a.n, omitted := a.omitted + 1) END, struct_pack(used := CAST(0 AS BIGINT), n := CAST(0 AS BIGINT), omitted := CAST(0 AS BIGINT))) AS f FROM w) SELECT thread_id, f.used AS used, f.n AS shown, f.omitted AS omitted FROM t""")
def certificate_fill(spark, d):
    """Certificates of supported facts, newest first, taken while they fit into sixty tokens, and how many were left out."""
    line = F.concat("key", F.lit(": "), "value", F.lit(" ⟨#"), F.col("valid_from").cast("string"), F.lit("⟩"))
    rows = talk_facts(spark, d).where("phase = 'SUPPORTED'").select("thread_id", (-F.col("valid_from")).alias("o"), "key", (approx_tokens(line) + 1).alias("cost"))
    return budget.fill_with_omitted(rows, 60)


@query(f"""WITH {POST_SQL}, size AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT doc_id, dl FROM post)), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))), 6) AS score FROM terms JOIN post USING (term) JOIN df USING (term), size GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s), c AS (SELECT k.query_id, k.doc_id, rank, CAST(sum(ceil(length(text) / 3.6e0 * 1.1e0)) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM k JOIN documents USING (doc_id) WHERE rank <= 10) SELECT query_id, rank, doc_id, used FROM c WHERE used <= 2000""")
def bm25_packets(spark, d):
    """The baseline of plain search: the best texts of each query that two thousand tokens hold, up to the first that doesn't
    fit."""
    best = QUERIES["bm25_topk"](spark, d)
    cost = table(spark, d, "documents").select("doc_id", approx_tokens(F.col("text")).alias("tokens"))
    used = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return best.join(cost, "doc_id").withColumn("used", used).where("used <= 2000").select("query_id", "rank", "doc_id", "used")


@query(f"WITH RECURSIVE {LEDGER_SQL}, n AS (SELECT thread_id, name, max(seq) AS seq FROM loss GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC, name) AS r, count(*) OVER (PARTITION BY thread_id) AS total FROM n) SELECT thread_id, '⟨lost: ' || string_agg(name || ' #' || CAST(seq AS VARCHAR), ', ' ORDER BY r) || CASE WHEN max(total) > 6 THEN ', +' || CAST(max(total) - 6 AS VARCHAR) ELSE '' END || '⟩' AS line FROM r WHERE r <= 6 GROUP BY 1")
def ledger_lines(spark, d):
    """What a packet says of its thread's losses: the six newest names with their places, and how many more there are."""
    newest = talk_ledger(spark, d).groupBy("thread_id", "name").agg(F.max("seq").alias("seq"))
    order = Window.partitionBy("thread_id").orderBy(F.desc("seq"), "name")
    ranked = newest.withColumn("r", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy("thread_id"))).where("r <= 6")
    words = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("name", F.lit(" #"), F.col("seq").cast("string")).alias("w")))), lambda x: x["w"])
    rows = ranked.groupBy("thread_id").agg(F.array_join(words, ", ").alias("w"), F.max("total").alias("total"))
    more = F.when(F.col("total") > 6, F.concat(F.lit(", +"), (F.col("total") - 6).cast("string"))).otherwise("")
    return rows.select("thread_id", F.concat(F.lit("⟨lost: "), "w", more, F.lit("⟩")).alias("line"))
