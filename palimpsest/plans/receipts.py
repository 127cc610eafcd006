"""Queries over receipts: collections, claims, reachability, removal, attachments, packets and small measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import approx_tokens, coverage_status, sentences, sentences_sql
from ..operators import archive, evidence, receipts
from ..sources.episodes import TALK_SQL, table, talk_episodes
from ..sources.tables import stored
from .capsules import LINES_SQL, SPAN, talk_lines
from .extraction import COMMIT_SQL, talk_facts
from .registry import TOKENS, query
from .retrieval import QU_SQL, talk_questions

# ---- collections --------------------------------------------------------------------------------------------

_BOTH = "(SELECT question_id, text FROM qu UNION ALL SELECT question_id + 1000000, 'List every one of the three ' || text || ' of the archive, all 12 notes' FROM qu)"


def _collections(spark, d):
    q = talk_questions(spark, d).select("question_id", "text")
    more = q.select((F.col("question_id") + 1000000).alias("question_id"), F.concat(F.lit("List every one of the three "), "text", F.lit(" of the archive, all 12 notes")).alias("text"))
    return q.union(more)


@query(f"WITH {TALK_SQL}, {QU_SQL} SELECT question_id, {receipts.collection_sql('text')} FROM {_BOTH}")
def collection_questions(spark, d):
    return _collections(spark, d).select("question_id", *receipts.collection(F.col("text")))


_WORDS = "list_distinct(list_transform(regexp_extract_all(lower({}), '([\\p{{L}}\\p{{N}}]+)', 1), lambda x: regexp_replace(x, 's$', '')))"


@query(f"WITH RECURSIVE {COMMIT_SQL}, {QU_SQL}, c AS (SELECT question_id, thread_id, query_seq, {receipts.collection_sql('text')} FROM qu), w AS (SELECT *, {_WORDS.format('subject')} AS words FROM c WHERE cue IS NOT NULL), fw AS (SELECT *, {_WORDS.format('key')} AS there FROM fact), tw AS (SELECT *, {_WORDS.format('content')} AS there FROM talk),"
    """ loc AS (SELECT w.question_id, f.valid_from AS source_seq, CASE WHEN phase = 'HISTORICAL' AND authority = 'user' THEN 2 WHEN phase = 'SUPPORTED' AND authority = 'user' THEN 3 ELSE 1 END AS r FROM w JOIN fw f USING (thread_id) WHERE len(words) > 0 AND list_has_all(there, words) AND f.valid_from < query_seq
  UNION ALL SELECT w.question_id, t.seq, 0 FROM w JOIN tw t USING (thread_id) WHERE len(words) > 0 AND list_has_all(there, words) AND t.event_id % 3 = 0 AND NOT t.removed AND t.seq < query_seq AND t.role NOT IN ('system', 'handoff')),
pl AS (SELECT question_id, source_seq, max(r) AS r FROM loc GROUP BY 1, 2), n AS (SELECT question_id, count(*) FILTER (r = 3) AS s, count(*) FILTER (r = 2) AS h, count(*) FILTER (r = 1) AS p, count(*) FILTER (r = 0) AS u FROM pl GROUP BY 1),
z AS (SELECT w.question_id, required, coalesce(s, 0) AS supported, coalesce(h, 0) AS historical, coalesce(s, 0) + coalesce(h, 0) + coalesce(p, 0) AS located, greatest(coalesce(u, 0), coalesce(required, 0) - coalesce(s, 0)) AS unresolved FROM w LEFT JOIN n USING (question_id))
SELECT *, coalesce(located = required AND supported = required AND historical = 0 AND unresolved = 0, false) AS complete, concat_ws(',', CASE WHEN required IS NULL THEN 'unknown-cardinality' END, CASE WHEN unresolved > 0 THEN 'unresolved' END, CASE WHEN historical > 0 THEN 'historical' END, CASE WHEN required IS NOT NULL AND located > required THEN 'surplus' END) AS issues FROM z""")
def collection_receipts(spark, d):
    """Coverage of each collection question, from the facts and the episodes before it that have all words of its subject."""
    q = stored(talk_questions(spark, d).select("question_id", "thread_id", "query_seq", *receipts.collection(F.col("text"))).where("cue is not null"), "questions")
    known = talk_facts(spark, d).select("thread_id", F.col("valid_from").alias("source_seq"), F.col("key").alias("text"), coverage_status(F.col("phase"), F.col("authority")).alias("status"))
    found = talk_episodes(spark, d).where("event_id % 3 = 0 and not removed and role not in ('system', 'handoff')").select("thread_id", F.col("seq").alias("source_seq"), F.col("content").alias("text"))
    one = receipts.covering(q, known).select("question_id", "source_seq", "status")
    two = receipts.covering(q, found).select("question_id", "source_seq", F.lit("unresolved").alias("status"))
    return receipts.collection_receipt(q, one.union(two))


@query(f"WITH {TALK_SQL}, w AS (SELECT thread_id, seq, CASE event_id % 4 WHEN 0 THEN 'There are ' WHEN 1 THEN 'Exactly ' WHEN 2 THEN 'All ' ELSE 'Some ' END || CAST(event_id % 50 AS VARCHAR) || ' notes were found. ' || content AS text FROM talk) SELECT thread_id, seq, {receipts.safe_wording_sql('text')} AS text FROM w")
def safe_wordings(spark, d):
    lead = F.when(F.col("event_id") % 4 == 0, "There are ").when(F.col("event_id") % 4 == 1, "Exactly ").when(F.col("event_id") % 4 == 2, "All ").otherwise("Some ")
    text = F.concat(lead, (F.col("event_id") % 50).cast("string"), F.lit(" notes were found. "), "content")
    return talk_episodes(spark, d).select("thread_id", "seq", receipts.safe_wording(text).alias("text"))


# ---- claims -------------------------------------------------------------------------------------------------

TP = names.places_sql("talk", "thread_id, seq", "content")
CLAIM_SQL = f"""{TALK_SQL}, {TP}, said AS (SELECT p.*, t.role, t.removed FROM place p JOIN talk t USING (thread_id, seq)),
cl AS (SELECT thread_id, seq, name, start, CASE WHEN EXISTS (SELECT 1 FROM said s WHERE s.thread_id = c.thread_id AND s.name = c.name AND s.seq < c.seq AND NOT s.removed AND s.role <> 'assistant') THEN 'SUPPORTED'
  WHEN EXISTS (SELECT 1 FROM said s WHERE s.thread_id = c.thread_id AND s.name = c.name AND s.seq < c.seq AND s.removed) THEN 'HISTORICAL'
  WHEN EXISTS (SELECT 1 FROM said s WHERE s.thread_id = c.thread_id AND s.name = c.name AND s.seq < c.seq) THEN 'PROPOSED' ELSE 'UNKNOWN' END AS class FROM said c WHERE role = 'assistant' AND kind <> 'entity')"""


def _claims(spark, d):
    said = names.name_places(talk_episodes(spark, d), ["thread_id", "seq"]).join(talk_episodes(spark, d).select("thread_id", "seq", "role", "removed"), ["thread_id", "seq"])
    return receipts.claim_classes(said.where("role = 'assistant' and kind <> 'entity'").select("thread_id", "seq", "name", "start"), said)


@query(f"WITH {CLAIM_SQL} SELECT * FROM cl")
def claim_classes(spark, d):
    """Numbers, quotes, dates and codes in the assistant's turns with the best evidence before them."""
    return _claims(spark, d)


@query(f"WITH {CLAIM_SQL}, f AS (SELECT thread_id, seq, class, min(start) AS start, count(*) AS n FROM cl GROUP BY 1, 2, 3) SELECT thread_id, seq, CAST(sum(n) AS BIGINT) AS claims, string_agg(class, ',' ORDER BY start, class) AS classes, bool_and(class = 'SUPPORTED') AS released FROM f GROUP BY 1, 2")
def claim_gate(spark, d):
    return receipts.gate(_claims(spark, d))


@query(f"WITH {TALK_SQL}, s AS (SELECT thread_id, seq, unnest({sentences_sql('content')}) AS s FROM (SELECT thread_id, seq, CASE event_id % 3 WHEN 0 THEN replace(content, ' moved to ', ' does not live in ') WHEN 1 THEN replace(content, ' works at ', ' is never the owner of the ') ELSE replace(content, ' was born in ', ' owns ') END AS content FROM talk)), r AS (SELECT thread_id, seq, {receipts.relation_sql('s')} AS r FROM s) SELECT thread_id, seq, r.relation AS relation, r.subject AS subject, r.object AS object, r.negated AS negated FROM r WHERE r IS NOT NULL")
def relation_signatures(spark, d):
    """Who owns what and who lives where, and whether it is denied."""
    text = F.when(F.col("event_id") % 3 == 0, F.replace("content", F.lit(" moved to "), F.lit(" does not live in "))).when(F.col("event_id") % 3 == 1, F.replace("content", F.lit(" works at "), F.lit(" is never the owner of the "))).otherwise(F.replace("content", F.lit(" was born in "), F.lit(" owns ")))
    said = talk_episodes(spark, d).select("thread_id", "seq", F.explode(sentences(text)).alias("s")).select("thread_id", "seq", receipts.relation(F.col("s")).alias("r")).where("r is not null")
    return said.select("thread_id", "seq", "r.*")


_NEAR = "(abs(a.v - b.v) < 1e-9 OR abs(floor(a.v + 0.5e0) - b.v) < 1e-9 OR abs(a.v - floor(b.v + 0.5e0)) < 1e-9 OR abs(floor(a.v * 10e0 + 0.5e0) / 10e0 - b.v) < 1e-9 OR abs(a.v - floor(b.v * 10e0 + 0.5e0) / 10e0) < 1e-9)"


@query(f"WITH {TALK_SQL}, {TP}, n AS (SELECT DISTINCT thread_id, seq, CAST(regexp_extract(name, '^(-?[0-9.]+)', 1) AS DOUBLE) + CASE WHEN seq % 3 = 0 THEN 0.04e0 ELSE 0e0 END AS v, regexp_extract(name, ' ([a-z%]+)$', 1) AS unit FROM place WHERE kind = 'number') SELECT a.thread_id, a.seq, a.v, a.unit, count(*) FILTER (b.seq < a.seq AND (a.unit = '' OR a.unit = b.unit) AND {_NEAR}) > 0 AS retained FROM n a JOIN n b USING (thread_id) GROUP BY 1, 2, 3, 4")
def numbers_retained(spark, d):
    """Numbers with their units, and whether an earlier one of the thread is the same after rounding; a number with a unit
    needs the same unit. Witnesses meet by thread and whole part, not by all pairs."""
    raw = names.name_places(talk_episodes(spark, d), ["thread_id", "seq"]).where("kind = 'number'")
    n = raw.select("thread_id", "seq", (F.regexp_extract("name", "^(-?[0-9.]+)", 1).try_cast("double") + F.when(F.col("seq") % 3 == 0, 0.04).otherwise(0.0)).alias("v"), F.regexp_extract("name", " ([a-z%]+)$", 1).alias("unit")).distinct()
    whole = F.floor("v").cast("long")
    there = n.select("thread_id", F.explode(F.array(whole - 1, whole, whole + 1)).alias("cell"), F.col("v").alias("seen"), F.col("unit").alias("seen_unit"), F.col("seq").alias("seen_seq"))
    first = there.groupBy("thread_id", "cell", "seen", "seen_unit").agg(F.min("seen_seq").alias("seen_seq"))
    hit = n.withColumn("cell", whole).join(first, ["thread_id", "cell"]).where((F.col("seen_seq") < F.col("seq")) & ((F.col("unit") == "") | (F.col("unit") == F.col("seen_unit"))) & evidence.retained(F.col("v"), F.col("seen")))
    return n.join(hit.select("thread_id", "seq", "v", "unit").distinct().withColumn("_h", F.lit(True)), ["thread_id", "seq", "v", "unit"], "left").select("thread_id", "seq", "v", "unit", F.coalesce("_h", F.lit(False)).alias("retained"))


@query(f"WITH {TALK_SQL}, issued AS (SELECT thread_id, seq, sha256(CAST(thread_id AS VARCHAR) || '|' || CAST(seq AS VARCHAR) || '|' || sha256(content)) AS digest FROM talk WHERE event_id % 2 = 0), now AS (SELECT thread_id, seq, removed, sha256(CAST(thread_id AS VARCHAR) || '|' || CAST(seq AS VARCHAR) || '|' || sha256(CASE WHEN event_id % 8 = 0 THEN content || '.' ELSE content END)) AS digest FROM talk) SELECT i.thread_id, i.seq, CASE WHEN n.removed THEN 'removed' WHEN n.digest <> i.digest THEN 'changed' ELSE 'valid' END AS state FROM issued i JOIN now n USING (thread_id, seq)")
def evidence_capabilities(spark, d):
    """Digests issued for evidence against the archive as it is now (here: every eighth episode was changed since)."""
    e = talk_episodes(spark, d)
    digest = lambda c: F.sha2(F.concat_ws("|", F.col("thread_id").cast("string"), F.col("seq").cast("string"), F.sha2(c, 256)), 256)
    issued = e.where("event_id % 2 = 0").select("thread_id", "seq", digest(F.col("content")).alias("digest"))
    now = e.select("thread_id", "seq", "removed", digest(F.when(F.col("event_id") % 8 == 0, F.concat("content", F.lit("."))).otherwise(F.col("content"))).alias("now"))
    return issued.join(now, ["thread_id", "seq"]).select("thread_id", "seq", F.when(F.col("removed"), "removed").when(F.col("now") != F.col("digest"), "changed").otherwise("valid").alias("state"))


# ---- reachability -------------------------------------------------------------------------------------------

REACH_SQL = f"""{TALK_SQL}, head AS (SELECT thread_id, max(seq) AS head_seq FROM talk GROUP BY 1), seal AS (SELECT thread_id, (seq - 1) // {SPAN} AS no FROM talk GROUP BY 1, 2 HAVING count(*) = {SPAN}),
each AS (SELECT t.thread_id, t.seq, CASE WHEN (t.seq > head_seq - 5 OR t.event_id % 12 = 0) AND NOT t.removed THEN 'resident' WHEN s.no IS NOT NULL THEN 'capsule ' || CAST(s.no AS VARCHAR) ELSE 'pageable' END AS state FROM talk t JOIN head USING (thread_id) LEFT JOIN seal s ON s.thread_id = t.thread_id AND s.no = (t.seq - 1) // {SPAN}),
grp AS (SELECT *, seq - row_number() OVER (PARTITION BY thread_id, state ORDER BY seq) AS g FROM each), runs AS (SELECT thread_id, state, min(seq) AS from_seq, max(seq) AS to_seq FROM grp GROUP BY thread_id, state, g)"""


def _runs(spark, d):
    e = talk_episodes(spark, d)
    heads = e.groupBy("thread_id").agg(F.max("seq").alias("head_seq"))
    residents = e.join(heads, "thread_id").where("(seq > head_seq - 5 or event_id % 12 = 0) and not removed").select("thread_id", "seq")
    return receipts.reachability(heads, residents, archive.windows(e, SPAN), SPAN), heads


@query(f"WITH {REACH_SQL} SELECT thread_id, state, from_seq, to_seq FROM runs")
def reachability_partition(spark, d):
    return _runs(spark, d)[0]


@query(f"WITH {REACH_SQL}, bad AS (SELECT thread_id, state, CASE WHEN from_seq % 7 = 3 THEN from_seq - 1 ELSE from_seq END AS from_seq, CASE WHEN to_seq % 5 = 0 THEN to_seq - 1 ELSE to_seq END AS to_seq FROM runs), z AS (SELECT b.*, head_seq, coalesce(lag(to_seq) OVER w, 0) AS bef, lead(from_seq) OVER w AS nxt FROM bad b JOIN head USING (thread_id) WINDOW w AS (PARTITION BY thread_id ORDER BY from_seq, to_seq)), f AS (SELECT thread_id, from_seq, CASE WHEN from_seq > bef + 1 THEN 'gap' WHEN from_seq <= bef THEN 'overlap' WHEN nxt IS NULL AND to_seq <> head_seq THEN 'end' END AS fault FROM z) SELECT * FROM f WHERE fault IS NOT NULL")
def reachability_faults(spark, d):
    """Faults of a partition (here: one that was tampered with at some of its borders)."""
    runs, heads = _runs(spark, d)
    bad = runs.withColumn("from_seq", F.when(F.col("from_seq") % 7 == 3, F.col("from_seq") - 1).otherwise(F.col("from_seq"))).withColumn("to_seq", F.when(F.col("to_seq") % 5 == 0, F.col("to_seq") - 1).otherwise(F.col("to_seq")))
    return receipts.partition_faults(bad, heads)


# ---- removal ------------------------------------------------------------------------------------------------


@query(f"WITH {TALK_SQL}, stone AS (SELECT thread_id, seq AS target, seq + 1 + event_id % 3 AS removal_seq FROM talk WHERE removed) SELECT s.thread_id, s.target, s.removal_seq, t.seq IS NOT NULL AND t.role <> 'assistant' AS recorded FROM stone s LEFT JOIN talk t ON t.thread_id = s.thread_id AND t.seq = s.removal_seq")
def removal_tombstones(spark, d):
    """Tombstones and whether the archive holds the episode that records the removal, not said by the assistant."""
    e = talk_episodes(spark, d)
    stones = e.where("removed").select("thread_id", F.col("seq").alias("target"), (F.col("seq") + 1 + F.col("event_id") % 3).alias("removal_seq"))
    there = e.select("thread_id", F.col("seq").alias("removal_seq"), "role")
    return stones.join(there, ["thread_id", "removal_seq"], "left").select("thread_id", "target", "removal_seq", F.coalesce(F.col("role") != "assistant", F.lit(False)).alias("recorded"))


@query(f"WITH {TALK_SQL}, leaf AS (SELECT thread_id, (seq - 1) // {SPAN} AS no, min(seq) AS a, max(seq) AS b FROM talk GROUP BY 1, 2 HAVING count(*) = {SPAN}) SELECT t.thread_id, t.seq, l.no, l.a AS from_seq, l.b AS to_seq FROM talk t JOIN leaf l ON l.thread_id = t.thread_id AND t.seq BETWEEN l.a AND l.b WHERE t.removed")
def removal_covering_capsules(spark, d):
    """The sealed window over each removed episode: the point-in-interval join on equal window numbers."""
    gone = talk_episodes(spark, d).where("removed").select("thread_id", "seq", F.floor((F.col("seq") - 1) / SPAN).cast("long").alias("no"))
    return gone.join(archive.windows(talk_episodes(spark, d), SPAN).select("thread_id", "no", "from_seq", "to_seq"), ["thread_id", "no"]).select("thread_id", "seq", "no", "from_seq", "to_seq")


@query(f"WITH RECURSIVE {LINES_SQL}, gone AS (SELECT l.*, EXISTS (SELECT 1 FROM talk t WHERE t.thread_id = l.thread_id AND t.removed AND instr(l.line, '⟨#' || CAST(t.seq AS VARCHAR) || '⟩') > 0) AS gone FROM lines l) SELECT thread_id, no, count(*) FILTER (gone) AS dropped, sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY ordinal), '')) AS hash FROM gone GROUP BY 1, 2 HAVING count(*) FILTER (gone) > 0")
def removal_rewritten_capsules(spark, d):
    """Capsules that lose the lines marked with removed episodes, and the digest of what is left."""
    gone = talk_episodes(spark, d).where("removed").select("thread_id", F.col("seq").cast("string").alias("mark"), F.lit(True).alias("gone"))
    lines = talk_lines(spark, d).withColumn("mark", F.regexp_extract("line", "⟨#([0-9]+)⟩$", 1)).join(gone, ["thread_id", "mark"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    rest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("ordinal", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy("thread_id", "no").agg(F.count_if("gone").alias("dropped"), F.sha2(rest, 256).alias("hash")).where("dropped > 0")


@query(f"WITH RECURSIVE {COMMIT_SQL} SELECT f.thread_id, f.key, f.valid_from, CASE WHEN t.removed THEN 'REVOKED' ELSE f.phase END AS phase FROM fact f JOIN talk t ON t.thread_id = f.thread_id AND t.seq = f.valid_from")
def removal_revokes_facts(spark, d):
    source = talk_episodes(spark, d).select("thread_id", F.col("seq").alias("valid_from"), "removed")
    return talk_facts(spark, d).join(source, ["thread_id", "valid_from"]).select("thread_id", "key", "valid_from", F.when(F.col("removed"), "REVOKED").otherwise(F.col("phase")).alias("phase"))


@query(f"WITH {TALK_SQL}, n AS (SELECT thread_id, 'Removed ' || string_agg('#' || CAST(seq AS VARCHAR), ', ' ORDER BY seq) || '.' AS note FROM talk WHERE removed GROUP BY 1) SELECT thread_id, note, CAST(unnest(regexp_extract_all(note, '#([0-9]+)', 1)) AS BIGINT) AS seq FROM n")
def removal_notes(spark, d):
    """The record of what was removed from a thread, and the numbers read back from it."""
    seqs = F.transform(F.array_sort(F.collect_list("seq")), lambda s: F.concat(F.lit("#"), s.cast("string")))
    notes = talk_episodes(spark, d).where("removed").groupBy("thread_id").agg(F.concat(F.lit("Removed "), F.array_join(seqs, ", "), F.lit(".")).alias("note"))
    return notes.select("thread_id", "note", F.explode(F.regexp_extract_all("note", F.lit("#([0-9]+)"), F.lit(1))).alias("s")).select("thread_id", "note", F.col("s").cast("long").alias("seq"))


# ---- attachments --------------------------------------------------------------------------------------------

_STEP = 1021
_at = lambda p: f"hex(array_slice(data, {p} + 1, {p} + 1)) BETWEEN '80' AND 'BF'"
_al = lambda p: f"CASE WHEN {_at(p)} THEN CASE WHEN {_at(p + ' - 1')} THEN CASE WHEN {_at(p + ' - 2')} THEN {p} - 3 ELSE {p} - 2 END ELSE {p} - 1 END ELSE {p} END"
ALIGNED_SQL = f"""obj AS (SELECT doc_id, encode(text) AS data, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL AND text <> ''), ord AS (SELECT *, unnest(generate_series(0, (size - 1) // {_STEP})) AS ordinal FROM obj),
cut AS (SELECT *, {_al(f'(ordinal * {_STEP})')} AS from_byte, CASE WHEN (ordinal + 1) * {_STEP} >= size THEN size ELSE {_al(f'((ordinal + 1) * {_STEP})')} END AS to_byte FROM ord),
span AS (SELECT doc_id, ordinal, from_byte, to_byte, sha256(array_slice(data, from_byte + 1, to_byte)) AS hash FROM cut WHERE to_byte > from_byte)"""


def _aligned(spark, d):
    return receipts.aligned_spans(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id", 1024)


@query(f"WITH {ALIGNED_SQL} SELECT doc_id, ordinal, from_byte, to_byte, hash FROM span")
def aligned_attachment_spans(spark, d):
    """Spans of at most 1,024 bytes that cut no character."""
    return _aligned(spark, d)


@query(f"WITH {ALIGNED_SQL} SELECT doc_id, max(to_byte) AS size, count(*) AS spans, sha256(string_agg(CAST(from_byte AS VARCHAR) || ':' || CAST(to_byte AS VARCHAR) || ':' || hash, '|' ORDER BY ordinal)) AS digest FROM span GROUP BY 1")
def attachment_manifests(spark, d):
    return receipts.manifests(_aligned(spark, d), "doc_id")


@query(f"WITH {ALIGNED_SQL}, bad AS (SELECT doc_id, ordinal, from_byte + CASE WHEN (doc_id + ordinal) % 9 = 4 THEN 1 ELSE 0 END AS from_byte, to_byte FROM span), p AS (SELECT *, coalesce(lag(to_byte) OVER (PARTITION BY doc_id ORDER BY ordinal), 0) AS expected FROM bad) SELECT doc_id, ordinal, from_byte, expected FROM p WHERE from_byte <> expected")
def attachment_partition_check(spark, d):
    """Spans that don't begin where the one before ended (here: every ninth was moved by a byte)."""
    moved = _aligned(spark, d).withColumn("from_byte", F.col("from_byte") + F.when((F.col("doc_id") + F.col("ordinal")) % 9 == 4, 1).otherwise(0))
    return evidence.partition_gaps(moved, "doc_id")


@query(f"WITH {ALIGNED_SQL} SELECT s.doc_id, s.from_byte, s.to_byte + s.doc_id % 2 * (s.ordinal % 3) AS to_byte, sha256(data) = sha256(CASE WHEN s.doc_id % 5 = 0 THEN encode('x') ELSE data END) AND s.to_byte + s.doc_id % 2 * (s.ordinal % 3) <= size AS verified, CASE WHEN sha256(data) = sha256(CASE WHEN s.doc_id % 5 = 0 THEN encode('x') ELSE data END) AND s.to_byte + s.doc_id % 2 * (s.ordinal % 3) <= size THEN sha256(array_slice(data, s.from_byte + 1, s.to_byte + s.doc_id % 2 * (s.ordinal % 3))) END AS hash FROM span s JOIN obj USING (doc_id)")
def attachment_verified_reads(spark, d):
    """Ranges read from objects (here: some recorded with another hash, some ending behind the object)."""
    objects = table(spark, d, "documents").select("doc_id", F.col("text").alias("content")).where("content <> ''")
    whole = objects.select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("content", 256)).alias("whole_hash"))
    asked = _aligned(spark, d).join(whole, "doc_id").select("doc_id", "from_byte", (F.col("to_byte") + F.col("doc_id") % 2 * (F.col("ordinal") % 3)).alias("to_byte"), "whole_hash")
    return receipts.verified_ranges(asked, objects, "doc_id")


_MIMES = ("text/plain; charset=utf-8", "application/json", "image/png", "Application/XHTML+XML", "application/pdf", "text/html", "application/x-ndjson", "video/mp4")


@query(f"WITH m AS (SELECT page_id, [{', '.join(repr(m) for m in _MIMES)}][CAST(page_id % {len(_MIMES)} AS INT) + 1] AS mime FROM pages), b AS (SELECT *, lower(trim(split_part(mime, ';', 1))) AS base FROM m) SELECT page_id, mime, base LIKE 'text/%' OR base IN ('application/json', 'application/ld+json', 'application/xml', 'application/xhtml+xml', 'application/javascript', 'application/typescript', 'application/x-ndjson') AS indexable FROM b")
def attachment_mime(spark, d):
    mime = F.element_at(F.array(*[F.lit(m) for m in _MIMES]), (F.col("page_id") % len(_MIMES) + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", mime.alias("mime"), receipts.indexable(mime).alias("indexable"))


@query(f"WITH {TALK_SQL}, {QU_SQL}, w AS (SELECT question_id, regexp_extract_all(text, '[\"''`]([^\"''`\\n]{{1,400}})[\"''`]', 1) AS q, regexp_extract_all(text, '([\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}._/-]{{0,255}})', 1) AS w FROM qu), a AS (SELECT question_id, list_concat(q, w, flatten(list_transform(generate_series(1, len(w)), lambda i: list_transform(list_filter(generate_series(2, 8), lambda k: i + k - 1 <= len(w)), lambda k: array_to_string(list_slice(w, i, i + k - 1), ' '))))) AS l FROM w), c AS (SELECT question_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM a), u AS (SELECT question_id, regexp_replace(lower(trim(p)), '[.,;:!?]+$', '') AS probe, min(i) AS i FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY i) AS r FROM u) SELECT question_id, probe FROM r WHERE r <= 64")
def attachment_name_probes(spark, d):
    return receipts.name_probes(talk_questions(spark, d))


@query(f"WITH {ALIGNED_SQL}, live AS (SELECT doc_id, hash FROM span WHERE doc_id % 3 <> 0) SELECT hash, count(*) AS refs, count(DISTINCT doc_id) AS objects FROM live WHERE hash IN (SELECT hash FROM span WHERE doc_id % 3 = 0) GROUP BY 1")
def live_blob_references(spark, d):
    """Chunks of removed objects (every third) that others still hold and that must stay: unnested references, semi-joined."""
    spans = _aligned(spark, d)
    return spans.where("doc_id % 3 <> 0").join(spans.where("doc_id % 3 = 0").select("hash").distinct(), "hash", "left_semi").groupBy("hash").agg(F.count("*").alias("refs"), F.countDistinct("doc_id").alias("objects"))


@query(f"WITH {ALIGNED_SQL} SELECT doc_id, ordinal, from_byte, to_byte, ordinal = 15 AND to_byte < size AS truncated FROM cut WHERE ordinal < 16 AND to_byte > from_byte")
def index_plan(spark, d):
    """At most sixteen spans of each text go to a vector index; whether more was left."""
    sizes = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("size"))
    return _aligned(spark, d).where("ordinal < 16").join(sizes, "doc_id").select("doc_id", "ordinal", "from_byte", "to_byte", ((F.col("ordinal") == 15) & (F.col("to_byte") < F.col("size"))).alias("truncated"))


# ---- packets and measures -----------------------------------------------------------------------------------


@query(f"WITH {TALK_SQL}, p AS (SELECT thread_id, seq AS turn_seq, event_id, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS age FROM talk WHERE role = 'assistant'), t AS (SELECT thread_id, min(turn_seq) AS threshold FROM p WHERE age <= 5 GROUP BY 1) SELECT p.thread_id, turn_seq, turn_seq >= threshold AS has_body FROM p JOIN t USING (thread_id)")
def packet_retention(spark, d):
    """The five newest packets of a thread keep their bodies, older ones only their receipts."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("seq"))
    return talk_episodes(spark, d).where("role = 'assistant'").select("thread_id", F.col("seq").alias("turn_seq"), (F.row_number().over(order) <= 5).alias("has_body"))


@query("SELECT event_id, CASE WHEN octet_length(encode(props)) > 9 THEN 'large' WHEN NOT json_valid(props) THEN 'invalid' WHEN json_extract(props, '$.k') IS NULL THEN 'empty' ELSE 'fine' END AS state, CASE WHEN octet_length(encode(props)) <= 9 AND json_valid(props) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM (SELECT event_id, CASE event_id % 7 WHEN 1 THEN left(props, length(props) - 1) WHEN 2 THEN '{}' ELSE props END AS props FROM events)")
def packet_preflight(spark, d):
    """Bounded JSON, checked before it is read: too large, no JSON, without the field, fine."""
    e = table(spark, d, "events")
    p = e.select("event_id", F.when(F.col("event_id") % 7 == 1, F.expr("left(props, length(props) - 1)")).when(F.col("event_id") % 7 == 2, "{}").otherwise(F.col("props")).alias("props"))
    small, valid, k = F.octet_length("props") <= 9, F.try_parse_json("props").isNotNull(), F.get_json_object("props", "$.k")
    return p.select("event_id", F.when(~small, "large").when(~valid, "invalid").when(k.isNull(), "empty").otherwise("fine").alias("state"), F.when(small & valid, k.cast("long")).alias("k"))


@query("SELECT user_id, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_id % 3 = 0) AS BIGINT) AS prompt, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_id % 4 = 0) AS BIGINT) AS completion, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_id % 3 = 0), 0) + coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (event_id % 4 = 0), 0) AS BIGINT) AS total FROM events GROUP BY 1")
def provider_usage(spark, d):
    """Usage with optional columns: a sum without values stays null, the total counts it as none."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(F.col("event_id") % 3 == 0, k)).alias("prompt"), F.sum(F.when(F.col("event_id") % 4 == 0, k)).alias("completion"))
    return rows.withColumn("total", F.coalesce("prompt", F.lit(0)) + F.coalesce("completion", F.lit(0)))


@query(f"WITH {TALK_SQL}, o AS (SELECT thread_id, seq, row_number() OVER (PARTITION BY thread_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY thread_id) AS n FROM talk) SELECT thread_id, seq FROM o WHERE i % greatest(1, n // 8) = 0")
def spaced_sample(spark, d):
    """An even, deterministic sample: every n/8-th episode of a thread."""
    w = Window.partitionBy("thread_id")
    rows = talk_episodes(spark, d).select("thread_id", "seq", (F.row_number().over(w.orderBy("seq")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return rows.where("i % greatest(1, cast(n div 8 as bigint)) = 0").select("thread_id", "seq")


@query(f"WITH {TALK_SQL}, {TP} SELECT thread_id, seq, name, start, octet_length(encode(left(content, start))) AS from_byte, octet_length(encode(left(content, start + length(name)))) AS to_byte FROM place JOIN talk USING (thread_id, seq) WHERE kind IN ('date', 'code')")
def byte_spans(spark, d):
    """Places in characters as places in bytes."""
    e = talk_episodes(spark, d)
    rows = names.name_places(e, ["thread_id", "seq"]).where("kind in ('date', 'code')").join(e.select("thread_id", "seq", "content"), ["thread_id", "seq"])
    bytes_to = lambda n: F.octet_length(F.expr(f"left(content, {n})")).cast("long")
    return rows.select("thread_id", "seq", "name", "start", bytes_to("cast(start as int)").alias("from_byte"), bytes_to("cast(start + length(name) as int)").alias("to_byte"))


@query("SELECT doc_id, start, CASE WHEN length(text) / 3.6e0 * 1.1e0 <= 60 THEN text ELSE CASE WHEN a > 0 THEN '… ' ELSE '' END || substr(text, CAST(a AS INT) + 1, CAST(b - a AS INT)) || CASE WHEN b < length(text) THEN ' …' ELSE '' END END AS excerpt FROM (SELECT *, greatest(0, start + 5 - 96) AS a, greatest(least(length(text), greatest(0, start + 5 - 96) + 192), least(length(text), start + 10)) AS b FROM (SELECT doc_id, text, CAST(doc_id * 37 % greatest(1, length(text)) AS BIGINT) AS start FROM documents WHERE text <> ''))")
def excerpts(spark, d):
    """A window of about sixty tokens around a place of each text; the place itself is never cut."""
    rows = table(spark, d, "documents").where("text <> ''").select("doc_id", "text", (F.col("doc_id") * 37 % F.greatest(F.lit(1), F.length("text"))).alias("start"))
    n, a = F.length("text"), F.greatest(F.lit(0), F.col("start") + 5 - 96)
    cut = rows.withColumn("a", a).withColumn("b", F.greatest(F.least(n, F.col("a") + 192), F.least(n, F.col("start") + 10)))
    part = F.expr("substr(text, cast(a as int) + 1, cast(b - a as int))")
    whole = F.concat(F.when(F.col("a") > 0, "… ").otherwise(""), part, F.when(F.col("b") < n, " …").otherwise(""))
    return cut.select("doc_id", "start", F.when(approx_tokens(F.col("text")) <= 60, F.col("text")).otherwise(whole).alias("excerpt"))


@query(f"WITH {TALK_SQL}, b AS (SELECT thread_id, CAST(seq AS BIGINT) AS seq, role, content FROM talk WHERE seq < 20) SELECT thread_id, seq, role, base64(encode('{{\"seq\":' || CAST(seq AS VARCHAR) || ',\"thread_id\":' || CAST(thread_id AS VARCHAR) || '}}')) AS cursor FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC) AS r FROM b) WHERE r <= 6")
def transcript_page(spark, d):
    """The six episodes before number 20 of every thread, each with the opaque cursor that continues behind it."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("seq"))
    cursor = F.base64(F.to_json(F.struct("seq", "thread_id")).cast("binary"))
    return talk_episodes(spark, d).where("seq < 20").withColumn("_r", F.row_number().over(order)).where("_r <= 6").select("thread_id", "seq", "role", cursor.alias("cursor"))


@query(f"WITH {TALK_SQL} SELECT thread_id, count(*) AS rows, min(seq) AS first_seq, max(seq) AS last_seq, CAST(sum(octet_length(encode(content))) AS BIGINT) AS bytes, count(*) FILTER (octet_length(encode(content)) > 60) AS over, list_aggregate(list_sort(list_distinct(list(role))), 'string_agg', ',') AS roles FROM talk GROUP BY 1")
def export_preflight(spark, d):
    """Bounds, sizes and kinds of what an export would hold, and how many rows are over a bound of bytes."""
    size = F.octet_length("content").cast("long")
    return talk_episodes(spark, d).groupBy("thread_id").agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.sum(size).alias("bytes"), F.count_if(size > 60).alias("over"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


@query(f"WITH {TALK_SQL}, head AS (SELECT thread_id, max(seq) AS head_seq FROM talk WHERE seq <= 40 GROUP BY 1), old AS (SELECT * FROM talk WHERE seq <= 40), inc AS (SELECT * FROM talk WHERE seq > 35), new AS (SELECT * FROM inc i WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.thread_id = i.thread_id AND o.ts = i.ts AND o.role = i.role AND o.content = i.content)) SELECT n.thread_id, coalesce(head_seq, 0) + row_number() OVER (PARTITION BY n.thread_id ORDER BY ts, role, sha256(content)) AS seq, ts, role, content FROM new n LEFT JOIN head USING (thread_id)")
def appended_episodes(spark, d):
    """A batch of which a part is there already: only the rest is numbered behind the head."""
    e = talk_episodes(spark, d)
    old = e.where("seq <= 40")
    heads = old.groupBy("thread_id").agg(F.max("seq").alias("head_seq"))
    return archive.appended(old, heads, e.where("seq > 35").select("thread_id", "ts", "role", "content"))


@query(f"WITH {TALK_SQL}, c AS (SELECT thread_id, 'role.' || role AS key, count(*) AS value, min(seq) AS first_seq, max(seq) AS last_seq FROM talk WHERE seq <= 40 GROUP BY 1, 2), n AS (SELECT thread_id, 'role.' || role AS key, count(*) AS value, min(seq) AS first_seq, max(seq) AS last_seq FROM talk WHERE seq > 40 GROUP BY 1, 2) SELECT thread_id, key, CAST(sum(value) AS BIGINT) AS value, min(first_seq) AS first_seq, max(last_seq) AS last_seq FROM (SELECT * FROM c UNION ALL SELECT * FROM n) GROUP BY 1, 2")
def counters_merged(spark, d):
    """Counters of an archive and of a batch, merged: sums, earliest, latest."""
    e = talk_episodes(spark, d)
    count = lambda df: df.groupBy("thread_id", F.concat(F.lit("role."), "role").alias("key")).agg(F.count("*").alias("value"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return count(e.where("seq <= 40")).union(count(e.where("seq > 40"))).groupBy("thread_id", "key").agg(F.sum("value").alias("value"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


@query(f"WITH {TALK_SQL}, p AS (SELECT thread_id, seq AS turn, event_id % 6 AS packet FROM talk WHERE role = 'assistant'), k AS (SELECT thread_id, packet, count(*) AS answers, min(turn) AS first_turn FROM p GROUP BY 1, 2) SELECT thread_id, packet, answers FROM k WHERE answers <> 1")
def packet_answers(spark, d):
    """Packets that don't have exactly one answer."""
    rows = talk_episodes(spark, d).where("role = 'assistant'").groupBy("thread_id", (F.col("event_id") % 6).alias("packet")).agg(F.count("*").alias("answers"))
    return rows.where("answers <> 1")


@query(f"WITH {TALK_SQL}, v AS (SELECT thread_id, max(seq) - thread_id % 3 AS seq, sha256(arg_max(content, seq)) AS hash FROM talk GROUP BY 1, thread_id) SELECT v.thread_id, v.seq, t.seq IS NOT NULL AND sha256(t.content) = v.hash AS holds FROM v LEFT JOIN talk t ON t.thread_id = v.thread_id AND t.seq = v.seq")
def verified_frontier(spark, d):
    """Recorded frontiers against the archive (here: two of three name another place than their hash is of)."""
    e = talk_episodes(spark, d)
    v = e.groupBy("thread_id").agg(F.max(F.struct("seq", "content")).alias("h")).select("thread_id", (F.col("h.seq") - F.col("thread_id") % 3).alias("seq"), F.sha2("h.content", 256).alias("hash"))
    return v.join(e.select("thread_id", "seq", "content"), ["thread_id", "seq"], "left").select("thread_id", "seq", F.coalesce(F.sha2("content", 256) == F.col("hash"), F.lit(False)).alias("holds"))


@query(f"WITH {TALK_SQL}, w AS (SELECT thread_id, (seq - 1) // 16 AS checkpoint, role, count(*) FILTER (NOT removed) * 1e0 / count(*) AS rate FROM talk GROUP BY 1, 2, 3) SELECT checkpoint, role, round(min(rate), 6) AS least, count(*) AS probes FROM w GROUP BY 1, 2")
def checkpoint_series(spark, d):
    """For a chart: per checkpoint and family of probes the least rate over threads."""
    rows = talk_episodes(spark, d).groupBy("thread_id", F.floor((F.col("seq") - 1) / 16).cast("long").alias("checkpoint"), "role").agg((F.count_if(~F.col("removed")) / F.count("*")).alias("rate"))
    return rows.groupBy("checkpoint", "role").agg(F.round(F.min("rate"), 6).alias("least"), F.count("*").alias("probes"))


@query("SELECT source, count(*) AS labelled, count(*) FILTER (guess = toxic) AS right_, count(*) FILTER (guess = 1 AND toxic = 0) AS false_alarm, count(*) FILTER (guess = 0 AND toxic = 1) AS missed FROM (SELECT source, toxic, CASE WHEN length(text) % 5 = 0 THEN 1 ELSE 0 END AS guess FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL) GROUP BY 1")
def label_confusion(spark, d):
    """A prediction (here a made-up one, from the length) against labels: right, false alarms, missed."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.when(F.length("text") % 5 == 0, 1).otherwise(0).alias("guess")).join(table(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("labelled"), F.count_if(F.col("guess") == F.col("toxic")).alias("right_"), F.count_if((F.col("guess") == 1) & (F.col("toxic") == 0)).alias("false_alarm"), F.count_if((F.col("guess") == 0) & (F.col("toxic") == 1)).alias("missed"))


@query(f"WITH {TALK_SQL}, n AS (SELECT thread_id, seq, CASE WHEN event_id % 31 = 0 THEN seq + 1 ELSE seq END AS slot FROM talk), s AS (SELECT thread_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM talk GROUP BY 1) SELECT s.thread_id, s.last_seq - s.first_seq + 1 - s.n AS holes, (SELECT count(*) FROM (SELECT slot FROM n WHERE n.thread_id = s.thread_id GROUP BY slot HAVING count(*) > 1)) AS doubled FROM s")
def import_slots(spark, d):
    """Checks before an import is taken: holes in a thread's numbers, and numbers taken twice (here: every 31st claims the
    next one's)."""
    e = talk_episodes(spark, d)
    slots = e.select("thread_id", F.when(F.col("event_id") % 31 == 0, F.col("seq") + 1).otherwise(F.col("seq")).alias("at")).groupBy("thread_id", "at").count()
    doubled = slots.groupBy("thread_id").agg(F.count_if(F.col("count") > 1).alias("doubled"))
    return e.groupBy("thread_id").agg((F.max("seq") - F.min("seq") + 1 - F.count("*")).alias("holes")).join(doubled, "thread_id")


@query(f"WITH RECURSIVE {COMMIT_SQL}, gone AS (SELECT thread_id, seq FROM talk WHERE event_id % 6 = 0) SELECT f.thread_id, f.key, f.valid_from FROM fact f WHERE EXISTS (SELECT 1 FROM gone g WHERE g.thread_id = f.thread_id AND g.seq = f.valid_from)")
def import_orphans(spark, d):
    """Facts whose source the bundle lacks (here: every sixth episode was left out of it)."""
    there = talk_episodes(spark, d).where("event_id % 6 <> 0").select("thread_id", F.col("seq").alias("valid_from"))
    return talk_facts(spark, d).join(there, ["thread_id", "valid_from"], "left_anti").select("thread_id", "key", "valid_from")
