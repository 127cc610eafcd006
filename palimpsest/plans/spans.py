"""Queries over intervals that overlap and strings that contain others."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stems import stems_of, stems_sql
from ..functions.text import NAMES_SQL, terms_of
from ..operators import containment, evidence, intervals, search
from ..sources.episodes import CITIES, EV_SQL, PEOPLE, TALK_SQL, event_episodes, table, talk_episodes
from ..sources.tables import stored
from .catalogue import POST_SQL, _docs, _names, _terms
from .registry import query

# Claims: the lines of a document. Spans: names for parts of it, of lengths from 1 to some thousand characters, each with a
# phase; where they start depends on the text's length.
CLAIM_SQL = """piece AS (SELECT doc_id, text, length(text) AS n, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
claim AS (SELECT doc_id, i - 1 AS id, CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS start, CAST(coalesce(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)), 0) + length(l[i]) AS BIGINT) AS end_ FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM piece)),
span AS (SELECT doc_id, i AS id, (i * 37 + n) % greatest(n, 1) AS start, (i * 37 + n) % greatest(n, 1) + (i * i * i) % 3001 + 1 AS end_, CASE WHEN (i + doc_id) % 9 = 0 THEN 'PROPOSED' ELSE 'SUPPORTED' END AS phase FROM (SELECT doc_id, n, unnest(generate_series(0, 11)) AS i FROM piece))"""


def claims(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    lines = F.split("text", "\n", -1)
    begins = F.aggregate(lines, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, x: F.struct((acc["at"] + F.length(x) + 1).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(begins.alias("start"), F.transform(lines, F.length).alias("n"))).alias("id", "x"))
    return rows.select("doc_id", "id", F.col("x.start").alias("start"), (F.col("x.start") + F.col("x.n")).alias("end"))


def spans(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").cast("long").alias("n"))
    rows = docs.select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("id"))
    i, start = F.col("id").cast("long"), F.pmod(F.col("id") * 37 + F.col("n"), F.greatest("n", F.lit(1)))
    return rows.select("doc_id", "id", start.alias("start"), (start + i * i * i % 3001 + 1).alias("end"), F.when((i + F.col("doc_id")) % 9 == 0, "PROPOSED").otherwise("SUPPORTED").alias("phase"))


@query(f"WITH {CLAIM_SQL} SELECT c.doc_id, c.id AS left_id, s.id AS right_id FROM claim c JOIN span s ON s.doc_id = c.doc_id AND c.start < s.end_ AND s.start < c.end_ AND c.start < c.end_")
def overlapping_spans(spark, d):
    """Which spans each line of a document overlaps."""
    return intervals.overlapping(claims(spark, d), spans(spark, d), ["doc_id"])


@query(f'''WITH {CLAIM_SQL}, j AS (SELECT c.doc_id, c.id, count(s.id) AS "overlaps", count(DISTINCT s.phase) AS phases, min(s.phase) AS phase FROM claim c LEFT JOIN span s ON s.doc_id = c.doc_id AND c.start < s.end_ AND s.start < c.end_ AND c.start < c.end_ GROUP BY 1, 2) SELECT doc_id, id, "overlaps", CASE WHEN phases = 1 THEN phase END AS phase FROM j''')
def overlap_phase(spark, d):
    """The phase of each line: that of all spans it overlaps, if they agree. No pairs are made."""
    found = intervals.overlap_summary(claims(spark, d), spans(spark, d), ["doc_id"], {"low": ("min", "phase"), "high": ("max", "phase")})
    return found.select("doc_id", "id", "overlaps", intervals.agreed(found, "low", "high").alias("phase"))


PARCEL_SQL = "parcel AS (SELECT l_suppkey, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 86400000000 * 32 + CAST(floor(l_quantity) AS BIGINT) % 30 AS id, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 86400000000 AS start, epoch_us(CAST(l_shipdate AS TIMESTAMP)) // 86400000000 + CAST(floor(l_quantity) AS BIGINT) % 30 AS end_, CAST(floor(l_quantity) AS BIGINT) AS quantity FROM lineitem)"


def parcels(spark, d):
    """A line is on the way from its day of shipment, for as many days as its quantity leaves over thirty."""
    day, quantity = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long"), F.floor("l_quantity").cast("long")
    return table(spark, d, "lineitem").select("l_suppkey", (day * 32 + quantity % 30).alias("id"), day.alias("start"), (day + quantity % 30).alias("end"), quantity.alias("quantity"))


@query(f'''WITH {PARCEL_SQL} SELECT a.l_suppkey, a.id, count(b.id) AS "overlaps", CAST(sum(b.quantity) AS BIGINT) AS on_the_way, max(b.end_) AS last_day FROM (SELECT DISTINCT l_suppkey, id, start, end_ FROM parcel) a LEFT JOIN parcel b ON a.l_suppkey = b.l_suppkey AND a.start < b.end_ AND b.start < a.end_ AND a.start < a.end_ AND b.start < b.end_ GROUP BY 1, 2''')
def parcels_on_the_way(spark, d):
    """For each time that a supplier's lines are on the way, all its lines that are on the way meanwhile: their number,
    quantity and last day."""
    rows = parcels(spark, d)
    return intervals.overlap_summary(rows, rows, ["l_suppkey"], {"on_the_way": ("sum", "quantity"), "last_day": ("max", "end")})


# ---- strings that texts contain -----------------------------------------------------------------------------


@query("WITH p AS (SELECT item_id, trim(unnest(string_split(text, chr(10)))) AS pattern FROM benchmark), q AS (SELECT DISTINCT pattern FROM p WHERE length(pattern) >= 12) SELECT doc_id, pattern, contains(text, pattern) AS exact FROM documents JOIN q ON contains(lower(text), lower(pattern))")
def contained_lines(spark, d):
    """Documents that contain a line of a benchmark item, and whether in the same letters."""
    lines = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n", -1)).alias("line")).select(F.trim("line").alias("pattern"))
    return containment.contained(table(spark, d, "documents"), lines.where(F.length("pattern") >= 12), ["doc_id"], "text")


@query(f"WITH {EV_SQL}, {NAMES_SQL}, lost AS (SELECT DISTINCT thread_id, upper(name) AS name FROM nm WHERE seq % 10 = 0) SELECT e.thread_id, e.seq, count(*) AS names FROM ev e JOIN lost l ON l.thread_id = e.thread_id AND contains(lower(e.content), lower(l.name)) WHERE role = 'assistant' AND seq % 10 <> 0 GROUP BY 1, 2")
def removal_echo_strings(spark, d):
    """Assistant episodes that still contain, as a string in any case, a name of a removed episode (here: every tenth)."""
    e = event_episodes(spark, d)
    lost = _names(spark, d).where("seq % 10 = 0").select("thread_id", F.upper("name").alias("pattern")).distinct()
    said = e.where("role = 'assistant' and seq % 10 <> 0")
    return containment.contained(said, lost, ["thread_id", "seq"], within=["thread_id"]).groupBy("thread_id", "seq").agg(F.count("*").alias("names"))


_KNOWN = [(n.split(" ")[-1], n) for n in (*PEOPLE, *CITIES) if " " in n] + [("Ada", "Ada Lovelace"), ("da", "Ada Lovelace"), ("da", "Omar Haddad"), ("Nobody", "Vera Lind")]


@query(f"WITH {TALK_SQL}, known(alias, name) AS (VALUES {', '.join(repr(k) for k in _KNOWN)}), t AS (SELECT DISTINCT thread_id FROM talk), p AS (SELECT DISTINCT thread_id, alias, name FROM t, known WHERE EXISTS (SELECT 1 FROM talk x WHERE x.thread_id = t.thread_id AND x.role = 'user' AND contains(lower(x.content), lower(alias))) AND EXISTS (SELECT 1 FROM talk x WHERE x.thread_id = t.thread_id AND x.role = 'user' AND contains(lower(x.content), lower(name)))), s AS (SELECT thread_id, alias FROM p GROUP BY 1, 2 HAVING count(DISTINCT name) = 1) SELECT thread_id, alias, name FROM p JOIN s USING (thread_id, alias)")
def alias_strings(spark, d):
    """Aliases that a thread's user has written, for names that they have written, if they stand for one name only."""
    said = talk_episodes(spark, d).where("role = 'user'")
    known = spark.createDataFrame(_KNOWN, "alias string, name string")
    strings = known.select(F.explode(F.array("alias", "name")).alias("pattern")).distinct()
    hits = containment.contained(said, strings, ["thread_id", "seq"])
    proposed = said.select("thread_id").distinct().join(F.broadcast(known))  # a list of a dozen
    return containment.aliases(proposed, hits)


# ---- stems ----------------------------------------------------------------------------------------------------

_VOCABULARY = "words AS (SELECT DISTINCT term FROM post UNION SELECT term FROM terms)"


@query(f"WITH {POST_SQL}, words AS (SELECT DISTINCT term FROM post), {stems_sql('words')} SELECT term, stem FROM stems")
def vocabulary_stems(spark, d):
    """The stem of every word of the documents."""
    return stems_of(_docs(spark, d).select(F.explode(F.array_distinct(terms_of(F.col("content")))).alias("term")))


_SCORE = "round(sum(ln(1 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / a))), 6)"
STEM_SQL = f"""{POST_SQL}, {_VOCABULARY}, {stems_sql('words')}, size AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT doc_id, dl FROM post)),
asked AS (SELECT DISTINCT query_id, stem FROM terms JOIN stems USING (term)), spost AS (SELECT doc_id, dl, stem, sum(tf) AS tf FROM post JOIN stems USING (term) GROUP BY 1, 2, 3), df AS (SELECT stem, count(*) AS df FROM spost GROUP BY 1),
s AS (SELECT query_id, doc_id, {_SCORE} AS score, count(*) AS matched FROM asked JOIN spost USING (stem) JOIN df USING (stem), size GROUP BY 1, 2)"""
_RANK = "SELECT query_id, doc_id, score, matched, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s{}) WHERE rank <= 10"


@query(f"WITH {STEM_SQL} {_RANK.format('')}")
def stemmed_bm25_topk(spark, d):
    """The ten best documents of each query, by stems."""
    stems, asked = search.stemmed(_docs(spark, d), _terms(spark, d))
    return search.bm25(_docs(spark, d), asked.withColumnRenamed("stem", "term"), "doc_id", 10, stems=stored(stems, "stems"))


@query(f"WITH {STEM_SQL} {_RANK.format(' WHERE doc_id % 3 <> query_id % 3')}")
def stemmed_bm25_excluded(spark, d):
    """The same without documents that a query has seen (here: those with its remainder of 3), which still count."""
    docs = _docs(spark, d)
    stems, asked = search.stemmed(docs, _terms(spark, d))
    seen = asked.select("query_id").distinct().join(docs.select("doc_id", (F.col("doc_id") % 3).alias("r")), F.col("query_id") % 3 == F.col("r")).select("query_id", "doc_id")
    return search.bm25(docs, asked.withColumnRenamed("stem", "term"), "doc_id", 10, exclude=seen, stems=stored(stems, "stems"))


# ---- blobs ------------------------------------------------------------------------------------------------------

# Threads attach documents; a document has a manifest, which names its chunks and, for every fourth one, the manifest of the
# version before it. Threads whose number three divides are gone.
BLOB_SQL = f"""{TALK_SQL}, chunk AS (SELECT doc_id, i, sha256(substr(text, i * 500 + 1, 500)) AS hash, CAST(strlen(substr(text, i * 500 + 1, 500)) AS BIGINT) AS size FROM (SELECT doc_id, text, unnest(generate_series(0, (length(text) - 1) // 500)) AS i FROM documents WHERE length(text) > 0)),
manifest AS (SELECT doc_id, sha256('manifest ' || CAST(doc_id AS VARCHAR)) AS hash, count(*) AS n FROM chunk GROUP BY 1),
attached AS (SELECT DISTINCT 'thread ' || CAST(thread_id AS VARCHAR) AS parent, m.hash AS child FROM talk t JOIN manifest m ON m.doc_id = t.event_id % 97 WHERE t.event_id % 5 = 0),
refs AS (SELECT * FROM attached UNION SELECT m.hash, c.hash FROM manifest m JOIN chunk c USING (doc_id) UNION SELECT m.hash, o.hash FROM manifest m JOIN manifest o ON o.doc_id = m.doc_id // 2 WHERE m.doc_id % 4 = 0),
blob AS (SELECT hash, max(size) AS size FROM (SELECT hash, size FROM chunk UNION ALL SELECT hash, n * 64 FROM manifest) GROUP BY 1),
mark AS (SELECT DISTINCT 'thread ' || CAST(thread_id AS VARCHAR) AS node FROM talk WHERE thread_id % 3 <> 0 AND thread_id < 60 UNION SELECT child FROM mark JOIN refs ON parent = node)"""


def blob_store(spark, d):
    """(references, blobs, live threads) of the documents that threads attach."""
    docs = table(spark, d, "documents").where(F.length("text") > 0)
    part = lambda i: F.struct(i.alias("i"), F.substring(F.col("text"), (i * 500 + 1).cast("int"), F.lit(500)).alias("t"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 500).cast("int")), lambda i: F.struct(F.sha2(part(i)["t"], 256).alias("hash"), F.octet_length(part(i)["t"]).cast("long").alias("size")))
    chunks = stored(docs.select("doc_id", F.explode(cut).alias("c")).select("doc_id", "c.*"), "chunks")
    name = lambda c: F.sha2(F.concat(F.lit("manifest "), c.cast("string")), 256)
    manifests = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("hash", name(F.col("doc_id")))
    e = talk_episodes(spark, d)
    node = F.concat(F.lit("thread "), F.col("thread_id").cast("string"))
    attached = e.where("event_id % 5 = 0").select(node.alias("parent"), (F.col("event_id") % 97).alias("doc_id")).join(manifests.select("doc_id", F.col("hash").alias("child")), "doc_id").select("parent", "child")
    older = manifests.where("doc_id % 4 = 0").select(F.col("hash").alias("parent"), F.floor(F.col("doc_id") / 2).cast("long").alias("doc_id")).join(manifests.select("doc_id", F.col("hash").alias("child")), "doc_id").select("parent", "child")
    references = attached.union(chunks.select(name(F.col("doc_id")).alias("parent"), F.col("hash").alias("child"))).union(older)
    blobs = chunks.select("hash", "size").union(manifests.select("hash", (F.col("n") * 64).alias("size"))).groupBy("hash").agg(F.max("size").alias("size"))
    return references, stored(blobs, "blobs"), e.where("thread_id % 3 <> 0 and thread_id < 60").select(node.alias("node")).distinct()


@query(f"WITH RECURSIVE {BLOB_SQL} SELECT hash, size FROM blob WHERE hash IN (SELECT node FROM mark)")
def blobs_exported(spark, d):
    """Blobs that the live threads reach over manifests, their chunks and older versions: what a bundle of them holds."""
    references, blobs, live = blob_store(spark, d)
    return evidence.swept(blobs, evidence.reachable(references, live))[0]


@query(f"WITH RECURSIVE {BLOB_SQL} SELECT hash, size FROM blob WHERE hash NOT IN (SELECT node FROM mark)")
def blobs_swept(spark, d):
    """Blobs that nothing live reaches any more: what goes."""
    references, blobs, live = blob_store(spark, d)
    return evidence.swept(blobs, evidence.reachable(references, live))[1]
