"""Queries over summaries: their text, what it loses, and the ledger over levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import SALIENT_PATTERN, sentences_sql
from ..operators import archive, capsules
from ..sources.episodes import talk_episodes, table
from ..sources.tables import stored
from .extraction import COMMIT_SQL, talk_facts
from .registry import query

SPAN, FAN, CAP, UPPER_CAP, ROOT_CAP = 8, 4, 90, 150, 120
_SALIENT = SALIENT_PATTERN.replace("'", "''")
COST = "CAST(ceil(length(line) / 3.6e0 * 1.1e0) AS BIGINT)"
LINES_SQL = COMMIT_SQL + f""", leaf AS (SELECT thread_id, (seq - 1) // {SPAN} AS no FROM talk GROUP BY 1, 2 HAVING count(*) = {SPAN}),
sent AS (SELECT thread_id, seq, unnest(generate_series(1, len(l))) - 1 AS i, regexp_replace(unnest(l), '\\s+', ' ', 'g') AS s FROM (SELECT thread_id, seq, {sentences_sql('content')} AS l FROM talk WHERE NOT removed) WHERE len(l) > 0),
sal AS (SELECT *, regexp_matches(lower(s), '{_SALIENT}') AS salient FROM sent),
told AS (SELECT *, min(CASE WHEN NOT salient THEN i END) OVER (PARTITION BY thread_id, seq) AS first FROM sal),
cand AS (SELECT thread_id, (valid_from - 1) // {SPAN} AS no, 0 AS tier, valid_from AS seq, 0 AS i, key || ': ' || value || ' ⟨#' || CAST(valid_from AS VARCHAR) || '⟩' AS line, key FROM fact WHERE phase = 'SUPPORTED'
  UNION ALL SELECT thread_id, (seq - 1) // {SPAN}, CASE WHEN salient THEN 1 ELSE 2 END, seq, i, CASE WHEN salient THEN s || ' ⟨#' || CAST(seq AS VARCHAR) || '⟩' ELSE s END, '' FROM told WHERE salient OR i = first),
sight AS (SELECT thread_id, no, line, min((tier, seq, key, i)) AS spot FROM cand JOIN leaf USING (thread_id, no) GROUP BY 1, 2, 3),
placed AS (SELECT *, row_number() OVER w AS ordinal FROM sight WINDOW w AS (PARTITION BY thread_id, no ORDER BY spot, line)),
cost AS (SELECT *, CAST(sum({COST} + CASE WHEN ordinal > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id, no ORDER BY ordinal) AS BIGINT) AS used FROM placed),
lines AS (SELECT thread_id, no, ordinal, spot[1] AS tier, spot[2] AS seq, line, used FROM cost WHERE used <= {CAP}),
caps AS (SELECT thread_id, no, string_agg(line, chr(10) ORDER BY ordinal) AS text FROM lines GROUP BY 1, 2)"""


def talk_lines(spark, d, episodes=None, facts_=None):
    e = episodes if episodes is not None else talk_episodes(spark, d)
    known = facts_ if facts_ is not None else talk_facts(spark, d, e)
    return capsules.written_lines(capsules.candidate_lines(e, known.where("phase = 'SUPPORTED'"), SPAN), CAP)


@query("SELECT DISTINCT n_chars AS budget, CAST(greatest(150, n_chars // 40) AS BIGINT) AS leaf, CAST(greatest(200, n_chars // 32) AS BIGINT) AS middle, CAST(greatest(300, n_chars // 16) AS BIGINT) AS root, CAST(greatest(2, least(6, floor((floor(n_chars * 18 / 100) - greatest(300, n_chars // 16)) / greatest(150, n_chars // 40)))) AS BIGINT) AS resident_leaves FROM documents")
def capsule_token_caps(spark, d):
    return capsules.token_caps(table(spark, d, "documents").select(F.col("n_chars").alias("budget")).distinct())


@query(f"WITH RECURSIVE {LINES_SQL} SELECT * FROM lines")
def capsule_lines(spark, d):
    return talk_lines(spark, d)


@query(f"WITH RECURSIVE {LINES_SQL} SELECT thread_id, no, text, CAST(ceil(length(text) / 3.6e0 * 1.1e0) AS BIGINT) AS tokens, sha256(text) AS hash FROM caps")
def capsule_texts(spark, d):
    return capsules.capsule_texts(talk_lines(spark, d))


@query(f"WITH RECURSIVE {LINES_SQL}, n AS (SELECT thread_id, key, max(valid_from) AS newest FROM fact WHERE phase = 'SUPPORTED' GROUP BY 1, 2), old AS (SELECT thread_id, no, ordinal, regexp_extract(line, '^([^:]+): ', 1) AS key, seq FROM lines WHERE tier = 0) SELECT thread_id, no, ordinal, key, seq - seq % 2 AS seq, newest FROM old JOIN n USING (thread_id, key) WHERE newest > seq - seq % 2")
def stale_certificates(spark, d):
    """Certificates overtaken by a newer value (here: lines that claim to be one older than they are, where odd)."""
    known = talk_facts(spark, d)
    aged = talk_lines(spark, d, facts_=known).withColumn("seq", F.col("seq") - F.col("seq") % 2)
    return capsules.stale_certificates(aged, known)


PLACES = names.places_sql("talk", "thread_id, seq", "content")
SHOWN = names.places_sql("caps", "thread_id, no", "text").replace("lex_", "ley_").replace("place AS (", "shown AS (")
UPPER_SQL = f"""upper AS (SELECT thread_id, no // {FAN} AS no FROM caps GROUP BY 1, 2 HAVING count(*) = {FAN}),
upsight AS (SELECT l.thread_id, u.no, line, min((tier, seq, '', ordinal)) AS spot FROM lines l JOIN upper u ON u.thread_id = l.thread_id AND u.no = l.no // {FAN} GROUP BY 1, 2, 3),
upplaced AS (SELECT *, row_number() OVER (PARTITION BY thread_id, no ORDER BY spot, line) AS ordinal FROM upsight),
upcost AS (SELECT *, CAST(sum({COST} + CASE WHEN ordinal > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id, no ORDER BY ordinal) AS BIGINT) AS used FROM upplaced),
uplines AS (SELECT thread_id, no, ordinal, spot[1] AS tier, spot[2] AS seq, line, used FROM upcost WHERE used <= {UPPER_CAP}),
upcaps AS (SELECT thread_id, no, string_agg(line, chr(10) ORDER BY ordinal) AS text FROM uplines GROUP BY 1, 2)"""
SHOWN1 = names.places_sql("upcaps", "thread_id, no", "text").replace("lex_", "lez_").replace("place AS (", "upshown AS (")
LEDGER_SQL = LINES_SQL + f""", {PLACES}, {SHOWN}, {UPPER_SQL}, {SHOWN1},
src AS (SELECT thread_id, (seq - 1) // {SPAN} AS no, name, max(seq) AS seq FROM (SELECT p.thread_id, p.seq, p.name FROM place p JOIN talk USING (thread_id, seq) WHERE NOT removed UNION ALL SELECT thread_id, valid_from, lower(key) FROM fact UNION ALL SELECT thread_id, valid_from, lower(value) FROM fact) GROUP BY 1, 2, 3),
src0 AS (SELECT s.* FROM src s JOIN leaf USING (thread_id, no)),
kept0 AS (SELECT * FROM src0 s WHERE EXISTS (SELECT 1 FROM shown x WHERE x.thread_id = s.thread_id AND x.no = s.no AND x.name = s.name)),
drop0 AS (SELECT * FROM src0 s WHERE NOT EXISTS (SELECT 1 FROM shown x WHERE x.thread_id = s.thread_id AND x.no = s.no AND x.name = s.name)),
src1 AS (SELECT s.* FROM (SELECT thread_id, no // {FAN} AS no, name, max(seq) AS seq FROM kept0 GROUP BY 1, 2, 3) s JOIN upper USING (thread_id, no)),
shown1 AS (SELECT DISTINCT thread_id, no, name FROM upshown),
drop1 AS (SELECT * FROM src1 s WHERE NOT EXISTS (SELECT 1 FROM shown1 x WHERE x.thread_id = s.thread_id AND x.no = s.no AND x.name = s.name)),
loss AS (SELECT 0 AS level, thread_id, no, name, seq FROM drop0 UNION ALL SELECT 1, thread_id, no, name, seq FROM drop1 d WHERE NOT EXISTS (SELECT 1 FROM drop0 x WHERE x.thread_id = d.thread_id AND x.name = d.name AND x.seq = d.seq))"""


def _parts(spark, d):
    """Source vocabulary, shown names and lines of the sealed leaves; each written table is derived once."""
    e = stored(talk_episodes(spark, d), "talk")
    facts_ = talk_facts(spark, d, e)
    lines = stored(talk_lines(spark, d, e, facts_), "lines")
    leaves = archive.windows(e, SPAN).select("thread_id", "no")
    source = capsules.source_vocabulary(names.name_places(e.where("not removed"), ["thread_id", "seq"]), facts_, SPAN).join(leaves, ["thread_id", "no"])
    shown = names.name_places(capsules.capsule_texts(lines), ["thread_id", "no"], "text")
    return source, shown, lines


def talk_ledger(spark, d):
    """Losses of two levels: leaves, and the capsules above, whose text is written from their leaves' lines."""
    source, shown, lines = _parts(spark, d)
    kept, dropped = (stored(x, "ledger") for x in capsules.split(stored(source, "source"), stored(shown, "shown")))
    above = upper_text(lines)
    shown1 = names.name_places(capsules.capsule_texts(above), ["thread_id", "no"], "text")
    raised = capsules.raised(kept, FAN).join(above.select("thread_id", "no").distinct(), ["thread_id", "no"])
    _, dropped1 = capsules.split(raised, shown1)
    level = lambda df, k: df.select(F.lit(k).alias("level"), "thread_id", "no", "name", "seq")
    return stored(level(dropped, 0).union(level(capsules.new_losses(dropped1, dropped), 1)), "losses")


def upper_text(lines):
    return stored(capsules.written_lines(capsules.upper_lines(lines, FAN), UPPER_CAP), "upper-lines")


@query(f"WITH RECURSIVE {LINES_SQL}, {UPPER_SQL} SELECT * FROM uplines")
def upper_capsule_lines(spark, d):
    """Capsules of the second level: the lines of four leaves, by tier, cut to their own cap."""
    return upper_text(stored(talk_lines(spark, d), "lines"))


@query(f"WITH RECURSIVE {LEDGER_SQL} SELECT * FROM src0")
def source_vocabulary(spark, d):
    return _parts(spark, d)[0]


@query(f"WITH RECURSIVE {LEDGER_SQL} SELECT * FROM loss")
def ledger_levels(spark, d):
    return talk_ledger(spark, d)


@query(f"WITH RECURSIVE {LEDGER_SQL}, up AS (SELECT thread_id, CASE WHEN level = 0 THEN no // {FAN} ELSE no END AS no, name, seq FROM loss), l1 AS (SELECT thread_id, no, name FROM up WHERE seq % 13 <> 0), low AS (SELECT thread_id, no // {FAN} AS no, name, max(seq) AS seq FROM drop0 GROUP BY 1, 2, 3) SELECT thread_id, no, name, seq FROM low l WHERE NOT EXISTS (SELECT 1 FROM l1 x WHERE x.thread_id = l.thread_id AND x.no = l.no AND x.name = l.name)")
def ledger_conservation(spark, d):
    """Names of leaf ledgers that the ledger above misses (here: entries at every 13th place were taken out of it)."""
    losses = talk_ledger(spark, d)
    above = losses.withColumn("no", F.when(F.col("level") == 0, F.floor(F.col("no") / FAN)).otherwise(F.col("no")).cast("long")).where(F.col("seq") % 13 != 0)
    return capsules.unconserved(above, losses.where("level = 0"), FAN)


@query(f"WITH RECURSIVE {LEDGER_SQL} SELECT thread_id, no // {FAN} AS no, count(*) AS carried, count(DISTINCT name) AS names FROM drop0 GROUP BY 1, 2")
def carried_counts(spark, d):
    """What the leaves below hand up to each upper capsule."""
    rows = talk_ledger(spark, d).where("level = 0")
    return rows.groupBy("thread_id", F.floor(F.col("no") / FAN).cast("long").alias("no")).agg(F.count("*").alias("carried"), F.countDistinct("name").alias("names"))


@query(f"WITH RECURSIVE {LEDGER_SQL}, e AS (SELECT thread_id, no, name, seq, sha256(name || '|' || CAST(seq AS VARCHAR)) AS h FROM loss WHERE level = 0) SELECT thread_id, no, count(*) AS entries, sha256(string_agg(h, '' ORDER BY seq, name)) AS digest FROM e GROUP BY 1, 2")
def ledger_digests(spark, d):
    """An ordered digest over the entries of each leaf's ledger."""
    row = F.struct("seq", "name", F.sha2(F.concat("name", F.lit("|"), F.col("seq").cast("string")), 256).alias("h"))
    rows = talk_ledger(spark, d).where("level = 0")
    return rows.groupBy("thread_id", "no").agg(F.count("*").alias("entries"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["h"]), ""), 256).alias("digest"))


@query(f"WITH RECURSIVE {LINES_SQL}, w AS (SELECT thread_id, (seq - 1) // {SPAN} AS no, min(seq) AS from_seq, max(seq) AS to_seq FROM talk GROUP BY 1, 2 HAVING count(*) = {SPAN}), c AS (SELECT thread_id, max(to_seq) - {3 * SPAN} AS covered_to FROM w GROUP BY 1), r AS (SELECT w.*, row_number() OVER (PARTITION BY thread_id ORDER BY no DESC) AS r FROM w JOIN c USING (thread_id) WHERE to_seq > covered_to) SELECT thread_id, no, from_seq, to_seq FROM r WHERE r <= 2")
def resident_capsules(spark, d):
    """The two newest leaves behind what the root covers: all but the last three."""
    windows = archive.windows(talk_episodes(spark, d), SPAN)
    covered = windows.groupBy("thread_id").agg((F.max("to_seq") - 3 * SPAN).alias("covered_to"))
    return capsules.resident(windows, covered, 2)


@query(f"WITH RECURSIVE {LINES_SQL}, k AS (SELECT r.thread_id, r.root, l.line, max(l.seq) AS seq FROM (SELECT DISTINCT thread_id, no AS root FROM lines) r JOIN lines l ON l.thread_id = r.thread_id AND l.no <= r.root GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY thread_id, root ORDER BY seq DESC, line) AS ordinal FROM k) SELECT thread_id, root, ordinal, line, seq FROM o WHERE ordinal <= 5")
def rolling_root(spark, d):
    return capsules.sequential_root(talk_lines(spark, d), capsules.newest(5)).select("thread_id", "root", "ordinal", "line", "seq")


@query(f"WITH RECURSIVE {LINES_SQL}, k AS (SELECT r.thread_id, r.root, l.line, max(l.seq) AS seq FROM (SELECT thread_id, max(no) AS root FROM lines GROUP BY 1) r JOIN lines l ON l.thread_id = r.thread_id AND l.no <= r.root GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY seq DESC, line) AS ordinal FROM k), s AS (SELECT thread_id, line FROM o WHERE ordinal <= 5) SELECT f.thread_id, count(*) AS facts, count(*) FILTER (EXISTS (SELECT 1 FROM s WHERE s.thread_id = f.thread_id AND instr(s.line, f.value) > 0)) AS survive FROM fact f WHERE f.phase = 'SUPPORTED' GROUP BY 1")
def rolling_summary_survival(spark, d):
    """The baseline of a rolling summary: how many supported values its last state still shows."""
    known = talk_facts(spark, d)
    lines = stored(talk_lines(spark, d, facts_=known), "lines")
    last = lines.groupBy("thread_id").agg(F.max("no").alias("root"))
    root = capsules.sequential_root(lines, capsules.newest(5)).join(last, ["thread_id", "root"]).select("thread_id", "line")
    live = known.where("phase = 'SUPPORTED'").select("thread_id", "key", "value")
    hit = live.join(root, "thread_id").where(F.contains("line", F.col("value"))).select("thread_id", "key").distinct().withColumn("_s", F.lit(1))
    return live.join(hit, ["thread_id", "key"], "left").groupBy("thread_id").agg(F.count("*").alias("facts"), F.count("_s").alias("survive"))


# ---- the sequential root --------------------------------------------------------------------------------------

# leaves as they were when sealed: certificates of what was supported then
SEALED_SQL = LINES_SQL.replace("FROM fact WHERE phase = 'SUPPORTED'", f"FROM fact WHERE authority = 'user' AND (valid_to IS NULL OR valid_to > ((valid_from - 1) // {SPAN} + 1) * {SPAN})")
_ONE = "CAST(ceil(length({}.line) / 3.6e0 * 1.1e0) AS BIGINT)"
ROOT_SQL = SEALED_SQL + f""", sealed AS (SELECT l.thread_id, l.no, list({{'tier': CAST(l.tier AS BIGINT), 'seq': l.seq, 'until': f.valid_to, 'line': l.line}} ORDER BY l.ordinal) AS leaf FROM lines l LEFT JOIN fact f ON l.tier = 0 AND f.thread_id = l.thread_id AND f.valid_from = l.seq AND l.line = f.key || ': ' || f.value || ' ⟨#' || CAST(f.valid_from AS VARCHAR) || '⟩' GROUP BY 1, 2),
turn AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY no) AS i FROM sealed),
roll AS (SELECT thread_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS root, CAST([] AS STRUCT(tier BIGINT, seq BIGINT, until BIGINT, line VARCHAR)[]) AS text FROM (SELECT DISTINCT thread_id FROM turn)
  UNION ALL SELECT thread_id, i, no, list_filter(once, lambda x, k: list_sum(list_transform(once[1:k], lambda y: {_ONE.format('y')} + 1)) - 1 <= {ROOT_CAP})
  FROM (SELECT *, list_filter(tiered, lambda x, k: list_position(list_transform(tiered, lambda y: y.line), x.line) = k) AS once
    FROM (SELECT thread_id, i, no, list_concat(list_filter(alive, lambda x: x.tier = 0), list_concat(list_filter(alive, lambda x: x.tier = 1), list_filter(alive, lambda x: x.tier = 2))) AS tiered
      FROM (SELECT t.thread_id, t.i, t.no, list_filter(list_concat(r.text, t.leaf), lambda x: x.until IS NULL OR x.until > (t.no + 1) * {SPAN}) AS alive FROM roll r JOIN turn t ON t.thread_id = r.thread_id AND t.i = r.i + 1)))),
root AS (SELECT thread_id, root, unnest(generate_series(1, len(text))) AS ordinal, unnest(text) AS x FROM roll WHERE i > 0 AND len(text) > 0)"""


def sealed_lines(spark, d, episodes=None):
    """Lines of the leaves with the facts that were supported when they were sealed, and where each certificate is overtaken."""
    e = episodes if episodes is not None else talk_episodes(spark, d)
    known = talk_facts(spark, d, e)
    lines = capsules.written_lines(capsules.candidate_lines(e, capsules.supported_at_end(known, SPAN), SPAN), CAP)
    until = known.select("thread_id", capsules.certificate(F.col("key"), F.col("value"), F.col("valid_from")).alias("line"), F.lit(0).alias("tier"), F.col("valid_to").alias("until"))
    return lines.join(until, ["thread_id", "line", "tier"], "left").withColumn("to_seq", (F.col("no") + 1) * SPAN)


@query(f"WITH RECURSIVE {ROOT_SQL} SELECT thread_id, root, ordinal, x.tier AS tier, x.seq AS seq, x.line AS line FROM root")
def sequential_root(spark, d):
    """The root after each leaf: what it held and the leaf's lines, without certificates that were overtaken meanwhile, by
    tier, cut to the root's cap."""
    return capsules.sequential_root(sealed_lines(spark, d), most=ROOT_CAP)


ROOTNAMES = names.places_sql("rootcaps", "thread_id, root", "text").replace("lex_", "lew_").replace("place AS (", "rootshown AS (")


@query(f"""WITH RECURSIVE {ROOT_SQL}, leafcaps AS (SELECT thread_id, no, string_agg(line, chr(10) ORDER BY ordinal) AS text FROM lines GROUP BY 1, 2), rootcaps AS (SELECT thread_id, root, string_agg(x.line, chr(10) ORDER BY ordinal) AS text FROM root GROUP BY 1, 2),
{names.places_sql("leafcaps", "thread_id, no", "text").replace("lex_", "lev_").replace("place AS (", "leafshown AS (")}, {ROOTNAMES},
sh AS (SELECT DISTINCT thread_id, root, name FROM rootshown), kp AS (SELECT DISTINCT thread_id, no, name FROM leafshown),
rs AS (SELECT thread_id, root, lead(root) OVER (PARTITION BY thread_id ORDER BY root) AS next FROM (SELECT thread_id, root FROM sh UNION SELECT thread_id, no FROM kp)),
sources AS (SELECT sh.thread_id, rs.next AS root, name FROM sh JOIN rs USING (thread_id, root) WHERE next IS NOT NULL UNION SELECT thread_id, no, name FROM kp)
SELECT thread_id, root, name FROM sources ANTI JOIN sh USING (thread_id, root, name)""")
def root_losses(spark, d):
    """Names that go out of sight with each new root: of the root before it and of the leaf it took in."""
    lines = stored(sealed_lines(spark, d), "lines")
    kept = names.name_places(capsules.capsule_texts(lines), ["thread_id", "no"], "text").select("thread_id", "no", "name").distinct()
    rows = capsules.sequential_root(lines, most=ROOT_CAP).withColumnRenamed("root", "no")
    shown = names.name_places(capsules.capsule_texts(rows), ["thread_id", "no"], "text").select("thread_id", F.col("no").alias("root"), "name").distinct()
    return capsules.root_losses(stored(shown, "shown"), stored(kept, "kept"))
