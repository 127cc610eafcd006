"""Facts from text: rules over sentences, corrections, and the law by which statements become facts.

A rule is a list of cue phrases, where they may stand, and what is taken from the words around them. A sentence is probed
whole, behind a lead-in ("...: "), and behind a correction's opening word. One pattern a rule, made from its cues, finds
the cue and gives the words behind it (and, for rules about persons, the name before it); what follows works on these
words: they are counted, split at a word, or cut to the capitalised name that they begin with. All rules are tried in one
projection, so extraction is a narrow map over episodes. Rules are written as SQL from the same lists.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import as_in_sql, authority, collapsed, lowered, sentences, sentences_sql, slug, slug_sql
from ..sources.tables import stored

SPOKEN = ("user", "assistant")
# Words by which a sentence says what it states, lower case, with a plain apostrophe.
NAMED = ("my name is", "call me", "i'm called", "i am called")
LIVING = (
    "i live in", "i reside in", "i moved to", "i just moved to", "i've moved to", "i've just moved to", "i have moved to", "i have just moved to", "i relocated to",
    "i'm living in", "i am living in", "i'm now living in", "i am now living in", "i'm based in", "i am based in", "i'm now based in", "i am now based in",
)
REMEMBER = ("remember that", "remember")
RULING = ("rule:", "from now on", "from here on", "always", "never", "don't ever", "dont ever", "please always", "please never", "please don't ever")
DECIDED = (
    "decision:", "we decided to", "we decided on", "we decided that", "we decided", "we have decided to", "we have decided on", "we have decided that", "we have decided",
    "we agreed to", "we agreed on", "we agreed that", "we agreed", "let's go with", "lets go with", "we're going with", "we are going with", "we'll use",
)
USING = ("use",)
TO_DO = ("todo:", "todo", "remind me to", "i will", "i'll", "i need to", "i'm going to", "i am going to")
LIVES = ("lives in", "now lives in", "moved to", "has moved to", "relocated to", "is based in")
WORKS = ("works at", "now works at", "joined", "is now at", "switched jobs - now at", "switched jobs — now at")
BORN = ("was born in",)
OF_THINGS = ("the", "our")
NOT = ("not",)
COPULAS = ("is", "are", "was", "were", "=")
MEANWHILE = ("now", "currently")
INSTEAD = ("but", "it's", "its")
NEGATIVE = ("never", "don't ever", "dont ever", "please never", "please don't ever")
CORRECTING = ("actually", "correction", "sorry", "no")
PARTICLES = ("of", "de", "la", "van", "der", "den", "du", "di")
PRONOUNS = ("i", "we", "he", "she", "it", "they", "you", "this", "that", "there", "who")

_CAP = r"\p{Lu}[\p{L}\p{N}_'’-]*"
NAME = rf"{_CAP}(?:\s+(?:(?:{'|'.join(PARTICLES)})\s+)?{_CAP})*"


def _any_of(phrases: tuple[str, ...]) -> str:
    """A pattern for one of the phrases, longer ones first."""
    escaped = (p.replace("'", "['’]").replace(" ", r"\s+") for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return "(?i:" + "|".join(escaped) + ")"


def opening(phrases: tuple[str, ...]) -> str:
    """A text that begins with one of the phrases; group 1 is the rest."""
    return rf"(?s)^{_any_of(phrases)}(?:[\s,:]+|\b)(\S.*)$"


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    roles: tuple[str, ...]
    cues: tuple[str, ...]
    stands: str  # the cue's place: open (the text begins with it), inside (any word), between (two names)
    shape: str  # what is taken: name, clause, memory, purpose, copula, swap or person
    key: str  # the key, or what it begins or ends with
    confidence: float
    words: int = 6  # of the key
    most: int = 40  # words that the rest may have

    @property
    def find(self) -> str:
        """Group 1: the words behind the cue; between names, group 1 is the first and group 2 the second."""
        if self.stands == "between":
            return rf"(?:^|[^\p{{L}}\p{{N}}_'’-])({NAME})\s+{_any_of(self.cues)}\s+({NAME})"
        if self.stands == "open":
            return opening(self.cues)
        return rf"(?s)(?:^|[^\p{{L}}\p{{N}}_]){_any_of(self.cues)}[\s,:]+(\S.*)$"


RULES = (
    Rule("identity.name", "identity", ("user",), NAMED, "inside", "name", "identity.name", 1.0),
    Rule("user.location", "fact", ("user",), LIVING, "inside", "name", "user.location", 1.0),
    Rule("remember", "fact", SPOKEN, REMEMBER, "inside", "memory", "fact.", 1.0),
    Rule("rule", "preference", SPOKEN, RULING, "open", "clause", "rule.", 1.0, 8),
    Rule("decision.stated", "decision", SPOKEN, DECIDED, "open", "clause", "decision.", 1.0),
    Rule("decision.use-for", "decision", SPOKEN, USING, "inside", "purpose", "decision.", 0.9, most=20),
    Rule("task", "task", SPOKEN, TO_DO, "open", "clause", "task.", 0.85),
    Rule("person.location", "fact", SPOKEN, LIVES, "between", "person", ".location", 0.95, 4),
    Rule("person.employer", "fact", SPOKEN, WORKS, "between", "person", ".employer", 0.95, 4),
    Rule("person.birthplace", "fact", SPOKEN, BORN, "between", "person", ".birthplace", 0.95, 4),
    Rule("fact.copula", "fact", SPOKEN, OF_THINGS, "open", "copula", "fact.", 0.85, 5, 24),
    Rule("correction.not-but", "correction", SPOKEN, NOT, "inside", "swap", "correction.", 0.95, most=24),
)

# how a rest is split: at a copula, at "for", at a comma
SPLIT = {"copula": rf"(?s)^(.*?\S)\s+{_any_of(COPULAS)}\s+(\S.*)$", "purpose": r"(?s)^(.*?\S)\s+(?i:for)\s+(\S.*)$", "swap": r"(?s)^([^,]*[^,\s])\s*,\s*(\S.*)$"}
LEADS = {"copula": rf"^{_any_of(MEANWHILE)}\s+", "swap": rf"^{_any_of(INSTEAD)}\s+"}
STATED = r"\p{N}|^\p{Lu}"  # a thing's state is a number or a name
DRAFT = "rule string, kind string, key string, value string, supersedes string, confidence double"


def _draft(rule: str | Column, kind: str, key: Column, value: Column, confidence: float | Column, supersedes: Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(rule).alias("rule"), F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), (supersedes if supersedes is not None else F.lit(None).cast("string")).alias("supersedes"), lit(confidence).cast("double").alias("confidence"))


def _undotted(text: Column) -> Column:
    return F.regexp_replace(text, as_in_sql(r"[\s.]+$"), "")


def _name(text: Column) -> Column:
    return F.regexp_extract(text, as_in_sql(f"^({NAME})"), 1)


def _words(text: Column) -> Column:
    return F.size(F.split(text, as_in_sql(r"\s+")))


def shaped(rule: Rule, probe: Column, rest: Column, before: Column) -> Column:
    """The draft that a rule makes of the words behind its cue (and before it), or null."""
    clause = _undotted(rest)
    prefix = lambda text: F.concat(F.lit(rule.key), slug(text, rule.words))
    if rule.shape == "name":
        value = _name(rest)
        return F.when(F.length(value) >= 2, _draft(rule.name, rule.kind, F.lit(rule.key), value, rule.confidence))
    if rule.shape == "person":
        key = F.concat(F.lit("person."), slug(before, rule.words), F.lit(rule.key))
        fine = (F.length(before) >= 2) & (F.length(rest) >= 2) & ~lowered(before).isin(*PRONOUNS)
        return F.when(fine, _draft(rule.name, rule.kind, key, rest, rule.confidence))
    whole = (clause != "") & (_words(clause) <= rule.most)
    if rule.shape == "clause":
        value = clause if rule.name != "rule" else F.concat(F.when(probe.rlike(as_in_sql(opening(NEGATIVE))), "never: ").otherwise(""), clause)
        return F.when(whole, _draft(rule.name, rule.kind, prefix(clause), value, rule.confidence))
    one, two = (F.regexp_extract(clause, as_in_sql(SPLIT["copula" if rule.shape == "memory" else rule.shape]), i) for i in (1, 2))
    if rule.shape == "memory":
        said = F.length(slug(one, rule.words)) >= 2
        return F.when(whole, _draft(rule.name, rule.kind, F.when(said, prefix(one)).otherwise(prefix(clause)), F.when(said, two).otherwise(clause), F.when(said, 1.0).otherwise(0.9)))
    if rule.shape == "purpose":
        return F.when(whole & (F.length(slug(two, rule.words)) >= 2), _draft(rule.name, rule.kind, prefix(two), one, rule.confidence))
    value = F.regexp_replace(two, as_in_sql(LEADS[rule.shape]), "")
    if rule.shape == "copula":
        return F.when(whole & value.rlike(STATED) & (F.length(slug(one, rule.words)) >= 3), _draft(rule.name, rule.kind, prefix(one), value, rule.confidence))
    return F.when(whole & (value != ""), _draft(rule.name, rule.kind, prefix(value), value, rule.confidence, one))


def drafts(episodes: DataFrame) -> DataFrame:
    """(thread_id, seq, role, sentence, probe, no, rule, kind, key, value, supersedes, confidence): what the rules make of
    every sentence. Tools and attachments are data and state nothing. A correction that no rule reads is one by itself."""
    spoken = episodes.where(F.col("role").isin(*SPOKEN)).select("thread_id", "seq", "role", F.posexplode(sentences(F.col("content"))).alias("sentence", "s"))
    colon = F.instr("s", ": ")
    behind = F.when((colon > 1) & (colon < F.length("s") - 4), F.substring("s", colon + 2, F.length("s")))
    correcting = as_in_sql(opening(CORRECTING))
    fixed = F.when(F.col("s").rlike(correcting), F.regexp_extract("s", correcting, 1))
    probes = spoken.select("thread_id", "seq", "role", "sentence", F.posexplode(F.array(F.col("s"), behind, fixed)).alias("probe", "text")).where("text is not null")
    # each pattern runs once: what it finds is a column, and shapes read that column
    at = {r.name: i for i, r in enumerate(RULES)}
    rests = F.array(*[F.regexp_extract("text", as_in_sql(r.find), 2 if r.stands == "between" else 1) for r in RULES])
    befores = F.array(*[F.regexp_extract("text", as_in_sql(r.find), 1) if r.stands == "between" else F.lit("") for r in RULES])
    probes = probes.withColumns({"rests": rests, "befores": befores})
    one = lambda r: F.when((F.get("rests", F.lit(at[r.name])) != "") & F.col("role").isin(*r.roles), shaped(r, F.col("text"), F.get("rests", F.lit(at[r.name])), F.get("befores", F.lit(at[r.name]))))
    found = F.filter(F.array(*[one(r) for r in RULES]), lambda x: x.isNotNull())
    bare = _draft("correction.bare", "correction", F.concat(F.lit("correction."), slug(_undotted(F.col("text")), 6)), _undotted(F.col("text")), 0.8)
    found = probes.withColumn("found", found)
    whole = F.when((F.col("probe") == 2) & (F.size("found") == 0), F.array(bare)).otherwise(F.col("found"))
    rows = found.select("thread_id", "seq", "role", "sentence", "probe", F.posexplode(whole).alias("no", "d")).select("thread_id", "seq", "role", "sentence", "probe", "no", "d.*")
    by_rule = F.when((F.col("probe") == 2) & (F.col("rule") != "correction.bare"), F.concat("rule", F.lit("+correction"))).otherwise(F.col("rule"))
    return rows.withColumn("rule", by_rule)


def bounded(found: DataFrame, most: int) -> DataFrame:
    """The first `most` drafts of each episode, and whether there was one more."""
    order = Window.partitionBy("thread_id", "seq").orderBy("sentence", "probe", "no")
    placed = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most + 1)
    whole = F.max("_r").over(Window.partitionBy("thread_id", "seq")) > most
    return placed.withColumn("overflow", whole).where(F.col("_r") <= most).drop("_r")


PLACE = ("seq", "sentence", "probe", "no")  # of a draft in its thread


def _resolved_once(found: DataFrame) -> DataFrame:
    """(thread_id, *PLACE, own, key, norm, old, authority) with each correction's key resolved against the supported values
    that the keys of the last round give."""
    first = found.groupBy("thread_id", "seq", "key").agg(F.min(F.struct("sentence", "probe", "no", "norm", "authority")).alias("d"))
    said = first.where("d.authority = 'user'").select("thread_id", "key", F.struct("seq", "d.sentence", "d.probe", "d.no").alias("at"), F.col("d.norm").alias("norm"))
    order = Window.partitionBy("thread_id", "key").orderBy("at")
    changes = said.withColumn("_p", F.lag("norm").over(order)).where(~F.col("norm").eqNullSafe(F.col("_p")))
    held = changes.select("thread_id", F.col("norm").alias("old"), F.col("key").alias("holder"), F.col("at").alias("since"), F.lead("at").over(order).alias("until"))
    fixes = found.where("old is not null").withColumn("at", F.struct(*PLACE))
    hit = fixes.join(held, ["thread_id", "old"]).where("since < at and (until is null or until >= at)")
    best = hit.groupBy("thread_id", *PLACE).agg(F.max(F.struct("since", "holder"))["holder"].alias("holder"))
    rows = found.join(best, ["thread_id", *PLACE], "left")
    return rows.withColumn("key", F.when(F.col("old").isNull(), F.col("key")).otherwise(F.coalesce("holder", "own"))).drop("holder")


def corrected(found: DataFrame) -> DataFrame:
    """Drafts with each correction put to the key that holds the value it replaces: the key whose supported value that is
    when the correction is made, the one stated last if there are several; a correction of a value that no key holds stays
    under a key of its own. The user's corrections are statements that later ones correct in turn.

    A fixed point: every round resolves all corrections against the intervals that the keys of the round before give. What a
    correction finds depends on earlier drafts of its thread only, so after n rounds the first n links of every chain are
    right, whatever the rest was, and the rounds end when no key changes. A round is one interval join on equal values;
    threads whose keys haven't changed take no part in the next one. Each round is written, so lineage stays short.
    """
    found = stored(found, "drafts")
    norm = lambda c: collapsed(F.col(c))
    slim = found.select("thread_id", *PLACE, F.col("key").alias("own"), "key", norm("value").alias("norm"), norm("supersedes").alias("old"), authority(F.col("role")).alias("authority"))
    fixing = slim.where("old is not null").select("thread_id").distinct()
    open_, settled = stored(slim.join(fixing, "thread_id", "left_semi"), "open"), []
    while True:
        after = _resolved_once(open_)
        now = stored(open_.withColumnRenamed("key", "was").join(after.select("thread_id", *PLACE, "key"), ["thread_id", *PLACE]), "resolved")
        moved = now.where("old is not null").groupBy("thread_id").agg(F.bool_or(F.col("was") != F.col("key")).alias("moved"))
        ends = now.where("old is not null").join(moved.where("not moved"), "thread_id", "left_semi")
        settled.append(ends.select("thread_id", *PLACE, F.col("key").alias("resolved")))
        going = moved.where("moved")
        if going.isEmpty():
            break
        open_ = now.join(going, "thread_id", "left_semi").drop("was")
    keys = settled[0]
    for more in settled[1:]:
        keys = keys.union(more)
    return found.join(keys, ["thread_id", *PLACE], "left").withColumn("key", F.coalesce("resolved", "key")).drop("resolved")


def statements(found: DataFrame) -> DataFrame:
    """(thread_id, key, seq, value, authority): the first draft of a key in an episode counts."""
    first = found.groupBy("thread_id", "seq", "key").agg(F.min(F.struct("sentence", "probe", "no", "value", "role")).alias("d"))
    return first.select("thread_id", "key", "seq", F.col("d.value").alias("value"), authority(F.col("d.role")).alias("authority"))


def quoted_candidates(candidates: DataFrame, episodes: DataFrame, most: int) -> DataFrame:
    """Candidates (thread_id, seq, quote, ...) from outside that quote their episode word for word, and a receipt of each
    episode: how many came, how many are verbatim, whether all were and they were at most `most`."""
    rows = candidates.join(episodes.select("thread_id", "seq", "content"), ["thread_id", "seq"])
    return rows.groupBy("thread_id", "seq").agg(F.count("*").alias("came"), F.count_if(F.contains("content", F.col("quote"))).alias("verbatim")).withColumn("complete", (F.col("came") == F.col("verbatim")) & (F.col("came") <= most))


# ---- the same as SQL ----------------------------------------------------------------------------------------


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _undotted_sql(text: str) -> str:
    return f"regexp_replace({text}, '[\\s.]+$', '')"


def rule_sql(no: int, rule: Rule) -> str:
    between = rule.stands == "between"
    rest, before = (f"regexp_extract(text, {_q(rule.find)}, {i})" for i in ((2, 1) if between else (1, 1)))
    clause = _undotted_sql(rest)
    supersedes, confidence = "CAST(NULL AS VARCHAR)", f"{rule.confidence}e0"
    fine = f"{clause} <> '' AND len(string_split_regex({clause}, '\\s+')) <= {rule.most}"
    pattern = SPLIT.get("copula" if rule.shape == "memory" else rule.shape, "")
    one, two = (f"regexp_extract({clause}, {_q(pattern)}, {i})" for i in (1, 2))
    prefix = lambda text: f"{_q(rule.key)} || {slug_sql(text, rule.words)}"
    if rule.shape == "name":
        key, value = _q(rule.key), f"regexp_extract({rest}, {_q(f'^({NAME})')}, 1)"
        fine = f"length({value}) >= 2"
    elif rule.shape == "person":
        key, value = f"'person.' || {slug_sql(before, rule.words)} || {_q(rule.key)}", rest
        fine = f"length({before}) >= 2 AND length({rest}) >= 2 AND lower({before}) NOT IN ({', '.join(map(_q, PRONOUNS))})"
    elif rule.shape == "clause":
        key, value = prefix(clause), clause
        if rule.name == "rule":
            value = f"CASE WHEN regexp_matches(text, {_q(opening(NEGATIVE))}) THEN 'never: ' ELSE '' END || {clause}"
    elif rule.shape == "memory":
        said = f"length({slug_sql(one, rule.words)}) >= 2"
        key, value, confidence = f"CASE WHEN {said} THEN {prefix(one)} ELSE {prefix(clause)} END", f"CASE WHEN {said} THEN {two} ELSE {clause} END", f"CASE WHEN {said} THEN 1e0 ELSE 0.9e0 END"
    elif rule.shape == "purpose":
        key, value = prefix(two), one
        fine += f" AND length({slug_sql(two, rule.words)}) >= 2"
    else:
        value = f"regexp_replace({two}, {_q(LEADS[rule.shape])}, '')"
        if rule.shape == "copula":
            key = prefix(one)
            fine += f" AND regexp_matches({value}, {_q(STATED)}) AND length({slug_sql(one, rule.words)}) >= 3"
        else:
            key, supersedes = prefix(value), one
            fine += f" AND {value} <> ''"
    roles = ", ".join(map(_q, rule.roles))
    return f"SELECT thread_id, seq, role, sentence, probe, {no} AS r, {_q(rule.name)} AS rule, {_q(rule.kind)} AS kind, {key} AS key, {value} AS value, {supersedes} AS supersedes, {confidence} AS confidence FROM probe WHERE role IN ({roles}) AND {rest} <> '' AND {fine}"


def drafts_sql(source: str) -> str:
    """Common table expressions up to `draft`, with the columns of drafts()."""
    clause, fixed = _undotted_sql("text"), _q(opening(CORRECTING))
    return f"""sen AS (SELECT thread_id, seq, role, unnest(generate_series(1, len({sentences_sql('content')}))) - 1 AS sentence, {sentences_sql('content')} AS all_s FROM {source} WHERE role IN ('user', 'assistant') AND len({sentences_sql('content')}) > 0),
one AS (SELECT thread_id, seq, role, sentence, all_s[sentence + 1] AS s FROM sen),
probe AS (SELECT thread_id, seq, role, sentence, 0 AS probe, s AS text FROM one
  UNION ALL SELECT thread_id, seq, role, sentence, 1, substr(s, instr(s, ': ') + 2) FROM one WHERE instr(s, ': ') > 1 AND instr(s, ': ') < length(s) - 4
  UNION ALL SELECT thread_id, seq, role, sentence, 2, regexp_extract(s, {fixed}, 1) FROM one WHERE regexp_matches(s, {fixed})),
hit AS ({" UNION ALL ".join(rule_sql(i, r) for i, r in enumerate(RULES))}),
draft AS (SELECT thread_id, seq, role, sentence, probe, row_number() OVER (PARTITION BY thread_id, seq, sentence, probe ORDER BY r) - 1 AS no, rule || CASE WHEN probe = 2 THEN '+correction' ELSE '' END AS rule, kind, key, value, supersedes, confidence FROM hit
  UNION ALL SELECT thread_id, seq, role, sentence, probe, 0, 'correction.bare', 'correction', 'correction.' || {slug_sql(clause, 6)}, {clause}, CAST(NULL AS VARCHAR), 0.8e0 FROM probe p WHERE probe = 2 AND NOT EXISTS (SELECT 1 FROM hit h WHERE h.thread_id = p.thread_id AND h.seq = p.seq AND h.sentence = p.sentence AND h.probe = 2))"""


def corrected_sql() -> str:
    """Common table expressions from `draft` to `fixed`: a fold over a thread's drafts in order, whose state is the list of
    supported values by key, and the keys that the episode has stated so far."""
    norm = lambda c: f"lower(trim(regexp_replace({c}, '\\s+', ' ', 'g')))"
    return f"""ordered AS (SELECT thread_id, seq, sentence, probe, no, key AS own, {norm('value')} AS norm, {norm('supersedes')} AS old, role <> 'assistant' AS user, row_number() OVER (PARTITION BY thread_id ORDER BY seq, sentence, probe, no) AS i FROM draft),
walk AS (SELECT thread_id, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS key, CAST([] AS STRUCT(i BIGINT, key VARCHAR, norm VARCHAR)[]) AS held, CAST([] AS VARCHAR[]) AS stated FROM (SELECT DISTINCT thread_id FROM ordered)
  UNION ALL SELECT thread_id, i, seq, key, CASE WHEN user AND NOT again AND coalesce(list_filter(held, lambda h: h.key = key)[1].norm <> norm, true) THEN list_append(list_filter(held, lambda h: h.key <> key), {{'i': i, 'key': key, 'norm': norm}}) ELSE held END, CASE WHEN again THEN stated ELSE list_append(stated, key) END
  FROM (SELECT *, list_contains(stated, key) AS again FROM (SELECT s.*, w.held, CASE WHEN w.seq = s.seq THEN w.stated ELSE CAST([] AS VARCHAR[]) END AS stated, CASE WHEN s.old IS NULL THEN s.own ELSE coalesce(list_last(list_sort(list_filter(w.held, lambda h: h.norm = s.old))).key, s.own) END AS key FROM walk w JOIN ordered s ON s.thread_id = w.thread_id AND s.i = w.i + 1))),
fixed AS (SELECT d.* EXCLUDE (key), w.key FROM draft d JOIN ordered o USING (thread_id, seq, sentence, probe, no) JOIN walk w ON w.thread_id = o.thread_id AND w.i = o.i)"""
