"""Receipts: collections and their cardinality, claims and their support, reachability, removal, attachments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .budget import islands

# Words that ask for a collection, words for its members, number words from zero, words that name nothing,
# and where it is looked for.
CUES = ("all", "every", "compare", "list", "each")
MEMBERS = ("item", "items", "note", "notes", "record", "records", "turn", "turns", "source", "sources", "owner", "owners", "place", "places")
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
FILLERS = ("of", "the")
WHOLES = ("archive", "conversation", "thread")
NEAR_CUE = 4  # words behind a cue in which its count may stand
# Openings that claim completeness before a number, verbs that do behind it, and what is said instead.
COMPLETE = ("there are", "there were", "exactly", "all")
COMPLETED = ("found", "located", "listed")
FOUND = "I found"


def collection(text: Column) -> list[Column]:
    """Cue, cardinality (null if the question has none) and subject of a collection question.

    The question up to its first colon is a sequence of words. The cue is the first cue word. The count is the first number
    in digits with a cue at most NEAR_CUE words before it, else the first in front of a member word, else the first number
    word with a cue so near that another word follows, no filler ("every one of" counts nothing). The subject are the words from the cue on that are neither cues,
    numbers, member words nor fillers, and don't say "in the archive".
    """
    words = F.regexp_extract_all(F.lower(F.split(text, ":").getItem(0)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    some = lambda *values: F.array(*[F.lit(v) for v in values])
    at = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    before = lambda i: F.slice(words, F.greatest(i - NEAR_CUE + 1, F.lit(1)), F.least(i, F.lit(NEAR_CUE)))
    near = lambda x: F.arrays_overlap(before(x["i"]), some(*CUES))
    digits = lambda x: x["w"].rlike("^[0-9]{1,9}$")
    next_ = lambda x, k=1: F.coalesce(F.get(words, x["i"] + k), F.lit(""))
    first = lambda test: F.get(F.filter(at, test), F.lit(0))["w"]
    spelled = F.array_position(some(*NUMBERS), first(lambda x: x["w"].isin(*NUMBERS) & near(x) & next_(x).rlike(r"^\p{L}") & ~next_(x).isin(*FILLERS))) - 1
    count = F.coalesce(first(lambda x: digits(x) & near(x)).try_cast("long"), first(lambda x: digits(x) & next_(x).isin(*MEMBERS)).try_cast("long"), spelled.cast("long"))
    cue = first(lambda x: x["w"].isin(*CUES))
    named = lambda x: ~x["w"].isin(*CUES, *MEMBERS, *NUMBERS, *FILLERS) & ~digits(x) & ~x["w"].isin(*WHOLES) & ~((x["w"] == "in") & (next_(x) == "the") & next_(x, 2).isin(*WHOLES))
    asked = F.filter(at, lambda x: (x["i"] >= F.array_position(words, cue) - 1) & named(x))
    return [cue.alias("cue"), count.alias("required"), F.array_join(F.transform(asked, lambda x: x["w"]), " ").alias("subject")]


def collection_sql(text: str) -> str:
    some = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    words = f"regexp_extract_all(lower(split_part({text}, ':', 1)), '([\\p{{L}}\\p{{N}}_]+)', 1)"
    near = f"len(list_filter(words[greatest(i - {NEAR_CUE}, 1):i - 1], lambda c: c IN {some(CUES)})) > 0"
    digits, next_ = "regexp_matches(w, '^[0-9]{1,9}$')", lambda k=1: f"coalesce(words[i + {k}], '')"
    first = lambda test: f"list_filter(words, lambda w, i: {test})[1]"
    cue = first(f"w IN {some(CUES)}")
    numbers = "[" + ", ".join(f"'{n}'" for n in NUMBERS) + "]"
    spelled = first(f"w IN {some(NUMBERS)} AND {near} AND regexp_matches({next_()}, '^\\p{{L}}') AND {next_()} NOT IN {some(FILLERS)}")
    count = f"coalesce(TRY_CAST({first(f'{digits} AND {near}')} AS BIGINT), TRY_CAST({first(f'{digits} AND {next_()} IN {some(MEMBERS)}')} AS BIGINT), CAST(list_position({numbers}, {spelled}) - 1 AS BIGINT))"
    named = f"w NOT IN {some((*CUES, *MEMBERS, *NUMBERS, *FILLERS, *WHOLES))} AND NOT {digits} AND NOT (w = 'in' AND {next_()} = 'the' AND {next_(2)} IN {some(WHOLES)})"
    subject = f"coalesce(array_to_string(list_filter(words, lambda w, i: i >= list_position(words, {cue}) AND {named}), ' '), '')"
    fill = lambda part: part.replace("words", words)
    return f"{fill(cue)} AS cue, {fill(count)} AS required, {fill(subject)} AS subject"


def _phrases(phrases: tuple[str, ...]) -> str:
    return "(?:" + "|".join(p.replace(" ", r"\s+") for p in phrases) + ")"


# a number behind an opening, then what is said of it
_OPENED = rf"(?i)\b{_phrases(COMPLETE)}\s+([0-9]+)\b"
_CLOSED = rf"{FOUND} ([0-9]+) ([^.!?\n]+?)\s+(?i:are|were)\s+(?i:{'|'.join(COMPLETED)})\b"


def safe_wording(text: Column) -> Column:
    """Claims to completeness in front of numbers become what was found."""
    return F.regexp_replace(F.regexp_replace(text, _OPENED, f"{FOUND} $1"), _CLOSED, f"{FOUND} $1 $2")


def safe_wording_sql(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '{_OPENED}', '{FOUND} \\1', 'g'), '{_CLOSED}', '{FOUND} \\1 \\2', 'g')"


def singular(word: Column) -> Column:
    return F.regexp_replace(word, "s$", "")


def covering(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(question_id, source_seq, ...) of the rows (thread_id, source_seq, text, ...) before a question (question_id,
    thread_id, query_seq, subject) that have all words of its subject, plurals without their s. Words meet by thread and
    word, after the rows' words are cut to asked ones; a subject without words is about nothing."""
    each = lambda df, text: F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.lower(df), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), singular))).alias(text)
    asked = questions.select("question_id", "thread_id", "query_seq", each(F.col("subject"), "word"))
    need = asked.groupBy("question_id").agg(F.count("*").alias("need"))
    others = [c for c in rows.columns if c not in ("thread_id", "source_seq", "text")]
    there = rows.select("thread_id", "source_seq", F.col("text").alias("_row"), *others, each(F.col("text"), "word")).join(asked.select("thread_id", "word").distinct(), ["thread_id", "word"], "left_semi")
    hits = asked.join(there, ["thread_id", "word"]).where("source_seq < query_seq").groupBy("question_id", "source_seq", "_row", *others).agg(F.countDistinct("word").alias("have"))
    return hits.join(need, "question_id").where("have = need").drop("have", "need", "_row")


def collection_receipt(questions: DataFrame, locators: DataFrame) -> DataFrame:
    """Per question (question_id, required) with its locators (question_id, source_seq, status): counts over distinct places,
    the strongest status of each, whether the collection is complete, and what keeps it from being so."""
    rank = F.array_position(F.array(*[F.lit(s) for s in ("unresolved", "proposed", "historical", "supported")]), F.col("status"))
    places = locators.groupBy("question_id", "source_seq").agg(F.max_by("status", rank).alias("status"))
    counts = places.groupBy("question_id").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("supported", "historical", "proposed", "unresolved")])
    rows = questions.select("question_id", "required").join(counts, "question_id", "left").fillna(0, ["supported", "historical", "proposed", "unresolved"])
    located = F.col("supported") + F.col("historical") + F.col("proposed")
    missing = F.greatest(F.col("unresolved"), F.coalesce(F.col("required"), F.lit(0)) - F.col("supported"))
    flags = F.array_compact(F.array(F.when(F.col("required").isNull(), "unknown-cardinality"), F.when(missing > 0, "unresolved"), F.when(F.col("historical") > 0, "historical"), F.when(F.col("required").isNotNull() & (located > F.col("required")), "surplus")))
    complete = F.coalesce((located == F.col("required")) & (F.col("supported") == F.col("required")) & (F.col("historical") == 0) & (missing == 0), F.lit(False))
    return rows.select("question_id", "required", located.alias("located"), "supported", "historical", missing.alias("unresolved"), complete.alias("complete"), F.array_join(flags, ",").alias("issues"))


# ---- claims -------------------------------------------------------------------------------------------------


def claim_classes(claims: DataFrame, said: DataFrame) -> DataFrame:
    """Claims (thread_id, seq, name, start) with the best class of evidence before them: SUPPORTED if somebody else than the
    assistant said it and it stands, HISTORICAL if only in removed episodes, PROPOSED if only the assistant did, else
    UNKNOWN. First sights of each name and kind of witness are all that is joined, so no pair is listed."""
    kind = F.when(F.col("removed"), "HISTORICAL").when(F.col("role") == "assistant", "PROPOSED").otherwise("SUPPORTED")
    first = said.withColumn("kind", kind).groupBy("thread_id", "name").agg(*[F.min(F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in ("SUPPORTED", "HISTORICAL", "PROPOSED")])
    rows = claims.join(first, ["thread_id", "name"], "left")
    best = F.when(F.col("SUPPORTED") < F.col("seq"), "SUPPORTED").when(F.col("HISTORICAL") < F.col("seq"), "HISTORICAL").when(F.col("PROPOSED") < F.col("seq"), "PROPOSED").otherwise("UNKNOWN")
    return rows.select("thread_id", "seq", "name", "start", best.alias("class"))


def gate(classified: DataFrame) -> DataFrame:
    """Per answer: its claims, its distinct classes in order of appearance, and whether it may be released."""
    first = classified.groupBy("thread_id", "seq", "class").agg(F.min("start").alias("start"), F.count("*").alias("n"))
    rows = first.groupBy("thread_id", "seq").agg(F.array_sort(F.collect_list(F.struct("start", "class"))).alias("c"), F.sum("n").alias("claims"))
    classes = F.transform("c", lambda x: x["class"])
    return rows.select("thread_id", "seq", "claims", F.array_join(classes, ",").alias("classes"), (F.size(F.filter(classes, lambda c: c != "SUPPORTED")) == 0).alias("released"))


# Verbs of the relations, by what they need before them.
BEING, DOING, DENYING = ("is", "are", "was", "were"), ("does", "do", "did"), ("not", "never")
VERBS = (("owner", "being", ("owner of", "the owner of")), ("owner", "doing", ("own", "owns", "owned")), ("location", "doing", ("live in", "lives in", "lived in")), ("location", "being", ("in", "based in", "living in")))


def _sentence(needs: str, verbs: tuple[str, ...]) -> str:
    """Subject, form of be (or of do, if any), denial if any, verb, object: groups 1 to 3 are subject, denial and object."""
    helping = rf"(?:{'|'.join(BEING)})\s+" if needs == "being" else rf"(?:(?:{'|'.join(DOING)})\s+)?"
    return rf"(?i)^(\S.*?)\s+{helping}(?:({'|'.join(DENYING)})\s+)?{_phrases(verbs)}\s+(\S.*)$"


RELATIONS = tuple((name, _sentence(needs, verbs)) for name, needs, verbs in VERBS)


def relation(sentence: Column) -> Column:
    """(relation, subject, object, negated) of a sentence, by the first shape that fits; null without one."""
    clause = F.regexp_replace(F.trim(sentence), "[.!?;]+$", "")
    argument = lambda c: F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^(?:the|an|a)\s+", ""))
    out = F.lit(None)
    for name, find in reversed(RELATIONS):
        part = lambda i, find=find: F.regexp_extract(clause, find, i)
        out = F.when(clause.rlike(find), F.struct(F.lit(name).alias("relation"), argument(part(1)).alias("subject"), argument(part(3)).alias("object"), (part(2) != "").alias("negated"))).otherwise(out)
    return out


def relation_sql(sentence: str) -> str:
    clause = f"regexp_replace(trim({sentence}), '[.!?;]+$', '')"
    argument = lambda c: f"trim(regexp_replace(lower(trim({c})), '^(?:the|an|a)\\s+', ''))"
    cases = []
    for name, find in RELATIONS:
        part = lambda i, find=find: f"regexp_extract({clause}, '{find}', {i})"
        cases.append(f"WHEN regexp_matches({clause}, '{find}') THEN struct_pack(relation := '{name}', subject := {argument(part(1))}, object := {argument(part(3))}, negated := {part(2)} <> '')")
    return "CASE " + " ".join(cases) + " END"


# ---- reachability -------------------------------------------------------------------------------------------


def reachability(heads: DataFrame, residents: DataFrame, windows: DataFrame, span: int) -> DataFrame:
    """[1, head] of each thread cut at residents and sealed windows into runs of equal state: resident, capsule (and which)
    or pageable; neighbours of equal state are one run."""
    edges = lambda df, a, b: df.select("thread_id", F.explode(F.array(a, b)).alias("at"))
    cuts = edges(heads, F.lit(1).cast("long"), F.col("head_seq") + 1).union(edges(residents, F.col("seq"), F.col("seq") + 1)).union(edges(windows, F.col("from_seq"), F.col("to_seq") + 1)).distinct()
    order = Window.partitionBy("thread_id").orderBy("at")
    parts = cuts.withColumn("to", F.lead("at").over(order) - 1).where("to is not null")
    here = residents.select("thread_id", F.col("seq").alias("at"), F.lit(True).alias("resident"))
    sealed = windows.select("thread_id", "no", F.lit(True).alias("sealed"))
    rows = parts.withColumn("no", F.floor((F.col("at") - 1) / span).cast("long")).join(here, ["thread_id", "at"], "left").join(sealed, ["thread_id", "no"], "left")
    state = F.when(F.col("resident"), "resident").when(F.col("sealed"), F.concat(F.lit("capsule "), F.col("no").cast("string"))).otherwise("pageable")
    runs = rows.select("thread_id", F.col("at").alias("seq"), state.alias("state"), "to")
    whole = islands(runs.select("thread_id", "seq", "state"))
    ends = runs.select("thread_id", F.col("seq").alias("to_seq"), F.col("to"))
    return whole.join(ends, ["thread_id", "to_seq"]).select("thread_id", "state", "from_seq", F.col("to").alias("to_seq"))


def partition_faults(runs: DataFrame, heads: DataFrame) -> DataFrame:
    """Gaps, overlaps and wrong ends of runs that should partition [1, head]."""
    order = Window.partitionBy("thread_id").orderBy("from_seq", "to_seq")
    rows = runs.join(heads, "thread_id").withColumn("before", F.coalesce(F.lag("to_seq").over(order), F.lit(0))).withColumn("next", F.lead("from_seq").over(order))
    fault = F.when(F.col("from_seq") > F.col("before") + 1, "gap").when(F.col("from_seq") <= F.col("before"), "overlap").when(F.col("next").isNull() & (F.col("to_seq") != F.col("head_seq")), "end")
    return rows.withColumn("fault", fault).where("fault is not null").select("thread_id", "from_seq", "fault")


# ---- attachments --------------------------------------------------------------------------------------------


def _aligned(data: str, at: Column) -> Column:
    """A byte place moved back to where a character begins: at most three steps over continuation bytes."""
    inside = lambda p: F.hex(F.substring(F.col(data), (p + 1).cast("int"), F.lit(1))).between("80", "BF")
    return F.when(inside(at), F.when(inside(at - 1), F.when(inside(at - 2), at - 3).otherwise(at - 2)).otherwise(at - 1)).otherwise(at)


def aligned_spans(texts: DataFrame, key: str, chunk: int) -> DataFrame:
    """Spans of a text's UTF-8 bytes, of `chunk` bytes at most, that cut no character, with the digest of each."""
    step = chunk - 3
    rows = texts.select(key, F.encode("content", "UTF-8").alias("data")).withColumn("size", F.octet_length("data").cast("long")).where("size > 0")
    end = lambda i: F.when((i + 1) * step >= F.col("size"), F.col("size")).otherwise(_aligned("data", (i + 1) * step))
    digest = lambda x: F.sha2(F.substring(F.col("data"), (x["from_byte"] + 1).cast("int"), (x["to_byte"] - x["from_byte"]).cast("int")), 256)
    places = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / step)), lambda i: F.struct(i.alias("ordinal"), _aligned("data", i * step).alias("from_byte"), end(i).alias("to_byte")))
    whole = F.filter(places, lambda x: x["to_byte"] > x["from_byte"])
    # digests are made where the bytes are; only places and digests are exploded
    cut = F.transform(whole, lambda x: F.struct(x["ordinal"].alias("ordinal"), x["from_byte"].alias("from_byte"), x["to_byte"].alias("to_byte"), digest(x).alias("hash")))
    return rows.select(key, F.explode(cut).alias("s")).select(key, "s.*")


def manifests(spans: DataFrame, key: str) -> DataFrame:
    """One row per object: size, spans, and a digest over its spans in order."""
    text = F.concat_ws(":", "from_byte", "to_byte", "hash")
    rows = F.array_sort(F.collect_list(F.struct("ordinal", text.alias("t"))))
    return spans.groupBy(key).agg(F.max("to_byte").alias("size"), F.count("*").alias("spans"), F.sha2(F.array_join(F.transform(rows, lambda x: x["t"]), "|"), 256).alias("digest"))


def indexable(mime: Column) -> Column:
    """Whether a MIME type's text may be searched."""
    base = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))
    return base.startswith("text/") | base.isin(*[f"application/{x}" for x in ("json", "ld+json", "xml", "xhtml+xml", "javascript", "typescript", "x-ndjson")])


def name_probes(questions: DataFrame, most: int = 64) -> DataFrame:
    """(question_id, probe): what a question may call an attachment: quoted names, single tokens, runs of two to eight
    words; the first `most` of them."""
    quoted = F.regexp_extract_all("text", F.lit("[\"'`]([^\"'`\\n]{1,400})[\"'`]"), F.lit(1))
    words = F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}][\p{L}\p{N}._/-]{0,255})"), F.lit(1))
    clean = lambda w: F.regexp_replace(F.lower(F.trim(w)), r"[.,;:!?]+$", "")
    rows = questions.select("question_id", quoted.alias("q"), words.alias("w"))
    n = F.size("w")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.filter(F.sequence(F.lit(2), F.lit(8)), lambda k: i + k - 1 <= n), lambda k: F.array_join(F.slice("w", i, k), " "))))
    every = F.slice(F.array_distinct(F.transform(F.concat("q", "w", F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))), clean)), 1, most)
    return rows.select("question_id", F.explode(every).alias("probe"))


def verified_ranges(asked: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """Byte ranges (key, from_byte, to_byte, whole_hash) read from objects, each only if the whole object still has the hash
    that was recorded and the range lies inside it."""
    data = F.encode("content", "UTF-8")
    rows = asked.join(objects.select(key, data.alias("data")), key)
    size = F.octet_length("data")
    fine = (F.sha2("data", 256) == F.col("whole_hash")) & (F.col("from_byte") >= 0) & (F.col("to_byte") <= size) & (F.col("from_byte") < F.col("to_byte"))
    part = F.substring(F.col("data"), (F.col("from_byte") + 1).cast("int"), (F.col("to_byte") - F.col("from_byte")).cast("int"))
    return rows.select(key, "from_byte", "to_byte", fine.alias("verified"), F.when(fine, F.sha2(part, 256)).alias("hash"))
