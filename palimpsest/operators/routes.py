"""Routes from a question to episodes: what each finds, when it may be asked, and how their pages share a budget.

A route is a DataFrame of (question_id, thread_id, seq, rank, route). A question never is its own witness: only episodes
before `query_seq` are found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import approx_tokens, collapsed, search_terms, terms_of

# Words that ask, that point back, and that speak of me or of you.
ASKING = "what where when who which why how did do does is are was were can could".split()
BACK = (
    "my mine our did was were had ago earlier before previously last back remember remembered remembers recall recalled recalls remind reminded reminds "
    "mention mentioned mentions said told discuss discussed discussing discusses talk talked talking talks decide decided decides agree agreed agrees "
    "promise promised promises chose name named names call called calls"
).split()
FIRST, SECOND = "i me my mine".split(), "you your".split()
# The order of routes.
ORDER = ("range", "sequence", "address", "semantic", "fact", "ledger", "historical", "attachment", "lexical", "path", "reply")


def word_pattern(words: list[str]) -> str:
    return "(?:^|[^a-z0-9_])(?:" + "|".join(words) + ")(?:[^a-z0-9_]|$)"


def cues(text: Column) -> list[Column]:
    low = F.lower(text)
    has = lambda words: low.rlike(word_pattern(words))
    return [(F.contains(text, F.lit("?")) | has(ASKING)).alias("asks"), has(BACK).alias("back"), has(FIRST).alias("first_person"), has(SECOND).alias("second_person"), F.size(search_terms(text)).cast("long").alias("terms")]


def _route(rows: DataFrame, route: str, *order: Column | str) -> DataFrame:
    """One row per episode of a question, ranked within the route."""
    best = rows.groupBy("question_id", "thread_id", "seq").agg(F.min(F.struct(*order)).alias("o"))
    rank = F.row_number().over(Window.partitionBy("question_id", "thread_id").orderBy("o", "seq"))
    return best.select("question_id", "thread_id", "seq", rank.cast("long").alias("rank"), F.lit(route).alias("route"))


def by_range(asked: DataFrame, episodes: DataFrame, most: int = 12) -> DataFrame:
    """Explicit ranges (question_id, thread_id, from_seq, to_seq): their first episodes. A range is cut before it meets
    the archive, so asking for [1, 10**9] reads no more."""
    seq = F.explode(F.sequence("from_seq", F.least("to_seq", F.col("from_seq") + most - 1))).alias("seq")
    rows = asked.where("from_seq <= to_seq").select("question_id", "thread_id", seq)
    return _route(rows.join(episodes.select("thread_id", "seq"), ["thread_id", "seq"]), "range", "seq")


def neighbours(hits: DataFrame, episodes: DataFrame, within: int = 12) -> DataFrame:
    """For each hit the nearest spoken episode of the other side: the assistant's behind a user's turn, the user's before
    an assistant's. One window over the thread gives both."""
    order = Window.partitionBy("thread_id").orderBy("seq")
    speech = lambda who: F.when((F.col("role") == who) & ~F.col("removed"), F.col("seq"))
    behind = F.first(speech("assistant"), ignorenulls=True).over(order.rowsBetween(1, within))
    before = F.last(speech("user"), ignorenulls=True).over(order.rowsBetween(-within, -1))
    near = episodes.select("thread_id", "seq", F.when(F.col("role") == "user", behind).when(F.col("role") == "assistant", before).alias("near"))
    return hits.select("question_id", "thread_id", "seq").join(near, ["thread_id", "seq"]).where("near is not null").select("question_id", "thread_id", "seq", "near")


def address_digest(text: Column, version: str = "v1") -> Column:
    return F.sha2(F.concat(F.lit(version + "|"), collapsed(text)), 256)


def effective_addresses(edges: DataFrame, closures: DataFrame, episodes: DataFrame) -> DataFrame:
    """Edges without a closing event whose witness still has the content that they were recorded with."""
    open_ = edges.join(closures.select("edge_id").distinct(), "edge_id", "left_anti")
    now = episodes.where(~F.col("removed")).select("thread_id", "seq", F.sha2("content", 256).alias("now"))
    return open_.join(now, ["thread_id", "seq"]).where("now = content_hash").drop("now")


def by_address(questions: DataFrame, edges: DataFrame) -> DataFrame:
    asked = questions.select("question_id", "thread_id", "query_seq", address_digest(F.col("text")).alias("digest"))
    return _route(edges.join(asked, ["thread_id", "digest"]).where("seq < query_seq"), "address", (-F.col("seq")).alias("new"))


def verified_hits(hits: DataFrame, episodes: DataFrame, questions: DataFrame) -> DataFrame:
    """Hits given from outside (question_id, thread_id, seq, quote, score) with the reason why each is refused, or null."""
    rows = hits.join(questions.select("question_id", "query_seq"), "question_id", "left").join(episodes.select("thread_id", "seq", "role", "removed", "content"), ["thread_id", "seq"], "left")
    why = F.when(F.col("role").isNull(), "missing").when(F.col("removed"), "removed").when(~F.col("role").isin("user", "tool", "attachment", "assistant"), "role").when(F.col("seq") >= F.col("query_seq"), "self").when(~F.contains("content", F.col("quote")), "quote")
    return rows.select("question_id", "thread_id", "seq", "score", why.alias("refused"))


def by_fact(asked: DataFrame, index: DataFrame, phase: str, most: int, route: str) -> DataFrame:
    """Sources of facts with an asked name (question_id, thread_id, query_seq, name) as key or value, the newest `most`."""
    hits = asked.join(index.where(F.col("phase") == phase), ["thread_id", "name"]).where("valid_from < query_seq").withColumn("seq", F.col("valid_from"))
    order = Window.partitionBy("question_id", "name").orderBy(F.desc("seq"), "key", "part")
    return _route(hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most), route, "_r")


def by_loss(asked: DataFrame, losses: DataFrame, most: int = 4) -> DataFrame:
    """The newest places of asked names that summaries have lost."""
    hits = asked.join(losses.select("thread_id", "name", "seq").distinct(), ["thread_id", "name"]).where("seq < query_seq")
    order = Window.partitionBy("question_id", "name").orderBy(F.desc("seq"))
    return _route(hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most), "ledger", "_r")


def by_attachment(asked: DataFrame, names: DataFrame) -> DataFrame:
    """The one earlier episode of its thread that has an asked code name; several are no answer."""
    hits = asked.where("kind = 'code'").join(names.select("thread_id", "name", "seq").distinct(), ["thread_id", "name"]).where("seq < query_seq")
    sole = hits.groupBy("question_id", "thread_id", "name").agg(F.min("seq").alias("seq"), F.count("*").alias("n")).where("n = 1")
    return _route(sole, "attachment", "name")


def by_words(questions: DataFrame, episodes: DataFrame, most: int = 8, serve: int = 2) -> DataFrame:
    """Strict search: episodes of the thread with every term of a question that asks with two terms or more, newest first;
    of at most `most`, `serve` are served."""
    q = questions.select("question_id", "thread_id", "query_seq", *cues(F.col("text")), search_terms(F.col("text")).alias("want")).where("asks and terms >= 2")
    said = episodes.where(~F.col("removed")).select("thread_id", "seq", F.array_distinct(terms_of(F.col("content"))).alias("have"))
    hits = q.join(said, "thread_id").where((F.col("seq") < F.col("query_seq")) & (F.size(F.array_except("want", "have")) == 0))
    ranked = _route(hits, "lexical", (-F.col("seq")).alias("new")).where(F.col("rank") <= most)
    return ranked.where(F.col("rank") <= serve)


def by_path(hits: DataFrame, episodes: DataFrame, receipts: DataFrame, most: int = 2) -> DataFrame:
    """From hits of the assistant over the receipt of their turn (thread_id, seq, pages: array of source seqs) to what was
    shown there, one step."""
    said = hits.join(episodes.where("role = 'assistant'").select("thread_id", "seq"), ["thread_id", "seq"])
    pages = said.join(receipts, ["thread_id", "seq"]).select("question_id", "thread_id", F.col("seq").alias("via"), F.explode("pages").alias("seq")).where("seq >= 1")
    order = Window.partitionBy("question_id", "via").orderBy(F.desc("seq"))
    return _route(pages.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most), "path", (-F.col("seq")).alias("new"))


def faults(questions: DataFrame, found: DataFrame) -> DataFrame:
    """Questions that point back, have a term, and that no route answers."""
    q = questions.select("question_id", "thread_id", *cues(F.col("text")))
    return q.where("asks and back and terms >= 1").join(found.select("question_id").distinct(), "question_id", "left_anti").select("question_id", "thread_id", "terms")


def pages(routes: list[DataFrame], episodes: DataFrame, budget: int, room: int = 60, each: int = 450, most: int | None = None) -> DataFrame:
    """The pages of each question: candidates of all routes, an episode counting for its first one, in route order. A page
    is served while fewer than max(1, budget / each) are and more than `room` tokens are left; a removed episode never."""
    most = most or max(1, budget // each)
    rows = routes[0]
    for r in routes[1:]:
        rows = rows.unionByName(r)
    place = F.array_position(F.array(*[F.lit(r) for r in ORDER]), F.col("route"))
    first = rows.withColumn("place", place).groupBy("question_id", "thread_id", "seq").agg(F.min(F.struct("place", "rank", "route")).alias("best"))
    live = episodes.where(~F.col("removed")).select("thread_id", "seq", approx_tokens(F.col("content")).alias("tokens"))
    order = Window.partitionBy("question_id").orderBy("best.place", "best.rank", F.desc("seq"))
    ranked = first.join(live, ["thread_id", "seq"]).withColumn("page", F.row_number().over(order).cast("long")).withColumn("used", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.where((F.col("page") <= most) & (F.col("used") - F.col("tokens") < budget - room)).select("question_id", "page", "seq", F.col("best.route").alias("route"), "used")
