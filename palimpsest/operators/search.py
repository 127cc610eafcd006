"""Lexical search: postings, BM25, strict and relaxed matching, and evidence routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stems import stems_of
from ..functions.text import search_terms, terms_of

K1, B = 1.2, 0.75


def postings(docs: DataFrame, *keys: str, only: DataFrame | None = None) -> DataFrame:
    """(keys, dl, term, tf): one row per distinct term of each text. With `only` (term), a set of query terms that the
    planner may broadcast, words are cut to these before anything is aggregated or moved."""
    rows = docs.select(*keys, terms_of(F.col("content")).alias("t"))
    each = rows.select(*keys, F.size("t").cast("long").alias("dl"), F.explode("t").alias("term"))
    if only is not None:
        each = each.join(only.select("term").distinct(), "term", "left_semi")
    return each.groupBy(*keys, "dl", "term").agg(F.count("*").alias("tf"))


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: how many texts have terms, and their mean length. Lengths need no explode."""
    n = F.size(terms_of(F.col("content")))
    return docs.select(n.alias("dl")).where("dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def query_terms(asked: DataFrame, most: int = 6) -> DataFrame:
    """(query_id, text) -> (query_id, term), the distinct search terms of each query."""
    return asked.select("query_id", F.explode(search_terms(F.col("text"), most)).alias("term"))


def stemmed(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words of the texts and queries with the stem of a query's term; query_id and stem). The texts' vocabulary is made
    distinct and stemmed once, and only words that share a stem with a query stay."""
    vocabulary = docs.select(F.explode(F.array_distinct(terms_of(F.col("content")))).alias("term"))
    stems = stems_of(vocabulary.union(terms.select("term")))
    asked = terms.join(stems, "term").select("query_id", "stem").distinct()
    return stems.join(asked.select("stem").distinct(), "stem", "left_semi").select("term", "stem"), asked


def bm25(docs: DataFrame, terms: DataFrame, key: str, n: int, exclude: DataFrame | None = None, stems: DataFrame | None = None) -> DataFrame:
    """The n best texts of each query; ties go to the smaller key. Texts in `exclude` (query_id, key) are no answers but
    count in the corpus. With `stems` (term, stem), a text's words count as their stems, and `terms` are stems. The corpus
    sums are one small row."""
    size = corpus_size(docs)
    if stems is None:
        wanted = postings(docs, key, only=terms)
    else:
        words = postings(docs, key, only=stems).join(stems, "term")
        wanted = words.groupBy(key, "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    spread = wanted.groupBy("term").agg(F.count("*").alias("df"))
    scored = wanted.join(spread, "term").crossJoin(F.broadcast(size))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    totals = terms.join(scored.select("term", key, weight.alias("w")), "term").groupBy("query_id", key).agg(F.round(F.sum("w"), 6).alias("score"), F.count("*").alias("matched"))
    if exclude is not None:
        totals = totals.join(exclude, ["query_id", key], "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return totals.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def all_terms(posted: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """Texts that have every term of a query."""
    need = terms.groupBy("query_id").agg(F.count("*").alias("need"))
    hits = terms.join(posted.select("term", key), "term").groupBy("query_id", key).agg(F.count("*").alias("have"))
    return hits.join(need, "query_id").where("have = need").select("query_id", key)


def any_long_term(posted: DataFrame, terms: DataFrame, key: str, found: DataFrame, least: int = 5, most: int = 3) -> DataFrame:
    """For queries without a strict match: texts with any of their longest terms."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.length("term")), "term")
    long = terms.where(F.length("term") >= least).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    open_ = long.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return open_.join(posted.select("term", key), "term").select("query_id", key).distinct()


def effective(edges: DataFrame, closures: DataFrame) -> DataFrame:
    """Routes without a closing event: an append-only table's state by an anti-join."""
    return edges.join(closures.select("route_id").distinct(), "route_id", "left_anti")
