"""Queries over the claims that drafts make."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims
from ..sources.episodes import TALK_SQL, table, talk_episodes
from .registry import query

_ALL = 'SELECT {key}, family, start, end_ AS "end", claim FROM claims'


@query("WITH " + claims.claims_sql("documents", "doc_id", "text") + " " + _ALL.format(key="doc_id"))
def document_claims(spark, d):
    """Claims of all families in whole documents."""
    return claims.claim_spans(table(spark, d, "documents"), "doc_id", "text")


# Conversations as drafts: some get a quote around their first sentence, a count or a code in front.
_DRAFT = "CASE event_id % 5 WHEN 0 THEN 'There are ' || CAST(event_id % 90 AS VARCHAR) || ' units in it. ' || content WHEN 1 THEN 'They said \"' || content || '\" at 12.5 ms.' WHEN 2 THEN 'ticket-' || CAST(event_id AS VARCHAR) || ' is open! ' || content WHEN 3 THEN 'Maybe it has 7%? ' || content ELSE content END"


@query(f"WITH {TALK_SQL}, draft AS (SELECT event_id, {_DRAFT} AS content FROM talk), {claims.claims_sql('draft', 'event_id', 'content')} " + _ALL.format(key="event_id"))
def draft_claims(spark, d):
    """Claims in drafts where families meet in the same characters."""
    no, e = F.col("event_id"), F.col("content")
    n = F.pmod(no, F.lit(5))
    draft = F.when(n == 0, F.concat(F.lit("There are "), (no % 90).cast("string"), F.lit(" units in it. "), e)).when(n == 1, F.concat(F.lit('They said "'), e, F.lit('" at 12.5 ms.'))).when(n == 2, F.concat(F.lit("ticket-"), no.cast("string"), F.lit(" is open! "), e)).when(n == 3, F.concat(F.lit("Maybe it has 7%? "), e)).otherwise(e)
    return claims.claim_spans(talk_episodes(spark, d).select("event_id", draft.alias("content")), "event_id")
