"""Where queries register, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TOKENS = "CAST(ceil(length(content) / 3.6e0 * 1.1e0) AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def two_lane_sql(stated: str) -> str:
    """The law of authority as a fold: CTEs from `stated` (thread_id, key, seq, value, authority) to `fact`."""
    return f"""st AS (SELECT *, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS norm, row_number() OVER (PARTITION BY thread_id, key ORDER BY seq) AS i FROM {stated}),
fold AS (SELECT thread_id, key, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS authority, false AS made, CAST(NULL AS VARCHAR) AS sup, CAST(NULL AS VARCHAR) AS prop, CAST(NULL AS BIGINT) AS sup_seq, CAST(NULL AS BIGINT) AS prop_seq, CAST(NULL AS BIGINT) AS closed_sup, CAST(NULL AS BIGINT) AS closed_prop FROM (SELECT DISTINCT thread_id, key FROM st)
  UNION ALL SELECT f.thread_id, f.key, s.i, s.seq, s.value, s.authority,
    NOT (coalesce(f.sup = s.norm, false) OR (s.authority <> 'user' AND coalesce(f.prop = s.norm, false))),
    CASE WHEN coalesce(f.sup = s.norm, false) OR s.authority <> 'user' THEN f.sup ELSE s.norm END,
    CASE WHEN coalesce(f.sup = s.norm, false) THEN f.prop WHEN s.authority = 'user' THEN NULL ELSE s.norm END,
    CASE WHEN coalesce(f.sup = s.norm, false) OR s.authority <> 'user' THEN f.sup_seq ELSE s.seq END,
    CASE WHEN coalesce(f.sup = s.norm, false) OR (s.authority <> 'user' AND coalesce(f.prop = s.norm, false)) THEN f.prop_seq WHEN s.authority = 'user' THEN NULL ELSE s.seq END,
    CASE WHEN NOT coalesce(f.sup = s.norm, false) AND s.authority = 'user' THEN f.sup_seq END,
    CASE WHEN NOT (coalesce(f.sup = s.norm, false) OR (s.authority <> 'user' AND coalesce(f.prop = s.norm, false))) THEN f.prop_seq END
  FROM fold f JOIN st s ON s.thread_id = f.thread_id AND s.key = f.key AND s.i = f.i + 1),
closed AS (SELECT thread_id, key, closed_sup AS at, seq FROM fold WHERE closed_sup IS NOT NULL UNION ALL SELECT thread_id, key, closed_prop, seq FROM fold WHERE closed_prop IS NOT NULL),
fact AS (SELECT f.thread_id, f.key, f.value, f.authority, CASE WHEN c.seq IS NOT NULL THEN 'HISTORICAL' WHEN f.authority = 'user' THEN 'SUPPORTED' ELSE 'PROPOSED' END AS phase, f.seq AS valid_from, c.seq AS valid_to
  FROM fold f LEFT JOIN closed c ON c.thread_id = f.thread_id AND c.key = f.key AND c.at = f.seq WHERE f.made)"""
