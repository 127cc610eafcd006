"""Episodes from the given tables: append-only rows (thread_id, seq, ts, role, content) with seq 1, 2, ... per thread.

Threads are numbered by a window over their own rows only, so that no step needs one global order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Give each row of a thread its place in the given order."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("thread_id").orderBy(*order)).cast("long"))


def conversation_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("thread_id"), (F.col("turn") + 1).alias("seq"), "role", F.col("text").alias("content"))


def event_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One thread per user; the content is a sentence with a number, a unit, a date and a code."""
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type").isin("signup", "click"), "user").when(F.col("event_type").isin("view", "purchase"), "assistant").otherwise("tool")
    content = F.concat(F.col("event_type"), F.lit(" took "), F.floor(F.col("value") * 10).cast("string"), F.lit(" ms on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" for build-"), (F.col("event_id") % 50).cast("string"))
    rows = e.select(F.col("user_id").alias("thread_id"), "ts", "event_id", "event_type", "value", role.alias("role"), content.alias("content"))
    return numbered(rows, "ts", "event_id")


def order_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One thread per customer; every order states the customer's priority anew."""
    o = table(spark, sf_dir, "orders")
    content = F.concat(F.lit("The customer-"), F.col("o_custkey").cast("string"), F.lit(" priority is now "), F.substring("o_orderpriority", 3, 40), F.lit("."))
    return numbered(o.select(F.col("o_custkey").alias("thread_id"), "o_orderdate", "o_orderkey", F.lit("user").alias("role"), content.alias("content")), "o_orderdate", "o_orderkey")


def line_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long thread per supplier: an episode for each order line."""
    rows = table(spark, sf_dir, "lineitem")
    content = F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" x"), F.floor("l_quantity").cast("string"), F.lit(" "), F.col("l_returnflag"))
    return numbered(rows.select(F.col("l_suppkey").alias("thread_id"), "l_orderkey", "l_linenumber", F.lit("tool").alias("role"), content.alias("content")), "l_orderkey", "l_linenumber", "content")


# What people say in a thread: one sentence or two for each event, so that all rules, cues and kinds of names occur.
PEOPLE = ("Ada Lovelace", "Bruno Katz", "Ines de Castro", "Omar Haddad", "Vera Lind")
CITIES = ("Lisbon", "Port Louis", "Graz", "Bank of Sava")
THEMES = ("alpha", "beta", "gamma")
SAYINGS = (
    "My name is {p}.",
    "I live in {c}. Remember that the {w} budget is {v} usd.",
    "From now on, use tabs for build-{a}.",
    "Never deploy on day {a}.",
    "We decided to ship version {b}.",
    "TODO: call {p} about invoice {v}.",
    "{p} moved to {c}.",
    "{p} works at {c} Labs.",
    "{p} was born in {c}.",
    "The deploy window is now {b}:30.",
    "Actually, the deploy window is {b}:45.",
    "It is not {b}:30, but {a}:15.",
    "What did {p} say about invoice {v}? I forgot.",
    "As I said in turn {a}, compare all {w} budgets.",
    'The {w} report was "large but not very stable" on 2024-03-1{a}, see src/{w}.py.',
    "One ground rule: never send {w} mail",
)


def talk_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(thread_id, seq, ts, event_id, role, removed, content): one thread per user; every tenth event is removed later."""
    e = table(spark, sf_dir, "events")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))
    i = F.col("event_id")
    text = pick(SAYINGS, i)
    fill = {"p": pick(PEOPLE, F.floor(i / 16)), "c": pick(CITIES, F.floor(i / 16)), "w": pick(THEMES, i), "v": F.floor("value").cast("long").cast("string"), "a": F.pmod(F.floor(i / 16), F.lit(9)).cast("string"), "b": F.pmod(F.floor(i / 16), F.lit(5)).cast("string")}
    for k, v in fill.items():
        text = F.replace(text, F.lit("{" + k + "}"), v)
    role = F.when(i % 7 < 4, "user").when(i % 7 < 6, "assistant").otherwise("tool")
    rows = e.select(F.col("user_id").alias("thread_id"), "ts", "event_id", role.alias("role"), (i % 10 == 0).alias("removed"), text.alias("content"))
    return numbered(rows, "ts", "event_id")


LINE_SQL = """line AS (SELECT l_suppkey AS thread_id, 'tool' AS role, 'part ' || CAST(l_partkey AS VARCHAR) || ' x' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || ' ' || l_returnflag AS content,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, 'part ' || CAST(l_partkey AS VARCHAR) || ' x' || CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR) || ' ' || l_returnflag) AS seq FROM lineitem)"""


def _pick_sql(words: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"][CAST(({n}) % {len(words)} AS INT) + 1]"


_filled = _pick_sql(SAYINGS, "event_id")
for _k, _v in {"p": _pick_sql(PEOPLE, "event_id // 16"), "c": _pick_sql(CITIES, "event_id // 16"), "w": _pick_sql(THEMES, "event_id"), "v": "CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)", "a": "CAST((event_id // 16) % 9 AS VARCHAR)", "b": "CAST((event_id // 16) % 5 AS VARCHAR)"}.items():
    _filled = f"replace({_filled}, '{{{_k}}}', {_v})"
TALK_SQL = f"""talk AS (SELECT user_id AS thread_id, ts, event_id, CASE WHEN event_id % 7 < 4 THEN 'user' WHEN event_id % 7 < 6 THEN 'assistant' ELSE 'tool' END AS role, event_id % 10 = 0 AS removed, {_filled} AS content,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""
EV_SQL = """ev AS (
  SELECT user_id AS thread_id, ts, event_id, event_type, value,
    CASE WHEN event_type IN ('signup', 'click') THEN 'user' WHEN event_type IN ('view', 'purchase') THEN 'assistant' ELSE 'tool' END AS role,
    event_type || ' took ' || CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR) || ' ms on ' || strftime(ts, '%Y-%m-%d') || ' for build-' || CAST(event_id % 50 AS VARCHAR) AS content,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq
  FROM events)"""
CONV_SQL = "conv AS (SELECT conv_id AS thread_id, turn + 1 AS seq, role, text AS content FROM conversations)"
ORD_SQL = """ord AS (
  SELECT o_custkey AS thread_id, 'The customer-' || CAST(o_custkey AS VARCHAR) || ' priority is now ' || substr(o_orderpriority, 3, 40) || '.' AS content,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders)"""
