"""Summaries of windows (capsules): their lines, the names they lose, and the ledger over levels.

A capsule's lines come in tiers: certificates of supported facts, sentences that must be kept word for word, and first
sentences. Equal lines stay at their first sight, and lines are taken in order until the first that doesn't fit. A name of
the source that the text no longer has is a loss, written once, at the lowest level that drops it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, MARGIN, approx_tokens, salient, sentences


def token_caps(budgets: DataFrame) -> DataFrame:
    """Token caps of capsules by level for each budget, and how many leaves stay resident beside the root."""
    leaf = F.greatest(F.lit(150), F.floor(F.col("budget") / 40))
    middle = F.greatest(F.lit(200), F.floor(F.col("budget") / 32))
    root = F.greatest(F.lit(300), F.floor(F.col("budget") / 16))
    leaves = F.greatest(F.lit(2), F.least(F.lit(6), F.floor((F.floor(F.col("budget") * 18 / 100) - root) / leaf)))
    return budgets.select("budget", *[c.cast("long").alias(n) for n, c in (("leaf", leaf), ("middle", middle), ("root", root), ("resident_leaves", leaves))])


def supported_at_end(facts: DataFrame, span: int) -> DataFrame:
    """The user's facts that were supported when the window they begin in was sealed, whatever came later."""
    return facts.where((F.col("authority") == "user") & (F.col("valid_to").isNull() | (F.col("valid_to") > (F.floor((F.col("valid_from") - 1) / span) + 1) * span)))


def certificate(key: Column, value: Column, seq: Column) -> Column:
    return F.concat(key, F.lit(": "), value, F.lit(" ⟨#"), seq.cast("string"), F.lit("⟩"))


def candidate_lines(episodes: DataFrame, facts: DataFrame, span: int) -> DataFrame:
    """(thread_id, no, tier, seq, i, line) of the sealed windows: certificates (tier 0) of the given facts, salient
    sentences (1), and the first other sentence of each episode (2). Removed episodes say nothing."""
    window = lambda c: F.floor((c - 1) / span).cast("long").alias("no")
    sealed = episodes.groupBy("thread_id", window(F.col("seq"))).agg(F.count("*").alias("_n")).where(F.col("_n") == span).drop("_n")
    mark = lambda c: F.concat(F.lit(" ⟨#"), c.cast("string"), F.lit("⟩"))
    facts = facts.select("thread_id", window(F.col("valid_from")), F.lit(0).alias("tier"), F.col("valid_from").alias("seq"), F.lit(0).alias("i"), certificate(F.col("key"), F.col("value"), F.col("valid_from")).alias("line"), "key")
    said = episodes.where(~F.col("removed")).select("thread_id", "seq", F.posexplode(F.transform(sentences(F.col("content")), lambda s: F.regexp_replace(s, r"\s+", " "))).alias("i", "s"))
    told = said.withColumn("salient", salient(F.col("s"))).withColumn("first", F.min(F.when(~F.col("salient"), F.col("i"))).over(Window.partitionBy("thread_id", "seq")))
    told = told.where(F.col("salient") | (F.col("i") == F.col("first")))
    lines = told.select("thread_id", window(F.col("seq")), F.when(F.col("salient"), 1).otherwise(2).alias("tier"), "seq", "i", F.when(F.col("salient"), F.concat("s", mark(F.col("seq")))).otherwise(F.col("s")).alias("line"), F.lit("").alias("key"))
    return facts.unionByName(lines).join(sealed, ["thread_id", "no"])


def written_lines(lines: DataFrame, most: int, tokens: Callable[[Column], Column] = approx_tokens) -> DataFrame:
    """The lines that a capsule of at most `most` tokens holds, with their running cost. `tokens` is the tokenizer."""
    at = F.struct("tier", "seq", "key", "i").alias("at")
    first = lines.groupBy("thread_id", "no", "line").agg(F.min(at).alias("at"))
    order = Window.partitionBy("thread_id", "no").orderBy("at.tier", "at.seq", "at.key", "at.i", "line")
    cost = tokens(F.col("line")) + F.when(F.row_number().over(order) > 1, 1).otherwise(0)
    placed = first.withColumn("ordinal", F.row_number().over(order).cast("long")).withColumn("cost", cost)
    used = F.sum("cost").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("used", used).where(F.col("used") <= most).select("thread_id", "no", "ordinal", F.col("at.tier").alias("tier"), F.col("at.seq").alias("seq"), "line", "used")


def capsule_texts(lines: DataFrame) -> DataFrame:
    """Text, tokens and digest of each capsule, of its written lines in order (their sum is bounded)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("thread_id", "no").agg(text.alias("text")).select("thread_id", "no", "text", approx_tokens(F.col("text")).alias("tokens"), F.sha2("text", 256).alias("hash"))


def source_vocabulary(names: DataFrame, facts: DataFrame, span: int) -> DataFrame:
    """(thread_id, no, name, seq): what a window's source is called by: names of its episodes, keys and values of facts
    that begin in it. The newest place counts."""
    of_facts = facts.select("thread_id", F.col("valid_from").alias("seq"), F.explode(F.array(F.lower("key"), F.lower("value"))).alias("name"))
    rows = names.select("thread_id", "seq", "name").union(of_facts.select("thread_id", "seq", "name"))
    return rows.groupBy("thread_id", F.floor((F.col("seq") - 1) / span).cast("long").alias("no"), "name").agg(F.max("seq").alias("seq"))


def split(source: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) entries of windows, by whether their text still has the name."""
    there = shown.select("thread_id", "no", "name").distinct()
    keys = ["thread_id", "no", "name"]
    return source.join(there, keys, "left_semi"), source.join(there, keys, "left_anti")


def raised(entries: DataFrame, fan_out: int) -> DataFrame:
    """Entries of windows as entries of the windows above; the newest place counts."""
    return entries.groupBy("thread_id", F.floor(F.col("no") / fan_out).cast("long").alias("no"), "name").agg(F.max("seq").alias("seq"))


def new_losses(dropped: DataFrame, written: DataFrame) -> DataFrame:
    """Of a level's dropped entries those that no lower level has written for the same name and place."""
    return dropped.join(written.select("thread_id", "name", "seq").distinct(), ["thread_id", "name", "seq"], "left_anti")


def unconserved(above: DataFrame, below: DataFrame, fan_out: int) -> DataFrame:
    """Entries of lower ledgers that the ledger above has lost: none, if the law holds."""
    return raised(below, fan_out).join(above.select("thread_id", "no", "name"), ["thread_id", "no", "name"], "left_anti")


def stale_certificates(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """Certificate lines (tier 0) whose key has a supported value newer than the line's."""
    newest = facts.where("phase = 'SUPPORTED'").groupBy("thread_id", "key").agg(F.max("valid_from").alias("newest"))
    marked = lines.where("tier = 0").withColumn("key", F.regexp_extract("line", "^([^:]+): ", 1))
    return marked.join(newest, ["thread_id", "key"]).where("newest > seq").select("thread_id", "no", "ordinal", "key", "seq", "newest")


def resident(windows: DataFrame, covered: DataFrame, most: int) -> DataFrame:
    """The newest `most` leaves behind what the root covers (thread_id, covered_to)."""
    order = Window.partitionBy("thread_id").orderBy(F.desc("no"))
    rows = windows.join(covered, "thread_id", "left").where(F.col("to_seq") > F.coalesce("covered_to", F.lit(0)))
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most).select("thread_id", "no", "from_seq", "to_seq")


def upper_lines(lines: DataFrame, fan_out: int) -> DataFrame:
    """Lines of sealed windows as candidates of the windows above: all `fan_out` children must have a text."""
    up = F.floor(F.col("no") / fan_out).cast("long")
    whole = lines.groupBy("thread_id", up.alias("no")).agg(F.countDistinct("no").alias("_n")).where(F.col("_n") == fan_out).drop("_n")
    return lines.select("thread_id", up.alias("no"), "tier", "seq", F.col("ordinal").alias("i"), "line", F.lit("").alias("key")).join(whole, ["thread_id", "no"])


# ---- the root, which is written again with every leaf ---------------------------------------------------------


class Line(NamedTuple):
    tier: int
    seq: int
    until: int | None  # the place at which a certificate is overtaken
    line: str


Writer = Callable[[list[Line], list[Line]], list[Line]]


def line_tokens(line: str) -> int:
    return math.ceil(len(line) / CHARS_PER_TOKEN * MARGIN)


def by_tier(root: list[Line], leaf: list[Line]) -> list[Line]:
    """The writer that needs no model: certificates, then salient lines, then others; in each tier the root's first."""
    return sorted([*root, *leaf], key=lambda x: x.tier)


def newest(keep: int) -> Writer:
    """The writer of a rolling summary: the `keep` lines seen last."""

    def write(root: list[Line], leaf: list[Line]) -> list[Line]:
        last: dict[str, Line] = {}
        for x in [*root, *leaf]:
            if x.line not in last or x.seq > last[x.line].seq:
                last[x.line] = x
        return sorted(last.values(), key=lambda x: (-x.seq, x.line))[:keep]

    return write


def sequential_root(leaves: DataFrame, writer: Writer = by_tier, most: int | None = None, tokens: Callable[[str], int] = line_tokens) -> DataFrame:
    """(thread_id, root, ordinal, tier, seq, line): the root after each leaf, root := writer(prune(root), prune(leaf)).

    leaves: (thread_id, no, ordinal, tier, seq, line), and until, to_seq if certificates are to be pruned: one whose key has
    a newer value at the leaf's end goes. Whatever the writer gives, equal lines stay once, and lines are taken in its order
    until the first that doesn't fit `most` tokens (a line feed costs one). A root depends on the one before it, so leaves of
    a thread are sorted by Spark and read as a stream; the state is one root and one leaf, and the work is linear in the
    leaves. An empty table gives an empty result.
    """
    pruned = {"until", "to_seq"} <= set(leaves.columns)
    none = F.lit(None).cast("long")
    rows = leaves.select("thread_id", "no", "ordinal", F.col("tier").cast("long").alias("tier"), "seq", F.col("until").alias("until") if pruned else none.alias("until"), F.col("to_seq").alias("to_seq") if pruned else none.alias("to_seq"), "line")

    def roll(root: list[Line], leaf: list[Line], end: int | None) -> list[Line]:
        live = lambda lines: [x for x in lines if x.until is None or end is None or x.until > end]
        out, seen, used = [], set(), 0
        for x in writer(live(root), live(leaf)):
            if x.line in seen:
                continue
            used += tokens(x.line) + (1 if out else 0)
            if most is not None and used > most:
                break
            seen.add(x.line)
            out.append(x)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, root, leaf, at, end, out = None, [], [], None, None, []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["thread_id", "root", "ordinal", "tier", "seq", "line"])

        def seal() -> list[Line]:
            now = roll(root, leaf, end)
            out.extend((thread, at, i + 1, x.tier, x.seq, x.line) for i, x in enumerate(now))
            return now

        for batch in batches:
            for t, no, _, tier, seq, until, to, line in zip(*(c.to_pylist() for c in batch.columns)):
                if (t, no) != (thread, at):
                    if at is not None:
                        root = seal()
                    if t != thread:
                        root = []
                    thread, at, end, leaf = t, no, to, []
                leaf.append(Line(tier, seq, until, line))
            if len(out) > 4096:
                yield flush()
                out.clear()
        if at is not None:
            seal()
        yield flush()

    dealt = rows.repartition("thread_id").sortWithinPartitions("thread_id", "no", "ordinal")
    return dealt.mapInArrow(run, "thread_id long, root long, ordinal long, tier long, seq long, line string")


def root_losses(shown: DataFrame, kept: DataFrame) -> DataFrame:
    """(thread_id, root, name): names that the root before, or the leaf that came in, still had and the new root's text no
    longer has. shown: (thread_id, root, name) of every root's text; kept: (thread_id, no, name) of the leaves. The ledger of
    a root is the union of the losses up to it, so each name is written when it goes and never copied on."""
    roots = shown.select("thread_id", "root").union(kept.select("thread_id", F.col("no"))).distinct()
    order = Window.partitionBy("thread_id").orderBy("root")
    after = roots.withColumn("next", F.lead("root").over(order)).where("next is not null")
    before = shown.join(after, ["thread_id", "root"]).select("thread_id", F.col("next").alias("root"), "name")
    source = before.union(kept.select("thread_id", F.col("no"), "name")).distinct()
    return source.join(shown, ["thread_id", "root", "name"], "left_anti")
