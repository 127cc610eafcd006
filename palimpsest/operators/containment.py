"""Which texts contain which of many strings.

Strings are packed into Aho-Corasick automata of at most BLOCK_CHARS characters, one at a time; a text is read once for each
automaton, however many strings it has, and nothing but hits is moved. Strings and texts are compared folded, and hits
tell whether the string is there as it stands, too. Where a string belongs to a group (a thread), hits of other groups are
dropped where they are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

BLOCK_CHARS = 1 << 20  # of the strings of one automaton, unless one string alone is longer


def folded(text: str) -> str:
    return text.lower()


def _blocks(patterns: DataFrame) -> Iterator[list[str]]:
    """The distinct strings, in blocks of bounded size: one block at a time is on the driver."""
    block, size = [], 0
    for r in patterns.select("pattern").where("pattern is not null and pattern <> ''").distinct().toLocalIterator():
        if block and size + len(r["pattern"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append(r["pattern"])
        size += len(r["pattern"])
    if block:
        yield block


def _hits(texts: DataFrame, keys: list[str], text: str, block: list[str], fold: Callable[[str], str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick  # in the task

        machine: dict[str, list[int]] = {}
        for i, p in enumerate(block):
            machine.setdefault(fold(p), []).append(i)
        automaton = ahocorasick.Automaton()
        for p, numbers in machine.items():
            automaton.add_word(p, numbers)
        automaton.make_automaton()
        for batch in batches:
            rows, found, exact = [], [], []
            for at, value in enumerate(batch.column(len(keys)).to_pylist()):
                if not value:
                    continue
                for number in sorted({n for _, numbers in automaton.iter(fold(value)) for n in numbers}):
                    rows.append(at)
                    found.append(block[number])
                    exact.append(block[number] in value)
            taken = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[: len(keys)]]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(found, pa.string()), pa.array(exact, pa.bool_())], [*keys, "pattern", "exact"])

    kinds = ", ".join(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys)
    return texts.select(*keys, text).mapInArrow(run, f"{kinds}, pattern string, exact boolean")


def contained(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str = "content", within: list[str] | None = None, fold: Callable[[str], str] = folded) -> DataFrame:
    """(keys, pattern, exact) for each row of `texts` and distinct string `pattern` that its text contains, folded; `exact`:
    also as it stands. With `within`, columns that both tables have, only strings of the same group count.

    Empty and null strings are contained in nothing, null texts contain nothing, repeated texts are rows of their own. An
    empty table on either side gives an empty result; extra columns are ignored.
    """
    out = None
    for block in _blocks(patterns):
        hits = _hits(texts, keys, text, block, fold)
        if within:
            hits = hits.join(patterns.select(*within, "pattern").distinct(), [*within, "pattern"], "left_semi").select(*keys, "pattern", "exact")
        hits = stored(hits, "contained")
        out = hits if out is None else out.union(hits)
    return out if out is not None else texts.select(*keys, F.lit("").alias("pattern"), F.lit(True).alias("exact")).limit(0)


def aliases(proposed: DataFrame, hits: DataFrame) -> DataFrame:
    """Proposed aliases (thread_id, alias, name) that are strings of their thread, as their names are: hits (thread_id,
    pattern) say which strings are there. A thread's string that stands for two names is nobody's alias."""
    there = hits.select("thread_id", "pattern").distinct()
    both = proposed.join(there.withColumnRenamed("pattern", "alias"), ["thread_id", "alias"], "left_semi").join(there.withColumnRenamed("pattern", "name"), ["thread_id", "name"], "left_semi").distinct()
    single = both.groupBy("thread_id", "alias").agg(F.countDistinct("name").alias("_n")).where("_n = 1").select("thread_id", "alias")
    return both.join(single, ["thread_id", "alias"], "left_semi").select("thread_id", "alias", "name")
