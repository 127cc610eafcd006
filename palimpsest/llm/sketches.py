"""Ranked lexical search over hashed max-sketches.

The index holds, for each document, its number of terms and a sketch: every term has a coordinate (its hash, cut to the
sketch's width), and a coordinate holds the largest frequency of the terms that fall on it. A term's impact grows with
its frequency, so the impact of a coordinate bounds that of each of its terms from above, whatever the corpus statistics
turn out to be. Widths are powers of two, SPREAD times the document's distinct terms or more, and only coordinates that are
not zero are stored.

A block of queries is looked up at once: a document's coordinates that any query uses become a row of impacts, and a
matrix product with the queries' weights gives upper bounds of all scores. Then

1. the documents of the greatest bounds for each query, over the whole table, are scored exactly; the k-th best of these
   scores is a threshold that the result can't be under;
2. every task scores its documents in descending order of bounds, as long as a bound reaches the threshold, which its own
   scores raise; it gives at most k documents a query, and the best k of all tasks are the result.

Exact scores count the query's terms in the whole text again, each confirmed byte by byte. No term, posting or candidate
is shuffled, only counts and results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, written
from ._text import _LOWER, byte_prefix_hash, column_bytes, range_hash, slices

BEST = 50
SPREAD = 64  # coordinates for each distinct term, at least
LEAST_BITS, MOST_BITS = 8, 24
FULL = 255  # a frequency of at least so much; its impact is bounded by IMPACT
IMPACT = 1_000_000
ITEMS = 256  # queries of a block
CELLS = 1 << 22  # terms times queries of a block, unless one query has more terms
_TERM = np.ones(256, bool)
_TERM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False


class Terms:
    """The terms of a string column: byte ranges in lower-cased `data`, hashes and rows."""

    def __init__(self, column: pa.Array):
        raw, rows = column_bytes(column)
        self.data = data = _LOWER[raw]
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = _TERM[data]
        edge = np.zeros(len(data) + 1, bool)  # a text ends before this byte
        edge[rows] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.hash = range_hash(byte_prefix_hash(data), self.start, self.end)
        self.row = np.searchsorted(rows, self.start, side="right") - 1
        self.counts = np.bincount(self.row, minlength=len(rows) - 1)

    def bytes_at(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def frequencies(terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, frequency) of each row's distinct terms, by row."""
    order = np.lexsort((terms.hash, terms.row))
    row, value = terms.row[order], terms.hash[order]
    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1]))) if len(row) else np.zeros(0, int)
    return row[new], value[new], np.diff(np.append(new, len(row)))


def sketches(row: np.ndarray, value: np.ndarray, tf: np.ndarray, rows: int) -> tuple[np.ndarray, list[bytes]]:
    """(bits of the width, stored sketch) of each row: little-endian numbers (coordinate << 8 | largest frequency)."""
    distinct = np.bincount(row, minlength=rows)
    bits = np.clip(np.ceil(np.log2(np.maximum(distinct * SPREAD, 1))), LEAST_BITS, MOST_BITS).astype(np.int32)
    place = value & ((np.uint64(1) << bits[row].astype(np.uint64)) - np.uint64(1))
    packed = (place.astype(np.uint32) << np.uint32(8)) | np.minimum(tf, FULL).astype(np.uint32)
    order = np.lexsort((packed, row))
    row, packed = row[order], packed[order]
    # the last of each coordinate has the largest frequency
    keep = np.append((row[1:] != row[:-1]) | (packed[1:] >> np.uint32(8) != packed[:-1] >> np.uint32(8)), True) if len(row) else np.zeros(0, bool)
    row, packed = row[keep], packed[keep].astype("<u4")
    at = np.searchsorted(row, np.arange(rows + 1))
    return bits, [packed[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]


INDEX = "at long, doc_id long, n long, bits int, sketch binary, text string"


def sketch_index(docs: DataFrame) -> DataFrame:
    """at (a number of its own), doc_id, n (terms), bits, sketch and text for each row (doc_id, text) that has a term.

    `at` is dealt out where the row is made: write the index before use.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                terms = Terms(part.column(1))
                bits, stored = sketches(*frequencies(terms), part.num_rows)
                has = pa.array(terms.counts > 0)
                columns = [pa.array(np.arange(at, at + part.num_rows)), part.column(0), pa.array(terms.counts.astype(np.int64)), pa.array(bits), pa.array(stored, pa.binary()), part.column(1)]
                yield pa.RecordBatch.from_arrays(columns, ["at", "doc_id", "n", "bits", "sketch", "text"]).filter(has)
                at += part.num_rows

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


@dataclass
class Block:
    """Some queries and their distinct terms, by hash. use_term and use_item say which query has which term."""

    items: list  # item ids
    hashes: np.ndarray
    lengths: np.ndarray
    text: np.ndarray  # the terms' bytes, one after the other
    begins: np.ndarray
    use_term: np.ndarray
    use_item: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[object, set[bytes]]]) -> Block:
        names = sorted({t for _, terms in items for t in terms})
        found = Terms(pa.array([t.decode() for t in names], pa.string()))
        order = np.argsort(found.hash, kind="stable")
        if len(np.unique(found.hash)) < len(names):
            raise ValueError("two query terms share a hash")
        number = {names[i]: k for k, i in enumerate(order.tolist())}
        pairs = [(number[t], i) for i, (_, terms) in enumerate(items) for t in sorted(terms)]
        lengths = (found.end - found.start)[order]
        text = np.frombuffer(b"".join(names[i] for i in order), np.uint8)
        return cls([i for i, _ in items], found.hash[order], lengths, text, np.append(0, np.cumsum(lengths))[:-1], *(np.array([p[i] for p in pairs], np.int64) for i in (0, 1)))

    def counts(self, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, frequency) of the block's terms in the rows; equal hashes are confirmed byte by byte."""
        if not len(self.hashes) or not len(terms.hash):
            return (np.zeros(0, np.int64),) * 3
        term = np.minimum(np.searchsorted(self.hashes, terms.hash), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[term] == terms.hash) & (self.lengths[term] == terms.end - terms.start))
        term, size = term[hit], self.lengths[term[hit]]
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        same = terms.data[np.repeat(terms.start[hit], size) + within] == self.text[np.repeat(self.begins[term], size) + within]
        good = np.logical_and.reduceat(same, np.cumsum(size) - size) if len(size) else np.zeros(0, bool)
        key, tf = np.unique(terms.row[hit][good] * len(self.hashes) + term[good], return_counts=True)
        return key // len(self.hashes), key % len(self.hashes), tf

    def weights(self, of_term: np.ndarray, place: np.ndarray, places: int) -> np.ndarray:
        """places x items: the weights of the terms at each place, summed. All are whole numbers."""
        out = np.zeros((places, len(self.items)))
        np.add.at(out, (place[self.use_term], self.use_item), of_term[self.use_term])
        return out


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def lengths_m(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """50 + 50 * n * N div L; in Python's integers where 64 bits don't hold the product."""
    if len(n) and 50 * int(n.max()) * docs >= 1 << 63:
        return np.array([50 + 50 * int(x) * docs // total for x in n], np.int64)
    return 50 + 50 * n.astype(np.int64) * docs // total


class Scorer:
    """Bounds and exact scores of documents for a block of queries."""

    def __init__(self, block: Block, of_term: np.ndarray, docs: int, total: int):
        self.block, self.of_term, self.docs, self.total = block, of_term.astype(float), docs, total
        self.exact = block.weights(self.of_term, np.arange(len(block.hashes)), len(block.hashes))
        # whole numbers up to 2**53 are exact in doubles
        self.kind = float if self.exact.sum(axis=0).max(initial=0) * IMPACT < 1 << 53 else np.int64
        self.exact = self.exact.astype(self.kind)
        self.by_bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _queries(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(column of each coordinate or -1, columns x items weights) for sketches of that width."""
        if bits not in self.by_bits:
            place = (self.block.hashes & np.uint64((1 << bits) - 1)).astype(np.int64)
            used, column = np.unique(place, return_inverse=True)
            look = np.full(1 << bits, -1, np.int32)
            look[used] = np.arange(len(used))
            self.by_bits[bits] = look, self.block.weights(self.of_term, column, len(used)).astype(self.kind)
        return self.by_bits[bits]

    def bounds(self, n: np.ndarray, bits: np.ndarray, stored: pa.Array) -> np.ndarray:
        """rows x items upper bounds."""
        out = np.zeros((len(n), len(self.block.items)), self.kind)
        m = lengths_m(n, self.docs, self.total)
        _, offsets, data = stored.buffers()
        off = np.frombuffer(offsets, np.int32)[stored.offset : stored.offset + len(stored) + 1].astype(np.int64)
        packed = np.frombuffer(data, np.uint8)[off[0] : off[-1]].view("<u4") if data is not None else np.zeros(0, "<u4")
        off = (off - off[0]) // 4
        for width in np.unique(bits):
            look, weights = self._queries(int(width))
            rows = np.flatnonzero(bits == width)
            step = max(1, (1 << 21) // max(1, len(weights)))
            for lo in range(0, len(rows), step):
                some = rows[lo : lo + step]
                size = off[some + 1] - off[some]
                entry = packed[np.repeat(off[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                column, row = look[entry >> np.uint32(8)], np.repeat(np.arange(len(some)), size)
                hit = column >= 0
                column, row, tf = column[hit], row[hit], (entry[hit] & np.uint32(255)).astype(np.int64)
                matrix = np.zeros((len(some), len(weights)), self.kind)
                matrix[row, column] = np.where(tf == FULL, IMPACT, impacts(tf, m[some][row]))
                out[some] = matrix @ weights
        return out

    def scores(self, text: pa.Array, n: np.ndarray) -> np.ndarray:
        """rows x items exact scores."""
        row, term, tf = self.block.counts(Terms(text))
        matrix = np.zeros((len(n), len(self.block.hashes)), self.kind)
        matrix[row, term] = impacts(tf, lengths_m(n, self.docs, self.total)[row])
        return matrix @ self.exact


class Best:
    """For each query the best k rows (value, doc_id, at), the greatest values first, then the least ids."""

    def __init__(self, items: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(float).copy()  # what a value must reach
        self.rows = [(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(items)]

    def add(self, values: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        for i in np.flatnonzero((values >= self.floor).any(axis=0)):
            use = values[:, i] >= self.floor[i]
            value, doc, place = (np.concatenate(x) for x in zip(self.rows[i], (values[use, i], ids[use], at[use])))
            order = np.lexsort((place, doc, -value))[: self.k]
            self.rows[i] = value[order], doc[order], place[order]
            if len(order) == self.k:
                self.floor[i] = max(self.floor[i], value[order[-1]])

    def batch(self, names: list[str]) -> pa.RecordBatch:
        item = np.repeat(np.arange(len(self.rows)), [len(r[0]) for r in self.rows]).astype(np.int32)
        value, ids, at = (np.concatenate([r[i] for r in self.rows]) if self.rows else np.zeros(0) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array(item), pa.array(value.astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(at.astype(np.int64))], names)


_HITS = "item int, value long, id long, at long"
_LAST = (1 << 63) - 1  # stands for a null doc_id among ids


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LAST).to_numpy(zero_copy_only=False)


def document_counts(index: DataFrame, block: Block) -> np.ndarray:
    """The number of documents that hold each term of the block: one row a term and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.hashes), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                total += np.bincount(block.counts(Terms(part.column(0)))[1].astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    out = np.zeros(len(block.hashes), np.int64)
    for r in index.select("text").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def search_block(index: DataFrame, block: Block, docs: int, total: int, k: int = BEST) -> DataFrame:
    """(item, value, id, at): for each query of the block, the best k rows of each task that reach the threshold."""
    df = document_counts(index, block)
    of_term = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    items = len(block.items)

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = Scorer(block, of_term, docs, total), Best(items, k, np.ones(items))
        for batch in batches:
            at, n, bits = (batch.column(i).to_numpy() for i in range(3))
            best.add(scorer.bounds(n, bits, batch.column(3)), at, at)
        yield best.batch(["item", "value", "id", "at"])

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = Scorer(block, of_term, docs, total), Best(items, k, np.ones(items))
        for batch in batches:
            for part in slices(batch, "text"):
                best.add(scorer.scores(part.column(2), part.column(1).to_numpy()), part.column(0).to_numpy(), part.column(0).to_numpy())
        yield best.batch(["item", "value", "id", "at"])

    order = Window.partitionBy("item").orderBy(F.desc("value"), "id", "at")
    leaders = index.select("at", "n", "bits", "sketch").mapInArrow(leading, _HITS).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    seeds = written(leaders.select("at").distinct(), "seeds")  # at most k for each of at most ITEMS queries
    exact = index.join(F.broadcast(seeds), "at", "left_semi").select("at", "n", "text").mapInArrow(seeded, _HITS)
    ranked = exact.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("item", "value").collect()
    floor = np.ones(items)  # a score must be above 0
    for r in ranked:
        floor[r["item"]] = max(1, r["value"])

    def descending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, best = Scorer(block, of_term, docs, total), Best(items, k, floor)
        for batch in batches:
            at, ids, n, bits = batch.column(0).to_numpy(), _ids(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            bounds = scorer.bounds(n, bits, batch.column(4))
            lead = (bounds / best.floor).max(axis=1, initial=0)
            rows = np.argsort(-lead, kind="stable")
            rows = rows[lead[rows] >= 1]
            for lo in range(0, len(rows), 256):
                some = rows[lo : lo + 256]
                some = some[(bounds[some] >= best.floor).any(axis=1)]  # the thresholds may have risen
                texts = pa.RecordBatch.from_arrays([pa.array(some), batch.column(5).take(pa.array(some))], ["row", "text"])
                for part in slices(texts, "text"):
                    own = part.column(0).to_numpy()
                    best.add(scorer.scores(part.column(1), n[own]), ids[own], at[own])
        yield best.batch(["item", "value", "id", "at"])

    return index.select("at", "doc_id", "n", "bits", "sketch", "text").mapInArrow(descending, _HITS)


def _blocks(items: DataFrame) -> Iterator[Block]:
    """The queries in blocks of at most ITEMS, so that one block at a time is on the driver."""
    rows = items.groupBy("item_id").agg(F.collect_set("text").alias("texts"))  # the texts of one id are one query
    n = rows.count()
    parts = -(-2 * n // ITEMS) if n > ITEMS else 1
    for part in range(parts):
        some, terms_of = [], {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toLocalIterator():
            found = Terms(pa.array([t or "" for t in r["texts"]] or [""], pa.string()))
            some.append((r["item_id"], {found.bytes_at(i) for i in range(len(found.start))}))
        some.sort(key=lambda x: (x[0] is None, x[0] or 0))
        while some:
            names, end = set(), 0
            while end < min(len(some), ITEMS) and (not end or (end + 1) * len(names | some[end][1]) <= CELLS):
                names |= some[end][1]
                end += 1
            yield Block.of(some[:end])
            some = some[end:]


def ranked_search(index: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of a written index for each item.

    Equal scores are ranked by ascending doc_id, null ids last. Repeated documents each have a rank of their own. The texts
    of one item_id, null included, are one query; one without terms finds nothing. Documents without terms are in no
    index. An empty table on either side gives an empty result; extra columns are ignored.
    """
    spark = index.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    sums = index.agg(F.count("*").alias("docs"), F.sum("n").alias("total")).first()
    out = None
    for block in _blocks(items.select(F.col("item_id").cast("long"), "text")) if sums["docs"] else []:
        hits = search_block(index, block, sums["docs"], sums["total"], k)
        order = Window.partitionBy("item").orderBy(F.desc("value"), "id", "at")
        ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.items)), "item int, item_id long")
        ids = F.when(F.col("id") != _LAST, F.col("id")).alias("doc_id")
        found = ranked.join(names, "item").select("item_id", "rank", ids, F.col("value").alias("score"))
        found = written(found, "ranked")
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = written(sketch_index(documents(spark, sf_dir)), "sketches", "zstd")
    return ranked_search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS_SQL} AS t FROM documents),
p AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS total FROM d WHERE len(t) > 0),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
scored AS (SELECT q.item_id, p.k, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * len(d.t) * s.n_docs) // s.total)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.k = p.k, s GROUP BY q.item_id, p.k),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, scored.k) AS rank, doc_id, score FROM scored JOIN d ON d.k = scored.k WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {BEST}"""
