"""Embedding near-duplicates by spherical-cap filters with list decoding.

Filter directions are a structured random product code: the vector space, randomly rotated, is split into blocks, each
with its own random unit codewords, and a filter is one codeword per block. A vector belongs to every filter whose
direction it exceeds a threshold with; these are found by list decoding (two halves, pruned by what the other can add),
not by trying all filters. Vectors that share a filter are compared in double precision.

The number of filters grows in proportion to the table, so that a filter holds a few unrelated vectors at any size;
the threshold follows from the wanted number of filters that a pair at the similarity limit shares. Several codes,
each with a rotation of its own, share that number, so that no direction of space is left without filters. Filters that many
vectors share are compared in pairs of blocks, each in its own task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import written
from .components import connected_components

LIMIT = 0.9
SHARED = 12.0  # filters that a pair at the limit shares on average
CODES = 6  # independent codes that these come from: one code alone favours vectors of even blocks
PER_VECTOR = 16  # filters of a code for each vector of the table
BLOCKS = 2
BLOCK_ROWS = 256


def cap_threshold(dim: int, filters: float, limit: float, shared: float) -> float:
    """t such that `filters` random unit directions hold, on average, `shared` with <u,x> >= t and <u,y> >= t, for
    unit x, y with <x,y> = limit: a numeric integral over the plane of x and y."""
    u = np.linspace(-1, 1, 801)[:, None]
    v = np.linspace(-1, 1, 801)[None, :]
    density = np.maximum(1 - u * u - v * v, 0) ** ((dim - 4) / 2) if dim > 4 else (u * u + v * v < 1).astype(float)
    density /= density.sum()
    low = np.minimum(u + 0 * v, limit * u + math.sqrt(1 - limit * limit) * v)
    order = np.argsort(-low, axis=None)
    mass = np.cumsum(density.ravel()[order])
    return float(low.ravel()[order][min(np.searchsorted(mass, shared / filters), low.size - 1)])


class ProductCode:
    """Rotation, codebooks and threshold for vectors of one dimension; a function of its arguments alone."""

    def __init__(self, dim: int, rows: int, limit: float, shared: float = SHARED, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
        blocks = len(self.edges) - 1
        self.words = max(4, math.ceil((PER_VECTOR * max(rows, 256)) ** (1 / blocks)))
        self.books = []
        for a, b in zip(self.edges, self.edges[1:]):
            book = rng.standard_normal((self.words, b - a))
            # a block's share of the direction's length is its share of the dimensions
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) * math.sqrt((b - a) / dim))
        self.threshold = cap_threshold(dim, float(self.words) ** blocks, limit, shared)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, the numbers of all filters that it exceeds."""
        x = unit @ self.rotation
        scores = [x[:, a:b] @ book.T for (a, b), book in zip(zip(self.edges, self.edges[1:]), self.books)]
        half = (len(scores) + 1) // 2

        def combine(parts: list[np.ndarray]) -> np.ndarray:
            total = np.zeros((len(x), 1))
            for s in parts:
                total = (total[:, :, None] + s[:, None, :]).reshape(len(x), -1)
            return total

        left, right = combine(scores[:half]), combine(scores[half:])
        best_l, best_r, n_right = left.max(axis=1), right.max(axis=1), right.shape[1]
        out = []
        for i in range(len(x)):
            a = np.flatnonzero(left[i] >= self.threshold - best_r[i])
            b = np.flatnonzero(right[i] >= self.threshold - best_l[i])
            p, q = np.nonzero(left[i][a][:, None] + right[i][b][None, :] >= self.threshold)
            out.append(a[p] * n_right + b[q])
        return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of the vectors of each length."""
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(n):
        yield int(dim), np.flatnonzero(n == dim)


def filter_rows(vectors: DataFrame, sizes: dict[int, int], limit: float, shared: float) -> DataFrame:
    """(id, filter) for all filters of each vector, in all codes for its length; `sizes` tells how many vectors of each
    length there are. Codes are made in the tasks, from their arguments; a filter's upper bits are the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list[ProductCode]] = {}
        for batch in batches:
            for dim, places in _by_length(batch.column(1)):
                if dim not in codes:
                    codes = {dim: [ProductCode(dim, sizes[dim], limit, shared / CODES, seed) for seed in range(CODES)]}
                step = max(16, min(512, (1 << 21) // codes[dim][0].words))  # bounded score matrices
                for at in range(0, len(places), step):
                    part = batch.take(pa.array(places[at : at + step]))
                    x = _matrix(part.column(1), dim).astype(np.float64)
                    each = [c.decode(x / np.linalg.norm(x, axis=1, keepdims=True)) for c in codes[dim]]
                    found = [np.concatenate([f[i] * CODES + k for k, f in enumerate(each)]) for i in range(len(x))]
                    n = np.array([len(f) for f in found])
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), n)), pa.array(np.concatenate(found).astype(np.int64) + (dim << 44))], ["id", "filter"])

    return vectors.select("id", "vector").mapInArrow(run, "id long, filter long")


def _compare(limit: float):
    """Links among rows (filter, i, j, block, id, vector) sorted by (filter, i, j): within a block, or across two."""

    def links(ids: np.ndarray, block: np.ndarray, x: np.ndarray, group: np.ndarray, across: np.ndarray) -> pa.RecordBatch:
        unit = np.sqrt(np.einsum("ij,ij->i", x, x))
        first = np.searchsorted(group, group, side="right")  # end of each row's group
        n = first - np.arange(len(ids)) - 1
        a = np.repeat(np.arange(len(ids)), n)
        b = np.arange(n.sum()) - np.repeat(np.append(0, np.cumsum(n)[:-1]), n) + a + 1
        use = ~across[a] | (block[a] != block[b])
        a, b = a[use], b[use]
        keep = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 16):
            p, q = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
            keep[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", x[p], x[q]) / (unit[p] * unit[q]) >= limit
        p, q = ids[a[keep]], ids[b[keep]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                rows = pa.Table.from_batches([batch.slice(at, 2048)])
                held = pa.concat_tables([held, rows]) if held is not None else rows
                key = np.stack([held[c].to_numpy() for c in ("filter", "i", "j")])
                new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
                last = int(np.flatnonzero(new)[-1])  # the last group may go on
                if last:
                    yield from _of(held.slice(0, last), new[:last])
                    held = held.slice(last)
        if held is not None and held.num_rows:
            key = np.stack([held[c].to_numpy() for c in ("filter", "i", "j")])
            yield from _of(held, np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0)))

    def _of(rows: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(new)
        for dim, places in _by_length(rows["vector"].combine_chunks()):  # vectors of a filter have one length
            part = rows.take(pa.array(places))
            x = _matrix(part["vector"].combine_chunks(), dim).astype(np.float64)
            yield links(part["id"].to_numpy(), part["block"].to_numpy(), x, group[places], part["i"].to_numpy() != part["j"].to_numpy())

    return run


def similar_pairs(vectors: DataFrame, limit: float = LIMIT, shared: float = SHARED) -> DataFrame:
    """Distinct pairs (a < b) of ids of `vectors` (id, vector) of one length that share a filter and have cosine >= limit."""
    sizes = {r["dim"]: r["count"] for r in vectors.groupBy(F.size("vector").alias("dim")).count().collect()}  # one row per length
    hits = written(filter_rows(vectors, sizes, limit, shared), "filters")
    sizes = hits.groupBy("filter").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK_ROWS).cast("int")
    placed = hits.join(sizes, "filter").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = placed.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = other.select("filter", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "block", "id")
    dealt = dealt.join(vectors.select("id", "vector"), "id").select("filter", "i", "j", "block", "id", "vector")
    near = dealt.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j").mapInArrow(_compare(limit), "a long, b long")
    return near.distinct()


def embedding_near_duplicates(table: DataFrame, limit: float = LIMIT, shared: float = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) for each row (vec_id, embedding).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Vectors of different
    lengths have no cosine, so each length links among itself. Equal vectors are one class and count as links of each
    other without being listed. Rows with a null vec_id link with nothing and have a null component_id. Repeated rows are
    rows of their own. An empty table gives an empty result; extra columns are ignored.
    """
    e = F.col("embedding")
    fine = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = table.select("vec_id", "embedding", fine.alias("fine"), F.xxhash64("embedding").alias("one"), F.hash("embedding").alias("two"))
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = rows.where("fine").groupBy("one", "two").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    # the class's vector is that of its first row; repeated ids are told by their vector
    vectors = rows.where("fine").join(classes.select("one", "two", "id"), ["one", "two"]).where("vec_id = id").select("one", "two", "embedding").dropDuplicates(["one", "two"])
    vectors = written(vectors.select(F.xxhash64("one", "two").alias("id"), F.col("embedding").alias("vector")), "vectors")
    links = written(similar_pairs(vectors, limit, shared), "links")
    groups = connected_components(links)
    named = classes.withColumn("key", F.xxhash64("one", "two"))
    ends = links.union(links.select("b", "a")).toDF("key", "other")
    n_links = ends.join(named.select(F.col("key").alias("other"), "copies"), "other").groupBy("key").agg(F.sum("copies").alias("others"))
    whole = named.join(n_links, "key", "left").join(groups.select(F.col("node").alias("key"), "root"), "key", "left")
    whole = whole.select("one", "two", "id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root"))
    least = whole.groupBy("root").agg(F.min("id").alias("component_id"))
    known = written(whole.join(least, "root").select("one", "two", "n_links", "component_id"), "known")
    out = rows.where("fine").join(known, ["one", "two"]).select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
