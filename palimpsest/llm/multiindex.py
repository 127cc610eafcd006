"""Nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised by themselves, so that K centroids a half make K * K cells. The cells of a query are
traversed by the sum of its distances to both centroids, with a heap that holds one candidate for each centroid of the
first half it has reached, until the cells passed hold `visit` entries; these are ranked by their exact distances.

* The codebooks are trained by k-means on at most SAMPLE vectors of a length (fewer if they are long), those of the least
  hashes. Every row is indexed.
* `visit` is measured, not guessed: for at most CHECKED queries the true neighbours are looked up among all rows, and
  `visit` is the number of entries after which AIM of them were passed.
* Equal vectors are one entry with its k + 1 least ids, which is all that a result can hold of them.
* Entries are dealt into blocks of about BLOCK rows: several small cells, or a part of a large one. A query goes once to
  each block that holds some of its cells, and blocks that many queries ask are copied, so that a task never holds more
  than a block and PROBES queries, however large a cell or a group of near copies is.
* Vectors of different lengths have no distance. The LENGTHS most frequent lengths have codebooks if they have LEAST
  vectors; each other length is one cell, whose entries are all ranked.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import written

NEAREST = 10
SAMPLE = 16_384
SAMPLE_NUMBERS = 1 << 23  # numbers of a sample: long vectors have a smaller one
LEAST = 4096
LENGTHS = 16
CELL_ROWS = 64  # vectors for each cell that the number of centroids aims at
MOST_CENTROIDS = 1024
ROUNDS = 10
CHECKED = 64
AIM = 0.97
BLOCK = 4096
PROBES = 4096

Books = dict[int, tuple[np.ndarray, np.ndarray]]


def halves(dim: int) -> tuple[slice, slice]:
    return slice(0, dim // 2), slice(dim // 2, dim)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :], 0)


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """k centroids of the rows; centroids that lose all rows start again at the rows farthest from theirs."""
    rng = np.random.default_rng(seed)
    book = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = [squares(x[a : a + 2048], book) for a in range(0, len(x), 2048)]
        cell, far = np.concatenate([d.argmin(axis=1) for d in near]), np.concatenate([d.min(axis=1) for d in near])
        count = np.bincount(cell, minlength=len(book))
        order = np.argsort(cell, kind="stable")
        begins = np.searchsorted(cell[order], np.flatnonzero(count))
        book[count > 0] = np.add.reduceat(x[order], begins, axis=0) / count[count > 0][:, None]
        empty = np.flatnonzero(count == 0)
        book[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return book


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for dim in np.unique(n):
        yield int(dim), np.flatnonzero(n == dim)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to q, in doubles; rows whose squares overflow are scaled first."""
    with np.errstate(over="ignore", invalid="ignore"):
        d = x - q
        out = np.sqrt((d * d).sum(axis=1))
        for i in np.flatnonzero(~np.isfinite(out)):
            scale = max(np.abs(x[i]).max(), np.abs(q).max())
            part = x[i] / scale - q / scale
            out[i] = math.sqrt(float((part * part).sum())) * scale
    return out


@dataclass
class Index:
    """entries (dim, cell, ids, vector) are a written table; counts: entries of each cell, for lengths with codebooks."""

    entries: DataFrame
    books: Books
    counts: dict[int, np.ndarray]
    k: int
    visit: dict[int, int]


def taking_part(table: DataFrame) -> DataFrame:
    """Distinct (vec_id, embedding) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return table.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).distinct()


def train(classes: DataFrame, sizes: dict[int, int], cell_rows: int) -> Books:
    """Codebooks for the lengths in `sizes`; each half is trained in a task of its own, on the bounded sample."""
    rows = F.least(F.lit(SAMPLE), F.floor(F.lit(SAMPLE_NUMBERS) / F.col("dim")) + 1024)
    order = Window.partitionBy("dim").orderBy(F.xxhash64("vector"), "vector")
    some = classes.where(F.col("dim").isin(list(sizes))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).where(F.col("r") <= rows)
    both = some.select("dim", "vector", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))

    def learn(group: pa.Table) -> pa.Table:
        dim, half = group["dim"][0].as_py(), group["half"][0].as_py()
        x = matrix(group["vector"].combine_chunks(), dim)[:, halves(dim)[half]]
        k = max(1, min(MOST_CENTROIDS, math.ceil(math.sqrt(sizes[dim] / cell_rows)), len(x) // 4)) if x.shape[1] else 1
        book = k_means(x, k) if x.shape[1] else np.zeros((1, 0))
        return pa.table({"dim": [dim] * len(book), "half": [half] * len(book), "place": list(range(len(book))), "centroid": pa.array(list(book), pa.list_(pa.float64()))})

    found: dict[tuple[int, int], list] = {}
    for r in both.groupBy("dim", "half").applyInArrow(learn, "dim long, half long, place long, centroid array<double>").collect():  # at most MOST_CENTROIDS each
        found.setdefault((r["dim"], r["half"]), []).append((r["place"], r["centroid"]))
    book = lambda dim, half: np.array([c for _, c in sorted(found[dim, half])], float).reshape(len(found[dim, half]), -1)
    return {dim: (book(dim, 0), book(dim, 1)) for dim in sizes}


def build_index(table: DataFrame, k: int = NEAREST, cell_rows: int = CELL_ROWS, least: int = LEAST) -> Index:
    """The index of all rows (vec_id, embedding) that take part; `k`: results that a search may ask for, at most."""
    ids = Window.partitionBy("embedding").orderBy("vec_id")
    few = taking_part(table).withColumn("r", F.row_number().over(ids)).where(F.col("r") <= k + 1)
    classes = few.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))  # at most k + 1
    classes = written(classes.select(F.size("embedding").alias("dim"), "ids", F.col("embedding").alias("vector")), "vector-classes")
    often = classes.groupBy("dim").count().where(F.col("count") >= least).orderBy(F.desc("count"), "dim").limit(LENGTHS)
    books = train(classes, {r["dim"]: r["count"] for r in often.collect()}, cell_rows)

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int32)
            for dim, places in by_length(batch.column(2)):
                if dim in books:
                    step = max(16, (1 << 20) // max(map(len, books[dim])))
                    for lo in range(0, len(places), step):
                        x = matrix(batch.column(2).take(pa.array(places[lo : lo + step])), dim)
                        i, j = (squares(x[:, h], book).argmin(axis=1) for h, book in zip(halves(dim), books[dim]))
                        cell[places[lo : lo + step]] = i * len(books[dim][1]) + j
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), batch.column(1), batch.column(2)], ["dim", "cell", "ids", "vector"])

    kind = classes.schema["vector"].dataType.simpleString()
    entries = written(classes.mapInArrow(quantise, f"dim int, cell int, ids array<bigint>, vector {kind}"), "multi-index")
    counts = {dim: np.zeros(len(a) * len(b), np.int64) for dim, (a, b) in books.items()}
    for r in entries.where(F.col("dim").isin(list(books))).groupBy("dim", "cell").count().toLocalIterator():  # at most MOST_CENTROIDS ** 2 a length
        counts[r["dim"]][r["cell"]] = r["count"]
    index = Index(entries, books, counts, k, {})
    index.visit = measured_visits(index, table)
    return index


def traverse(q: np.ndarray, books: tuple[np.ndarray, np.ndarray], counts: np.ndarray, visit: int) -> list[int]:
    """Cells that aren't empty, by ascending sum of distances, until they hold `visit` entries.

    The heap holds, for each centroid of the first half that was reached, its pair with the nearest centroid of the second
    half that wasn't passed; a pair with the very nearest one lets in the next centroid of the first half.
    """
    one, two = (squares(q[None, h], book)[0] for h, book in zip(halves(len(q)), books))
    first, second = np.argsort(one, kind="stable"), np.argsort(two, kind="stable")
    heap, out, seen = [(one[first[0]] + two[second[0]], 0, 0)], [], 0
    while heap and seen < visit:
        _, i, j = heapq.heappop(heap)
        cell = int(first[i]) * len(two) + int(second[j])
        if counts[cell]:
            out.append(cell)
            seen += int(counts[cell])
        if j + 1 < len(second):
            heapq.heappush(heap, (one[first[i]] + two[second[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (one[first[i + 1]] + two[second[0]], i + 1, 0))
    return out


def nearest(x: np.ndarray, ids: list[list[int]], query: int, q: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """The k nearest (distance, id, row), ties to the smaller id, each id once, without the query's own."""
    d, some = distances(x, q), k + 1
    while True:  # once, unless entries are the query's own or repeat an id
        limit = np.partition(d, some)[some] if len(d) > some else np.inf
        found: dict[int, tuple[float, int, int]] = {}
        for score, i, r in sorted((float(d[r]), i, int(r)) for r in np.flatnonzero(d <= limit) for i in ids[r] if i != query):
            found.setdefault(i, (score, i, r))
        if len(found) >= k or limit == np.inf:
            return list(found.values())[:k]
        some *= 2


def queries_of(table: DataFrame) -> DataFrame:
    """query_id and vector: rows whose vec_id is divisible by 100; the least vector, if an id has several."""
    return taking_part(table).where(F.col("vec_id") % 100 == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("vector"))


def measured_visits(index: Index, table: DataFrame) -> dict[int, int]:
    """For each length with codebooks: the entries to pass until AIM of the true neighbours of some queries were among them."""
    if not index.books:
        return {}
    k, order = index.k, Window.partitionBy("dim").orderBy(F.xxhash64("query_id"), "query_id")
    asked = queries_of(table).withColumn("dim", F.size("vector")).where(F.col("dim").isin(list(index.books)))
    some: dict[int, list] = {}
    for r in asked.withColumn("r", F.row_number().over(order)).where(F.col("r") <= CHECKED).collect():
        some.setdefault(r["dim"], []).append((r["query_id"], np.array(r["vector"], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            for dim, places in by_length(batch.column(2)):
                part = batch.take(pa.array(places))
                x, ids, cell = matrix(part.column(2), dim), part.column(1).to_pylist(), part.column(0).to_numpy()
                for query, q in some.get(dim, []):
                    found = [(score, i, int(cell[r])) for score, i, r in nearest(x, ids, query, q, k)]
                    best[dim, query] = sorted(best.get((dim, query), []) + found)[:k]
        rows = [(dim, query, *x) for (dim, query), found in best.items() for x in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int32()))], ["dim", "query", "score", "id", "cell"])

    true = index.entries.where(F.col("dim").isin(list(index.books))).select("cell", "ids", "vector").mapInArrow(run, "dim int, query long, score double, id long, cell int")
    first = Window.partitionBy("dim", "query").orderBy("score", "id")
    cells: dict[tuple[int, int], list[int]] = {}
    for r in true.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).collect():  # at most k a query
        cells.setdefault((r["dim"], r["query"]), []).append(r["cell"])
    visit = {dim: int(counts.sum()) for dim, counts in index.counts.items()}
    for dim, queries in some.items():
        passed = []
        for query, q in queries:
            way = traverse(q, index.books[dim], index.counts[dim], visit[dim])
            after = dict(zip(way, np.cumsum(index.counts[dim][way]).tolist()))
            passed += [after[c] for c in cells.get((dim, query), [])]
        if passed:
            visit[dim] = int(np.quantile(passed, AIM, method="higher"))
    return visit


def _dealt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first block, number of blocks) of each cell, for blocks of about BLOCK entries."""
    start = np.cumsum(counts) - counts
    first = start // BLOCK
    return first, np.maximum((start + counts - 1) // BLOCK - first + 1, 1)


def search(index: Index, queries: DataFrame, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each row (query_id, vector) with distinct ids.

    Distances are Euclidean, of the original vectors in double precision; ties go to the smaller vec_id; all rows of a
    query's own id are left out; an id is listed once. Rows with a null id, and vectors that are null, zero or hold null or
    non-finite components take no part, and vectors of another length aren't compared. An empty table gives an empty
    result; extra columns are ignored.
    """
    if k > index.k:
        raise ValueError("the index was built for fewer results")
    books, counts, visit = index.books, index.counts, index.visit
    dealt = {dim: _dealt(c) for dim, c in counts.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, cell, salt = (batch.column(i).to_numpy() for i in range(3))
            block = np.zeros(batch.num_rows, np.int64)
            for d in set(np.unique(dim).tolist()) & set(dealt):
                use = dim == d
                first, n = dealt[d][0][cell[use]], dealt[d][1][cell[use]]
                block[use] = first + salt[use] % n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(block), *batch.columns[1:2], *batch.columns[3:]], ["dim", "block", "cell", "ids", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                q = np.array(batch.column(1)[at].as_py(), float)
                dim = len(q)
                cells = np.array(traverse(q, books[dim], counts[dim], visit[dim]), np.int64)
                first, n = dealt[dim][0][cells], dealt[dim][1][cells]
                block = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                owner = np.repeat(cells, n)
                order = np.lexsort((owner, block))
                block, owner = block[order], owner[order]
                asked, begins = np.unique(block, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(owner)), pa.int32()), pa.array(owner.astype(np.int32)))
                same = [batch.column(i).take(pa.array(np.full(len(asked), at))) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(asked), dim, np.int32)), pa.array(asked), same[0], same[1], lists], ["dim", "block", "query_id", "vector", "cells"])

    kind = index.entries.schema["vector"].dataType.simpleString()
    salted = index.entries.select("dim", "cell", F.pmod(F.xxhash64("vector"), F.lit(1 << 30)).alias("salt"), "ids", "vector")
    coded = F.col("dim").isin(list(books))
    entries = salted.where(coded).mapInArrow(place, f"dim int, block long, cell int, ids array<bigint>, vector {kind}")
    # a length without codebooks: one cell in so many blocks as its entries need
    plain = salted.where(~coded)
    sizes = plain.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    entries = entries.union(plain.join(sizes, "dim").select("dim", F.pmod("salt", "blocks").alias("block"), "cell", "ids", "vector"))
    asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast(kind).alias("vector"), F.size("vector").alias("dim"))
    probes = asked.where(coded).select("query_id", "vector").mapInArrow(probe, f"dim int, block long, query_id long, vector {kind}, cells array<int>")
    rest = asked.where(~coded).join(sizes, "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "query_id", "vector", F.array(F.lit(0)).alias("cells"))
    probes = written(probes.union(rest), "probes")
    # blocks that many queries ask are copied
    loads = probes.groupBy("dim", "block").agg(F.ceil(F.count("*") / PROBES).alias("copies"))
    left = entries.join(loads, ["dim", "block"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies")
    right = probes.join(loads, ["dim", "block"]).withColumn("copy", F.pmod(F.xxhash64("query_id"), F.col("copies"))).drop("copies")

    def rank(entries: pa.Table, probes: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if entries.num_rows and probes.num_rows:
            entries = entries.sort_by("cell")
            dim = entries["dim"][0].as_py()
            x, ids, cell = matrix(entries["vector"].combine_chunks(), dim), entries["ids"].to_pylist(), entries["cell"].to_numpy()
            asking = matrix(probes["vector"].combine_chunks(), dim)
            for query, q, cells in zip(probes["query_id"].to_pylist(), asking, probes["cells"]):
                wanted = cells.values.to_numpy()
                a, b = np.searchsorted(cell, wanted), np.searchsorted(cell, wanted, side="right")
                use = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())
                rows += [(query, i, score) for score, i, _ in nearest(x[use], [ids[r] for r in use], query, q, k)] if len(use) else []
        return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})

    keys = ("dim", "block", "copy")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build_index(table), queries_of(table))
