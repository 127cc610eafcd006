"""Receipts: coverage counts, claims against evidence, removal, attachments, blobs and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

RANK = {"supported": 3, "historical": 2, "proposed": 1, "unresolved": 0}


def strongest(locators: DataFrame) -> DataFrame:
    """Union of what several routes found: one row per place, the strongest status wins."""
    rank = F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv])[F.col("status")]
    return locators.groupBy("thread_id", "key", "source_seq").agg(F.max_by("status", rank).alias("status"), F.count("*").alias("routes"))


def coverage(places: DataFrame, required: int) -> DataFrame:
    """Counts per collection, and whether all its members are located and supported."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("supported", "historical", "proposed")]
    rows = places.groupBy("thread_id").agg(F.count_if(F.col("status") != "unresolved").alias("located"), *counts, F.count_if(F.col("status") == "unresolved").alias("open"))
    unresolved = F.greatest(F.col("open"), F.lit(required) - F.col("supported"))
    complete = (F.col("located") == required) & (F.col("supported") == required) & (F.col("historical") == 0) & (unresolved == 0)
    return rows.select("thread_id", "located", "supported", "historical", unresolved.alias("unresolved"), complete.alias("complete"))


def retained(value: Column, seen: Column) -> Column:
    """Whether two numbers are equal within 1e-9, as they are or after rounding either to 0 or 1 decimals (half up)."""
    half_up = lambda x, k: F.floor(x * 10**k + 0.5) / F.lit(10.0**k)
    close = lambda a, b: F.abs(a - b) < 1e-9
    out = close(value, seen)
    for k in (0, 1):
        out |= close(half_up(value, k), seen) | close(value, half_up(seen, k))
    return out


def removed(episodes: DataFrame, targets: DataFrame) -> DataFrame:
    """A new version of the archive with the contents of the targets replaced by a removal note."""
    gone = targets.select("thread_id", "seq", F.lit(True).alias("_gone"))
    rows = episodes.join(gone, ["thread_id", "seq"], "left").withColumn("removed", F.coalesce("_gone", F.lit(False)))
    note = F.concat(F.lit("[removed "), F.sha2("content", 256).substr(1, 12), F.lit("]"))
    return rows.withColumn("content", F.when(F.col("removed"), note).otherwise(F.col("content"))).drop("_gone")


def echoes(names: DataFrame, targets: DataFrame, episodes: DataFrame) -> DataFrame:
    """Assistant episodes, not removed themselves, that repeat a name of a removed one."""
    lost = names.join(targets, ["thread_id", "seq"], "left_semi").select("thread_id", "name").distinct()
    said = episodes.where(F.col("role") == "assistant").join(targets, ["thread_id", "seq"], "left_anti").select("thread_id", "seq")
    return names.join(said, ["thread_id", "seq"]).join(lost, ["thread_id", "name"], "left_semi").groupBy("thread_id", "seq").agg(F.countDistinct("name").alias("names"))


def attachment_spans(texts: DataFrame, key: str, chunk: int) -> DataFrame:
    """Byte spans [from, to) of each text's UTF-8 bytes, of `chunk` bytes at most, with their digests. Spans are made where the
    bytes are, and only places and digests are exploded."""
    data = F.encode("content", "UTF-8")
    rows = texts.select(key, data.alias("data")).withColumn("size", F.octet_length("data").cast("long")).where("size > 0")
    ordinals = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / chunk))
    span = lambda i: F.struct(i.alias("ordinal"), (i * chunk).alias("from_byte"), F.least(i * chunk + chunk, F.col("size")).alias("to_byte"), F.sha2(F.substring(F.col("data"), (i * chunk + 1).cast("int"), F.lit(chunk)), 256).alias("hash"))
    return rows.select(key, F.explode(F.transform(ordinals, span)).alias("s")).select(key, "s.*")


def partition_gaps(spans: DataFrame, key: str) -> DataFrame:
    """Spans that don't begin where the one before ended."""
    before = F.coalesce(F.lag("to_byte").over(Window.partitionBy(key).orderBy("ordinal")), F.lit(0))
    return spans.withColumn("expected", before).where(F.col("from_byte") != F.col("expected")).select(key, "ordinal", "from_byte", "expected")


def blobs(texts: DataFrame, key: str) -> DataFrame:
    """Content-addressed store: one row per distinct content with its references."""
    return texts.select(F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size"), key).groupBy("hash", "size").agg(F.count("*").alias("refs"), F.min(key).alias("first_ref"))


def reachable(references: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) of all that can be reached from the roots (node) over references (parent, child), roots included: the mark
    phase. Every round follows the references of what the last one found new, and ends when there is none; rounds are as many
    as the longest chain, cycles end by themselves. Each round is written."""
    edges = stored(references.select("parent", "child").where("parent is not null and child is not null").distinct(), "references")
    front = stored(roots.select("node").where("node is not null").distinct(), "marked")
    found = front
    while True:
        next_ = edges.join(front.withColumnRenamed("node", "parent"), "parent", "left_semi").select(F.col("child").alias("node")).distinct()
        front = stored(next_.join(found, "node", "left_anti"), "marked")
        if front.isEmpty():
            return found
        found = found.union(front)


def swept(blobs: DataFrame, marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blobs that stay and are exported, blobs that go), by hash."""
    keep = marked.select(F.col("node").alias("hash"))
    return blobs.join(keep, "hash", "left_semi"), blobs.join(keep, "hash", "left_anti")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def _packed(vectors: DataFrame, total: int, size: int) -> DataFrame:
    """(dim, rows): rows of about `size` vectors of one length each, dealt by hash."""
    part = F.pmod(F.xxhash64("vec_id", "x"), F.lit(max(1, -(-total // size))))
    return vectors.groupBy(F.size("x").alias("dim"), part.alias("part")).agg(F.collect_list(F.struct("vec_id", "x")).alias("rows")).select("dim", "rows")


def nearest(vectors: DataFrame, every: int, n: int, batch: int = 256, block: int = 4096) -> DataFrame:
    """For each vector whose id is divisible by `every`, the n others with the largest cosine: a stated query set against
    all rows, in blocks. Queries are packed by `batch`, vectors by `block`; each batch meets each block of its length in one
    matrix product, which puts out its best n for each query, and those are ranked once more. Vectors that are null, zero or
    hold null or non-finite components take no part, and vectors of different lengths aren't compared."""
    fine = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    unit = vectors.where(fine).select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    total = unit.count()
    asked = _packed(unit.where(F.col("vec_id") % every == 0), max(1, total // every), batch).withColumnRenamed("rows", "queries")
    pairs = _packed(unit, total, block).join(asked, "dim").select("rows", "queries")

    def matrix(rows: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        ids, x = rows.values.field(0).to_numpy(), rows.values.field(1)
        m = x.flatten().to_numpy().reshape(len(ids), -1)
        return ids, m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for have, want in zip(rows.column(0), rows.column(1)):
                (ids, x), (q_ids, q) = matrix(have), matrix(want)
                cosine = np.round(q @ x.T, 6)
                cosine[q_ids[:, None] == ids[None, :]] = -2.0
                order = np.lexsort((np.broadcast_to(ids, cosine.shape), -cosine), axis=1)[:, :n]
                found = np.take_along_axis(cosine, order, axis=1)
                keep = found.ravel() > -2.0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, order.shape[1])[keep]), pa.array(ids[order].ravel()[keep]), pa.array(found.ravel()[keep])], ["query_id", "vec_id", "cosine"])

    best = pairs.mapInArrow(run, "query_id long, vec_id long, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n).select("query_id", "rank", "vec_id", "cosine")


def agreed_phase(spans: DataFrame) -> DataFrame:
    """The one status that all facts touching a span agree on, or unresolved."""
    return spans.groupBy("thread_id", "span").agg(F.when(F.countDistinct("phase") == 1, F.first("phase")).otherwise("unresolved").alias("phase"), F.count("*").alias("facts"))


def nearest_rank(rows: DataFrame, value: str, shares: list[float], *keys: str, middle: str = "ceil") -> DataFrame:
    """Percentiles by nearest rank: the value at place ceil(share * n), or at round(share * (n - 1)) counted from 0. Equal
    values are counted first, so that what is sorted is the distinct values of a group, not its rows."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*keys).orderBy(value)
    placed = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    place = lambda s: F.ceil(F.lit(s) * F.col("_n")) if middle == "ceil" else F.floor(F.lit(s) * (F.col("_n") - 1) + 0.5) + 1
    aggs = [F.min(F.when(F.col("_to") >= place(s), F.col(value))).alias(f"p{round(s * 100)}") for s in shares]
    return placed.groupBy(*keys).agg(*aggs, F.max(value).alias("max"), F.max("_n").cast("long").alias("n"))
