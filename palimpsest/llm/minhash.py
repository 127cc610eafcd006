"""Near-duplicate documents by SuperMinHash signatures, banding, verification and connected groups.

1. Every text gives its set of distinct word shingles (64-bit hashes), a SuperMinHash signature of that set, and one
   key per band of the signature. Documents with equal sets are one class from here on.
2. In each bucket (classes with a common band key) every class is paired with the bucket's leader only, and pairs are
   verified on full sets. Most groups are whole after that.
3. Buckets whose members are still in different groups are finished exactly: all pairs across groups in buckets up to
   a small size, and a prefix-filter join (rarest shingles first) over the members of larger ones, which finds every
   pair at the threshold whatever the bucket's size. So pairs within a group of copies are never listed.
4. Groups are the connected components of the verified links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, written
from ._text import Words, distinct_by_row, mix, shingles, slices
from .components import connected_components

WIDTH = 5
PERCENT = 75
BANDS = 40
ROWS = 5
SMALL_BUCKET = 32
_U = np.uint64


def superminhash(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """(rows, size) signatures of the element hashes h[first[i]:first[i + 1]], as uint32 of (level, fraction).

    Element e visits the slots in the order of its own random permutation; at its j-th visit it offers j + u with u
    in [0, 1). A slot keeps its least offer. A row stops at the level where all its slots hold smaller ones. Rows of
    no elements keep the largest value everywhere.
    """
    count = np.diff(first)
    out = np.full((len(count), size), 0xFFFFFFFF, np.uint32)
    order = np.argsort(count, kind="stable")
    order = order[count[order] > 0]
    total = np.cumsum(count[order])
    at = 0
    while at < len(order):  # rows of like size together, about 64k elements at a time
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 65_536, side="right")))
        rows = order[at:end]
        n = count[rows]
        row = np.repeat(np.arange(len(rows)), n)
        e = h[np.repeat(first[rows] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
        out[rows] = _batch(e, row, len(rows), size)
        at = end
    return out


def _batch(e: np.ndarray, row: np.ndarray, rows: int, size: int) -> np.ndarray:
    sig = np.full((rows, size), 0xFFFFFFFF, np.uint32)
    flat = sig.ravel()
    past: list[np.ndarray] = []
    perm = None
    for level in range(size):
        if level:
            live = (sig.max(axis=1) >= level << 25)[row]
            if not live.all():
                e, row, past = e[live], row[live], [x[live] for x in past]
                perm = perm[live] if perm is not None else None
            if not len(e):
                break
        x = mix(e + _U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = level + (((x >> _U(32)) * _U(size - level)) >> _U(32)).astype(np.int64)
        # Fisher-Yates: only what later visits can still reach is kept
        if level == 0:
            slot = k
        elif level == 1:
            slot = np.where(k == past[0], 0, k)
        else:
            each = np.arange(len(e))
            if perm is None:
                perm = np.tile(np.arange(size, dtype=np.int16), (len(e), 1))
                for i, was in enumerate(past):
                    perm[each, was] = perm[:, i]
            slot = perm[each, k].astype(np.int64)
            perm[each, k] = perm[:, level]
        if level < 2:
            past.append(k)
        np.minimum.at(flat, row * size + slot, (_U(level << 25) | (x & _U((1 << 25) - 1))).astype(np.uint32))
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for j in range(rows):
        out = mix(out + sig[:, j : bands * rows : rows].astype(np.uint64) + _U(j + 1))
    return mix(out + np.arange(bands, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)).astype(np.int64)


def _sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, and where each row's begin."""
    row, h = distinct_by_row(*shingles(Words(column), width))
    return h, np.searchsorted(row, np.arange(len(column) + 1))


def _class_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    one = np.append(_U(0), np.cumsum(mix(h + _U(0x5851F42D4C957F2D)), dtype=np.uint64))
    return mix(mix(one[first[1:]] - one[first[:-1]]) + np.diff(first).astype(np.uint64)).astype(np.int64)


def _tag() -> Column:
    """Tells rows apart: one row of a class, and its repetitions, stands for all."""
    return F.xxhash64("doc_id", "text")


def shingle_signatures(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, tag (of the row), n_shingles, class (id of the set) and its band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = _sets(part.column(1), width)
                keys = band_keys(superminhash(h, first, bands * rows), bands, rows)
                some = np.diff(first) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some * bands)).astype(np.int32)), pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(first)), pa.array(_class_ids(h, first)), lists], ["doc_id", "tag", "n_shingles", "class", "keys"])

    return docs.select("doc_id", "text", _tag()).mapInArrow(run, "doc_id long, tag long, n_shingles long, class long, keys array<long>")


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """class and its full set, as sorted hashes; each class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, first = _sets(part.column(0), width)
                yield pa.RecordBatch.from_arrays([pa.array(_class_ids(h, first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.astype(np.int64)))], ["class", "shingles"])

    sets = docs.select("text").mapInArrow(run, "class long, shingles array<long>")
    return sets.groupBy("class").agg(F.first("shingles").alias("shingles"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.toDF("b", "sb"), "b").join(sets.toDF("a", "sa"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs across groups that can reach the threshold. In one order of all shingles by rarity, two sets at the
    threshold share one of their first n - ceil(n * percent / 100) + 1; and where they share those at places i and j,
    the rarer ones before leave room for at most 1 + min(n - i, m - j) common ones, which must be enough."""
    items = sets.join(members.select("class", "group").distinct(), "class").select("class", "group", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    spread = items.groupBy("h").agg(F.count("*").alias("spread"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("spread", "h"))
    prefix = items.join(spread, "h").withColumn("place", place).where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1) & (F.col("spread") > 1)).select("class", "group", "n", "h", "place")
    mixed = prefix.groupBy("h").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo < hi").select("h")
    prefix = prefix.join(mixed, "h").select("class", "group", "n", "h", "place")
    other = prefix.toDF("class2", "group2", "n2", "h", "place2")
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2"))
    near = (F.col("class") < F.col("class2")) & (F.col("group") != F.col("group2")) & ((100 + percent) * room >= percent * (F.col("n") + F.col("n2")))
    return prefix.join(other.withColumnRenamed("h", "h2"), (F.col("h") == F.col("h2")) & near).select(F.col("class").alias("a"), F.col("class2").alias("b")).distinct()


def _groups(docs: DataFrame, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(rows with doc_id, tag, n_shingles and class, class -> root of its group and component_id)."""
    base = written(shingle_signatures(docs, width, bands, rows), "signatures")
    filled = base.where("n_shingles > 0")
    reps = filled.groupBy("class").agg(F.min("doc_id").alias("rep"), F.min("tag").alias("tag"))
    keyed = filled.select("class", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("top"), F.count("*").alias("met")).where("low < top").select("key", "met")
    found = written(keyed.join(shared, "key").select("key", "met", "class").distinct(), "buckets")
    # the leader is the member that meets most others in all its buckets: in a group of edited copies, the least edited
    central = found.groupBy("class").agg(F.sum("met").alias("meets"))
    leads = found.join(central, "class").groupBy("key").agg(F.max(F.struct("meets", "class"))["class"].alias("lead"))
    members = written(found.join(leads, "key").select("key", "lead", "class"), "buckets")
    first = written(members.where("class <> lead").select(F.col("lead").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    wanted = reps.join(members.select("class").distinct(), "class").select("tag")
    tagged = docs.select("doc_id", "text").withColumn("tag", _tag())
    sets = written(shingle_sets(tagged.join(wanted, "tag", "left_semi"), width), "sets")
    links = written(_linked(first, sets, percent), "links")
    groups = connected_components(links)
    # buckets that still hold several groups
    grouped = members.join(groups.select(F.col("node").alias("class"), "root"), "class", "left").select("key", "lead", "class", F.coalesce("root", "class").alias("group"))
    open_keys = grouped.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("size")).where("lo < hi").select("key", "size")
    rest = written(grouped.where("class <> lead").join(open_keys, "key"), "open")
    small = rest.where(F.col("size") <= SMALL_BUCKET).select("key", "class", "group")
    across = small.join(small.toDF("key", "class2", "group2"), "key").where("class < class2 and group <> group2").select(F.col("class").alias("a"), F.col("class2").alias("b"))
    large = grouped.join(open_keys.where(F.col("size") > SMALL_BUCKET), "key").select("class", "group").distinct()
    more = across.union(_prefix_pairs(large, sets, percent)).distinct().join(first, ["a", "b"], "left_anti").join(first.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    found = written(_linked(more, sets, percent), "links")
    if not found.isEmpty():
        groups = connected_components(links.union(found))
    named = reps.join(groups.select(F.col("node").alias("class"), "root"), "class", "left").select("class", "rep", F.coalesce("root", "class").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return base, written(named.join(smallest, "root").select("class", "root", "component_id"), "groups")


def near_duplicate_groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept (doc_id = component_id) for each row.

    Texts with fewer words than `width` have their whole word sequence as the one shingle. Null, empty and blank texts
    have an empty set and stand alone. Rows with a null doc_id link others but never name a group: a group of such rows
    alone has a null component_id and kept = false. Repeated rows come back once each. An empty table gives an empty
    result; extra columns are ignored.
    """
    base, names = _groups(docs, width, percent, bands, rows)
    ids = base.where("n_shingles > 0").join(names, "class").select("doc_id", "n_shingles", "component_id")
    out = ids.union(base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The rows of docs, all columns, with one text of each near-duplicate group: that of least doc_id (a null one comes
    last), then of the least hash of its row. Rows repeated in doc_id and text stay once, that with the least other
    columns; so a doc_id with two different texts keeps both unless they are near copies. Texts without words stay.
    """
    base, names = _groups(docs, width, percent, bands, rows)
    grouped = base.where("n_shingles > 0").join(names, "class")
    first = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag")).alias("first"))
    stay = first.select("first.tag").withColumn("alone", F.lit(False)).union(base.where("n_shingles = 0").select("tag", F.lit(True)).distinct())
    columns = docs.columns
    plain = [f"c{i}" for i in range(len(columns))]
    # the text is the same in all repetitions, so it comes last in their order
    order = sorted(range(len(columns)), key=lambda i: columns[i] == "text")
    raw = docs.select(_tag(), *columns).toDF("tag", *plain)
    kept = raw.join(stay, "tag")
    once = kept.where("not alone").groupBy("tag").agg(F.min(F.struct(*[plain[i] for i in order])).alias("row")).select(*[F.col("row")[c] for c in plain])
    return once.union(kept.where("alone").select(*plain)).toDF(*columns)


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(documents(spark, sf_dir))
