"""Removal of repeated passages with suffix arrays.

A byte is removed if a `length`-byte string that covers it also starts anywhere else. To bring equal strings together
without moving every suffix, each window of that length has an anchor: the k-gram in it with the least hash, the
leftmost on ties. Equal windows have equal anchors at equal places, so

1. every document is cut into segments (all windows with one anchor, a few hundred bytes) with the anchor's hash and
   the segment's; an anchor seen once can't hold a repeat and is dropped;
2. a segment whose whole content occurs twice is a repeat at once;
3. the other segments with a repeated anchor, and one of each content that step 2 found, are dealt by anchor. Tasks
   build suffix arrays of bounded batches of them: suffixes smaller than their successors are sorted directly, the
   rest are induced by bucket scans, and adjacent common prefixes tell which windows repeat;
4. anchors with too many different segments for a batch go another exact way: their windows are counted by content.

Texts move twice, compressed: once to cut segments out, once to remove the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, written
from ._text import _INV, byte_prefix_hash, column_bytes, mix, powers, range_hash, slices

LENGTH = 200
GRAM = 64
BATCH_BYTES = 1 << 20
LARGE_GROUP = 4096  # different segments of one anchor
_U = np.uint64
_POS_BITS = 28


# ---- suffix arrays of one batch ------------------------------------------------------------------------------


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of a byte array, sorted by their first `depth` bytes at least (ties in any order).

    Two stages: type S suffixes (smaller than their successor) are sorted directly, the others are induced from them
    bucket by bucket, by the first byte, from the smallest up.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    # type of each suffix: that of the next different byte; the last suffix is larger than its (empty) successor
    change = np.flatnonzero(text[:-1] != text[1:])
    run_end = np.append(change, n - 1)[np.searchsorted(change, np.arange(n))]
    smaller = np.zeros(n, bool)
    inner = run_end < n - 1
    smaller[inner] = text[run_end[inner]] < text[run_end[inner] + 1]
    order_s = _sort_directly(text, smaller, depth)
    # buckets by first byte; in each, type L come before type S
    starts_l: list[list[np.ndarray]] = [[] for _ in range(256)]
    by_byte = text[order_s]
    bounds = np.searchsorted(by_byte, np.arange(257))
    starts_l[text[n - 1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        part_s = order_s[bounds[c] : bounds[c + 1]]
        found = starts_l[c]
        k = 0
        while k < len(found):  # a type L suffix may put its predecessor into this same bucket, behind
            before = found[k] - 1
            before = before[(before >= 0)]
            before = before[~smaller[before] & (text[before] >= c)]
            _deal(text, before, starts_l)
            k += 1
        before = part_s - 1
        before = before[before >= 0]
        _deal(text, before[~smaller[before]], starts_l)
        out += [*found, part_s]
    return np.concatenate(out)


def _deal(text: np.ndarray, starts: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append suffixes to the buckets of their first bytes, in the given order."""
    if not len(starts):
        return
    byte = text[starts]
    order = np.argsort(byte, kind="stable")
    byte, starts = byte[order], starts[order]
    cut = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
    for a, b in zip(cut, np.append(cut[1:], len(byte))):
        buckets[byte[a]].append(starts[a:b])


def _ranks(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of the tuples of keys."""
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum()) + 1


def _sort_directly(text: np.ndarray, smaller: np.ndarray, depth: int) -> np.ndarray:
    """Type S suffixes in order. First by eight bytes (and, if these tie, by how far the next sorted start is: the
    nearer one is of type S where the other is of type L with the same byte, so it is the larger); then ranks are
    doubled over the sequence of starts. Long descents get extra starts, so that eight bytes always reach the next."""
    n = len(text)
    pick = smaller.copy()
    gap_start = np.flatnonzero(pick)
    edges = np.append(np.append(-1, gap_start), n)
    wide = np.flatnonzero(np.diff(edges) > 7)
    for i in wide:
        pick[edges[i] + 7 : edges[i + 1] : 7] = True
    at = np.flatnonzero(pick)
    if not len(at):
        return at
    padded = np.append(text, np.zeros(8, np.uint8))
    word = np.zeros(len(at), np.uint64)
    for j in range(8):
        word = (word << _U(8)) | padded[at + j].astype(np.uint64)
    distance = np.append(at[1:], n + 8) - at
    inside = np.minimum(n - at, 8)  # a suffix that ends is smaller than one that goes on in zero bytes
    rank, kinds = _ranks(word, inside, -distance)
    step = 1
    while kinds < len(at) and step < depth:
        follow = np.zeros(len(at), np.int64)
        if step < len(at):
            follow[:-step] = rank[step:] + 1
        rank, kinds = _ranks((rank.astype(np.uint64) << _U(31)) | follow.astype(np.uint64))
        step *= 2
    order = at[np.argsort(rank, kind="stable")]
    return order[smaller[order]]


def repeated_starts(text: np.ndarray, valid: np.ndarray, length: int) -> np.ndarray:
    """Of the starts marked valid, those whose `length` bytes also start at another valid one. The caller makes sure
    that these bytes exist."""
    order = suffix_array(text, length)
    order = order[valid[order]]
    if len(order) < 2:
        return order[:0]
    a, b = order[:-1], order[1:]
    # adjacent common prefixes, eight bytes at a time and only as far as they go
    same = np.arange(len(a))
    words = -(-length // 8)
    for w in range(words):
        at = min(8 * w, length - 8)
        same = same[_word(text, a[same] + at) == _word(text, b[same] + at)]
        if not len(same):
            break
    hit = np.zeros(len(order), bool)
    hit[same] = True
    hit[same + 1] = True
    return np.sort(order[hit])


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(text, 8)[at].copy().view(np.uint64).ravel()


# ---- segments of a document ----------------------------------------------------------------------------------


def segments(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, anchor hash, content hash) of all segments in the rows of a slice; windows are
    places in the slice. Rows shorter than `length` have none."""
    n = len(data)
    width = length - gram + 1
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    if n >= 1 << _POS_BITS:
        raise ValueError("a text of 256 MB or more")
    prefix = byte_prefix_hash(data)
    m = n - gram + 1
    h = mix((prefix[gram:] - prefix[:m]) * powers(m, _INV))
    key = (h >> _U(_POS_BITS) << _U(_POS_BITS)) | np.arange(m, dtype=np.uint64)
    # least key in each window of `width` grams: minima from both sides of fixed blocks
    pad = np.append(key, np.full((-m) % width, np.iinfo(np.uint64).max, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = m - width + 1
    anchor = (np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows]) & _U((1 << _POS_BITS) - 1)).astype(np.int64)
    # windows inside one row
    room = np.diff(off) - length + 1
    row = np.flatnonzero(room > 0)
    n_row = room[row]
    p = np.repeat(off[row] - np.append(0, np.cumsum(n_row)[:-1]), n_row) + np.arange(n_row.sum())
    owner = np.repeat(row, n_row)
    if not len(p):
        return none
    own = anchor[p]
    new = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])))
    lo, hi = p[new], p[np.append(new[1:], len(p)) - 1]
    return owner[new], lo, hi, h[own[new]], range_hash(prefix, lo, hi + length)


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = column_bytes(part.column(1))
                row, lo, hi, anchor, content = segments(data, off, length, gram)
                at = part.column(0).to_numpy(zero_copy_only=False)[row]
                place = ((lo - off[row]) << 8) | (hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(place), pa.array(anchor.astype(np.int64)), pa.array(content.astype(np.int64))], ["at", "place", "anchor", "content"])

    return run


def _packed(docs: DataFrame, *carry: str) -> DataFrame:
    """at, the compressed bytes of each row's text (for a shuffle), and other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                packed = pa.array([press.compress(x.as_buffer() or b"") if x.is_valid else b"" for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), packed, *part.columns[2:]], ["at", "packed", *carry])

    return docs.select("at", "text", *carry).mapInArrow(run, "at long, packed binary" + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry))


def _unpack(value: pa.BinaryScalar, tool: zstandard.ZstdDecompressor) -> bytes:
    raw = value.as_buffer()
    return tool.decompress(raw) if raw is not None and len(raw) else b""


def _cut(length: int):
    """(at, packed, places) -> the bytes of each wanted segment, by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            at, lo, anchor, span, data, size = [], [], [], [], [], 0
            for doc, packed, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = _unpack(packed, tool)
                for x in wanted.as_py():
                    first, more = x["place"] >> 8, x["place"] & 255
                    at.append(doc)
                    lo.append(first)
                    anchor.append(x["anchor"])
                    span.append(more)
                    data.append(text[first : first + more + length])
                    size += more + length
                if size > 4 << 20:
                    yield _pieces(at, lo, anchor, span, data)
                    at, lo, anchor, span, data, size = [], [], [], [], [], 0
            yield _pieces(at, lo, anchor, span, data)

    def _pieces(at, lo, anchor, span, data) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(lo, pa.int64()), pa.array(anchor, pa.int64()), pa.array(span, pa.int64()), pa.array(data, pa.binary())], ["at", "lo", "anchor", "span", "bytes"])

    return run


def _repeats(length: int, batch_bytes: int = BATCH_BYTES):
    """Segments sorted by anchor -> intervals (at, a, b) of repeated bytes. Whole anchors are batched up to
    `batch_bytes`; one anchor has at most LARGE_GROUP segments here."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        column = rows["bytes"].combine_chunks()
        _, offsets, raw = column.buffers()
        off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        text = np.frombuffer(raw, np.uint8)[off[0] : off[-1]]
        off = off - off[0]
        n = rows["span"].to_numpy() + 1
        valid = np.zeros(len(text), bool)
        base = np.repeat(off[:-1] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        valid[base] = True
        hit = repeated_starts(text, valid, length)
        owner = np.searchsorted(off, hit, side="right") - 1
        start = rows["lo"].to_numpy()[owner] + hit - off[owner]
        new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))) if len(hit) else np.zeros(0, int)
        end = start[np.append(new[1:], len(hit)) - 1] + length if len(hit) else start
        return pa.RecordBatch.from_arrays([pa.array(rows["at"].to_numpy()[owner[new]]), pa.array(start[new]), pa.array(end)], ["at", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                held.append(part)
                size += int(part.column(4).nbytes if part.num_rows == batch.num_rows else sum(len(x.as_buffer()) for x in part.column(4)))
                if size < batch_bytes:
                    continue
                rows = pa.Table.from_batches(held)
                anchor = rows["anchor"].to_numpy()
                other = np.flatnonzero(anchor != anchor[-1])  # the last anchor may go on
                whole = int(other[-1]) + 1 if len(other) else 0
                if whole:
                    yield solve(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    size = sum(len(x.as_buffer()) for x in rows["bytes"].slice(whole))
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _windows(length: int):
    """Every window of a segment with its content's hash: the exact way for anchors with very many segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                raw = [x.as_buffer() for x in part.column(4)]
                text = np.frombuffer(b"".join(raw), np.uint8)
                off = np.append(0, np.cumsum([len(r) for r in raw]))
                n = part.column(3).to_numpy() + 1
                at = np.repeat(off[:-1] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                row = np.repeat(np.arange(part.num_rows), n)
                content = range_hash(byte_prefix_hash(text), at, at + length)
                start = part.column(1).to_numpy()[row] + at - off[row]
                yield pa.RecordBatch.from_arrays([pa.array(part.column(0).to_numpy()[row]), pa.array(start), pa.array(part.column(2).to_numpy()[row]), pa.array(content.astype(np.int64))], ["at", "a", "anchor", "content"])

    return run


def repeated_intervals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large_group: int = LARGE_GROUP) -> DataFrame:
    """docs (at, text) -> at and its intervals [a, b) of repeated bytes, which may overlap; documents without any are
    left out."""
    found = docs.select("at", "text").mapInArrow(_anchors(length, gram), "at long, place long, anchor long, content long")
    # one occurrence of each content speaks for all: that with the least tag
    tag = F.xxhash64("at", "place")
    contents = found.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(tag).alias("tag"))
    groups = contents.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    contents = written(contents.join(groups, "anchor").select("anchor", "content", "n", "tag", "kinds"), "segment-kinds")
    marked = found.join(contents, ["anchor", "content"])
    sure, sole = F.col("n") > 1, F.col("kinds") > 1
    speaks = sole & ((F.col("n") == 1) | (F.col("tag") == tag))
    by_doc = marked.groupBy("at").agg(
        F.collect_set(F.when(sure, F.col("place"))).alias("sure"),  # sets: repeated rows have one list, not one each
        F.collect_set(F.when(speaks & (F.col("kinds") <= large_group), F.struct("place", "anchor"))).alias("some"),
        F.collect_set(F.when(speaks & (F.col("kinds") > large_group), F.struct("place", "anchor"))).alias("many"),
    )
    by_doc = written(by_doc, "segment-places")
    wanted = by_doc.where(F.size("some") + F.size("many") > 0)
    # one row of each repeated one: its segments would only meet themselves
    both = _packed(docs).join(wanted.select("at", F.concat("some", "many").alias("places")), "at").dropDuplicates(["at"])
    pieces = written(both.select("at", "packed", "places").mapInArrow(_cut(length), "at long, lo long, anchor long, span long, bytes binary"), "segments")
    large = contents.where(F.col("kinds") > large_group).select("anchor").distinct()
    few = pieces.join(large, "anchor", "left_anti").select("at", "lo", "anchor", "span", "bytes")
    solved = few.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeats(length), "at long, a long, b long")
    windows = pieces.join(large, "anchor", "left_semi").select("at", "lo", "anchor", "span", "bytes").mapInArrow(_windows(length), "at long, a long, anchor long, content long")
    twice = windows.groupBy("anchor", "content").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "content")
    counted = windows.join(twice, ["anchor", "content"]).select("at", "a", (F.col("a") + length).alias("b"))
    known = by_doc.select("at", F.explode("sure").alias("place")).select("at", F.shiftright("place", 8).alias("a"), (F.shiftright("place", 8) + F.col("place").bitwiseAND(F.lit(255)) + length).alias("b"))
    return solved.union(counted).union(known)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, large_group: int = LARGE_GROUP, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (the remaining bytes), n_bytes, n_removed and n_spans (maximal removed runs) of each document, then
    the columns to carry along.

    Texts are UTF-8 bytes; a null text is empty. Texts shorter than `length` lose nothing. A string that overlaps
    its own repetition counts, and repeated rows are documents of their own, so each is a repetition of the other. The
    kept bytes of a text may cut a character in two. An empty table gives an empty result; extra columns are ignored.
    """
    carried = F.struct(*[F.col(c) for c in carry] or [F.lit(0).alias("none")]).alias("carried")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), carried).withColumn("at", F.xxhash64("doc_id", "text"))
    spans = repeated_intervals(rows.select("at", "text"), length, gram, large_group)
    spans = spans.groupBy("at").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    packed = _packed(rows, "doc_id", "carried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor()
        for batch in batches:
            at, ids, kept, size, removed, runs, held = 0, [], [], [], [], [], 0
            for doc, packed, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = _unpack(packed, tool)
                gone, n_runs = 0, 0
                rest = text
                if found.is_valid:
                    a, b = (found.values.field(k).to_numpy() for k in (0, 1))
                    edge = np.bincount(a, minlength=len(text) + 1) - np.bincount(b, minlength=len(text) + 1)
                    out = np.cumsum(edge[:-1]) > 0
                    gone = int(out.sum())
                    n_runs = int((out[1:] & ~out[:-1]).sum() + out[0])
                    rest = np.frombuffer(text, np.uint8)[~out].tobytes()
                ids.append(doc)
                kept.append(rest)
                size.append(len(text))
                removed.append(gone)
                runs.append(n_runs)
                held += len(rest)
                if held > 8 << 20:
                    yield _out(batch.slice(at), ids, kept, size, removed, runs)
                    at, ids, kept, size, removed, runs, held = at + len(ids), [], [], [], [], [], 0
            yield _out(batch.slice(at), ids, kept, size, removed, runs)

    def _out(batch, ids, kept, size, removed, runs) -> pa.RecordBatch:
        carried = batch.column(3).slice(0, len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), carried], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "carried"])

    schema = f"doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, carried {rows.schema['carried'].dataType.simpleString()}"
    out = packed.join(spans, "at", "left").select("doc_id", "packed", "spans", "carried").mapInArrow(run, schema)
    return out.select("doc_id", "kept", "n_bytes", "n_removed", "n_spans", *[F.col("carried")[c].alias(c) for c in carry])


def valid_text(column: str) -> Column:
    """The bytes of a column as text, without the parts of characters that were cut in two."""

    @F.pandas_udf("string")
    def text(kept: pd.Series) -> pd.Series:
        return kept.map(lambda x: bytes(x).decode(errors="ignore"), na_action="ignore")

    return text(F.col(column))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = [hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return remove_repeats(documents(spark, sf_dir)).mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
