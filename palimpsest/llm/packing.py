"""Best-fit packing of tokenised documents into sequences of bounded length.

Pieces are packed by best-fit decreasing. Two pieces of one length are interchangeable, so the packing depends only
on how many pieces there are of each length: a histogram of at most `capacity` rows. The plan is made from that
histogram with a segment tree over remaining capacities, which finds the tightest open bin in logarithmic time, and
is a list of runs (length, ranks) -> (sequences, offset). Pieces get their rank within a length by block counts and
prefix sums, so no task and no driver ever holds the pieces of a hot length.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, text_of, written

CAPACITY = 1024
END_ID = 2
SPECIAL = {"<|endoftext|>": 50256}
LONG_RUN = 50_000
_LONG = re.compile(rf"(?<!\s)\s{{{LONG_RUN}}}|(?<!\S)\S{{{LONG_RUN}}}")  # looks at each run once


class OpenBins:
    """Open bins by remaining capacity: a segment tree of counts over 0..capacity, and the bins' numbers as ranges."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def _count(self, left: int, by: int) -> None:
        at = left + self.size
        while at:
            self.tree[at] += by
            at >>= 1

    def put(self, left: int, first: int, n: int) -> None:
        if n and left:
            self.ranges.setdefault(left, []).append((first, n))
            self._count(left, n)

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity >= need with an open bin."""
        at = need + self.size
        if self.tree[at]:
            return need
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None

    def take(self, left: int, most: int) -> tuple[int, int]:
        """Up to `most` bins with that capacity, as (first number, how many)."""
        first, n = self.ranges[left].pop()
        if n > most:
            self.ranges[left].append((first + most, n - most))
            n = most
        self._count(left, -n)
        return first, n


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Best-fit decreasing over a histogram of piece lengths.

    Returns runs sorted by (length, rank): the pieces of `length` with ranks from `rank` on go `per` to a sequence,
    from sequence `seq` on, the first of a sequence at `offset`.
    """
    bins, opened = OpenBins(capacity), 0
    runs: list[tuple[int, int, int, int, int]] = []
    for length in sorted((x for x in histogram if x > 0), reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = bins.tightest(length)
            fresh = left is None
            left = capacity if fresh else left
            per = left // length  # the bin just used is now the tightest, until it is full
            whole, rest = divmod(todo, per)
            most = whole or 1
            if fresh:
                first, n = opened, most
                opened += n
            else:
                first, n = bins.take(left, most)
            put = n * per if whole else rest
            runs.append((length, rank, first, per, capacity - left))
            bins.put(left - (per if whole else rest) * length, first, n)
            rank, todo = rank + put, todo - put
    runs.sort()
    return {k: np.array([r[i] for r in runs], np.int64) for i, k in enumerate(("length", "rank", "seq", "per", "offset"))}


class Encoder:
    """The byte-level BPE of a tokenizers JSON file. Texts go through tiktoken, which gives the same ids several times
    faster; those with LONG_RUN characters of white space, or without any, go through tokenizers itself, as the regular
    expression of tiktoken runs out of stack there."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in SPECIAL}
        self._fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self._path = path
        self._whole = None
        self.decode_bytes = self._fast.decode_bytes

    def _slow(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
        return self._whole

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and _LONG.search(text):
            return np.array(self._slow().encode(text, add_special_tokens=False).ids, np.uint32)
        if any(t in text for t in SPECIAL):
            return self._fast.encode_to_numpy(text, allowed_special="all")
        return self._fast.encode_to_numpy(text, disallowed_special=())


def tokenised_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is empty: its only id is the end."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        seen: dict[bytes, list[tuple[int, int, int]]] = {}  # copies of a text are encoded once; bounded below
        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                key = hashlib.blake2b(text.encode(), digest_size=16).digest()
                cuts = seen.get(key)
                if cuts is None:
                    ids = np.concatenate([encoder.encode(text), end]).astype("<u4")
                    n = len(ids)
                    first = (n - 1) % capacity + 1
                    edges = [0, *range(first, n + 1, capacity)]
                    if len(seen) >= 100_000:
                        seen.clear()
                    cuts = seen[key] = [(a, b - a, zlib.crc32(ids[a:b].tobytes())) for a, b in zip(edges, edges[1:])]
                for k, (a, n, c) in enumerate(cuts):
                    doc.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_rows: int = 1024) -> DataFrame:
    """Give every piece (doc_id, piece, length, ...) a sequence_id and an offset, gapless from 0 in each sequence.

    `pieces` must be a stable table (it is read several times). Pieces of length 0 don't exist; ties between pieces of
    one length are broken by (doc_id, piece) within hashed blocks, and repeated rows are packed once each. An empty
    table gives an empty result.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    total = sum(counts.values())
    block = max(block_rows, math.isqrt(total))
    blocks = max(1, -(-total // block))
    dealt = pieces.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = (
        dealt.groupBy("length", "_block")
        .count()
        .withColumn("_before", F.sum("count").over(Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select("length", "_block", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = F.row_number().over(Window.partitionBy("length", "_block").orderBy("doc_id", "piece"))
    ranked = dealt.withColumn("_rank", inside - 1).join(before, ["length", "_block"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_block", "_before")
    plan = plan_packing(counts, capacity)
    names = [c for c in pieces.columns]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan["length"] * (1 << 48) + plan["rank"]
        for batch in batches:
            cols = dict(zip(batch.schema.names, batch.columns))
            length, rank = cols["length"].to_numpy(zero_copy_only=False), cols["_rank"].to_numpy(zero_copy_only=False)
            run = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            bins, within = np.divmod(rank - plan["rank"][run], plan["per"][run])
            yield pa.RecordBatch.from_arrays([*(cols[c] for c in names), pa.array(plan["seq"][run] + bins), pa.array(plan["offset"][run] + within * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*names, F.col("_rank").cast("long")).mapInArrow(place, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise documents, cut long ones and pack the pieces by best-fit decreasing.

    Nulls: a null text is empty (one end token); a null doc_id is kept as null. Empty tables give no rows. Very long
    texts become many pieces. Extra columns are ignored.
    """
    return pack(written(tokenised_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir))
