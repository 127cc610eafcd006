"""Document fingerprints by consistent weighted sampling.

A document is a bag of weighted terms (lower-cased words, weighted by their counts). For each of `samples` seeds, a
term draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) from its own hash; with weight w it gets t = floor(ln w / r + beta)
and ln a = ln c - r (t - beta) - r. The term with the least ln a, together with its t, is the sample. Two documents
agree on a sample with probability equal to their generalised Jaccard similarity, sum min(w) / sum max(w).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, text_of
from ._text import Words, mix, slices

SAMPLES = 64
_U = np.uint64


def _log_a(keys: np.ndarray, weight: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """ln a and the 32-bit label of (term, t), for each (term, weight) and sample; a function of nothing else."""
    seeds = mix(np.arange(2 * samples, dtype=np.uint64) + _U(0x51ED27))
    one, two = mix(keys[:, None] ^ seeds[None, :samples]), mix(keys[:, None] ^ seeds[None, samples:])

    def uniform(bits: np.ndarray, shift: int) -> np.ndarray:
        return (((bits >> _U(shift)) & _U(0x1FFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-21)

    # Gamma(2, 1) is minus the log of a product of two uniforms
    r = -np.log(uniform(one, 0) * uniform(one, 21))
    log_c = np.log(-np.log(uniform(two, 0) * uniform(two, 21)))
    beta = uniform(two, 42)
    t = np.floor(np.log(weight).astype(np.float32)[:, None] / r + beta)
    label = (keys[:, None] + t.astype(np.uint32).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(16)
    return log_c - r * (t - beta) - r, (label & _U(0x7FFFFFFF)).astype(np.uint32)


def signatures(column: pa.Array, samples: int = SAMPLES) -> np.ndarray:
    """(rows, samples) of 32-bit samples; a row without words has all ones."""
    words = Words(column)
    rows = len(column)
    out = np.full((rows, samples), 0xFFFFFFFF, np.uint32)
    if not len(words.hash):
        return out
    # a term is 44 bits of its hash, so that (row, term) is one sortable number
    key = np.sort((words.row.astype(np.uint64) << _U(44)) | (words.hash >> _U(20)))
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    weight = np.diff(np.append(at, len(key)))
    term, row = key[at] & _U((1 << 44) - 1), (key[at] >> _U(44)).astype(np.int64)
    # a (term, weight) pair is drawn once for the slice; documents then only take minima over rows
    order = np.lexsort((weight, term))
    new = np.append(True, (term[order][1:] != term[order][:-1]) | (weight[order][1:] != weight[order][:-1]))
    one, inverse = order[new], np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    bound = np.searchsorted(row, np.arange(rows + 1))
    log_a, label = np.empty((len(one), samples), np.float32), np.empty((len(one), samples), np.uint32)
    keys = mix(term)
    for lo in range(0, len(one), 2048):
        part = one[lo : lo + 2048]
        log_a[lo : lo + 2048], label[lo : lo + 2048] = _log_a(keys[part], weight[part], samples)
    each = np.arange(samples)
    for i in range(rows):
        best = np.full(samples, np.inf, np.float32)
        for lo in range(bound[i], bound[i + 1], 20_000):  # one step but for very long texts
            terms = inverse[lo : min(lo + 20_000, bound[i + 1])]
            k = terms[log_a[terms].argmin(0)]
            better = log_a[k, each] < best
            best[better] = log_a[k, each][better]
            out[i, better] = label[k, each][better]
    return out


def fingerprint_text(sig: np.ndarray) -> list[str]:
    return [x.astype(">u4").tobytes().hex() for x in sig]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id and the fingerprint (hex text) of each whole text.

    Null and empty texts, and texts of white space only, share the fingerprint of no terms (all f). Copies and
    repeated rows get equal fingerprints; an empty table gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprint_text(signatures(part.column(1), samples)), pa.string())], ["doc_id", "fingerprint"])

    return text_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def ranges_of(docs: DataFrame, rows_per_range: int = 256, most: int = 8192) -> tuple[list[float], dict[int, tuple[int, ...]]]:
    """At most `most` cuts of doc_id into ranges of like size, and where the first document of each range is needed
    again: {its doc_id: the ranges it ends}. Ids alone are read; a few thousand numbers reach the driver."""
    ids = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"))
    n = ids.count()
    parts = min(most, max(1, -(-n // rows_per_range)))
    cuts = sorted(set(ids.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    firsts = sorted(r["first"] for r in ids.mapInArrow(_ranged(cuts), "range int, doc_id long").groupBy("range").agg(F.min("doc_id").alias("first")).collect())
    held = [int(np.searchsorted(cuts, float(x), side="right")) for x in firsts]
    ends: dict[int, tuple[int, ...]] = {}
    for i, first in enumerate(firsts):
        ends[first] = (*ends.get(first, ()), held[i - 1])  # for the first of all, i - 1 is the last range
    return cuts, ends


def _ranged(cuts: list[float]):
    edges = np.array(cuts, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, ids.astype(np.float64), side="right").astype(np.int32)), batch.column(0)], ["range", "doc_id"])

    return run


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES, slice_bytes: int = 4 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text (see edited_text; the following text is that of the next
    document in ascending doc_id, after the last: the first), and the likeness of neighbours.

    Each text moves once, to its range of doc_id; the first document of a range moves a second time, as the end of
    the range before it, so that a range is read as one sorted stream of any length. Null texts are empty and null
    ids come first; repeated ids are ordered by their text. With one document, it is its own next one. An empty table
    gives an empty result.
    """
    cuts, ends = ranges_of(docs)
    edges = np.array(cuts, np.float64)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.array(sorted(ends), np.int64)
        for batch in batches:
            ids = batch.column(2).to_numpy(zero_copy_only=False)
            where = np.searchsorted(edges, ids.astype(np.float64), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.zeros(len(ids), bool)), *batch.columns], ["range", "end", "doc_id", "text", "place"])
            for i in np.flatnonzero(np.isin(ids, first)):
                for r in ends[int(ids[i])]:
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([True]), *batch.slice(i, 1).columns], ["range", "end", "doc_id", "text", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        held, ended, size = None, False, 0

        def flush() -> pa.RecordBatch:
            """All but the last text, which is only the next one."""
            n = len(texts) - 1
            edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
            sig = signatures(pa.array(texts + edited, pa.string()), samples)
            own, after, new = sig[:n], sig[1 : n + 1], sig[n + 1 :]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids[:n], pa.int64()), pa.array([len(x) for x in texts[:n]], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()), pa.array(fingerprint_text(own), pa.string()), pa.array(fingerprint_text(new), pa.string()), pa.array(likeness(own, new)), pa.array(likeness(own, after))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        for batch in batches:
            for where, end, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if where != held:
                    ids, texts, held, ended, size = [], [], where, False, 0
                if ended:  # copies of the end row
                    continue
                value = text.as_py() or ""
                ids.append(doc)
                texts.append(value)
                size += len(value)
                ended = end
                if len(texts) > 1 and (end or size > slice_bytes):
                    yield flush()
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    placed = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"))
    dealt = placed.mapInArrow(deal, "range int, end boolean, doc_id long, text string, place long")
    return dealt.repartition("range").sortWithinPartitions("range", "end", "place", "text").mapInArrow(run, schema)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))
