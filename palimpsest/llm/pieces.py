"""Encoding into and decoding from the pieces of a SentencePiece BPE model, with seeded merge dropout.

A text is split before every run of spaces (no piece crosses such a border), and each chunk is merged from its
characters by an agenda of candidate pairs, best score first and leftmost on ties. With dropout p, a candidate taken
from the agenda is skipped when a hash of (seed, doc_id, the chunk's place in the document, step, piece) falls below p; it
comes back only when a neighbour has changed. So every occurrence of a word is segmented by itself, and the result is a
function of the inputs and the seed alone. Without dropout this is the model's own encoding. Every encoding decodes to the
text it came from.

All chunks of a slice of texts step together in numpy: a column for each chunk, a row for each of its characters, one
step of every agenda a round. Only chunks of over 32 characters go one by one.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents
from ._text import mix, slices

SPACE = "▁"
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32)  # chunks are padded to one of these
BLOCK = 8192  # chunks that step together
_NONE = 1 << 62  # no candidate
_U = np.uint64
_M = (1 << 64) - 1


def _dropped(salt: np.ndarray, step: int, piece: np.ndarray) -> np.ndarray:
    """32 bits that decide on the candidate of an agenda's step."""
    return (salt ^ _U(step * 0x9E3779B1) ^ (piece.astype(np.uint64) * _U(0x85EBCA6B))) * _U(0xC2B2AE3D27D4EB4F) >> _U(32)


class PairTable:
    """(left piece, right piece) -> score rank << 32 | merged piece, as an open hash table in arrays."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, (4 * len(key)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NONE, np.int64)
        slot = self._slot(key)
        while len(key):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = key[put], value[put]
            rest = np.ones(len(key), bool)
            rest[put] = False
            key, value, slot = key[rest], value[rest], self._next(slot[rest])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_NONE for pairs that make no piece; negative numbers are in no pair."""
        key = (left.astype(np.int64) << 20) | right
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.values[slot], _NONE)
        more = np.flatnonzero((there != key) & (there >= 0))
        while len(more):
            slot_more = slot[more] = self._next(slot[more])
            there = self.keys[slot_more]
            hit = there == key[more]
            out[more[hit]] = self.values[slot_more[hit]]
            more = more[~hit & (there >= 0)]
        return out


class Pieces:
    """The vocabulary of a model file: ids and scores of the pieces that merging can make, and the byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int32)
        self.rank: dict[str, tuple[float, int]] = {}
        spelt = []
        for i, piece in enumerate(text):
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                spelt.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                spelt.append(b"")
            else:
                self.rank[piece] = (-model.get_score(i), i)
                spelt.append(piece.replace(SPACE, " ").encode())
        self.size = np.array([len(x) for x in spelt])
        self.begin = np.append(0, np.cumsum(self.size)[:-1])
        self.spelt = np.frombuffer(b"".join(spelt), np.uint8)
        # the piece of each character; a space is the mark, and the mark itself must be written in bytes
        self.letter = np.full(0x110000, -2, np.int32)
        for piece, (_, i) in self.rank.items():
            if len(piece) == 1:
                self.letter[ord(piece)] = i
        self.letter[ord(" ")], self.letter[ord(SPACE)] = self.letter[ord(SPACE)], -2
        # every way to make a piece of two
        ways = [(self.rank[p[:k]][1] << 20 | self.rank[p[k:]][1], i) for p, (_, i) in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank]
        score = np.zeros(n)
        score[[i for _, i in self.rank.values()]] = [s for s, _ in self.rank.values()]
        made = np.array([w[1] for w in ways], np.int64)
        order = np.searchsorted(np.unique(score[made]), score[made])
        self.pairs = PairTable(np.array([w[0] for w in ways], np.int64), (order << 32) | made)

    def _merge_block(self, sym: np.ndarray, salt: np.ndarray, below: np.uint64) -> None:
        """Merge chunks in place: sym (width + 1, chunks) has their pieces, -1 behind their ends. A merged pair's piece
        takes the place of the left one, the right one becomes -1."""
        high, n = sym.shape
        row = np.arange(high)[:, None]
        agenda = np.full((high, n), _NONE, np.int64)
        agenda[:-1] = self.pairs.get(sym[:-1].ravel(), sym[1:].ravel()).reshape(high - 1, n) + (row[:-1] << 24)
        after = np.repeat(row + 1, n, axis=1).ravel()
        before = np.repeat((row - 1) % high, n, axis=1).ravel()  # the last row stands for no neighbour
        flat = sym.ravel()
        live, step = np.arange(n), 0
        while True:
            best = agenda.min(axis=0)
            a = np.flatnonzero(best < _NONE)
            if len(a) < 0.7 * len(live):
                agenda, live, best, a = agenda[:, a], live[a], best[a], np.arange(len(a))
            if not len(a):
                return
            best = best[a]
            j, piece = (best >> 24) & 255, best & 0xFFFFFF
            if below:
                skip = _dropped(salt[live[a]], step, piece) < below
                agenda[j[skip], a[skip]] = _NONE  # off the agenda, until a neighbour changes
                a, j, piece = a[~skip], j[~skip], piece[~skip]
            step += 1
            c = live[a]
            at = j * n + c
            k = after[at]
            gone = k * n + c
            follow = after[gone]
            flat[at], flat[gone], after[at] = piece, -1, follow
            before[np.minimum(follow, high - 1) * n + c] = j
            lead = before[at]
            agenda[k, a] = _NONE
            right, left = flat[np.minimum(follow, high - 1) * n + c], flat[lead * n + c]
            agenda[j, a] = self.pairs.get(piece, right) + (j << 24)
            agenda[lead, a] = np.where(left < 0, _NONE, self.pairs.get(left, piece) + (lead << 24))

    def merge(self, chunk: str, salt: int = 0, below: int = 0) -> list[int]:
        """The same for one chunk: a list with a piece at the place of its first character, -1 at its others, -2 where a
        character is no piece. Symbols are a linked list; a stale agenda entry is told by the borders of its two parts."""
        rank = self.rank
        parts: list[str] = list(chunk)
        n = len(parts)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        entry = lambda pair, i, j, k: (rank[pair][0], i, rank[pair][1], j, k)  # noqa: E731  best score, then leftmost
        agenda = [entry(pair, i, i + 1, i + 2) for i in range(n - 1) if (pair := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(agenda)
        step = -1
        while agenda:
            _, i, piece, j, k = heapq.heappop(agenda)
            if not parts[i] or after[i] != j or after[j] != k:
                continue
            step += 1
            if below and (((salt ^ (step * 0x9E3779B1) ^ (piece * 0x85EBCA6B)) * 0xC2B2AE3D27D4EB4F & _M) >> 32) < below:
                continue
            parts[i], parts[j] = parts[i] + parts[j], ""
            after[i] = k
            if k < n:
                before[k] = i
                if (new := parts[i] + parts[k]) in rank:
                    heapq.heappush(agenda, entry(new, i, k, after[k]))
            h = before[i]
            if h >= 0 and (new := parts[h] + parts[i]) in rank:
                heapq.heappush(agenda, entry(new, h, i, k))
        return [(rank[p][1] if p in rank else -2) if p else -1 for p in parts]

    def encode_many(self, texts: list[str], keys: np.ndarray, dropout: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, how many each has); `keys` seed the dropout of each text."""
        some = [i for i, t in enumerate(texts) if t]
        counts = np.zeros(len(texts), np.int64)
        if not some:
            return np.zeros(0, np.int32), counts
        code = np.frombuffer("".join([" " + texts[i] for i in some]).encode("utf-32-le"), "<u4")
        first = np.append(0, np.cumsum([len(texts[i]) + 1 for i in some]))
        space, mark = code == 32, code == ord(SPACE)
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        begin[first[:-1]] = True
        if mark.any():  # each by itself
            begin |= mark
            begin[1:] |= mark[:-1]
        start = np.flatnonzero(begin)
        length = np.diff(np.append(start, len(code)))
        at = np.searchsorted(start, first)
        doc = np.repeat(np.arange(len(some)), np.diff(at))
        place = np.arange(len(start)) - at[doc]
        salt = mix(keys[some][doc] + place.astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        below = min(int(dropout * 2**32), 1 << 32)
        sym = self.letter[code]
        order = np.argsort(np.minimum(length, 255).astype(np.uint8), kind="stable")
        ends = np.searchsorted(length[order], (1, *WIDTHS), side="right")
        for width, lo, hi in zip(WIDTHS, ends, ends[1:]):
            for a in range(lo, hi, BLOCK):
                which = order[a : min(a + BLOCK, hi)]
                inside = np.arange(width)[:, None] < length[which]
                where = np.where(inside, start[which] + np.arange(width)[:, None], 0)
                block = np.full((width + 1, len(which)), -1, np.int32)
                block[:-1] = np.where(inside, sym[where], -1)
                self._merge_block(block, salt[which], _U(below))
                sym[where[inside]] = block[:-1][inside]
        for i in order[ends[-1] :]:
            a, b = start[i], start[i] + length[i]
            chunk = code[a:b].tobytes().decode("utf-32-le").replace(" ", SPACE)
            sym[a:b] = self.merge(chunk, int(salt[i]), below)
        return self._in_bytes(sym, code, first, counts, some)

    def _in_bytes(self, sym: np.ndarray, code: np.ndarray, first: np.ndarray, counts: np.ndarray, some: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces in order, with the bytes of characters that are no piece."""
        n = (sym != -1).astype(np.int64)
        odd = np.flatnonzero(sym == -2)
        if len(odd):
            c = code[odd]
            n[odd] = 1 + (c > 0x7F).astype(np.int64) + (c > 0x7FF) + (c > 0xFFFF)
        total = np.append(0, np.cumsum(n))
        counts[some] = total[first[1:]] - total[first[:-1]]
        if not len(odd):
            return sym[sym != -1], counts
        ids = np.repeat(sym, n)
        raw = np.frombuffer(code[odd].tobytes().decode("utf-32-le").encode(), np.uint8)
        ids[np.repeat(total[odd] - np.append(0, np.cumsum(n[odd])[:-1]), n[odd]) + np.arange(len(raw))] = self.byte[raw]
        return ids, counts

    def encode(self, text: str, dropout: float = 0.0, seed: int = 0, key: int = 0) -> list[int]:
        return self.encode_many([text], document_keys(np.array([key]), seed), dropout)[0].tolist()

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ids: their bytes, without the space put first. Ids that spell no text are an error."""
        n = self.size[ids]
        total = np.append(0, np.cumsum(n))
        data = self.spelt[np.repeat(self.begin[ids] - total[:-1], n) + np.arange(total[-1])]
        edge = total[np.append(0, np.cumsum(counts))]
        head = edge[:-1][edge[1:] > edge[:-1]]
        head = head[data[head] == 32]
        lost = np.zeros(len(data) + 1, np.int64)
        lost[head + 1] = 1
        keep = np.ones(len(data), bool)
        keep[head] = False
        offsets = (edge - np.cumsum(lost)[edge]).astype(np.int32)
        raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(data[keep])])
        return raw.cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_many(np.array(ids, np.int64), np.array([len(ids)]))[0].as_py()


def document_keys(doc_ids: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(doc_ids.astype(np.int64).view(np.uint64)) + _U(seed & _M))


_loaded: dict[str, Pieces] = {}


def _pieces(path: str | None) -> Pieces:
    """The model of a worker, read once."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str | None = None, dropout: float = 0.1, seed: int = 0) -> DataFrame:
    """doc_id and ids of each whole text.

    A null or empty text has no ids. The segmentation depends on doc_id, so copies of a text vary and repeated rows are
    encoded alike; a null doc_id counts as -1. An empty table gives an empty result; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            for part in slices(batch, "text"):
                keys = document_keys(part.column(0).fill_null(-1).to_numpy(), seed)
                ids, counts = pieces.encode_many([t or "" for t in part.column(1).to_pylist()], keys, dropout)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids and the text that the ids spell; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # about a million ids at a time
                part = batch.slice(at)
                n = np.cumsum(part.column(1).value_lengths().fill_null(0).to_numpy())
                part = part.slice(0, max(1, int(np.searchsorted(n, 1 << 20, side="right"))))
                at += part.num_rows
                ids = part.column(1)
                counts = ids.value_lengths().fill_null(0).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns, pieces.decode_many(ids.flatten().to_numpy(zero_copy_only=False), counts)], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the number and checksum of its dropout ids, and the digest of the text that they decode to."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            n = [len(x.values) for x in ids]
            crc = [zlib.crc32(x.values.to_numpy().astype("<i4").tobytes()) for x in ids]
            sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha)], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"])

    return decode(encode(documents(spark, sf_dir))).mapInArrow(digest, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string")
