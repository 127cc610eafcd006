"""Fill-in-middle over texts that are stored as seekable compressed frames.

A stored text is a list of frames. Each is a zstandard frame of its own that begins at a code point, and carries the
number of units (`[A-Za-z]+|[^A-Za-z]`) that start before it and in it, and of its code points. So the place of a unit is
found from the counts, and only the frame that holds it is decompressed: a cut costs a frame, not a text.

A transformed text is again a list of frames: control strings are frames of their own, the frames of a moved part move
as they are, and only the frames that a cut goes through are decompressed and compressed anew as two. Digests and the
restored text come from the frames in order, one decompressed at a time.

All of it happens where the row stands: nothing is shuffled, and a task holds one slice of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, written
from ._text import column_bytes, slices

FRAME_BYTES = 1 << 16
LEVEL = 3
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
_FRAME = "struct<units_before:long,units:long,chars:long,joined:boolean,data:binary>"
STORE = f"doc_id long, n long, n_chars long, has_control boolean, frames array<{_FRAME}>"
_FRAME_TYPE = pa.struct([("units_before", pa.int64()), ("units", pa.int64()), ("chars", pa.int64()), ("joined", pa.bool_()), ("data", pa.binary())])

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def unit_starts(data: np.ndarray, joined: bool = False) -> np.ndarray:
    """For each byte, whether a unit starts there; `joined`: the byte before the first is a letter."""
    letter = _LETTER[data]
    follows = np.empty(len(data), bool)
    if len(data):
        follows[0] = joined
        follows[1:] = letter[:-1]
    return ((data & 0xC0) != 0x80) & ~(letter & follows)


def _frames_of(data: bytes, size: int, packer: zstandard.ZstdCompressor) -> list[tuple]:
    """The frames of one text, cut at the last code point that starts within `size` bytes."""
    raw = np.frombuffer(data, np.uint8)
    begin, units, joined, out = 0, 0, False, []
    while begin < len(data):
        end = min(begin + size, len(data))
        while end < len(data) and (data[end] & 0xC0) == 0x80:  # at most three bytes back
            end -= 1
        part = raw[begin:end]
        n = int(unit_starts(part, joined).sum())
        out.append((units, n, int(((part & 0xC0) != 0x80).sum()), joined, packer.compress(data[begin:end])))
        units, joined, begin = units + n, bool(_LETTER[data[end - 1]]), end
    return out


def _list_of_frames(rows: list[list[tuple]]) -> pa.Array:
    flat = [f for row in rows for f in row]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
    columns = [pa.array([f[i] for f in flat], kinds[i]) for i in range(5)]
    values = pa.StructArray.from_arrays(columns, fields=list(_FRAME_TYPE))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(r) for r in rows])), pa.int32()), values)


def frame_store(docs: DataFrame, frame_bytes: int = FRAME_BYTES, level: int = LEVEL) -> DataFrame:
    """doc_id, n (units), n_chars, has_control (whether a control string occurs) and frames of each row (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = column_bytes(part.column(1))
                made, control = [], []
                for a, b in zip(at[:-1], at[1:]):
                    data = raw[a:b].tobytes()
                    made.append(_frames_of(data, max(4, frame_bytes), packer))
                    control.append(any(c in data for c in (PREFIX, SUFFIX, MIDDLE)))
                n, chars = (pa.array([sum(f[i] for f in row) for row in made], pa.int64()) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([part.column(0), n, chars, pa.array(control, pa.bool_()), _list_of_frames(made)], ["doc_id", "n", "n_chars", "has_control", "frames"])

    return docs.select("doc_id", "text").mapInArrow(run, STORE)


class Frames:
    """A text as frames, read by place."""

    def __init__(self, frames: list[dict]):
        self.frames = frames
        self.open = zstandard.ZstdDecompressor()

    def cut(self, unit: int) -> tuple[int, int]:
        """(frame, byte within it) where that unit starts; after the last unit: the end."""
        starts = [f["units_before"] for f in self.frames]
        k = int(np.searchsorted(starts, unit, side="right")) - 1
        while k >= 0 and self.frames[k]["units"] == 0:  # a run of letters goes on through the whole frame
            k -= 1
        if k < 0 or unit >= self.frames[k]["units_before"] + self.frames[k]["units"]:
            return len(self.frames), 0
        data = np.frombuffer(self.open.decompress(self.frames[k]["data"]), np.uint8)
        places = np.flatnonzero(unit_starts(data, self.frames[k]["joined"]))
        return k, int(places[unit - self.frames[k]["units_before"]])

    def between(self, a: tuple[int, int], b: tuple[int, int], pack) -> list[tuple[int, bytes]]:
        """(code points, zstandard frame) for the text from place a to place b: frames within are given as they are."""
        out = []
        for k in range(a[0], min(b[0] + 1, len(self.frames))):
            low, high = a[1] if k == a[0] else 0, b[1] if k == b[0] else None
            if high == 0:
                break
            if low == 0 and high is None:
                out.append((self.frames[k]["chars"], self.frames[k]["data"]))
            else:
                data = self.open.decompress(self.frames[k]["data"])[low:high]
                out.append((int(((np.frombuffer(data, np.uint8) & 0xC0) != 0x80).sum()), pack(data)))
        return out


def control_places(pieces: Iterator[bytes], wanted: tuple[bytes, ...]) -> list[int]:
    """The byte offsets of the control strings, each looked for after the one before it, in a stream of pieces."""
    found, done, tail = [], 0, b""
    for piece in pieces:
        data = tail + piece
        base, at = done - len(tail), 0
        while len(found) < len(wanted) and (i := data.find(wanted[len(found)], at)) >= 0:
            found.append(base + i)
            at = i + 3
        done += len(piece)
        tail = data[max(at, len(data) - 2) :]
    return found


def restored(frames: list[bytes], form: str) -> Iterator[bytes]:
    """The original text, piece by piece, from the frames of an output and its form alone."""
    opened = zstandard.ZstdDecompressor()
    if form == "plain":
        yield from (opened.decompress(f) for f in frames)
        return
    order = (PREFIX, SUFFIX, MIDDLE) if form == "psm" else (SUFFIX, PREFIX, MIDDLE)
    sizes = [zstandard.frame_content_size(f) for f in frames]
    first, second, third = control_places((opened.decompress(f) for f in frames), order)
    one, two, last = (first + 3, second), (second + 3, third), (third + 3, sum(sizes))
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    for low, high in (prefix, last, suffix):
        begin = 0
        for f, size in zip(frames, sizes):
            if begin < high and begin + size > low:
                yield opened.decompress(f)[max(0, low - begin) : high - begin]
            begin += size


def fim_plan(doc_id: Column, n: Column, has_control: Column) -> tuple[Column, Column, Column]:
    """(form, units of the prefix, units of prefix and middle), by four numbers from a hash of the doc_id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h1, h2, h3, h4 = (F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4))
    form = F.when((n == 0) | has_control | (h3 % 100 >= 90), "plain").when(h4 % 100 < 20, "spm").otherwise("psm")
    return form, F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))


def fill_in_middle(store: DataFrame, level: int = LEVEL) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and frames (of the output, in order) for each row of a frame store.

    Form and cuts: see fim_plan. A plain output is the text as it was stored. A null doc_id counts as an empty one in the
    hash; rows of one doc_id are cut by the same numbers, each by its own length. Null texts are stored as empty ones.
    """
    form, low, high = fim_plan(F.col("doc_id"), F.col("n"), F.col("has_control"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        marks = {c: (3, packer.compress(c)) for c in (PREFIX, SUFFIX, MIDDLE)}
        names, kinds = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "frames"], (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()))

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

        for batch in batches:
            rows, size = [], 0
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                text, kind, sizes = Frames(row["frames"]), row["form"], (None, None)
                if kind == "plain":
                    out = [f["data"] for f in row["frames"]]
                else:
                    a, b, end = text.cut(row["low"]), text.cut(row["high"]), (len(row["frames"]), 0)
                    prefix, middle, suffix = (text.between(x, y, packer.compress) for x, y in (((0, 0), a), (a, b), (b, end)))
                    sizes = (sum(x[0] for x in prefix), sum(x[0] for x in middle))
                    p, s, m = marks[PREFIX], marks[SUFFIX], marks[MIDDLE]
                    parts = [p, *prefix, s, *suffix, m, *middle] if kind == "psm" else [s, *suffix, p, *prefix, m, *middle]
                    out = [x[1] for x in parts]
                rows.append((row["doc_id"], row["n"], kind, *sizes, out))
                size += sum(map(len, out))
                if size > 1 << 20 or len(rows) == 1024:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)

    planned = store.select("doc_id", "n", form.alias("form"), low.alias("low"), high.alias("high"), "frames")
    return planned.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, frames array<binary>")


def fim_digests(made: DataFrame) -> DataFrame:
    """The outputs' and the restored texts' SHA-256, streamed from the frames of an output one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            pairs = []
            for form, frames in zip(batch.column(2).to_pylist(), batch.column(5)):
                frames = frames.as_py()
                output, text = hashlib.sha256(), hashlib.sha256()
                for f in frames:
                    output.update(opened.decompress(f))
                for piece in restored(frames, form):
                    text.update(piece)
                pairs.append((output.hexdigest(), text.hexdigest()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *(pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])

    return made.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are stored as frames once, in the shared folder; cuts and digests work on that table."""
    store = written(frame_store(documents(spark, sf_dir)), "frames", "none")
    return fim_digests(fill_in_middle(store))


OP12_SQL = """WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, len(t) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(t[1:a], '') AS prefix, array_to_string(t[a + 1:b], '') AS middle, array_to_string(t[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
