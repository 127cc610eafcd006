"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its words; a word's embedding is the average over hashed byte n-grams of
the lower-cased word with its borders, and the word itself. The model is trained by stochastic gradient descent in numpy on
a bounded sample of labelled rows, as many of each language. Tasks turn the whole texts of the sample into features, so
that only (bucket, weight) pairs reach the driver. The model is calibrated by a temperature and folded into one table of
per-bucket logits, so that prediction is one lookup for each n-gram of each distinct word of a slice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents
from ._text import Words, mix, range_hash, slices

UNKNOWN = "und"
BUCKETS = 1 << 16
DIM = 16
GRAMS = (1, 2, 3, 4)
SAMPLE_ROWS = 2000  # labelled rows (whole texts) to train on, whatever the table's size, dealt evenly to the languages
_U = np.uint64


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (BUCKETS, languages): embedding times output weights
    bias: np.ndarray
    temperature: float
    doubt: float  # share of the score spread evenly: no held-out sample of n rows can show an error under about 1 / n
    threshold: float  # a calibrated score below it is a rejection


def word_features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature bucket, place in `which`) of the chosen words: byte n-grams with borders, and the word itself."""
    start, end = words.start[which], words.end[which]
    size = end - start
    place = np.arange(len(which))
    buckets, owner = [words.hash[which] >> _U(48)], [place]
    for n in GRAMS:
        # n-grams inside the word; the first and the last are marked as such
        m = np.maximum(size - n + 1, 0)
        own = np.repeat(place, m)
        at = np.repeat(start - np.append(0, np.cumsum(m)[:-1]), m) + np.arange(m.sum())
        h = range_hash(words.prefix, at, at + n)
        border = (at == start[own]).astype(np.uint64) + _U(2) * (at + n == end[own]).astype(np.uint64)
        buckets.append(mix(h + border) >> _U(48))
        owner.append(own)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner)


def text_features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: its feature buckets and their weights (each word weighs the same, its features share that)."""
    words = Words(column)
    kinds, one, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    bucket, owner = word_features(words, one)
    order = np.argsort(owner, kind="stable")
    bucket, n = bucket[order], np.bincount(owner, minlength=len(kinds))
    start = np.append(0, np.cumsum(n))
    out = []
    for a, b in zip(words.first, words.first[1:]):
        which, times = np.unique(inverse[a:b], return_counts=True)
        size = n[which]
        at = np.repeat(start[which] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
        weight = np.bincount(bucket[at], np.repeat(times / size, size), BUCKETS)
        some = np.flatnonzero(weight)
        out.append((some, (weight[some] / max(1, b - a)).astype(np.float32)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], steps: int = 6000, rate: float = 4.0, seed: int = 7) -> Model:
    """Train on three quarters of the rows (features of whole texts); the rest set the temperature and the threshold.

    The temperature makes held-out texts score what they are worth and noise (the same texts with random features) what
    guessing would. The threshold rejects 99 in a hundred noise texts as long as it stays well below the scores of 999 in
    a thousand held-out texts judged right, and is always clearly above guessing.

    With one language or none there is nothing to tell apart: its score is then 1 everywhere, or no language is learned.
    """
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.searchsorted(np.array(langs), np.array(labels))
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 4]
    train = order[len(rows) // 4 :]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    eye = np.eye(len(langs), dtype=np.float32)
    epochs = max(1, -(-steps // max(1, len(train))))  # passes, so that small samples are seen often enough
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            b, w = rows[i]
            v = w @ emb[b]
            g = _softmax(v @ out + bias) - eye[y[i]]
            back = out @ g
            out -= lr * 0.1 * np.outer(v, g)
            bias -= lr * 0.01 * g
            emb[b] -= lr * w[:, None] * back[None, :]
    seen = np.zeros(BUCKETS, bool)
    for i in train:
        seen[rows[i][0]] = True
    emb[~seen] = 0  # what no training text has says nothing
    logits = emb @ out
    temperature, threshold, doubt = 1.0, 0.0, 1 / (len(held) + 2)
    if len(held) and len(langs) > 1:
        z = np.array([w @ logits[b] + bias for b, w in (rows[i] for i in held)])
        # what no language is like: texts of the same shape whose features fall into random buckets
        noise = np.array([w @ logits[rng.integers(0, BUCKETS, len(b))] + bias for b, w in (rows[i] for i in held)])
        grid = np.geomspace(0.05, 20, 60)
        right = [-np.log(_softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        even = [-np.log(_softmax(noise / t) + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(np.add(right, even)))])
        p = _softmax(z / temperature)
        sure = p.max(axis=1)[p.argmax(axis=1) == y[held]]
        guess = 1 / len(langs)
        known = np.quantile(sure, 0.001) if len(sure) else 0.5
        threshold = float(max(guess + 0.1 * (1 - guess), min(0.9 * known, np.quantile(_softmax(noise / temperature).max(axis=1), 0.99))))
    return Model(langs, logits.astype(np.float32), bias, temperature, doubt, threshold)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, h, text) of at most `rows` labelled texts with a letter: of each language the same number of those with the
    least hash of (doc_id, text), so that no language is missed for being rare. Repeated rows count once."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row per language
    each = max(1, rows // max(1, len(counts)))
    # rows far beyond the wanted ones are dropped by their hash before anything is sorted
    share = {r["lang"]: min(1.0, (1.5 * each + 50) / max(1, r["n"])) for r in counts}
    near = F.lit(False)
    for lang, part in share.items():
        near |= (F.col("lang") == lang) & (F.shiftrightunsigned("h", 24) < int(part * (1 << 40)))
    some = labelled.where(near).dropDuplicates(["lang", "h"])
    order = Window.partitionBy("lang").orderBy("h")
    return some.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= each).select("lang", "h", "text")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Fit on the sample; rows without text or lang are out. Its texts stay in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = text_features(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b.astype("<u2").tobytes() for b, _ in found], pa.binary()), pa.array([w.tobytes() for _, w in found], pa.binary())], ["lang", "h", "bucket", "weight"])

    found = sample(docs, rows).mapInArrow(run, "lang string, h long, bucket binary, weight binary").collect()
    found.sort(key=lambda r: (r["h"], r["lang"]))
    return fit([(np.frombuffer(r["bucket"], "<u2").astype(np.int64), np.frombuffer(r["weight"], np.float32)) for r in found], [r["lang"] for r in found])


def predict_slice(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(language number, calibrated score) of each row; a row without words takes the prior."""
    words = Words(column)
    c = len(model.langs)
    _, one, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    bucket, owner = word_features(words, one)
    n = np.maximum(np.bincount(owner, minlength=len(one)), 1)
    total = np.empty((len(column), c))
    for k in range(c):
        per_word = np.bincount(owner, model.logits[bucket, k], minlength=len(one)) / n
        run = np.append(0.0, np.cumsum(per_word[inverse]))
        total[:, k] = (run[words.first[1:]] - run[words.first[:-1]]) / np.maximum(words.counts, 1)
    p = (1 - model.doubt) * _softmax((total + model.bias) / model.temperature) + model.doubt / c
    best = p.argmax(axis=1)
    return best, p[np.arange(len(p)), best]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row; only the text is looked at.

    A text that is null or has no letter is `und` with score 0, and rejected; so is every text if no language was
    learned. Otherwise lang_pred is a learned language, score its calibrated probability, and rejected tells whether
    that is under the model's threshold. Repeated rows come back once each; an empty table gives an empty result;
    extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                known = part.column(2).to_numpy(zero_copy_only=False).astype(bool)
                if m.langs:
                    best, score = predict_slice(part.column(1), m)
                else:
                    best, score, known = np.zeros(part.num_rows, int), np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                names = np.array([*m.langs, UNKNOWN], object)[np.where(known, best, len(m.langs))]
                score = np.where(known, score, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < m.threshold))], ["doc_id", "lang_pred", "score", "rejected"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", letters.alias("known")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def known_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, whose text is not rejected; nothing moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                keep = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
                if m.langs:
                    keep &= predict_slice(part.column(1), m)[1] >= m.threshold
                else:
                    keep[:] = False
                yield pa.RecordBatch.from_arrays(part.columns[2:], docs_names).filter(pa.array(keep))

    docs_names = docs.columns
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    numbered = docs.select(letters, "text", *docs.columns).toDF("known", "text", *[f"c{i}" for i in range(len(docs_names))])
    return numbered.mapInArrow(run, docs.schema)


def held_out(column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id is in none."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out("doc_id", 5, 0)))
    return identify(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score", "rejected")
