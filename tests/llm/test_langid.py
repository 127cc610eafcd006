import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import _text, langid

SYLLABLES = {"aa": "ka lo mi nu te sha", "bb": "qué ñan zor ix pl tre", "cc": "öst ßen wür ag ck dt"}


def text(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(n)).capitalize()


def table(spark, n=400):
    rng = random.Random(6)
    rows = [(i, text(lang, rng, rng.randint(3, 60)), lang, "s") for i, lang in enumerate(rng.choices(list(SYLLABLES), k=n))]
    odd = [(n, None, "aa", "s"), (n + 1, "", "aa", "s"), (n + 2, " 12, -- !", "aa", "s"), (n + 3, text("bb", rng, 5), None, "s"), (None, text("cc", rng, 20), "cc", "s"), (n + 4, text("aa", rng, 20_000), "aa", "s")]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy(spark):
    docs = table(spark)
    held = langid.held_out("doc_id", 5, 0)
    model = langid.train(docs.where(~held), rows=200)
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    rows = [r for r in docs.where(held).collect() if r["text"] and any(c.isalpha() for c in r["text"]) and r["lang"]]
    assert len(rows) > 50 and np.mean([out[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out.values())
    for i in (400, 401, 402):
        assert (out[i]["lang_pred"], out[i]["score"], out[i]["rejected"]) == ("und", 0.0, True)
    assert out[403]["lang_pred"] == "bb" and out[None]["lang_pred"] == "cc" and out[404]["lang_pred"] == "aa"
    kept = langid.known_language(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if not r["rejected"]}


def test_labels_and_ids_are_no_inputs(spark):
    docs = table(spark)
    model = langid.train(docs, rows=200)
    other = docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.col("doc_id") + 7)
    ids = lambda r, by: -1 if r["doc_id"] is None else r["doc_id"] - by
    a = sorted((ids(r, 0), r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect())
    b = sorted((ids(r, 7), r["lang_pred"], r["score"]) for r in langid.identify(other, model).collect())
    assert a == b


@pytest.mark.parametrize("seed", [1, 2])
def test_gradient_lowers_the_loss(seed):
    rng = random.Random(seed)
    langs = rng.choices(list(SYLLABLES), k=120)
    texts = [text(lang, rng, 30) for lang in langs]
    model = langid.fit(langid.text_features(pa.array(texts)), langs)
    best, score = langid.predict_slice(pa.array(texts), model)
    assert [model.langs[i] for i in best] == langs and score.min() > 1 / 3


def test_no_labels_and_empty_table(spark):
    docs = table(spark, 20)
    none = langid.train(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.known_language(docs, none).collect() == []
    one = langid.train(docs.where("lang = 'aa' or lang is null"))
    assert {r["lang_pred"] for r in langid.identify(docs, one).collect()} == {"aa", "und"}
    assert langid.identify(docs.where("doc_id = -4"), none).collect() == []


def test_text_features_are_means_over_words():
    texts = pa.array(["abc abc de", "", "de"])
    words = langid.Words(texts)
    bucket, owner = langid.word_features(words, np.arange(len(words.hash)))
    for i, (b, w) in enumerate(langid.text_features(texts)):
        want = np.zeros(langid.BUCKETS)
        for k in range(words.first[i], words.first[i + 1]):
            own = bucket[owner == k]
            np.add.at(want, own, 1 / len(own) / (words.first[i + 1] - words.first[i]))
        assert np.allclose(want[b], w) and len(b) == (want > 0).sum()


def test_rejects_what_no_language_is_like(spark):
    """Texts in a script that no training text has, and the sample: even over languages, whole texts."""
    rng = random.Random(4)
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(prose.where(~langid.held_out("doc_id", 5, 0)))
    strange = spark.createDataFrame([(i, "".join(chr(0x0430 + rng.randrange(32)) if rng.random() < 0.8 else " " for _ in range(400)), None) for i in range(40)], "doc_id long, text string, lang string")
    out = langid.identify(strange, model).collect()
    assert np.mean([r["rejected"] for r in out]) > 0.5 and langid.known_language(strange, model).count() == sum(not r["rejected"] for r in out)
    kept = langid.identify(prose.where(langid.held_out("doc_id", 5, 0)).where(F.length("text") > 40), model)
    assert kept.where("rejected").count() <= 0.02 * kept.count()
    docs = table(spark)
    model = langid.train(docs, rows=300)
    counts = {r["lang"]: r["n"] for r in langid.sample(docs, 90).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert counts == {"aa": 30, "bb": 30, "cc": 30}
    clash = docs.withColumn("known", F.lit("k")).withColumn("_known", F.lit(1))
    kept = langid.known_language(clash, model)
    assert kept.columns == clash.columns and {r["_known"] for r in kept.collect()} == {1}


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r["doc_id"]: r for r in langid.op7_language_id(spark, folder).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(rows) == set(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [i for i, r in rows.items() if r["held_out"] and docs[i]["lang"] and any(c.isalpha() for c in docs[i]["text"] or "")]
    assert np.mean([rows[i]["lang_pred"] == docs[i]["lang"] for i in held]) > 0.9


def plain_prediction(text, model):
    """(language, score) from the definition, word by word: means over a word's features, then over words; softmax."""
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def code(part):
        total, power = 0, 1
        for byte in part:
            total, power = total + int(_text._TABLE[byte]) * power, power * _text._BASE & mask
        return mix((total + len(part) * 0xD6E8FEB86659FD93) & mask)

    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())  # bytes.lower changes A-Z only
    z = np.zeros(len(model.langs))
    for word in words:
        buckets = [code(word) >> 48]
        for n in langid.GRAMS:
            for i in range(len(word) - n + 1):
                buckets.append(mix((code(word[i : i + n]) + (i == 0) + 2 * (i + n == len(word))) & mask) >> 48)
        z += model.logits[buckets].astype(float).mean(axis=0)
    z = (z / max(1, len(words)) + model.bias) / model.temperature
    p = np.exp(z - z.max())
    p = (1 - model.doubt) * p / p.sum() + model.doubt / len(p)
    return model.langs[int(p.argmax())], float(p.max())


def test_query_against_plain_evaluation(spark):
    """All rows of the query against the same model evaluated plainly."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = langid.train(docs.where(~langid.held_out("doc_id", 5, 0)))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = langid.op7_language_id(spark, folder).collect()
    assert len(rows) == docs.count() > 100
    for r in rows:
        text = texts[r["doc_id"]]
        if text is None or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        lang, score = plain_prediction(text, model)
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6, r
