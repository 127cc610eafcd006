import hashlib
import random

import numpy as np
import pyarrow as pa

from palimpsest.llm import fingerprints


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + str(rng.randint(0, 30)) for _ in range(n)]


def jaccard(a, b):
    terms = {*a, *b}
    return sum(min(a.count(t), b.count(t)) for t in terms) / sum(max(a.count(t), b.count(t)) for t in terms)


def test_collision_rate_is_generalised_jaccard():
    rng = random.Random(1)
    for share in (0.0, 0.3, 0.6, 0.9):
        a = words(rng, 200) + ["often"] * 50
        b = a[: int(share * len(a))] + words(rng, 250 - int(share * 250))
        sig = fingerprints.signatures(pa.array([" ".join(a), " ".join(b)]), 1024)
        assert abs(fingerprints.likeness(sig[:1], sig[1:])[0] - jaccard(a, b)) < 0.06


def test_signature_does_not_depend_on_the_slice():
    rng = random.Random(2)
    texts = [" ".join(words(rng, n)) for n in (1, 5, 50, 25_000)]
    alone = [fingerprints.signatures(pa.array([t]))[0] for t in texts]
    assert (fingerprints.signatures(pa.array(texts)) == np.stack(alone)).all()
    assert (fingerprints.signatures(pa.array(["", None, " \n"])) == 0xFFFFFFFF).all()


def test_edits_follow_doc_id(spark):
    rng = random.Random(3)
    texts = {i * 3: " ".join(words(rng, rng.randint(0, 80))) for i in range(700)} | {-5: None, 10_000: "", 10_001: "é𝄞x" * 9, 10_002: "end"}
    docs = spark.createDataFrame([(i, t, "r", True) for i, t in texts.items()], "doc_id long, text string, range string, end boolean").repartition(7)
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs).collect()}
    order = sorted(texts)
    assert sorted(got) == order
    for i, j in zip(order, order[1:] + order[:1]):
        a, b = texts[i] or "", texts[j] or ""
        q = len(a) // 4
        edited = a[: len(a) - q] + b[:q]
        sig = fingerprints.signatures(pa.array([a, edited, b]))
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert [r["fingerprint"], r["edited_fingerprint"]] == fingerprints.fingerprint_text(sig[:2])
        assert abs(r["near_edited"] - (sig[0] == sig[1]).mean()) < 1e-9 and abs(r["near_next"] - (sig[0] == sig[2]).mean()) < 1e-9
    single = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(docs).collect()}
    assert single == {i: r["fingerprint"] for i, r in got.items()}


def test_one_none_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "x")], "doc_id long, text string")
    rows = fingerprints.fingerprint_edits(docs).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "1", "None"]
    assert len({r["fingerprint"] for r in rows if r["doc_id"]}) == 1
    assert fingerprints.fingerprint_edits(docs.where("doc_id = 1").limit(1)).first()["near_next"] == 1.0
    assert fingerprints.fingerprint_edits(docs.where("doc_id = 5")).collect() == []


def test_query_equals_the_library(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in fingerprints.op10_document_fingerprints(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    order = sorted(texts)
    for i, j in zip(order, order[1:] + order[:1]):
        a, q = texts[i], len(texts[i]) // 4
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(a), hashlib.sha256((a[: len(a) - q] + texts[j][:q]).encode()).hexdigest())


def test_large_weights_are_told_apart():
    """A term that occurs a million times or more has draws of its own weight, beside others of the slice as well as alone."""
    many = ["x " * n for n in ((1 << 20) - 1, 1 << 20, 3 << 20)]
    together = fingerprints.signatures(pa.array(many), 512)
    alone = [fingerprints.signatures(pa.array([t]), 512)[0] for t in many]
    assert (together == np.stack(alone)).all()
    assert fingerprints.likeness(together[1:2], together[2:])[0] < 0.6  # generalised Jaccard: a third
