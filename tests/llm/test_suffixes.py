import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import suffixes


def brute(texts, length):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 250))).astype(np.uint8)
    if seed % 3 == 0:
        x = np.repeat(x, rng.integers(1, 12, len(x)))[:400]
    if seed % 7 == 0:
        x = np.tile(x[: max(1, len(x) // 9)], 9)
    b = x.tobytes()
    assert suffixes.suffix_array(x, 10**6).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


@pytest.mark.parametrize("large_group", [suffixes.LARGE_GROUP, 2])
def test_against_brute_force(spark, large_group):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7)))
    some = lambda n: " ".join(word() for _ in range(n))
    shared, hot = some(60), some(45)
    texts = [None, "", "short", "a" * 900, "ab" * 400, some(200)]
    texts += [some(40) + shared + some(30), shared, some(5) + shared[3:] + some(5), shared + shared]
    texts += [some(rng.randint(0, 30)) + hot + some(rng.randint(0, 30)) for _ in range(40)]
    texts += [texts[5]] * 3 + [some(4000)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, at int, packed int").repartition(5)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in suffixes.remove_repeats(docs, large_group=large_group).collect()}
    assert [got[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts], 200)


def test_repeated_rows_and_empty_table(spark):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(300))
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [(r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(twice).collect()] == [(300, 1), (300, 1)]
    assert suffixes.remove_repeats(twice.where("doc_id = 2")).collect() == []


def test_many_repeated_rows(spark):
    """A text in a thousand rows: its places are listed once, and all of it goes everywhere."""
    text = "".join(random.Random(2).choice("abcdef ") for _ in range(700))
    docs = spark.createDataFrame([(1, text)] * 1000 + [(2, text[:350])], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"], r["n_spans"]) for r in suffixes.remove_repeats(docs).collect())
    assert got == {(1, 700, 1): 1000, (2, 350, 1): 1}


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], brute([(r["text"] or "").encode() for r in rows], 200)))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.op2_suffix_array_dedup(spark, folder).collect()}
    assert got == want


def test_intervals_of_repeated_rows_do_not_grow(spark):
    """However often a row is repeated beside one that shares half of it, its intervals are those of one row."""
    rng = np.random.default_rng(21)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    one, half = word(900), word(450)
    counts = []
    for n in (2, 40, 160):
        rows = [(7, half + one)] * n + [(8, half + word(450))]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        at = docs.selectExpr("xxhash64(doc_id, text) AS at", "text")
        counts.append(suffixes.repeated_intervals(at).count())
        out = suffixes.remove_repeats(docs).select("doc_id", "n_removed").distinct().collect()
        assert sorted(map(tuple, out)) == [(7, 1350), (8, 450)]
    assert counts[0] == counts[1] == counts[2]
