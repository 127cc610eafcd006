import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import minhash
from palimpsest.llm.components import connected_components

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    """{row number: (size, smallest linked doc_id)}, by all pairs."""
    sets = []
    for _, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return Counter((d, len(sets[i]), min(least[find(i)], default=None)) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    words = lambda n: [word() for _ in range(n)]
    edit = lambda w, n: [word() if i in set(rng.sample(range(len(w)), n)) else x for i, x in enumerate(w)]
    base, hot = words(120), words(40)
    texts = [None, "", " \t\n", "one", "ONE", "a b c d", "A b\tc d"]
    texts += [" ".join(edit(base, n)) for n in [0, 0, 1, 2, 3, 3, 4, 4, 5, 6, 8, 12] * 4]
    texts += [" ".join(words(rng.randint(10, 60)) + hot + words(rng.randint(10, 60))) for _ in range(60)]
    chain = words(100)
    for _ in range(8):
        chain = edit(chain, 2)
        texts.append(" ".join(chain))
    texts += [" ".join(words(1500))] * 2
    middle = edit(chain, 3)
    bridge = edit(middle, 3)
    texts += [" ".join(chain[:20] + chain), " ".join(bridge)]
    return list(enumerate(texts)) + [(20, texts[20]), (None, " ".join(base)), (None, "alone of all"), (None, " ".join(middle)), (None, " ".join(middle))]


@pytest.mark.parametrize("small,times", [(minhash.SMALL_BUCKET, 1), (0, 1), (0, 3)])
def test_groups_equal_all_pairs(spark, monkeypatch, small, times):
    """With every open bucket counted as large, all goes through the prefix-filter join; and so with repeated rows."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", small)
    rows = corpus() * times
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], "doc_id long, text string, class int, keys string").repartition(5)
    got = minhash.near_duplicate_groups(docs).collect()
    empty = Counter((d, 0, d) for d, t in rows if not (t or "").split())
    want = brute([r for r in rows if (r[1] or "").split()]) + empty
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for shared in (0, 150, 300, 600):
        a, b = pool[:600], pool[600 - shared : 1200 - shared][:600]
        b = np.concatenate([pool[:shared], rng.integers(0, 1 << 63, 600 - shared, dtype=np.uint64)])
        sig = minhash.superminhash(np.concatenate([a, b]), np.array([0, 600, 1200]), 400)
        assert abs((sig[0] == sig[1]).mean() - shared / (1200 - shared)) < 0.1
    tiny = minhash.superminhash(pool[:1], np.array([0, 0, 1]), 64)
    assert (tiny[0] == 0xFFFFFFFF).all() and len(set((tiny[1] >> 25).tolist())) == 64


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"))
    least = got.groupBy("root").agg(F.min("node").alias("least"), F.count("*").alias("n")).collect()
    assert sorted((r["least"], r["n"]) for r in least) == [(1, 40), (100, 60), (200, 2)]
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark):
    assert minhash.near_duplicate_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefix_join_finds_all_pairs_of_repeated_rows(spark):
    """The join called by itself: every row once, twice and three times gives the same pairs."""
    rng = random.Random(11)
    base = [rng.choice("abcdefghijkl") * rng.randint(1, 5) for _ in range(150)]
    texts = []
    for _ in range(12):
        new = list(base)
        for i in rng.sample(range(150), 2):
            new[i] = "x" + str(rng.randint(0, 10**6))
        texts.append(" ".join(new))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    true = sum(100 * len(a & b) >= 75 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    assert true > 10
    for times in (1, 2, 3):
        docs = spark.createDataFrame(list(enumerate(texts)) * times, "doc_id long, text string")
        shingles = minhash.shingle_sets(docs).cache()
        assert shingles.count() == len(texts)
        members = shingles.select("class", F.col("class").alias("group"))
        pairs = minhash._prefix_pairs(members, shingles, 75)
        assert minhash._linked(pairs, shingles, 75).count() == true


def test_null_ids_link(spark):
    """1 ~ (no id) ~ 2, where 1 and 2 aren't linked directly."""
    words = [f"w{i}" for i in range(60)]
    a, b = list(words), list(words)
    a[5] = "x"
    b[50] = "y"
    rows = [(1, " ".join(a)), (None, " ".join(words)), (2, " ".join(b))]
    got = minhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, None: 1, 2: 1}


def test_one_of_each_group(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "end"])
    rows = [(5, " ".join(words), "b"), (5, " ".join(words), "a"), (5, "quite another text of some words", "c"), (6, near, "d"), (None, near, "e"), (None, "nobody's own text is this one", "f"), (None, "nobody's own text is this one", "f"), (7, None, "g"), (7, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    kept = minhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["tag"]) for r in kept.collect()) == [("5", "a"), ("5", "c"), ("7", "g"), ("7", "h"), ("None", "f")]
    assert minhash.one_of_each_group(docs.where("doc_id > 9")).collect() == []


def test_query_equals_the_library(spark):
    got = minhash.op6_minhash_near_dedup(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = brute([r for r in rows if (r[1] or "").split()]) + Counter((d, 0, d) for d, t in rows if not (t or "").split())
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == want
