import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import sketches
from palimpsest.llm._shared import written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(docs, items, k):
    kept = [(i, d, terms(t)) for i, (d, t) in enumerate(docs) if terms(t)]
    n_docs, total = len(kept), sum(len(t) for _, _, t in kept)
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(terms(text))
    df = {t: sum(t in words for _, _, words in kept) for q in queries.values() for t in q}
    out = []
    for item, q in queries.items():
        scored = []
        for i, doc, words in kept:
            m = 50 + 50 * len(words) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * words.count(t) // (1000 * words.count(t) + 20 * m)) for t in q if t in words)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, i))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def tables(rng):
    words = [f"{a}{b}" for a in ("ba", "É", "ko", "x1", "東") for b in range(60)]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([20, 300])]) for _ in range(rng.randint(1, 80)))) for i in range(220)]
    docs += [(7, docs[7][1])] * 60 + [(None, docs[9][1]), (None, None), (500, ""), (501, None), (502, " .,-"), (503, "ba1 " * 400 + "BA2"), (504, "\x00ba1\x7fÉ3")]
    docs += [(600 + i, "ba3 x11 same text") for i in range(70)]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    items += [(3, items[5][1]), (40, None), (41, ""), (42, "never seen words"), (None, "ba1 x12"), (43, "ba3 same"), (44, "Ba1 BA1 ba1")]
    return docs, items


def searched(spark, docs, items, k=sketches.BEST, parts=4):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, score int").repartition(parts)
    q = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    index = written(sketches.sketch_index(d), "sketches")
    return sorted((tuple(r) for r in sketches.ranked_search(index, q, k).collect()), key=repr)


def test_equals_brute_force(spark):
    docs, items = tables(random.Random(1))
    assert searched(spark, docs, items) == brute(docs, items, 50)
    assert searched(spark, docs, items, k=3) == brute(docs, items, 3)


@pytest.mark.parametrize("name,value", [("ITEMS", 4), ("CELLS", 40)])
def test_blocks_of_queries(spark, monkeypatch, name, value):
    docs, items = tables(random.Random(2))
    monkeypatch.setattr(sketches, name, value)
    assert searched(spark, docs, items, k=7) == brute(docs, items, 7)


def test_narrow_sketches_still_bound(monkeypatch):
    rng = random.Random(3)
    docs, items = tables(rng)
    column = pa.array([t for _, t in docs], pa.string())
    found = sketches.Terms(column)
    block = sketches.Block.of([(i, {t.encode() for t in terms(text)}) for i, text in items])
    of_term = np.array([rng.randint(0, 9000) for _ in block.hashes])
    n = found.counts
    for least, spread in ((1, 0.1), (4, 1), (8, 64)):
        monkeypatch.setattr(sketches, "LEAST_BITS", least)
        monkeypatch.setattr(sketches, "SPREAD", spread)
        bits, stored = sketches.sketches(*sketches.frequencies(found), len(column))
        scorer = sketches.Scorer(block, of_term, int((n > 0).sum()), int(n.sum()))
        bounds, exact = scorer.bounds(n, bits, pa.array(stored, pa.binary())), scorer.scores(column, n)
        assert (bounds >= exact).all() and exact.max() > 0
        if spread == 64:
            assert (bounds == exact).mean() > 0.5


def test_whole_numbers_beyond_doubles():
    block = sketches.Block.of([(1, {b"a", b"b"})])
    scorer = sketches.Scorer(block, np.array([1 << 40, 3]), 2, 4)
    assert scorer.kind is np.int64
    assert scorer.scores(pa.array(["a b"]), np.array([2]))[0, 0] == ((1 << 40) + 3) * (10**9 // (1000 + 20 * 100))
    assert sketches.lengths_m(np.array([10**9]), 10**11, 10**12)[0] == 50 + 50 * 10**9 * 10**11 // 10**12


def test_bounds_spare_documents():
    """A document like the query is found by its bound, and no other bound reaches its score; of the ten best bounds, most
    are near the ten best scores."""
    rng = random.Random(4)
    docs = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(40)) for _ in range(3000)]
    column = pa.array(docs)
    found = sketches.Terms(column)
    bits, stored = sketches.sketches(*sketches.frequencies(found), len(docs))
    block = sketches.Block.of([(0, {t.encode() for t in docs[17].split()})])
    scorer = sketches.Scorer(block, np.full(len(block.hashes), 1000), len(docs), int(found.counts.sum()))
    bounds, exact = scorer.bounds(found.counts, bits, pa.array(stored, pa.binary()))[:, 0], scorer.scores(column, found.counts)[:, 0]
    assert exact.argmax() == 17 and (bounds >= exact[17]).sum() == 1
    assert (bounds > exact).mean() < 0.6


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")], parts=1) == [] and searched(spark, [(1, "a")], [], parts=1) == [] and searched(spark, [(1, None)], [(1, "a")], parts=1) == []


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got = sketches.op13_ranked_search(spark, folder)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(sketches.OP13_SQL).fetchall())
