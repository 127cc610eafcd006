import itertools
import math

import numpy as np
import pytest

from palimpsest.llm import multiindex

SCHEMA = "vec_id long, embedding array<double>, score string, dim string"


def brute(rows, k=10):
    fine = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    queries = {}
    for i, v in fine:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    out = {}
    for i, q in queries.items():
        best = {}
        for j, v in fine:
            if j != i and len(v) == len(q):
                d = float(multiindex.distances(np.array([v]), np.array(q))[0])
                best[j] = min(d, best.get(j, math.inf))
        out[i] = sorted((d, j) for j, d in best.items())[:k]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    true = sum(map(len, want.values()))
    return sum(len({j for _, j in got.get(q, [])} & {j for _, j in w}) for q, w in want.items()) / true


def cloud(rng, n, dim, centres=0):
    x = rng.standard_normal((n, dim))
    return x if not centres else rng.standard_normal((centres, dim))[rng.integers(0, centres, n)] * 3 + x


@pytest.mark.parametrize("centres", [0, 20])
def test_recall_against_brute_force(spark, centres):
    rng = np.random.default_rng(centres)
    rows = [(int(i), x.tolist()) for i, x in enumerate(cloud(rng, 6000, 24, centres))]
    rows += [(10_000 + i, rows[500][1]) for i in range(1500)]  # a hot vector, and a group near another
    rows += [(20_000 + i, (np.array(rows[700][1]) + rng.standard_normal(24) * 1e-3).tolist()) for i in range(1500)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    index = multiindex.build_index(table, cell_rows=16)
    assert len(index.books[24][0]) > 10 and index.counts[24].sum() == 6000 + 1500  # equal vectors are one entry
    got, want = found(multiindex.search(index, multiindex.queries_of(table))), brute(rows)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    assert recall(got, want) >= 0.9
    for q, hits in got.items():
        exact = dict((j, d) for d, j in brute([(q, rows[q][1] if q < 6000 else next(v for i, v in rows if i == q))] + [(i, v) for i, v in rows if i in {j for _, j in hits}])[q])
        assert all(exact[j] == d for d, j in hits) and hits == sorted(hits)
    assert [j for _, j in got[500]] == list(range(10_000, 10_010))  # ties to the smaller id
    if centres:
        assert index.visit[24] < 0.5 * 7500  # with clusters, most entries are spared


def test_without_codebooks_all_is_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), x.tolist()) for i, x in enumerate(cloud(rng, 900, 5))] + [(3000 + int(i), x.tolist()) for i, x in enumerate(cloud(rng, 300, 9))]
    rows += [(None, rows[1][1]), (4000, None), (4100, []), (4200, [0.0] * 5), (4300, [1.0, None, 1.0, 1.0, 1.0]), (4400, [float("nan")] * 5), (4500, [float("inf")] * 5)]
    rows += [(4600, [1e200] * 5), (4601, [1e200] * 4 + [2e200]), (4700, [1.0, 2.0]), (4800, [2.0]), (4801, [2.5]), (100, rows[3][1]), (100, rows[100][1]), (100, rows[100][1]), (5, rows[8][1])]
    rows += [(5000 + i, [0.5, 1.5]) for i in range(30)]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    got = found(multiindex.search(multiindex.build_index(table), multiindex.queries_of(table)))
    want = {q: w for q, w in brute(rows).items() if w}
    assert got == want
    assert len(got[4800]) == 1 and len(got[5000]) == 10


def test_blocks_and_copies(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 50)
    monkeypatch.setattr(multiindex, "PROBES", 3)
    rng = np.random.default_rng(8)
    rows = [(int(i), x.tolist()) for i, x in enumerate(cloud(rng, 1200, 6))]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    index = multiindex.build_index(table, cell_rows=40, least=100)
    index.visit = {6: 1200}
    assert found(multiindex.search(index, multiindex.queries_of(table))) == brute(rows)


def test_nearest_lists_an_id_once():
    x = np.arange(1, 40, dtype=float)[:, None]
    assert [i for _, i, _ in multiindex.nearest(x, [[100]] * 25 + [[7]] * 8 + [[8], [9], [3, 2], [1], [1], [5]], 100, np.zeros(1), 4)] == [7, 8, 9, 2]


def test_traversal_is_by_summed_distance():
    rng = np.random.default_rng(9)
    books, q = (rng.standard_normal((7, 2)), rng.standard_normal((5, 3))), rng.standard_normal(5)
    counts = rng.integers(0, 4, 35)
    way = multiindex.traverse(q, books, counts, 1 << 30)
    total = {i * 5 + j: ((q[:2] - books[0][i]) ** 2).sum() + ((q[2:] - books[1][j]) ** 2).sum() for i, j in itertools.product(range(7), range(5))}
    assert way == [c for c in sorted(total, key=total.get) if counts[c]]
    some = multiindex.traverse(q, books, counts, 10)
    assert some == way[: len(some)] and counts[some].sum() >= 10 > counts[some[:-1]].sum()


def test_empty_and_query(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert multiindex.search(multiindex.build_index(table), multiindex.queries_of(table)).count() == 0
    out = multiindex.op11_nearest_neighbours(spark, "/root/testdata/sf0.001")
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and found(out) == brute(rows)
