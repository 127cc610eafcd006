import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import neighbours


def brute(ids, x, limit=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= limit
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    for _ in range(len(ids)):
        new = np.minimum(root, np.where(near, root[None, :], len(ids)).min(axis=1))
        if (new == root).all():
            break
        root = new
    return {int(i): (int(n), int(ids[r])) for i, n, r in zip(ids, near.sum(axis=1), root)}


def test_groups_and_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 32))
    x = np.concatenate([rng.standard_normal((500, 32)), *(c + 0.2 * rng.standard_normal((25, 32)) for c in centres), *[centres[:1]] * 300]).astype(np.float32)
    ids = np.arange(len(x))
    odd = [(9001, None), (9002, []), (9003, [0.0] * 32), (9004, [float("nan")] + [1.0] * 31), (9005, [None] + [1.0] * 31), (9006, [1.0] * 5), (None, x[0].tolist()), (9007, [float("inf")] * 32)]
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + odd, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).repartition(4)
    got = {r["vec_id"]: r for r in neighbours.embedding_near_duplicates(table).collect()}
    want = brute(ids, x.astype(np.float64))
    assert len(got) == len(ids) + len(odd)
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, i is not None) for i, _ in odd)
    found, true = sum(got[i]["n_links"] for i in want), sum(n for n, _ in want.values())
    assert 0.98 * true <= found <= true
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    assert sum(got[i]["component_id"] == want[i][1] for i in want) >= 0.98 * len(want)


def test_list_decoding_equals_trying_all_filters():
    rng = np.random.default_rng(0)
    code = neighbours.ProductCode(16, 300, 0.9)
    x = rng.standard_normal((40, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ code.rotation
    grid = np.stack(np.meshgrid(*[np.arange(code.words)] * len(code.books), indexing="ij"), -1).reshape(-1, len(code.books))
    directions = np.concatenate([book[grid[:, k]] for k, book in enumerate(code.books)], axis=1)
    for row, found in zip(y, code.decode(x)):
        assert set(found.tolist()) == set(np.flatnonzero(directions @ row >= code.threshold).tolist())


def test_empty_and_repeated(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.embedding_near_duplicates(none).collect() == []
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in neighbours.embedding_near_duplicates(twice).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_each_length_links_among_itself(spark):
    rows = [(i, [1.0, 2.0, 3.0 + 0.01 * i]) for i in range(5)] + [(10, [1.0] * 5), (11, [1.0] * 5), (12, [1.0, 1.0, 1.0, 1.0, 1.1]), (20, [3.0]), (21, [4.0]), (22, [-4.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.embedding_near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {**{i: (4, 0) for i in range(5)}, 10: (2, 10), 11: (2, 10), 12: (2, 10), 20: (1, 20), 21: (1, 20), 22: (0, 22)}


def test_query_recall(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["vec_id"]: r for r in neighbours.op9_embedding_near_dedup(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64))
    assert set(got) == set(want)
    found, true = sum(got[i]["n_links"] for i in want), sum(n for n, _ in want.values())
    assert 0.9 * true <= found <= true
