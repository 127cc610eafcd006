import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import packing

TEXTS = [None, "", "a", "word " * 3000, "It's 12,5 — naïve 日本語 \x00 ▁", "<|endoftext|> x", "same", "same", "\n\n  \t tabs", "x" * 5000]


@pytest.mark.parametrize("seed,top", [(0, 1024), (1, 300), (2, 700), (3, 40)])
def test_plan_is_best_fit_decreasing(seed, top):
    lengths = np.random.default_rng(seed).integers(1, top + 1, 3000).tolist()
    plan = packing.plan_packing(Counter(lengths), 1024)
    key = plan["length"] * (1 << 48) + plan["rank"]
    ranks, spans = Counter(), []
    for n in lengths:
        i = int(np.searchsorted(key, n * (1 << 48) + ranks[n], side="right")) - 1
        q, w = divmod(ranks[n] - plan["rank"][i], plan["per"][i])
        ranks[n] += 1
        spans.append((plan["seq"][i] + q, plan["offset"][i] + w * n, n))
    ends = defaultdict(int)
    for seq, offset, n in sorted(spans):
        assert offset == ends[seq]
        ends[seq] += n
    assert max(ends.values()) <= 1024
    open_, opened = [], 0
    for n in sorted(lengths, reverse=True):  # one document at a time
        i = bisect.bisect_left(open_, n)
        opened += i == len(open_)
        left = (1024 if i == len(open_) else open_.pop(i)) - n
        if left:
            bisect.insort(open_, left)
    assert len(ends) == opened


def test_pieces_and_places(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(7, "same", "x", 1)], "doc_id long, text string, sequence_id string, length long")
    rows = packing.best_fit_packing(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in [*enumerate(TEXTS), (7, "same")]:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, n in enumerate([(len(ids) - 1) % 1024 + 1] + [1024] * ((len(ids) - 1) // 1024)):
            want.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    assert sorted(tuple(r[:5]) for r in rows) == sorted(want)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "\t" * 1_000_000 + "x", "a" + " \n" * 500_000 + "b c", "x" * 1_000_000, "!?" * 60_000 + " <|endoftext|>" + " " * 60_000])
def test_long_runs_encode_as_tokenizers_does(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert packing.Encoder(path).encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_long_white_space_is_packed(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "a b")], "doc_id long, text string")
    got = packing.best_fit_packing(docs).groupBy("doc_id").sum("length").collect()
    n = len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(" " * 1_000_000, add_special_tokens=False).ids)
    assert sorted(map(tuple, got)) == [(1, n + 1), (2, 3)]


def test_empty_table(spark):
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_the_library(spark):
    rows = packing.op1_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs.items()}
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in rows)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 1024
