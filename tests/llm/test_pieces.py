import functools
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece

from palimpsest.llm import pieces as module
from palimpsest.llm.pieces import Pieces, decode, document_keys, encode, op4_sentencepiece

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["  a  b ", "", "a", "\n\t x", " ", "▁x ▁ y▁", "é世𝄞\x00", "ﬁ ①", "x" * 500, "<s> </s><unk>", "a  ", " " * 40, "Straße 12.5%", "▁▁ ▁"]


@pytest.fixture(scope="module")
def pieces():
    return Pieces(PATH)


def prose(n=None):
    return pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()[:n]


def test_without_dropout_it_is_the_models_own(pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [t or "" for t in prose()] + [t for t in HARD if "▁" not in t]
    assert all(pieces.encode(t) == model.encode(t) for t in texts)


@functools.cache
def vocabulary():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    n = model.get_piece_size()
    vocab = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    return model, vocab, {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}


def brute(text, key, seed, dropout):
    """One chunk after the other, one candidate after the other, with plain lists. Returns ids and how many candidates
    were taken and skipped."""
    model, vocab, byte = vocabulary()
    out, place, taken, skipped = [], 0, 0, 0
    for piece in re.split("(▁)", " " + text) if text else []:
        for chunk in ["▁"] if piece == "▁" else re.findall(r" *[^ ]+| +", piece):
            salt = int(module.mix(document_keys(np.array([key]), seed) + np.uint64(place * 0xD6E8FEB86659FD93 & (1 << 64) - 1))[0])
            place += 1
            if piece == "▁":
                out += [byte[b] for b in "▁".encode()]
                continue
            parts, step, off = list(chunk.replace(" ", "▁")), 0, set()
            while True:
                # those off the agenda are told by their two sides' places
                ends = np.cumsum([0] + [len(p) for p in parts]).tolist()
                cand = [(-model.get_score(vocab[parts[i] + parts[i + 1]]), i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in vocab and (ends[i], ends[i + 1], ends[i + 2]) not in off]
                if not cand:
                    break
                _, i = min(cand)
                new = vocab[parts[i] + parts[i + 1]]
                skip = int(module._dropped(np.array([salt], np.uint64), step, np.array([new]))[0]) < int(dropout * 2**32)
                step += 1
                taken, skipped = taken + 1, skipped + skip
                if skip:
                    off.add((ends[i], ends[i + 1], ends[i + 2]))
                else:
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
            for p in parts:
                out += [vocab[p]] if p in vocab else [byte[b] for b in p.encode()]
    return out, taken, skipped


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_against_brute_force(pieces, dropout):
    texts = [t or "" for t in prose(25)] + HARD
    texts = [t[:3000] for t in texts]
    keys = np.arange(len(texts)) * 7 - 3
    ids, counts = pieces.encode_many(texts, document_keys(keys, 5), dropout)
    taken = skipped = at = 0
    for text, key, n in zip(texts, keys, counts):
        want, t, s = brute(text, int(key), 5, dropout)
        assert ids[at : at + n].tolist() == want
        at, taken, skipped = at + n, taken + t, skipped + s
    assert taken > 10_000 and abs(skipped / taken - dropout) < 0.01


def test_occurrences_vary_by_themselves(pieces):
    ids = pieces.encode(" ".join(["international"] * 2000), 0.3, seed=1)
    word = pieces.encode("international international")[1:]
    assert len(word) < 13
    kinds = {tuple(x) for x in "".join(chr(i) for i in ids).split(chr(ids[0]))}
    assert len(kinds) > 20  # far more segmentations than a few fixed variants


def test_lossless_seeded_and_varied(spark):
    rows = [(i, t, "x") for i, t in enumerate([*HARD, None, "some longer words appear here repeatedly " * 20])] + [(None, "a row without an id", "y")]
    docs = spark.createDataFrame(rows + rows[-2:-1], "doc_id long, text string, ids string")
    out = decode(encode(docs, dropout=0.3, seed=1)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == sorted((str(i), t or "") for i, t, _ in rows + rows[-2:-1])
    again = encode(docs.repartition(3), dropout=0.3, seed=1).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in again) == sorted((str(r["doc_id"]), r["ids"]) for r in out)
    other = {r["doc_id"]: r["ids"] for r in encode(docs, dropout=0.3, seed=2).collect()}
    last = len(rows) - 2
    assert other[last] != next(r["ids"] for r in again if r["doc_id"] == last)
    assert encode(docs.where("doc_id < 0")).collect() == []


def test_very_long_text(pieces):
    text = "lorem  ipsum\n" * 80_000 + "z" * 20_000
    ids = pieces.encode(text, 0.1)
    assert pieces.decode(ids) == text


def test_query_equals_the_library(spark, pieces):
    got = {r["doc_id"]: r for r in op4_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert set(got) == {r["doc_id"] for r in table}
    for r in table[:40]:
        ids, _, _ = brute((r["text"] or "")[:4000], r["doc_id"], 0, 0.1)
        mine = got[r["doc_id"]]
        if len(r["text"] or "") <= 4000:
            assert (mine["n_ids"], mine["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))
        assert mine["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
