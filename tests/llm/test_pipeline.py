"""The pipeline's stages on a small corpus of planted cases."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import packing, suffixes


def corpus(spark):
    rng = random.Random(8)
    some = {"aa": "ka lo mi nu te sha ru", "bb": "qué ñan zor ix pl tre um"}
    word = lambda lang: "".join(rng.choices(some[lang].split(), k=rng.randint(1, 4)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    passage = line("aa", 70)
    rows = []
    for i in range(60):
        lang = "aa" if i % 2 else "bb"
        rows.append((i, "\n".join(line(lang, rng.randint(20, 40)) for _ in range(4)), lang))
    rows.append((100, rows[3][1], "aa"))  # an exact copy
    rows.append((101, rows[5][1].replace("\n", " ") + " " + word("aa"), "aa"))  # a near copy on one line
    rows += [(110 + k, line("aa", 30) + " " + passage + " " + line("aa", 30), "aa") for k in range(3)]
    rows += [(120, None, "aa"), (121, "...", "aa"), (122, rows[7][1].split("\n")[0] + "\n" + line("aa", 25), "aa")]
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long"), passage


def test_stages(spark):
    docs, passage = corpus(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "passage_dedup", "best_fit_packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {120, 121}.isdisjoint(kept["language_id"]) and len(kept["language_id"]) == 66
    assert 100 not in kept["line_dedup"] and "\n" not in kept["line_dedup"][122] and set(range(60)) <= set(kept["line_dedup"])
    assert 101 not in kept["near_dedup"] and set(range(60)) <= set(kept["near_dedup"])
    for i in range(110, 113):
        assert passage in kept["near_dedup"][i] and passage[50:-50] not in kept["passage_dedup"][i]
    assert all(kept["passage_dedup"][i] == kept["near_dedup"][i] for i in range(60))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r["doc_id"] for r in packed} == set(kept["passage_dedup"])
    assert max(r["offset"] + r["length"] for r in packed) <= packing.CAPACITY


def test_cut_characters_leave_valid_text(spark):
    df = spark.createDataFrame([(bytearray("aé".encode()[:2] + b"b"),), (None,)], "kept binary")
    assert [r[0] for r in df.select(suffixes.valid_text("kept")).collect()] == ["ab", None]


def test_run_and_empty_table(spark, tmp_path):
    docs, _ = corpus(spark)
    docs.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    docs.where(F.lit(False)).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "full")).count() > 60
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
