import random

import pyspark.sql.functions as F
import pytest

from palimpsest.functions import canonical, stems
from palimpsest.operators import containment, search

KNOWN = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "caress": "caress", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll",
    "by": "by", "a": "a", "yes": "ye", "naïve": "naïv", "東京": "東京",
}


def test_known_stems():
    assert {w: stems.stem(w) for w in KNOWN} == KNOWN


def test_search_by_stems(spark):
    docs = spark.createDataFrame([(1, "connected connection connects"), (2, "connecting"), (3, "other words"), (4, None), (5, "connecting")], "doc_id long, content string")
    terms = spark.createDataFrame([(7, "connections"), (7, "connected"), (8, "unseen")], "query_id long, term string")
    table, asked = search.stemmed(docs, terms)
    assert sorted(r["term"] for r in table.collect()) == ["connected", "connecting", "connection", "connections", "connects", "unseen"]
    out = search.bm25(docs, asked.withColumnRenamed("stem", "term"), "doc_id", 10, stems=table)
    rows = out.orderBy("rank").collect()
    assert [r["doc_id"] for r in rows] == [1, 2, 5] and all(r["matched"] == 1 for r in rows)  # equal scores: the smaller id first
    assert rows[1]["score"] == rows[2]["score"]
    seen = spark.createDataFrame([(7, 2)], "query_id long, doc_id long")
    assert [r["doc_id"] for r in search.bm25(docs, asked.withColumnRenamed("stem", "term"), "doc_id", 10, exclude=seen, stems=table).orderBy("rank").collect()] == [1, 5]


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_containment_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(containment, "BLOCK_CHARS", block)
    rng = random.Random(block)
    word = lambda n: "".join(rng.choice("abAB é") for _ in range(n))
    texts = [(i % 3, i, word(rng.randint(0, 60))) for i in range(60)] + [(1, 99, None), (1, 100, ""), (1, 100, "aba"), (1, 100, "aba")]
    patterns = [(i % 3, word(rng.randint(1, 4))) for i in range(15)] + [(1, ""), (1, None), (2, "É"), (0, "aba")]
    t = spark.createDataFrame([(*r, "x") for r in texts], "thread_id long, seq long, content string, pattern string").drop("pattern").repartition(3)
    p = spark.createDataFrame([(*r, 1) for r in patterns], "thread_id long, pattern string, seq int")
    strings = {s for _, s in patterns if s}
    want = sorted((a, b, s, s in c) for a, b, c in texts if c for s in strings if s.lower() in c.lower())
    assert sorted(map(tuple, containment.contained(t, p, ["thread_id", "seq"]).collect())) == want
    own = sorted((a, b, s, e) for a, b, s, e in want if (a, s) in set(patterns))
    assert sorted(map(tuple, containment.contained(t, p, ["thread_id", "seq"], within=["thread_id"]).collect())) == own
    assert containment.contained(t, p.limit(0), ["thread_id", "seq"]).count() == 0 and containment.contained(t.limit(0), p, ["thread_id", "seq"]).count() == 0


def test_canonical_forms(spark):
    cases = {
        '{"b": 1, "a": {"d": [1.0, 2.5e0, -0.0], "c": null}}': '{"a":{"c":null,"d":[1,2.5,0]},"b":1}',
        '"é"': '"é"', "1e-7": "1e-7", "1.5E+30": "1.5e+30", "123456789012345678901": "123456789012345678901", " [ ] ": "[]", '{"\\u0061":"\\n"}': '{"a":"\\n"}',
        '{"a":1,"a":2}': None, "{": None, "": None, "NaN": None, "1e999": None, "[" * 100_000: None,
    }
    assert {k: canonical.canonical_text(k) for k in cases} == cases
    df = spark.createDataFrame([(1, "ＡＢＣ　ﬁne\tＸ "), (2, None), (3, "")], "i long, t string").select("i", canonical.folded(F.col("t")).alias("t"), canonical.canonical_json(F.col("t")).alias("j"))
    assert sorted(map(tuple, df.collect())) == [(1, "abc fine x", None), (2, None, None), (3, "", None)]
