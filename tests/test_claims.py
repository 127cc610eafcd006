from palimpsest.operators import claims


def said(text):
    return [(f, text[a:b]) for f, a, b in claims.scan(text)]


def test_families_and_who_gives_way():
    assert said("There are 12 units in it. We paid 5 EUR.") == [("collection", "There are 12 units in it."), ("number", "5 EUR")]
    assert said('He said "one two three" once, "no more" twice.') == [("quote", '"one two three"')]
    assert said("ticket-42 is open. The door is red.") == [("code", "ticket-42"), ("copula", "The door is red.")]
    assert said("It costs a lot. Maybe it costs more. Does it have it? She has a cat and is here.") == [("clause", "It costs a lot."), ("copula", "She has a cat and is here.")]
    assert said("abc1 1,200.5 ms 7% 9x") == [("number", "1,200.5 ms"), ("number", "7%")]
    # a number gives way to a collection, and a copula to a number even so
    assert said("There were 3 and it is so") == [("collection", "There were 3 and it is so")]
    assert said("") == [] and said(" \n. ") == []


def test_places_in_other_scripts_and_long_texts(spark):
    text = "\U0001d11e Ärger İ 5 ms.\n" * 30_000
    df = spark.createDataFrame([(1, text, 7), (2, None, 7), (3, "", 7), (None, "It is 5%.", 7), (None, "It is 5%.", 7)], "id long, content string, start int")
    rows = claims.claim_spans(df, "id").collect()
    assert [r["id"] for r in rows].count(1) == 30_000 and {r["claim"] for r in rows} == {"5 ms", "5%"}
    assert sum(r["id"] is None for r in rows) == 2
    assert all(text[r["start"] : r["end"]] == r["claim"] for r in rows if r["id"] == 1)
    assert claims.claim_spans(df.where("id > 9"), "id").collect() == []
