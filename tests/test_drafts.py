import random

import duckdb
import pandas as pd

from palimpsest.operators import atomize

# what the two engines' patterns and lower cases take for words, spaces, ends and letters of either case
ODD = ["ñ", "é", "ſ", "K", "İ", "ı", "Σ", "\x0b", " ", "\x85", " ", "’", "—", "_", "ó", "\r", "\t", "."]
TEXTS = [
    "Noñu boosque los cillos.", "Decision:élan vital", "Actually\x0bthe sky is blue", "Todo call", "The İstanbul port is 5 units", "Kall me Ada", "Alwayſ use tabs",
    "We decided to ship.  ", "İt moved to Graz", "It is not a\x0bb, but c ", "The ΟΔΟΣ price is 7.\x85", "Correction—Ada works at Graz", "Never deploy. Sorry_no", "No.", "no ó", "Noó: x is 5",
]


def test_drafts_equal_sql_on_odd_characters(spark):
    rng = random.Random(5)
    cues = [c for r in atomize.RULES for c in r.cues] + [*atomize.CORRECTING, *atomize.COPULAS]
    words = ["Ada", "Vera Lind", "Graz", "tabs", "5", "for", "it", "a, b", "but", "the", ": "]
    mixed = ["".join(rng.choice([rng.choice(cues).capitalize(), rng.choice(words), rng.choice(ODD)]) + rng.choice(["", " ", " "]) for _ in range(rng.randint(2, 9))) for _ in range(1500)]
    rows = [(1, i, "assistant" if i % 5 == 0 else "user", t) for i, t in enumerate(TEXTS + mixed)]
    got = atomize.drafts(spark.createDataFrame(rows, "thread_id long, seq long, role string, content string")).toPandas()
    talk = pd.DataFrame(rows, columns=["thread_id", "seq", "role", "content"])  # noqa: F841  read by name
    want = duckdb.sql(f"WITH {atomize.drafts_sql('talk')} SELECT * FROM draft").df()
    plain = lambda t: sorted(tuple("" if pd.isna(v) else str(v) for v in r) for r in t[sorted(got.columns)].itertuples(index=False, name=None))
    assert len(got) > 300
    assert plain(got) == plain(want)
