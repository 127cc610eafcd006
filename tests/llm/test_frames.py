import hashlib
import random
import re

import duckdb
import zstandard

from palimpsest.llm import frames

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
ODD = ["", None, "a", "abc", "é", "<P>", "x<S>y", "a < P>b<M", "<" * 9, "ab" * 50, "𝄞" * 40, "\x00\n\t", "z" * 300 + " " + "y" * 300 + "é", "<S", "S>M>P>"]


def texts(rng, n):
    return [*ODD, *("".join(rng.choice(["word", "Ab", " ", "é", "1", "\n", "<", ">", "S>", "<M", "𝄞"]) for _ in range(rng.randint(0, 60))) for _ in range(n))]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(c in text for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h[3] % 100 < 20 else "psm", len(p), len(m), out, text


def test_small_frames_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, t, "x", False) for i, t in enumerate(texts(rng, 200))] + [(None, "no id here", "x", True), (3, "abc", "x", True), (3, "abc", "x", True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, frames string, n boolean").repartition(5)
    want = sorted(((r[0] if r[0] is not None else -1, *brute(r[0], r[1])) for r in rows), key=repr)
    for size in (4, 7, 64, frames.FRAME_BYTES):
        made = frames.fill_in_middle(frames.frame_store(docs, size))
        opened = zstandard.ZstdDecompressor()
        got = []
        for r in made.collect():
            out = b"".join(opened.decompress(f) for f in r["frames"]).decode()
            back = b"".join(frames.restored([bytes(f) for f in r["frames"]], r["form"])).decode()
            got.append((r["doc_id"] if r["doc_id"] is not None else -1, r["n"], r["form"], r["prefix_chars"], r["middle_chars"], out, back))
        assert sorted(got, key=repr) == want
        digests = frames.fim_digests(made).collect()
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert sorted((r["output_sha256"], r["restored_sha256"]) for r in digests) == sorted((sha(w[5]), sha(w[6])) for w in want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_a_cut_opens_its_frame_only(spark):
    text = "".join(f"word{i} " for i in range(40_000))
    store = frames.frame_store(spark.createDataFrame([(1, text)], "doc_id long, text string"), 4096)
    row = store.collect()[0].asDict(recursive=True)
    assert len(row["frames"]) > 80 and row["n_chars"] == len(text) and row["n"] == len(UNIT.findall(text))
    for i, f in enumerate(row["frames"]):
        if i != 50:
            f["data"] = b"not a frame"
    unit = row["frames"][50]["units_before"] + 10
    k, at = frames.Frames(row["frames"]).cut(unit)
    before = sum(f["chars"] for f in row["frames"][:50])
    assert k == 50 and len("".join(UNIT.findall(text)[:unit])) == before + at


def test_control_strings_over_borders():
    data = b"<P>aa<<S>b<S<M>c"
    for size in range(1, 8):
        pieces = (data[i : i + size] for i in range(0, len(data), size))
        assert frames.control_places(pieces, (b"<P>", b"<S>", b"<M>")) == [0, 6, 12]


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = frames.op12_fill_in_middle(spark, folder)
    order = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert got.columns == order
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(f"SELECT {', '.join(order)} FROM ({frames.OP12_SQL})").fetchall(), key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert frames.fim_digests(frames.fill_in_middle(frames.frame_store(docs))).count() == 0
