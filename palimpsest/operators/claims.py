"""Claims in a draft: spans of several families in one pass over the text, and which of them keep their characters.

Families, by what they look at: quotes of three words or more, codes, numbers with their unit, and whole sentences that
count (collection), say what something is (copula) or state something else (clause). A span goes if it overlaps one of a
family that is more decisive about the same characters: see LOSES. Spans of one family never overlap.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Units, and words by which sentences count, say what is, or take it back.
UNITS = "USD EUR GBP ms second seconds minute minutes hour hours unit units".split()
COUNTING = ["there were", "there are", "exactly"]
COUNTING_WITH_NUMBER = ["all", "i found"]
COPULAS = "is are was were live lives lived owner owned called named".split()
HEDGES = ["i would", "i could", "i should", "let us", "let's", "perhaps", "maybe"]
# Verbs of other statements, our own choice.
STATING = "has have had works worked moved owns uses used costs needs runs started ended".split()

QUOTE = '"[^"]+"'
CODE = r"\b[A-Za-z]+-[0-9]+\b"
NUMBER = r"\b[0-9]+(?:[.,][0-9]+)*(?: ?%| ?(?:" + "|".join(UNITS) + r")\b|\b)"
SENTENCE = r"[^.!?\n]+[.!?]?"
COLLECTION_CUE = r"\b(?:" + "|".join(COUNTING + [f"{w} [0-9]+" for w in COUNTING_WITH_NUMBER]) + r")\b"
COPULA_CUE = r"\b(?:" + "|".join(COPULAS) + r")\b"
CLAUSE_CUE = r"\b(?:" + "|".join(STATING) + r")\b"
HEDGE = r"^(?:" + "|".join(HEDGES) + r")\b"
# Which families a family gives way to where they overlap.
LOSES = {"number": ("collection", "code"), "copula": ("collection", "code", "number", "quote"), "clause": ("collection", "copula")}

_BLANK = " \t\r\f\n"
_quote, _code, _number, _sentence = (re.compile(p, re.ASCII) for p in (QUOTE, CODE, NUMBER, SENTENCE))
_collection, _copula, _clause, _hedge = (re.compile(p, re.ASCII) for p in (COLLECTION_CUE, COPULA_CUE, CLAUSE_CUE, HEDGE))


def _lower(text: str) -> str:
    """A-Z only, so that places stay."""
    return text.translate({c: c + 32 for c in range(65, 91)})


def _met(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of these sorted, disjoint spans overlaps [start, end)."""
    i = bisect_right(spans, (start, 1 << 62))
    return (i > 0 and spans[i - 1][1] > start) or (i < len(spans) and spans[i][0] < end)


def scan(text: str) -> list[tuple[str, int, int]]:
    """(family, start, end) in code points, by start."""
    found: dict[str, list[tuple[int, int]]] = {
        "quote": [m.span() for m in _quote.finditer(text) if len(m[0][1:-1].split()) >= 3],
        "code": [m.span() for m in _code.finditer(text)],
        "number": [m.span() for m in _number.finditer(text)],
        "collection": [], "copula": [], "clause": [],
    }
    for m in _sentence.finditer(text):
        raw = m[0]
        body = raw.strip(_BLANK)
        if not body:
            continue
        start = m.start() + len(raw) - len(raw.lstrip(_BLANK))
        low, span = _lower(body), (start, start + len(body))
        for family, cue in (("collection", _collection), ("copula", _copula)):
            if cue.search(low):
                found[family].append(span)
        if body[-1] != "?" and _clause.search(low) and not _hedge.search(low):
            found["clause"].append(span)
    kept = [(f, a, b) for f, spans in found.items() for a, b in spans if not any(_met(found[g], a, b) for g in LOSES.get(f, ()))]
    return sorted(kept, key=lambda x: (x[1], x[2], x[0]))


def claim_spans(drafts: DataFrame, key: str, text: str = "content") -> DataFrame:
    """(key, family, start, end, claim): one row per claim. Null and empty texts have none; repeated rows repeat theirs;
    other columns are ignored. A text's claims are told where it stands, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = scan(t) if t else []
                for at in range(0, len(rows), 65_536):
                    part = rows[at : at + 65_536]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(part), k.type), pa.array([r[0] for r in part], pa.string()), pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()), pa.array([t[r[1] : r[2]] for r in part], pa.string())], [key, "family", "start", "end", "claim"])

    rows = drafts.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, family string, start long, end long, claim string")


def claims_sql(source: str, key: str, text: str) -> str:
    """CTEs from `source` to `claims`: (key, family, start, end_, claim)."""
    raw = lambda family, pattern: f"""SELECT k, '{family}' AS family, CAST(sum(gap) OVER w + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, m FROM (SELECT k, i, length(parts[i]) AS gap, ms[i] AS m FROM (SELECT k, parts, ms, unnest(generate_series(1, len(ms))) AS i FROM (SELECT k, regexp_split_to_array(t, '{pattern}') AS parts, regexp_extract_all(t, '{pattern}') AS ms FROM src))) WINDOW w AS (PARTITION BY k ORDER BY i)"""
    cue = lambda c: "regexp_matches(low, '" + c.replace("'", "''") + "')"
    lead = "'^[ \\t\\r\\f\\n]+'"
    loses = " OR ".join(f"(a.family = '{f}' AND b.family IN ({', '.join(repr(g) for g in gs)}))" for f, gs in LOSES.items())
    sentence = SENTENCE.replace("\\n", "\n")
    return f"""src AS (SELECT {key} AS k, {text} AS t FROM {source} WHERE {text} <> ''),
words AS ({raw('quote', QUOTE)} UNION ALL {raw('code', CODE)} UNION ALL {raw('number', NUMBER)}),
sent0 AS ({raw('sentence', sentence)}),
sent AS (SELECT k, start + length(m) - length(regexp_replace(m, {lead}, '')) AS start, regexp_replace(regexp_replace(m, {lead}, ''), '[ \\t\\r\\f\\n]+$', '') AS m FROM sent0),
low AS (SELECT *, translate(m, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM sent WHERE m <> ''),
span AS (SELECT k, family, start, start + length(m) AS end_, m FROM words WHERE family <> 'quote' OR len(list_filter(regexp_split_to_array(m[2:-2], '\\s+'), lambda w: w <> '')) >= 3
  UNION ALL SELECT k, 'collection', start, start + length(m), m FROM low WHERE {cue(COLLECTION_CUE)}
  UNION ALL SELECT k, 'copula', start, start + length(m), m FROM low WHERE {cue(COPULA_CUE)}
  UNION ALL SELECT k, 'clause', start, start + length(m), m FROM low WHERE m[-1] <> '?' AND {cue(CLAUSE_CUE)} AND NOT {cue(HEDGE)}),
claims AS (SELECT k AS {key}, family, start, end_, m AS claim FROM span a WHERE NOT EXISTS (SELECT 1 FROM span b WHERE b.k = a.k AND b.start < a.end_ AND a.start < b.end_ AND ({loses})))"""
