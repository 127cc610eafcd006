"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980, with the author's later changes), for distinct words.

A word is a sequence of consonants and vowels (a y behind a consonant is a vowel); its measure is the number of vowel runs
that a consonant run follows. Suffixes go in five steps, each only if what is left has the measure that the step asks for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The suffixes of steps 2, 3 and 4 and what stands for them.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def shape(word: str) -> str:
    """c or v for each letter."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    return len(re.findall("v+c", shape(word)))


def _longest(word: str, suffixes) -> str | None:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s) and len(word) > len(s)), None)


def _short_end(word: str) -> bool:
    """Ends consonant, vowel, consonant, and the last isn't w, x or y."""
    return shape(word).endswith("cvc") and word[-1] not in "wxy"


def _plural(w: str) -> str:
    if w.endswith(("sses", "ies")) and len(w) > 3:
        return w[:-2]
    return w[:-1] if re.search("[^s]s$", w) else w


def _past(w: str) -> str:
    if w.endswith("eed") and len(w) > 3:
        return w[:-1] if measure(w[:-3]) > 0 else w
    end = next((e for e in ("ed", "ing") if w.endswith(e) and "v" in shape(w[: -len(e)])), None)
    if not end:
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and shape(w)[-1] == "c" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if measure(w) == 1 and _short_end(w) else w


def stem(word: str) -> str:
    """The stem of a lower-cased word; words of fewer than three letters are their own."""
    if len(word) < 3:
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (SECOND, THIRD):
        end = _longest(w, table)
        if end and measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = _longest(w, FOURTH)
    if end and measure(w[: -len(end)]) > 1 and (end != "ion" or w[-4] in "st"):
        w = w[: -len(end)]
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


def stems_of(words: DataFrame) -> DataFrame:
    """(term, stem) for each distinct term of `words`: no word is stemmed twice, however often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([stem(w) for w in batch.column(0).to_pylist()], pa.string())], ["term", "stem"])

    return words.where("term is not null").select("term").distinct().mapInArrow(run, "term string, stem string")


def stems_sql(source: str) -> str:
    """The same as common table expressions, from `source` (term) to `stems` (term, stem), by patterns instead of shapes."""
    c, v = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
    m0, m1, one, vowel = f"^({c})?{v}{c}", f"^({c})?{v}{c}{v}{c}", f"^({c})?{v}{c}({v})?$", f"^({c})?[aeiouy]"
    short = f"^{c}[aeiouy][^aeiouwxy]$"
    cut = lambda n: f"left(w, length(w) - {n})"

    def table(suffixes: dict[str, str], pattern: str) -> str:
        cases = " ".join(f"WHEN w LIKE '_%{s}' THEN CASE WHEN regexp_matches({cut(len(s))}, '{pattern}'){' AND substr(w, length(w) - 3, 1) IN (chr(115), chr(116))' if s == 'ion' else ''} THEN {cut(len(s))} || '{to}' ELSE w END" for s, to in sorted(suffixes.items(), key=lambda x: -len(x[0])))
        return f"CASE {cases} ELSE w END"

    ended = f"CASE WHEN w LIKE '%ed' AND regexp_matches({cut(2)}, '{vowel}') THEN {cut(2)} WHEN w LIKE '%ing' AND regexp_matches({cut(3)}, '{vowel}') THEN {cut(3)} END"
    return f"""st0 AS (SELECT term, CASE WHEN term LIKE 'y%' THEN 'Y' || substr(term, 2) ELSE term END AS w FROM (SELECT DISTINCT term FROM {source}) WHERE length(term) >= 3),
st1 AS (SELECT term, CASE WHEN w LIKE '%sses' OR w LIKE '_%ies' THEN {cut(2)} WHEN regexp_matches(w, '[^s]s$') THEN {cut(1)} ELSE w END AS w FROM st0),
st2 AS (SELECT term, w, CASE WHEN w NOT LIKE '_%eed' THEN {ended} END AS e FROM st1),
st3 AS (SELECT term, CASE WHEN w LIKE '_%eed' THEN CASE WHEN regexp_matches({cut(3)}, '{m0}') THEN {cut(1)} ELSE w END WHEN e IS NULL THEN w
  WHEN regexp_matches(e, '(at|bl|iz)$') THEN e || 'e' WHEN length(e) > 1 AND right(e, 1) = substr(e, length(e) - 1, 1) AND regexp_matches(e, '[^aeiouylsz]$') THEN left(e, length(e) - 1) WHEN regexp_matches(e, '{short}') THEN e || 'e' ELSE e END AS w FROM st2),
st4 AS (SELECT term, CASE WHEN w LIKE '%y' AND regexp_matches({cut(1)}, '{vowel}') THEN {cut(1)} || 'i' ELSE w END AS w FROM st3),
st5 AS (SELECT term, {table(SECOND, m0)} AS w FROM st4), st6 AS (SELECT term, {table(THIRD, m0)} AS w FROM st5), st7 AS (SELECT term, {table(dict.fromkeys(FOURTH, ''), m1)} AS w FROM st6),
st8 AS (SELECT term, CASE WHEN w LIKE '%e' AND (regexp_matches({cut(1)}, '{m1}') OR (regexp_matches({cut(1)}, '{one}') AND NOT regexp_matches({cut(1)}, '{short}'))) THEN {cut(1)} ELSE w END AS w FROM st7),
stems AS (SELECT term, replace(CASE WHEN w LIKE '%ll' AND regexp_matches(w, '{m1}') THEN {cut(1)} ELSE w END, 'Y', 'y') AS stem FROM st8 UNION ALL SELECT DISTINCT term, term FROM {source} WHERE length(term) < 3)"""
