"""Texts and JSON in one form: equal contents get equal strings, and so equal digests.

What built-in functions lack runs on Arrow batches: Unicode normalisation, and JSON of any nesting with its keys in order.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def folded_text(text: str) -> str:
    """NFKC, white space collapsed and trimmed, lower case."""
    return " ".join(unicodedata.normalize("NFKC", text).split()).lower()


def _number(x: float) -> str:
    """The shortest text of a double: whole numbers without a point, exponents without zeros in front."""
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, power = repr(x).partition("e")
    return f"{digits.removesuffix('.0')}e{'-' if power[0] == '-' else '+'}{power.lstrip('+-0')}" if power else digits


def canonical_text(text: str) -> str | None:
    """JSON without spaces, keys of every object in code point order, strings in NFC, numbers in their shortest form; None
    for what is no JSON, has a key twice, or holds a number that no double can."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        out = {unicodedata.normalize("NFC", k): v for k, v in items}
        if len(out) < len(items):
            raise ValueError("a key twice")
        return out

    def put(v: object) -> str:
        if isinstance(v, dict):
            return "{" + ",".join(f"{put(k)}:{put(v[k])}" for k in sorted(v)) + "}"
        if isinstance(v, list):
            return "[" + ",".join(map(put, v)) + "]"
        if isinstance(v, float):
            return _number(v)
        return json.dumps(unicodedata.normalize("NFC", v) if isinstance(v, str) else v, ensure_ascii=False)

    def refuse(_: str):
        raise ValueError("no JSON number")

    try:
        return put(json.loads(text, object_pairs_hook=pairs, parse_constant=refuse))
    except (ValueError, OverflowError, RecursionError):
        return None


def folded(text: Column) -> Column:
    """Names and keys as they are compared; null stays null."""

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(folded_text, na_action="ignore")

    return fold(text)


def canonical_json(text: Column) -> Column:
    """The canonical form of JSON texts; null for null and for what isn't JSON (see canonical_text)."""

    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        return s.map(canonical_text, na_action="ignore")

    return canonical(text)


def canonical_hash(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)
