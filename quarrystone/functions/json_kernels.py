"""Canonical JSON of any text, where expressions don't reach: an Arrow-batched UDF over the standard library's parser."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed value: the largest integer that every reader of JSON can hold.
SAFE_INTEGER = (1 << 53) - 1


class _Fraction:
    """A number that was written with a fraction or an exponent, or as a constant that isn't JSON."""

    def __init__(self, _: str):
        pass


class _BadKey(dict):
    """Stands in the order of checks for a key that isn't ASCII."""


def _integer(digits: str) -> int:
    return int(digits) if len(digits) <= 20 else (-1 if digits[0] == "-" else 1) << 64  # out of range either way


def problem(value) -> tuple[str, str] | None:
    """What keeps a parsed value from a canonical form, the first in the order of the text, and where; None if nothing does."""
    stack = [(value, "$")]
    while stack:
        v, path = stack.pop()
        if isinstance(v, _Fraction):
            return "fraction", path
        if isinstance(v, str):
            if any("\ud800" <= c <= "\udfff" for c in v):
                return "surrogate", path
            if not unicodedata.is_normalized("NFC", v):
                return "not composed", path
        elif isinstance(v, bool) or v is None:
            continue
        elif isinstance(v, int):
            if abs(v) > SAFE_INTEGER:
                return "integer range", path
        elif isinstance(v, list):
            stack.extend((x, f"{path}[{i}]") for i, x in reversed(list(enumerate(v))))
        elif (bad := next((n for n, k in enumerate(v) if not k.isascii()), None)) is None:
            stack.extend((x, f"{path}.{k}") for k, x in reversed(v.items()))
        else:  # what stands before the key counts first
            stack.append((_BadKey(), path))
            stack.extend((x, f"{path}.{k}") for k, x in reversed(list(v.items())[:bad]))
        if isinstance(v, _BadKey):
            return "key", path
    return None


def canonical_of(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(canonical text, problem, path): keys in order at every level, no spaces; of repeated keys the last value counts."""
    if text is None:
        return None, None, None
    try:
        value = json.loads(text, parse_float=_Fraction, parse_constant=_Fraction, parse_int=_integer)
        found = problem(value)
        return (None, *found) if found else (json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")), None, None)
    except RecursionError:
        return None, "too deep", "$"
    except ValueError:
        return None, "not JSON", "$"


@F.pandas_udf(StructType([StructField(name, StringType()) for name in ("canonical", "problem", "path")]))
def canonical(texts: pd.Series) -> pd.DataFrame:
    """Canonical JSON of each text, or why it has none and where; nulls of a null."""
    return pd.DataFrame([canonical_of(t) for t in texts], columns=["canonical", "problem", "path"])
