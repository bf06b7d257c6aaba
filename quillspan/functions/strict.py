"""Strict reading of JSON text: an object that names a key twice says two things, and is taken for no object.

Spark's VARIANT refuses a text with a repeated key at any depth, and takes one that goes on after its value. A scan of the
tokens keeps the place of a fault: each object with a repeated key, or with too many keys, becomes null, and what stands
around it can still be read; a text that is not exactly one value is none.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Bytes of a text and keys of an object beyond which it is not read.
MOST_BYTES, MOST_KEYS = 8 << 20, 4096


def _no_number(name: str):
    raise ValueError(name)


def strict_json(text: str | None) -> tuple[str | None, bool | None]:
    """The text with null for each object that repeats a key, and whether there is one; None where it is not one JSON value."""
    if not isinstance(text, str) or len(text.encode("utf-8", "surrogatepass")) > MOST_BYTES:
        return None, None
    faults = []

    def read_object(pairs: list[tuple]) -> dict | None:
        found = dict(pairs)
        if len(found) == len(pairs) <= MOST_KEYS:
            return found
        faults.append(len(pairs))
        return None

    try:
        return json.dumps(json.loads(text, object_pairs_hook=read_object, parse_constant=_no_number)), bool(faults)
    except (ValueError, RecursionError):
        return None, None


def _scanned(text: Column) -> Column:
    @pandas_udf("struct<json:string,repeated:boolean>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = [strict_json(t) for t in texts]
        return pd.DataFrame({"json": pd.Series([j for j, _ in rows], dtype=object), "repeated": pd.Series([r for _, r in rows], dtype=object)})

    return scan(text)


def strict_variant(text: Column) -> Column:
    """A JSON text as VARIANT, objects with repeated keys as null; null for what is no JSON."""
    return F.try_parse_json(_scanned(text)["json"])


def repeated_fields(text: Column) -> Column:
    """Whether a JSON text repeats a key somewhere; null for what is no JSON."""
    return _scanned(text)["repeated"]


def field_names(text: str | None, name: str) -> list[list[str] | None] | None:
    """The field names of each object in a text's list of a name, however long the text is; None for an entry that is no object
    or repeats a name, and None where the text is not one JSON object with such a list."""

    def read_object(pairs: list[tuple]) -> dict | None:
        found = dict(pairs)
        return found if len(found) == len(pairs) else None

    def finite(number: str) -> float:
        if abs(value := float(number)) == float("inf"):
            raise ValueError(number)
        return value

    try:
        whole = json.loads(text, object_pairs_hook=read_object, parse_constant=_no_number, parse_float=finite) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None
    entries = whole.get(name) if isinstance(whole, dict) else None
    return [list(e) if isinstance(e, dict) else None for e in entries] if isinstance(entries, list) else None


def listed_fields(text: Column, name: str) -> Column:
    """field_names() of a JSON text's list of a name."""

    @pandas_udf("array<array<string>>")
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([field_names(t, name) for t in texts], dtype=object)

    return scan(text)
