"""Canonical JSON and its hashes: NFC strings, keys in order, no white space, no numbers that are not finite."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal(value: object) -> object:
    """Strings in NFC; two keys that become one are an error, as is a number without end."""
    if isinstance(value, str):
        return unicodedata.normalize("NFC", value)
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a number that is not finite")
    if isinstance(value, dict):
        out: dict[str, object] = {}
        for k, v in value.items():
            key = unicodedata.normalize("NFC", k)
            if key in out:
                raise ValueError(f"key {key!r} twice")
            out[key] = normal(v)
        return out
    return [normal(v) for v in value] if isinstance(value, list | tuple) else value


def canonical(value: object) -> str:
    return json.dumps(normal(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def canonical_hash(value: object, without: str | None = None) -> str:
    """SHA-256 of the canonical text, of an object without its own hash field if named."""
    if without is not None:
        value = {k: v for k, v in value.items() if k != without}
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def canonical_lines(values: list[object]) -> str:
    return "\n".join(map(canonical, values))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null for null and for texts that are none."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else canonical(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)
