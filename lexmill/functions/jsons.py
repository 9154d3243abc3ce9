"""JSON texts with their strings hashed."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _hashed(value):
    """The value with strings hashed, and whether any was; a key whose value changed says so in its name, and one that says so already stays."""
    if isinstance(value, str):
        return hashlib.sha256(value.encode()).hexdigest(), True
    if isinstance(value, list):
        parts = [_hashed(v) for v in value]
        return [v for v, _ in parts], any(c for _, c in parts)
    if isinstance(value, dict):
        out, changed = {}, False
        for k, v in value.items():
            new, different = (v, True) if k.endswith("_hash") else _hashed(v)
            out[k if k.endswith("_hash") or not different else f"{k}_hash"] = new
            changed |= different
        return out, changed
    return value, False


def anonymised_text(text: str | None) -> str | None:
    if text is None:
        return None
    return json.dumps(_hashed(json.loads(text))[0], ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(StringType())
def anonymised(texts: pd.Series) -> pd.Series:
    """A JSON text whose strings are their SHA-256; the tree has no fixed schema, so it is walked in Python. Null stays null."""
    return texts.map(anonymised_text)
