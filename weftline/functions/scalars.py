"""Scalar helpers: time windows, hashes, signatures."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86_400
# Seconds of the units of look-back windows and of durations ('m' is a month of 30 days in
# the first, a minute in the second).
WINDOW_UNITS = {"d": DAY, "w": 7 * DAY, "m": 30 * DAY, "y": 365 * DAY}
SINCE_UNITS = {"d": DAY, "h": 3600, "m": 60, "s": 1}


def window_seconds(text: str) -> int:
    """Of '30d', '4w', '6m', '1y'."""
    found = re.fullmatch(r"\s*(\d+)\s*([dwmy])\s*", text)
    if not found:
        raise ValueError(f"not a window: {text!r}")
    return int(found[1]) * WINDOW_UNITS[found[2]]


def since_seconds(text: str) -> int:
    """Of '2h30m', '1d', '45s'."""
    parts = re.findall(r"(\d+)\s*([dhms])", text)
    if not parts or re.sub(r"\d+\s*[dhms]", "", text).strip():
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * SINCE_UNITS[u] for n, u in parts)


def extension(path: Column) -> Column:
    """After the last dot of the last path segment; '' if there is none."""
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def context_hash(flags: Column) -> Column:
    """SHA-256 of sorted flags."""
    return F.sha2(F.to_json(F.struct(F.array_sort(flags).alias("flags"))), 256)


def hmac_sha256(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 as hex, from two native SHA-256 rounds (RFC 2104)."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in block)), text.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in block)), F.unhex(inner)), 256)


def hmac_reference(text: str, key: bytes) -> str:
    return hmac.new(key, text.encode(), hashlib.sha256).hexdigest()


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """A unified diff of two texts; null counts as empty."""
    import difflib

    return pd.Series(["\n".join(difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), lineterm="", n=3)) for a, b in zip(old, new, strict=True)])
