"""Hashes and canonical serialisation that the JVM functions do not cover."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36_sha1(data: bytes) -> str:
    """SHA-1 in base 36, 31 characters."""
    n, out = int.from_bytes(hashlib.sha1(data).digest(), "big"), ""
    while n:
        n, r = divmod(n, 36)
        out = _DIGITS[r] + out
    return out.rjust(31, "0")


def sha1_base36(text: Column | str) -> Column:
    def make(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else base36_sha1(v.encode()))

    return F.pandas_udf(make, "string")(text)


def commitment(key: bytes, domain: str, payload: bytes) -> str:
    """P19 for one value: HMAC-SHA256 over a domain, a null byte and the payload, in hex digits."""
    if len(key) != 32:
        raise ValueError("a commitment key has 32 bytes")
    return hmac.new(key, domain.encode() + b"\0" + payload, hashlib.sha256).hexdigest()


def keyed_commitment(text: Column | str, key: bytes, domain: str) -> Column:
    """HMAC-SHA256 over a domain, a null byte and the text; the key has 32 bytes."""
    if len(key) != 32:
        raise ValueError("a commitment key has 32 bytes")

    def make(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(key, domain.encode() + b"\0" + v.encode(), hashlib.sha256).hexdigest())

    return F.pandas_udf(make, "string")(text)


def canonical_json(value: object) -> bytes:
    """K1: sorted keys, no spaces, no escaping beyond JSON's own, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def self_hash(value: dict, field: str) -> str:
    """Hash of an object without its own hash field."""
    return hashlib.sha256(canonical_json({k: v for k, v in value.items() if k != field})).hexdigest()


def self_hash_valid(body: Column | str, field: str) -> Column:
    """Whether a JSON text states its own hash rightly; null for text that is no object."""

    def check(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                o = json.loads(v) if v is not None else None
                out.append(self_hash(o, field) == o.get(field) if isinstance(o, dict) else None)
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype="object")

    return F.pandas_udf(check, "boolean")(body)
