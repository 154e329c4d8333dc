"""Redaction of payloads. Their nesting has no bound, so this is a Pandas UDF over JSON text."""

from __future__ import annotations

import hashlib
import json
import re
from uuid import UUID

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SENSITIVE_KEY = re.compile(r"token|secret|authorization|cookie|password|key|jwt|bearer|session|credential", re.IGNORECASE)
PEM = re.compile(r"-----BEGIN[\s\S]*?-----END[\s\S]*?-----")


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _is_uuid(text: str) -> bool:
    try:
        UUID(text)
    except ValueError:
        return False
    return True


def redacted(value):
    """A JSON value without what looks secret: values under telling keys, PEM blocks, UUIDs, and
    texts of 24 characters or more that are mostly different ones."""
    todo: list = []

    def taken(x):
        if isinstance(x, (dict, list)):
            copy = type(x)()
            todo.append((x, copy))
            return copy
        if not isinstance(x, str):
            return x
        text = PEM.sub("<redacted_pem>", x)
        if _is_uuid(text):
            return "<uuid>"
        return f"<redacted_entropy_sha256:{_digest(text)}>" if len(text) >= 24 and len(set(text)) / len(text) > 0.65 else text

    out = taken(value)
    while todo:  # a list of its own in place of recursion: nesting may be deep
        source, copy = todo.pop()
        if isinstance(source, list):
            copy.extend(taken(x) for x in source)
            continue
        for key, x in source.items():
            if SENSITIVE_KEY.search(key):
                copy[key] = f"<redacted_sha256:{_digest(x)}>" if isinstance(x, str) else "<redacted>"
            else:
                copy[key] = taken(x)
    return out


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=True)


@F.pandas_udf(StringType())
def _redact(payloads: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        try:
            return canonical(redacted(json.loads(text)))
        except (ValueError, RecursionError):
            return "{}"

    return payloads.map(one)


def redact(payload: Column) -> Column:
    """A JSON payload redacted, in canonical form; null stays null, text that is no JSON gives {}."""
    return _redact(payload)
