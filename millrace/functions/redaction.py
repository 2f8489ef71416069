"""Secrets taken out of nested values and free text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What names of secrets hold, and what takes a secret's place.
SECRET_NAMES = ["secret", "password", "passwd", "token", "api-key", "api_key", "apikey", "authorization", "auth", "cookie", "session", "credential", "dsn", "private"]
REDACTED, TOO_DEEP = "***redacted***", "<max-depth>"
#: Levels below the outermost value that are looked at.
DEPTH = 6

_NAME = re.compile("|".join(map(re.escape, SECRET_NAMES)), re.I)
_PAIR = re.compile(rf"((?:{_NAME.pattern})[\w-]*\s*[=:]\s*)[^\s,;&]+", re.I)
_BEARER = re.compile(r"\b(bearer|basic)\s+[\w.~+/=-]{8,}", re.I)


def without_secrets(value, depth: int = 0):
    """A nested value without the values of secret names; texts lose what follows such a name or a bearer mark."""
    if depth > DEPTH:
        return TOO_DEEP
    if isinstance(value, dict):
        return {k: REDACTED if _NAME.search(k) else without_secrets(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [without_secrets(v, depth + 1) for v in value]
    if isinstance(value, str) and len(value) >= 6:
        return _BEARER.sub(lambda m: f"{m[1]} {REDACTED}", _PAIR.sub(lambda m: m[1] + REDACTED, value))
    return value


def _one(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(without_secrets(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, RecursionError):
        return without_secrets(text)


@F.pandas_udf(StringType())
def redacted(column: pd.Series) -> pd.Series:
    """JSON texts with secrets redacted at every level, as compact JSON; what is no JSON is taken as free text. Null stays null."""
    return column.map(_one)
