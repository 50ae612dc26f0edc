"""Positional parameters as typed values."""

from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

from heronbase.errors import InvalidValue

_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_TIME = re.compile(r"\d{2}:\d{2}:\d{2}(\.\d{1,9})?")
_STAMP = re.compile(r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?( ?([+-]\d{2}:?\d{2}|Z))?")
_WHOLE = re.compile(r"[+-]?\d+")


def value(kind: str, text: object) -> object:
    """A binding ``{"type": kind, "value": text}`` as a Python value that Spark types."""
    kind = (kind or "TEXT").upper()
    if text is None or kind == "NULL":
        return None
    text = str(text)
    if kind in ("FIXED", "INTEGER", "INT", "BIGINT", "SMALLINT", "TINYINT", "NUMBER"):
        if not _WHOLE.fullmatch(text):
            if kind in ("FIXED", "NUMBER") and re.fullmatch(r"[+-]?\d*\.\d+", text):
                return Decimal(text)
            raise InvalidValue(f"no whole number: {text!r}")
        return int(text)
    if kind in ("REAL", "FLOAT", "DOUBLE"):
        try:
            return float(text)
        except ValueError as e:
            raise InvalidValue(f"no number: {text!r}") from e
    if kind == "BOOLEAN":
        return text.lower() in ("true", "1")
    try:
        if kind == "DATE":
            if not _DATE.fullmatch(text):
                raise ValueError
            return dt.date.fromisoformat(text)
        if kind == "TIME":
            if not _TIME.fullmatch(text):
                raise ValueError
            return dt.time.fromisoformat(text[:15])
        if kind.startswith("TIMESTAMP") or kind == "DATETIME":
            if not _STAMP.fullmatch(text):
                raise ValueError
            return dt.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text).replace(" +", "+").replace(" -", "-") if text.count(" ") > 1 else re.sub(r"(\.\d{6})\d+", r"\1", text))
    except ValueError as e:
        raise InvalidValue(f"no {kind}: {text!r}") from e
    return text


def arguments(bindings: dict | list | None) -> dict[str, object]:
    """Arguments ``p1, p2, ...`` from bindings by number or a plain list."""
    if not bindings:
        return {}
    if isinstance(bindings, (list, tuple)):
        bindings = {str(i): v for i, v in enumerate(bindings, 1)}
    out = {}
    for k, v in bindings.items():
        if not str(k).isdigit():
            raise InvalidValue(f"bindings go by number: {k!r}")
        out[f"p{k}"] = value(v.get("type", "TEXT"), v.get("value")) if isinstance(v, dict) else v
    return out
