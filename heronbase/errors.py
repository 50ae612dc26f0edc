"""Errors with their SQLSTATE."""

from __future__ import annotations


class EngineError(Exception):
    code, state = "000603", "HY000"


class SqlSyntaxError(EngineError):
    code, state = "001003", "42000"


class NotFound(EngineError):
    code, state = "002003", "02000"


class AlreadyExists(EngineError):
    code, state = "002002", "42710"


class InvalidValue(EngineError):
    code, state = "001007", "22023"


class DuplicateMatch(EngineError):
    """A MERGE that would change one target row more than once."""

    code, state = "100090", "42P18"


class Conflict(EngineError):
    code, state = "000625", "40001"


class SessionError(EngineError):
    code, state = "390104", "08001"


class Canceled(EngineError):
    code, state = "000604", "57014"


def wrap(error: Exception) -> EngineError:
    """Spark's errors as ours."""
    if isinstance(error, EngineError):
        return error
    kind, text = type(error).__name__, str(error).split("\n")[0]
    if kind == "ParseException":
        return SqlSyntaxError(text)
    if "TABLE_OR_VIEW_NOT_FOUND" in text or "SCHEMA_NOT_FOUND" in text or "UNRESOLVED_COLUMN" in text or "REQUIRES_SINGLE_PART_NAMESPACE" in text:
        return NotFound(text)
    return EngineError(text)
