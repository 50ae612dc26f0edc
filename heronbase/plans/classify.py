"""What kind of statement a text is."""

from __future__ import annotations

from dataclasses import dataclass

from heronbase.lexer import tokens

SELECT, DML, CREATE, DROP = 1, 3, 4, 5


@dataclass(frozen=True)
class Statement:
    kind: str
    type_id: int
    is_query: bool = False
    is_ddl: bool = False
    is_dml: bool = False


QUERY = Statement("query", SELECT, is_query=True)
OTHER = Statement("dml", DML, is_dml=True)
_BY_WORD = {
    **dict.fromkeys(("SELECT", "SHOW", "DESCRIBE", "DESC", "EXPLAIN", "WITH", "VALUES", "TABLE", "LIST", "LS"), QUERY),
    "CREATE": Statement("create", CREATE, is_ddl=True),
    "DROP": Statement("drop", DROP, is_ddl=True),
    "ALTER": Statement("alter", CREATE, is_ddl=True),
    "COPY": Statement("copy", DML, is_dml=True),
    "MERGE": Statement("merge", DML, is_dml=True),
    **dict.fromkeys(("BEGIN", "START", "COMMIT", "ROLLBACK"), Statement("transaction", DML)),
}


def classify(sql: str) -> Statement:
    """By the first word, past comments and opening parentheses."""
    for t in tokens(sql):
        if t.up != "(":
            return _BY_WORD.get(t.up, OTHER)
    return OTHER


def words(sql: str, n: int) -> list[str]:
    return [t.up for t in tokens(sql)[:n]]


def is_query(sql: str) -> bool:
    return classify(sql).is_query


def is_ddl(sql: str) -> bool:
    return classify(sql).is_ddl


def is_create_table(sql: str) -> bool:
    first = [w for w in words(sql, 6) if w not in ("OR", "REPLACE", "TEMP", "TEMPORARY", "TRANSIENT")]
    return first[:2] == ["CREATE", "TABLE"]


def is_drop_table(sql: str) -> bool:
    return words(sql, 2) == ["DROP", "TABLE"]


def is_copy(sql: str) -> bool:
    return classify(sql).kind == "copy"


def is_merge(sql: str) -> bool:
    return classify(sql).kind == "merge"


def is_transaction(sql: str) -> bool:
    return classify(sql).kind == "transaction"


def is_begin(sql: str) -> bool:
    return words(sql, 1) in (["BEGIN"], ["START"])


def is_commit(sql: str) -> bool:
    return words(sql, 1) == ["COMMIT"]


def is_rollback(sql: str) -> bool:
    return words(sql, 1) == ["ROLLBACK"]


def statement_type_id(sql: str) -> int:
    return classify(sql).type_id
