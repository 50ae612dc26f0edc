"""Tokens of the dialect: enough structure to rewrite text without touching literals or comments."""

from __future__ import annotations

import re
from dataclasses import dataclass

from heronbase.errors import SqlSyntaxError

_RULES = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<comment>--[^\n]*|//[^\n]*|/\*.*?\*/)
  | (?P<string>'(?:[^']|'')*')
  | (?P<dollar>\$\$.*?\$\$)
  | (?P<quoted>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<param>:\d+|\?)
  | (?P<word>[^\W\d]\w*(?:\$\w*)*|\$\d+)
  | (?P<op>::|<=>|<>|!=|<=|>=|\|\||=>|->|.)
    """,
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def up(self) -> str:
        """Upper-case text of a bare word or operator, empty for anything else."""
        return self.text.upper() if self.kind in ("word", "op") else ""

    @property
    def name(self) -> str:
        """What an identifier names: quotes taken off, bare words in upper case."""
        if self.kind == "quoted":
            q = self.text[0]
            return self.text[1:-1].replace(q * 2, q)
        return self.text.upper()

    @property
    def value(self) -> str:
        """A string literal's content."""
        return self.text[2:-2] if self.kind == "dollar" else self.text[1:-1].replace("''", "'")


def tokens(sql: str, trivia: bool = False) -> list[Token]:
    """Tokens of ``sql``; white space and comments only with ``trivia``."""
    out = []
    for m in _RULES.finditer(sql):
        kind = m.lastgroup
        if kind == "op" and m[0] in "'\"`":
            raise SqlSyntaxError(f"unterminated {'string' if m[0] == chr(39) else 'identifier'} at {m.start()}")
        if trivia or kind not in ("space", "comment"):
            out.append(Token(kind, m[0]))
    return out


def literal(value: str) -> str:
    """A string as Spark reads it."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spell(items: list[Token]) -> str:
    """Spark text of tokens."""
    out = []
    for t in items:
        if t.kind in ("string", "dollar"):
            out.append(literal(t.value))
        elif t.kind == "quoted":
            out.append("`" + t.name.replace("`", "``") + "`")
        else:
            out.append(t.text)
    return " ".join(out).replace(" . ", ".")


def closing(items: list[Token], at: int) -> int:
    """Index of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(items)):
        if items[i].kind == "op":
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(items[i].text, 0)
            if not depth:
                return i
    raise SqlSyntaxError("unbalanced parentheses")


def split(items: list[Token], by: str = ",") -> list[list[Token]]:
    """Parts between ``by`` outside parentheses."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in items:
        if t.kind == "op":
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(t.text, 0)
        if not depth and t.up == by:
            out.append([])
        else:
            out[-1].append(t)
    return out if out != [[]] else []


def find(items: list[Token], *words: str, start: int = 0) -> int:
    """First place at the outer level where ``words`` follow each other; -1 if nowhere."""
    depth = 0
    for i in range(start, len(items)):
        if items[i].kind == "op":
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(items[i].text, 0)
        if not depth and [t.up for t in items[i : i + len(words)]] == list(words):
            return i
    return -1
