"""The dialect's text as Spark SQL.

Works on tokens, so literals, comments and quoted names are never touched, and function
arguments are rewritten at any depth, in any clause and any statement.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from heronbase.errors import SqlSyntaxError
from heronbase.lexer import Token, closing, find, literal, spell, split, tokens
from heronbase.types import NAMES, spark_type

Args = list[list[Token]]


def raw(text: str) -> list[Token]:
    """Finished Spark text as one token."""
    return [Token("raw", text)]


def day_difference(s: str, e: str) -> str:
    return f"cast(datediff({e}, {s}) as bigint)"


def date_difference(part: str, s: str, e: str) -> str:
    """Boundaries of ``part`` between two dates, times of day aside."""
    s, e = f"cast({s} as date)", f"cast({e} as date)"
    days = day_difference(s, e)
    years = f"(year({e}) - year({s}))"
    part = PARTS.get(part.lower(), part.lower())
    if part in SECONDS:
        return f"({days} * {86400 // SECONDS[part]})" if part != "millisecond" else f"({days} * 86400000)"
    forms = {
        "day": days, "week": f"cast({days} div 7 as bigint)", "year": f"cast({years} as bigint)",
        "month": f"cast({years} * 12 + month({e}) - month({s}) as bigint)",
        "quarter": f"cast({years} * 4 + quarter({e}) - quarter({s}) as bigint)",
    }
    if part not in forms:
        raise SqlSyntaxError(f"no such date part: {part}")
    return forms[part]


#: Date parts and their short names.
PARTS = {
    "years": "year", "yy": "year", "yyyy": "year", "y": "year", "months": "month", "mm": "month", "mon": "month", "days": "day", "dd": "day", "d": "day",
    "weeks": "week", "wk": "week", "w": "week", "quarters": "quarter", "q": "quarter", "qtr": "quarter", "hours": "hour", "hh": "hour", "h": "hour",
    "minutes": "minute", "mi": "minute", "min": "minute", "seconds": "second", "ss": "second", "s": "second", "sec": "second", "milliseconds": "millisecond", "ms": "millisecond",
}
SECONDS = {"hour": 3600, "minute": 60, "second": 1, "millisecond": 1}


def _part(arg: list[Token]) -> str:
    if len(arg) != 1:
        raise SqlSyntaxError("a date part is one word")
    word = (arg[0].value if arg[0].kind == "string" else arg[0].text).lower()
    return PARTS.get(word, word)


def _iff(a: Args) -> str | None:
    return f"if({', '.join(map(spell, a))})" if len(a) == 3 else None


def _dateadd(a: Args) -> str | None:
    if len(a) != 3:
        return None
    return f"cast(dateadd({_part(a[0]).upper()}, {spell(a[1])}, cast({spell(a[2])} as date)) as timestamp_ntz)"


def _datediff(a: Args) -> str | None:
    return date_difference(_part(a[0]), spell(a[1]), spell(a[2])) if len(a) == 3 else None


def _to_variant(a: Args) -> str | None:
    return f"cast({spell(a[0])} as variant)" if len(a) == 1 else None


def _object_construct(a: Args) -> str | None:
    if len(a) % 2:
        raise SqlSyntaxError("OBJECT_CONSTRUCT takes keys and values in turn")
    if all(len(k) == 1 and k[0].kind == "string" for k in a[::2]):
        if not a:
            return "'{}'"
        return f"to_json(named_struct({', '.join(map(spell, a))}), map('ignoreNullFields', 'false'))"
    keys, values = (", ".join(f"cast({spell(x)} as {kind})" for x in a[i::2]) for i, kind in ((0, "string"), (1, "variant")))
    return f"to_json(map_from_arrays(array({keys}), array({values})), map('ignoreNullFields', 'false'))"


def _concat(a: Args) -> str | None:
    return f"concat_ws('', {', '.join(f'cast({spell(x)} as string)' for x in a)})" if a else None


def _substr(a: Args) -> str | None:
    """Position 0 is the one before the first."""
    if len(a) == 3 and spell(a[1]) == "0":
        return f"substr({spell(a[0])}, 1, greatest({spell(a[2])} - 1, 0))"
    return None


def _flatten(a: Args) -> str | None:
    return f"explode({spell(a[0])})" if len(a) == 1 else None


def _array_to_string(a: Args) -> str | None:
    return f"array_join(cast({spell(a[0])} as array<string>), {spell(a[1])})" if len(a) == 2 else None


#: The dialect's date pictures and Java's.
PICTURES = (("YYYY", "yyyy"), ("YY", "yy"), ("HH24", "HH"), ("HH12", "hh"), ("MI", "mm"), ("SS", "ss"), ("FF3", "SSS"), ("FF6", "SSSSSS"), ("FF9", "SSSSSSSSS"), ("FF", "SSS"), ("MON", "MMM"), ("DD", "dd"), ("DY", "EEE"), ("AM", "a"), ("PM", "a"))


def date_picture(text: str) -> str:
    """A date picture as Java's; what it does not know stays."""
    out, i = "", 0
    while i < len(text):
        short, java = next(((a, b) for a, b in PICTURES if text.startswith(a, i)), (text[i], text[i]))
        out, i = out + java, i + len(short)
    return out


def _to_char(a: Args) -> str | None:
    """Dates by a picture; pictures of numbers are Spark's own."""
    if len(a) == 1:
        return f"cast({spell(a[0])} as string)"
    if len(a) == 2 and len(a[1]) == 1 and a[1][0].kind == "string":
        picture = a[1][0].value
        if "HH24" in picture or "HH12" in picture or not set(picture) & set("09$"):
            return f"date_format({spell(a[0])}, {literal(date_picture(picture))})"
    return None


#: The letters of strftime and Java's.
STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "j": "DDD", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "F": "yyyy-MM-dd", "T": "HH:mm:ss"}


def _strftime(a: Args) -> str | None:
    if len(a) != 2 or len(a[1]) != 1 or a[1][0].kind != "string":
        return None
    out, plain = "", ""
    for form, other in re.findall(r"%(.)|([^%]|%$)", a[1][0].value, re.DOTALL):
        if form and form != "%":
            if form not in STRFTIME:
                raise SqlSyntaxError(f"no such letter of a date form: %{form}")
            out, plain = out + _quoted(plain) + STRFTIME[form], ""
        else:
            plain += other or "%"
    return f"date_format({spell(a[0])}, {literal(out + _quoted(plain))})"


def _quoted(text: str) -> str:
    """Text between the letters of a Java date form."""
    return "'" + text.replace("'", "''") + "'" if any(c.isalpha() or c in "'%[]{}#" for c in text) else text


def _pictured(name: str) -> Callable[[Args], str | None]:
    """A function of a text and a date picture."""

    def call(a: Args) -> str | None:
        if len(a) == 2 and len(a[1]) == 1 and a[1][0].kind == "string":
            return f"{name}({spell(a[0])}, {literal(date_picture(a[1][0].value))})"
        return None

    return call


def _date_diff(a: Args) -> str | None:
    """Boundaries of a part between two times, times of day included."""
    if len(a) != 3:
        return None
    part, s, e = _part(a[0]), spell(a[1]), spell(a[2])
    if part in SECONDS and part != "millisecond":
        at = lambda x: f"unix_seconds(cast(date_trunc('{part}', {x}) as timestamp))"
        return f"cast(({at(e)} - {at(s)}) div {SECONDS[part]} as bigint)"
    return date_difference(part, s, e)


def _split_by(a: Args) -> str | None:
    """The separator is text, not a pattern."""
    return f"split({spell(a[0])}, concat('\\\\Q', {spell(a[1])}, '\\\\E'))" if len(a) == 2 else None


def _renamed(name: str) -> Callable[[Args], str | None]:
    return lambda a: f"{name}({', '.join(map(spell, a))})"


FUNCTIONS: dict[str, Callable[[Args], str | None]] = {
    "IFF": _iff, "DATEADD": _dateadd, "DATEDIFF": _datediff, "TO_VARIANT": _to_variant, "OBJECT_CONSTRUCT": _object_construct,
    "CONCAT": _concat, "SUBSTR": _substr, "SUBSTRING": _substr, "FLATTEN": _flatten, "ARRAY_TO_STRING": _array_to_string, "TO_CHAR": _to_char, "TO_VARCHAR": _to_char,
    # names that the engine behind the dialect has for what Spark calls otherwise
    "LIST_CONTAINS": _renamed("array_contains"), "LIST_SORT": _renamed("array_sort"), "LIST_DISTINCT": _renamed("array_distinct"), "LIST_VALUE": _renamed("array"), "ARRAY_LENGTH": _renamed("size"),
    "LIST": _renamed("collect_list"), "ARG_MIN": _renamed("min_by"), "ARG_MAX": _renamed("max_by"), "QUANTILE_CONT": _renamed("percentile"), "APPROX_QUANTILE": _renamed("percentile_approx"),
    "ARRAY_CONSTRUCT": _renamed("array"), "ARRAY_CAT": _renamed("concat"), "LIST_TRANSFORM": _renamed("transform"), "LIST_FILTER": _renamed("filter"), "UNNEST": _flatten, "STRPOS": _renamed("instr"),
    "BOOLAND_AGG": _renamed("bool_and"), "BOOLOR_AGG": _renamed("bool_or"), "DATE_FROM_PARTS": _renamed("make_date"), "EDITDISTANCE": _renamed("levenshtein"),
    "STRFTIME": _strftime, "TO_DATE": _pictured("to_date"), "TO_TIMESTAMP": _pictured("to_timestamp"), "DATE_DIFF": _date_diff, "STRING_SPLIT": _split_by,
    "REGEXP_MATCHES": _renamed("regexp_like"), "STARTS_WITH": _renamed("startswith"), "ENDS_WITH": _renamed("endswith"),
}
#: Table functions over files, and the reader of each.
READERS = {"READ_PARQUET": "parquet", "PARQUET_SCAN": "parquet", "READ_CSV": "csv", "READ_CSV_AUTO": "csv", "READ_JSON": "json", "READ_JSON_AUTO": "json", "READ_NDJSON": "json"}
_ORDER_ENDS = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "UNION", "INTERSECT", "EXCEPT", "QUALIFY", "WINDOW"}
TableNames = Callable[[list[str]], str | None]


Files = Callable[[str, str, dict[str, str]], str]


class Rewriter:
    """``table`` names the Spark relation of a dotted table name, or None to leave it; ``files`` that of a reader, a path and options."""

    def __init__(self, table: TableNames | None = None, files: Files | None = None):
        self.table, self.files = table or (lambda parts: None), files
        self.params = 0

    def __call__(self, sql: str) -> str:
        items = tokens(sql)
        while items and items[-1].up == ";":
            items.pop()
        if not items:
            raise SqlSyntaxError("empty statement")
        return spell(self.statement(items))

    def statement(self, items: list[Token]) -> list[Token]:
        return self.expression(self.clauses(items))

    # -- clauses, on the dialect's tokens -----------------------------------------

    def clauses(self, items: list[Token]) -> list[Token]:
        out: list[Token] = []
        i = 0
        while i < len(items):
            if items[i].up == "(":
                end = closing(items, i)
                out += [items[i], *self.clauses(items[i + 1 : end]), items[end]]
                i = end + 1
            else:
                out.append(items[i])
                i += 1
        return self.tables(self.ordered(self.limited(self.qualified(self.without_dual(out)))))

    def limited(self, items: list[Token]) -> list[Token]:
        """OFFSET n ROWS and FETCH FIRST n ROWS ONLY as LIMIT and OFFSET."""
        fetch = next((i for i in range(len(items) - 1) if items[i].up == "FETCH" and items[i + 1].up in ("FIRST", "NEXT") and self._level(items, i) == 0), -1)
        rows = ("ROW", "ROWS")
        if fetch >= 0:
            end, n = fetch + 2, [Token("number", "1")]
            if items[end].up not in rows:
                n, end = [items[end]], end + 1
            if end + 1 >= len(items) or items[end].up not in rows or items[end + 1].up != "ONLY":
                raise SqlSyntaxError("FETCH needs ROWS ONLY")
            at = find(items, "OFFSET")
            at = at if 0 <= at < fetch else fetch
            items = [*items[:at], Token("word", "LIMIT"), *n, *items[at:fetch], *items[end + 2 :]]
        at = find(items, "OFFSET")
        return [*items[: at + 2], *items[at + 3 :]] if 0 <= at < len(items) - 2 and items[at + 2].up in rows else items

    def without_dual(self, items: list[Token]) -> list[Token]:
        at = find(items, "FROM", "DUAL")
        return items[:at] + items[at + 2 :] if at >= 0 and (at + 2 == len(items) or items[at + 2].up in _ORDER_ENDS | {"ORDER", "WHERE", ")"}) else items

    def qualified(self, items: list[Token]) -> list[Token]:
        """QUALIFY as a filter over a subquery that carries its condition."""
        at = find(items, "QUALIFY")
        if at < 0:
            return items
        select = max(i for i in range(at) if items[i].up == "SELECT" and find(items[i:at], "SELECT") == 0 and self._level(items, i) == 0)
        rest = next((i for i in range(at, len(items)) if self._level(items, i) == 0 and items[i].up in (_ORDER_ENDS | {"ORDER"}) - {"QUALIFY", "ROWS", "RANGE"}), len(items))
        start = find(items, "FROM", start=select)
        condition, ahead = items[at + 1 : rest], items[:select]
        if not any(t.up == "OVER" for t in condition):  # on names of the select list
            return [*ahead, *raw("SELECT * FROM ("), *items[select:at], *raw(") WHERE"), *condition, *items[rest:]]
        inner = [*items[select:start], *raw(", ("), *condition, *raw(") as __qualified"), *items[start:at]]
        return [*ahead, *raw("SELECT * EXCEPT (__qualified) FROM ("), *inner, *raw(") WHERE __qualified"), *items[rest:]]

    @staticmethod
    def _level(items: list[Token], at: int) -> int:
        return sum({"(": 1, ")": -1}.get(t.text, 0) for t in items[:at] if t.kind == "op")

    def ordered(self, items: list[Token]) -> list[Token]:
        """Nulls sort last in either direction unless the text says otherwise."""
        out: list[Token] = []
        i = 0
        while i < len(items):
            out.append(items[i])
            if items[i].up == "BY" and i and items[i - 1].up == "ORDER":
                depth, end = 0, i + 1
                while end < len(items) and not (depth == 0 and (items[end].up in _ORDER_ENDS or items[end].up == ")")):
                    depth += {"(": 1, ")": -1}.get(items[end].text, 0) if items[end].kind == "op" else 0
                    end += 1
                keys = split(items[i + 1 : end])
                for k, key in enumerate(keys):
                    out += [*([Token("op", ",")] if k else []), *key]
                    if not any(t.up == "NULLS" or t.text == "NULLS LAST" for t in key):
                        out += raw("NULLS LAST")
                i = end
                continue
            i += 1
        return out

    def tables(self, items: list[Token]) -> list[Token]:
        """Names of tables after FROM, JOIN and the commas between them; TABLE(FLATTEN(...)) as a lateral join."""
        out: list[Token] = []
        i, expect = 0, False
        while i < len(items):
            t = items[i]
            if t.up in ("FROM", "JOIN") and not (i and t.up == "FROM" and items[i - 1].up == "DISTINCT"):
                expect = True
                out.append(t)
                i += 1
                continue
            if expect and t.up == "TABLE" and i + 1 < len(items) and items[i + 1].up == "(":
                end = closing(items, i + 1)
                if found := self.flattened(items[i + 2 : end]):
                    out += raw(found)
                    i, expect = end + 1, False
                    continue
            if expect and t.kind in ("word", "quoted") and t.up not in ("LATERAL", "SELECT", "VALUES"):
                parts, j = [t], i + 1
                while j + 1 < len(items) and items[j].text == "." and items[j + 1].kind in ("word", "quoted"):
                    parts.append(items[j + 1])
                    j += 2
                if len(parts) == 1 and t.up in READERS and self.files and j < len(items) and items[j].up == "(":
                    end = closing(items, j)
                    name = self.files(READERS[t.up], *self.reader_options(items[j + 1 : end]))
                    out += raw(name)
                    i, expect = end + 1, False
                    continue
                if j >= len(items) or items[j].up != "(":
                    name = self.table([p.name for p in parts])
                    sampled, j = self.sampled(items, j, name or spell(parts if len(parts) == 1 else items[i:j]), parts[-1].name)
                    if sampled:
                        out += raw(sampled)
                        i, expect = j, False
                        continue
                    # the bare name stays usable for columns
                    alias = j < len(items) and (items[j].up == "AS" or items[j].kind == "quoted" or (items[j].kind == "word" and items[j].up not in _AFTER_TABLE))
                    out += raw(name if alias else f"{name} AS `{parts[-1].name}`") if name else items[i:j]
                    i, expect = j, False
                    continue
            if t.up == ",":
                expect = self._in_from(items, i)
            elif t.up != "LATERAL":
                expect = False
            out.append(t)
            i += 1
        return out

    def _in_from(self, items: list[Token], at: int) -> bool:
        depth = 0
        for t in reversed(items[:at]):
            depth += {")": 1, "(": -1}.get(t.text, 0) if t.kind == "op" else 0
            if depth < 0:
                return False
            if not depth and t.up in _CLAUSES:
                return t.up in ("FROM", "JOIN", "ON", "USING")
        return False

    @staticmethod
    def reader_options(call: list[Token]) -> tuple[str, dict[str, str]]:
        """Path and named options of a table function over files."""
        path, options = "", {}
        for arg in split(call):
            if len(arg) == 1 and arg[0].kind in ("string", "dollar"):
                path = arg[0].value
            elif len(arg) > 2 and arg[1].up in ("=", "=>"):
                options[arg[0].text.lower()] = arg[2].value if arg[2].kind in ("string", "dollar") else arg[2].text.lower()
        if not path:
            raise SqlSyntaxError("a path is needed")
        return path, options

    def sampled(self, items: list[Token], at: int, name: str, bare: str) -> tuple[str | None, int]:
        """A table with SAMPLE, TABLESAMPLE or USING SAMPLE behind it, before or after its alias, as Spark writes it; where it ends."""
        start, alias = at, bare
        if at < len(items) and (items[at].up == "AS" or (items[at].kind in ("word", "quoted") and items[at].up not in _AFTER_TABLE)):
            at += items[at].up == "AS"
            alias, at = items[at].name, at + 1
        if [t.up for t in items[at : at + 2]] == ["USING", "SAMPLE"]:
            at += 1
        if at >= len(items) or items[at].up not in ("SAMPLE", "TABLESAMPLE"):
            return None, start
        at += 1
        if at < len(items) and items[at].up in ("BERNOULLI", "SYSTEM", "ROW", "BLOCK", "RESERVOIR"):
            at += 1
        if at < len(items) and items[at].up == "(":
            end = closing(items, at)
            body, at = items[at + 1 : end], end + 1
        else:
            body, at = items[at : at + 2], at + 2
            if len(body) < 2 or body[1].up not in ("%", "PERCENT", "ROWS"):
                raise SqlSyntaxError("SAMPLE needs a share or a number of rows")
        if not body or body[0].kind != "number" or len(body) > 2:
            raise SqlSyntaxError("SAMPLE needs a share or a number of rows")
        if len(body) == 2 and body[1].up in ("ROW", "ROWS"):
            text = f"(SELECT * FROM {name} ORDER BY rand() LIMIT {body[0].text})"
        else:
            text = f"{name} TABLESAMPLE ({body[0].text} PERCENT)"
        if at < len(items) and bare == alias and (items[at].up == "AS" or (items[at].kind in ("word", "quoted") and items[at].up not in _AFTER_TABLE)):
            at += items[at].up == "AS"
            alias, at = items[at].name, at + 1
        return f"{text} AS `{alias}`", at

    def flattened(self, call: list[Token]) -> str | None:
        if not call or call[0].up != "FLATTEN" or call[1].up != "(":
            return None
        for arg in split(call[2 : closing(call, 1)]):
            if len(arg) > 2 and arg[1].up == "=>":
                if arg[0].up == "INPUT":
                    arg = arg[2:]
                else:
                    continue
            return f"LATERAL (SELECT pos AS `INDEX`, key AS `KEY`, value AS `VALUE` FROM variant_explode(cast({spell(self.expression(arg))} as variant)))"
        return None

    # -- expressions ----------------------------------------------------------------

    def expression(self, items: list[Token]) -> list[Token]:
        out: list[Token] = []
        i = 0
        while i < len(items):
            t = items[i]
            if t.up == "EXCLUDE" and out and out[-1].text == "*" and i + 1 < len(items):
                # SELECT * EXCLUDE column, or several in parentheses
                end = closing(items, i + 1) if items[i + 1].up == "(" else i + 1
                out += raw(f"EXCEPT ({spell(items[i + 2 : end] if items[i + 1].up == '(' else items[i + 1 : i + 2])})")
                i = end + 1
                continue
            call = t.kind == "word" and i + 1 < len(items) and items[i + 1].up == "(" and not (i and items[i - 1].text == ".")
            if call:
                end = closing(items, i + 1)
                body = items[i + 2 : end]
                if t.up == "LISTAGG":
                    text, i = self.listagg(body, items, end)
                    out += raw(text)
                    continue
                if t.up in ("CAST", "TRY_CAST") and (at := find(body, "AS")) >= 0:
                    out += raw(f"{t.text}({spell(self.expression(body[:at]))} AS {self.type_name(body[at + 1 :])})")
                    i = end + 1
                    continue
                args = [self.expression(a) for a in split(body)]
                if t.up in FUNCTIONS and (text := FUNCTIONS[t.up](args)) is not None:
                    out += raw(text)
                    i = end + 1
                    continue
                out += [t, items[i + 1]]
                for k, a in enumerate(args):
                    out += [*([Token("op", ",")] if k else []), *a]
                out.append(items[end])
                i = end + 1
                continue
            if t.up == "::" and i + 1 < len(items):
                end = closing(items, i + 2) + 1 if i + 2 < len(items) and items[i + 2].up == "(" else i + 2
                out += [t, *raw(self.type_name(items[i + 1 : end]))]
                i = end
                continue
            if t.kind == "param":
                self.params += t.text == "?"
                out += raw(f":p{self.params}" if t.text == "?" else f":p{t.text[1:]}")
            else:
                out.append(t)
            i += 1
        return out

    def listagg(self, body: list[Token], items: list[Token], end: int) -> tuple[str, int]:
        """Values in order of themselves unless the text says otherwise."""
        distinct = bool(body) and body[0].up == "DISTINCT"
        args = [spell(self.expression(a)) for a in split(body[distinct:])]
        value = f"cast({args[0]} as string)"
        call = f"listagg({'DISTINCT ' if distinct else ''}{value}, {args[1] if len(args) > 1 else literal('')})"
        if [t.up for t in items[end + 1 : end + 4]] == ["WITHIN", "GROUP", "("]:
            last = closing(items, end + 3)
            keys = []
            for key in split(items[end + 6 : last]):
                at = next((i for i, t in enumerate(key) if t.up in ("ASC", "DESC", "NULLS") or t.kind == "raw"), len(key))
                text = spell(self.expression(key[:at]))
                keys.append(f"{value if text == args[0] else text} {spell(key[at:])}")
            return f"{call} WITHIN GROUP (ORDER BY {', '.join(keys)})", last + 1
        return f"{call} WITHIN GROUP (ORDER BY {value})", end + 1

    @staticmethod
    def type_name(items: list[Token]) -> str:
        text = spell(items)
        return spark_type(text).simpleString() if items and items[0].up in NAMES else text


_AFTER_TABLE = {
    "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "ON", "USING", "UNION", "INTERSECT", "EXCEPT", "QUALIFY",
    "WINDOW", "OFFSET", "FETCH", "LATERAL", "TABLESAMPLE", "PIVOT", "UNPIVOT", "SET", "WHEN", "SEMI", "ANTI", "MINUS", "SAMPLE", "VERSION", "TIMESTAMP",
}
_CLAUSES = {"SELECT", "FROM", "JOIN", "WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "QUALIFY", "ON", "USING", "WINDOW", "SET", "VALUES"}


def rewrite(sql: str, table: TableNames | None = None) -> str:
    return Rewriter(table)(sql)
