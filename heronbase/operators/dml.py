"""INSERT, UPDATE, DELETE, TRUNCATE and MERGE over tables of Parquet files.

Updates, deletes and merges find the files that hold matching rows first and rewrite
those alone; all other files are carried over.  UPDATE ... FROM and DELETE ... USING join
the target with other tables; where several of their rows match a target row, one of
them, whichever, gives the new values.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from heronbase.errors import DuplicateMatch, InvalidValue, SqlSyntaxError
from heronbase.lexer import Token, closing, find, spell, split, tokens
from heronbase.sources.catalog import Key, Table, View


@dataclass
class Changed:
    """Rows that a statement has changed."""

    inserted: int = 0
    updated: int = 0
    deleted: int = 0

    @property
    def affected(self) -> int:
        return self.inserted + self.updated + self.deleted


@dataclass
class When:
    matched: bool
    condition: list[Token] | None
    action: str
    assign: list[tuple[str, list[Token]]]
    values: list[list[Token]]


@dataclass
class Merge:
    target: list[str]
    alias: str
    source: list[Token]
    source_alias: str
    on: list[Token]
    whens: list[When]


def dotted(items: list[Token], at: int) -> tuple[list[str], int]:
    """A dotted name from ``at`` and the place behind it."""
    if at >= len(items) or items[at].kind not in ("word", "quoted"):
        raise SqlSyntaxError("a table name is needed")
    parts = [items[at].name]
    at += 1
    while at + 1 < len(items) and items[at].text == "." and items[at + 1].kind in ("word", "quoted"):
        parts.append(items[at + 1].name)
        at += 2
    return parts, at


def assignments(items: list[Token], aliases: set[str]) -> list[tuple[str, list[Token]]]:
    out = []
    for part in split(items):
        at = find(part, "=")
        names = [t.name for t in part[:at] if t.text != "."]
        if at < 1 or len(names) > 2 or (len(names) == 2 and names[0].upper() not in aliases):
            raise SqlSyntaxError(f"no assignment: {spell(part)}")
        out.append((names[-1], part[at + 1 :]))
    return out


def parse_merge(sql: str | list[Token]) -> Merge:
    items = tokens(sql) if isinstance(sql, str) else list(sql)
    if items and items[-1].up == ";":
        items.pop()
    if [t.up for t in items[:2]] != ["MERGE", "INTO"]:
        raise SqlSyntaxError("MERGE INTO is needed")
    target, at = dotted(items, 2)
    at += items[at].up == "AS" if at < len(items) else 0
    alias = target[-1]
    if at < len(items) and items[at].up != "USING":
        alias, at = items[at].name, at + 1
    if at >= len(items) or items[at].up != "USING":
        raise SqlSyntaxError("MERGE needs USING")
    at += 1
    if items[at].up == "(":
        end = closing(items, at)
        source, at, source_alias = items[at : end + 1], end + 1, ""
    else:
        parts, end = dotted(items, at)
        source, at, source_alias = items[at:end], end, parts[-1]
    at += items[at].up == "AS" if at < len(items) else 0
    if at < len(items) and items[at].up != "ON":
        source_alias, at = items[at].name, at + 1
    if at >= len(items) or items[at].up != "ON" or not source_alias:
        raise SqlSyntaxError("MERGE needs a named source and ON")
    first = find(items, "WHEN", start=at)
    if first < 0:
        raise SqlSyntaxError("MERGE needs a WHEN clause")
    on, whens = items[at + 1 : first], []
    starts = [i for i in range(first, len(items) - 1) if items[i].up == "WHEN" and items[i + 1].up in ("MATCHED", "NOT") and find(items[i:], "THEN") > 0 and not _inside(items[first:i])]
    for a, b in zip(starts, [*starts[1:], len(items)], strict=True):
        whens.append(_when(items[a:b], {alias.upper(), target[-1].upper()}))
    if not on or not whens:
        raise SqlSyntaxError("MERGE needs a condition and a WHEN clause")
    return Merge(target, alias, source, source_alias, on, whens)


def _inside(before: list[Token]) -> bool:
    """Is the place behind ``before`` within parentheses or a CASE?"""
    depth = sum({"(": 1, ")": -1}.get(t.text, 0) for t in before if t.kind == "op")
    return depth > 0 or sum(t.up == "CASE" for t in before) > sum(t.up == "END" for t in before)


def _when(items: list[Token], aliases: set[str]) -> When:
    matched = items[1].up == "MATCHED"
    at = 2 if matched else 3
    then = next((i for i in range(at, len(items)) if items[i].up == "THEN" and i + 1 < len(items) and items[i + 1].up in ("UPDATE", "DELETE", "INSERT")), -1)
    if then < 0 or (not matched and items[2].up != "MATCHED"):
        raise SqlSyntaxError("a WHEN clause needs THEN and an action")
    condition = items[at + 1 : then] if items[at].up == "AND" else None
    action, rest = items[then + 1].up, items[then + 2 :]
    if matched == (action == "INSERT"):
        raise SqlSyntaxError(f"{action} is not for rows that {'match' if matched else 'do not match'}")
    if action == "UPDATE":
        if not rest or rest[0].up != "SET":
            raise SqlSyntaxError("UPDATE needs SET")
        return When(True, condition, action, assignments(rest[1:], aliases), [])
    if action == "DELETE":
        return When(True, condition, action, [], [])
    names: list[str] = []
    if rest and rest[0].up == "(":
        end = closing(rest, 0)
        names = [[t.name for t in p][-1] for p in split(rest[1:end])]
        rest = rest[end + 1 :]
    if len(rest) < 2 or rest[0].up != "VALUES" or rest[1].up != "(":
        raise SqlSyntaxError("INSERT needs VALUES")
    values = split(rest[2 : closing(rest, 1)])
    if names and len(names) != len(values):
        raise SqlSyntaxError("as many values as columns are needed")
    return When(False, condition, action, [(n, []) for n in names], values)


class Writer:
    """Changes tables on behalf of a session; ``run`` makes a DataFrame of dialect tokens, ``text`` Spark text of them."""

    def __init__(self, view: View, resolve, run, text):
        self.view, self.spark, self.resolve, self.run, self.text = view, view.spark, resolve, run, text

    # -- helpers -----------------------------------------------------------------------

    def _stored(self, table: Table, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        """``df``'s columns, by position, as the table's; missing ones take their defaults."""
        names = [n.upper() for n in names] if names else [c.name.upper() for c in table.columns]
        known = {c.name.upper() for c in table.columns}
        if len(df.columns) != len(names):
            raise InvalidValue(f"{len(names)} columns are needed, {len(df.columns)} are given")
        if unknown := [n for n in names if n not in known]:
            raise InvalidValue(f"no such column: {unknown[0]}")
        at = {n: i for i, n in enumerate(names)}
        flat = df.toDF(*[f"__{i}" for i in range(len(names))])
        out = []
        for c, f in zip(table.columns, table.schema, strict=True):
            value = F.col(f"__{at[c.name.upper()]}") if c.name.upper() in at else F.expr(c.default) if c.default else F.lit(None)
            out.append(self._checked(c, value.cast(f.dataType)).alias(c.name))
        return flat.select(*out)

    @staticmethod
    def _checked(column, value):
        if column.nullable and not column.primary_key:
            return value
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"NULL in column {column.name}")).cast("void"))

    def _append(self, key: Key, table: Table, df: DataFrame) -> int:
        files, n = self.view.counted(key, df)
        self.view.put(key, table, replace(table, files=table.files + files))
        return n

    def _place(self, table: Table) -> DataFrame:
        """The table's rows with the file and row they stand in."""
        return self.view.read(table).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def _named(self, df: DataFrame) -> str:
        name = f"__t{uuid.uuid4().hex[:12]}"
        df.createOrReplaceTempView(name)
        return name

    @staticmethod
    def _same(files: tuple[str, ...], found: set[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Files that were found and those that were not, however their scheme is spelt."""
        plain = lambda f: f.split(":", 1)[1].lstrip("/") if ":" in f else f.lstrip("/")
        hit = {plain(f) for f in found}
        return tuple(f for f in files if plain(f) in hit), tuple(f for f in files if plain(f) not in hit)

    # -- statements ---------------------------------------------------------------------

    def insert(self, items: list[Token]) -> Changed:
        overwrite = items[1].up == "OVERWRITE"
        parts, at = dotted(items, 2 + (items[2].up == "INTO" if overwrite else 0))
        key = self.resolve(parts)
        table, names = self.view.get(key), None
        if items[at].up == "(" and (closing(items, at) + 1 < len(items)) and items[closing(items, at) + 1].up in ("VALUES", "SELECT", "WITH", "("):
            end = closing(items, at)
            names, at = [p[-1].name for p in split(items[at + 1 : end])], end + 1
        df = self._stored(table, self.run(items[at:]), names)
        if overwrite:
            files, n = self.view.counted(key, df)
            self.view.put(key, table, replace(table, files=files))
            return Changed(inserted=n)
        return Changed(inserted=self._append(key, table, df))

    def insert_rows(self, key: Key, rows: DataFrame, names: list[str] | None = None) -> int:
        table = self.view.get(key)
        return self._append(key, table, self._stored(table, rows, names))

    def _matching(self, table: Table, alias: str, where: list[Token]) -> set[str]:
        """Files that hold rows for which the condition holds."""
        name = self._named(self._place(table))
        try:
            condition = f" WHERE {self.text(where)}" if where else ""
            return {r[0] for r in self.spark.sql(f"SELECT DISTINCT __file FROM {name} AS `{alias}`{condition}").collect()}
        finally:
            self.spark.catalog.dropTempView(name)

    def _rewritten(self, key: Key, table: Table, files: tuple[str, ...], keep: tuple[str, ...], select: str, where: list[Token], alias: str, stays: bool) -> int:
        """Writes ``files`` anew in one scan, in which each row's condition is computed once; rows that hit are selected and, unless one ``stays``, left out.  How many hit."""
        name = self._named(self.view.read(replace(table, files=files)))
        seen = Observation()
        try:
            condition = f"coalesce(({self.text(where)}), false)" if where else "true"
            marked = self.spark.sql(f"SELECT *, {condition} AS __hit FROM {name} AS `{alias}`").observe(seen, F.count_if("__hit").alias("n"))
            other = self._named(marked)
            try:
                fresh = self.spark.sql(f"SELECT {select} FROM {other} AS `{alias}`" + ("" if stays else " WHERE NOT __hit"))
                new = self.view.written(key, fresh)
            finally:
                self.spark.catalog.dropTempView(other)
        finally:
            self.spark.catalog.dropTempView(name)
        if n := seen.get["n"]:
            self.view.put(key, table, replace(table, files=keep + new))
        return n

    def _joined(self, key: Key, table: Table, alias: str, others: list[Token], where: list[Token], values: list[str]) -> int:
        """Target rows that the other tables' rows match get ``values``, or go if there are none.  How many match."""
        target = self._named(self._place(table))
        try:
            condition = f" WHERE {self.text(where)}" if where else ""
            found = self.spark.sql(f"SELECT {', '.join(['__file', '__row', *values])} {self.text([Token('word', 'FROM'), *others])}, {target} AS `{alias}`{condition}")
            with self._kept(key, found.dropDuplicates(["__file", "__row"])) as acted:
                by_file = acted.groupBy("__file").count().collect()
                if by_file:
                    self.view.put(key, table, self._replaced(key, table, acted, {r["__file"] for r in by_file}, acted if values else None))
                return sum(r["count"] for r in by_file)
        finally:
            self.spark.catalog.dropTempView(target)

    def _replaced(self, key: Key, table: Table, acted: DataFrame, found: set[str], fresh: DataFrame | None) -> Table:
        """The table with its files ``found`` written anew: without the rows of ``acted``, with those of ``fresh``."""
        files, keep = self._same(table.files, found)
        names = [c.name for c in table.columns]
        left = self._place(replace(table, files=files)).join(acted.select("__file", "__row"), ["__file", "__row"], "left_anti").select(*names)
        whole = left.union(fresh.select(*names)) if fresh is not None else left
        return replace(table, files=keep + self.view.written(key, self._stored(table, whole)))

    @contextmanager
    def _kept(self, key: Key, df: DataFrame) -> Iterator[DataFrame]:
        """``df`` computed once, in files that go afterwards."""
        store, part = self.view.catalog.store, ("tables", *key, f"scratch-{uuid.uuid4().hex}")
        df.write.parquet(store.url(*part))
        try:
            yield self.spark.read.schema(df.schema).parquet(store.url(*part))
        finally:
            store.delete(*part)

    def update(self, items: list[Token]) -> Changed:
        parts, at = dotted(items, 1)
        key, alias = self.resolve(parts), parts[-1]
        if items[at].up != "SET":
            at += items[at].up == "AS"
            alias, at = items[at].name, at + 1
        table, from_, end = self.view.get(key), find(items, "FROM", start=at), find(items, "WHERE", start=at)
        where = items[end + 1 :] if end >= 0 else []
        end = end if end >= 0 else len(items)
        others = items[from_ + 1 : end] if from_ >= 0 else []
        new = {n.upper(): e for n, e in assignments(items[at + 1 : from_ if others else end], {alias.upper(), parts[-1].upper()})}
        if unknown := new.keys() - {c.name.upper() for c in table.columns}:
            raise InvalidValue(f"no such column: {sorted(unknown)[0]}")
        if not table.files:
            return Changed()
        values = []
        for c, f in zip(table.columns, table.schema, strict=True):
            kind, old = f.dataType.simpleString(), f"`{alias}`.`{c.name}`"
            fresh = f"cast({self.text(new[c.name.upper()])} as {kind})" if c.name.upper() in new else old
            values.append(f"{fresh} AS `{c.name}`" if others or fresh == old else f"CASE WHEN __hit THEN {fresh} ELSE {old} END AS `{c.name}`")
        if others:
            return Changed(updated=self._joined(key, table, alias, others, where, values))
        hit, keep = self._same(table.files, self._matching(table, alias, where))
        return Changed(updated=self._rewritten(key, table, hit, keep, ", ".join(values), where, alias, True) if hit else 0)

    def delete(self, items: list[Token]) -> Changed:
        parts, at = dotted(items, 2)
        key, alias = self.resolve(parts), parts[-1]
        if at < len(items) and items[at].up not in ("WHERE", "USING"):
            at += items[at].up == "AS"
            alias, at = items[at].name, at + 1
        table, end = self.view.get(key), find(items, "WHERE", start=at)
        where = items[end + 1 :] if end >= 0 else []
        others = items[at + 1 : end if end >= 0 else len(items)] if at < len(items) and items[at].up == "USING" else []
        if not table.files:
            return Changed()
        if others:
            return Changed(deleted=self._joined(key, table, alias, others, where, []))
        if not where:
            n = self.view.read(table).count()
            self.view.put(key, table, replace(table, files=()))
            return Changed(deleted=n)
        hit, keep = self._same(table.files, self._matching(table, alias, where))
        columns = ", ".join(f"`{c.name}`" for c in table.columns)
        return Changed(deleted=self._rewritten(key, table, hit, keep, columns, where, alias, False) if hit else 0)

    def truncate(self, items: list[Token]) -> Changed:
        parts, _ = dotted(items, 2 if items[1].up == "TABLE" else 1)
        key = self.resolve(parts)
        table = self.view.get(key)
        n = self.view.read(table).count() if table.files else 0
        self.view.put(key, table, replace(table, files=()))
        return Changed(deleted=n)

    def merge(self, sql: str | list[Token]) -> Changed:
        """One join finds each target row's action (the first clause that holds); files with acted rows are rewritten, inserts are what no target row matches."""
        m = parse_merge(sql)
        key = self.resolve(m.target)
        table = self.view.get(key)
        kinds = {c.name.upper(): f.dataType.simpleString() for c, f in zip(table.columns, table.schema, strict=True)}
        for w in m.whens:
            if unknown := [n for n, _ in w.assign if n.upper() not in kinds]:
                raise InvalidValue(f"no such column: {unknown[0]}")
        inner = m.source[1:-1] if m.source[0].up == "(" else [*tokens("SELECT * FROM"), *m.source]
        with ExitStack() as stack:

            def named(df: DataFrame) -> str:
                name = self._named(df)
                stack.callback(self.spark.catalog.dropTempView, name)
                return name

            source = named(stack.enter_context(self._kept(key, self.run(inner))))  # both joins read it
            target = named(self._place(table) if table.files else self.view.read(table).select("*", F.lit("").alias("__file"), F.lit(0).cast("long").alias("__row")))
            t, s = f"{target} AS `{m.alias}`", f"{source} AS `{m.source_alias}`"
            out, on = Changed(), self.text(m.on)
            after, added = table, ()
            matched = [w for w in m.whens if w.matched]
            if matched and table.files:
                action = "CASE " + " ".join(f"WHEN {self.text(w.condition) if w.condition else 'true'} THEN {i}" for i, w in enumerate(matched)) + " END"
                values = []
                for c in table.columns:
                    whens = [f"WHEN {i} THEN cast({self.text(e)} as {kinds[c.name.upper()]})" for i, w in enumerate(matched) for n, e in w.assign if n.upper() == c.name.upper()]
                    old = f"`{m.alias}`.`{c.name}`"
                    values.append(f"CASE __action {' '.join(whens)} ELSE {old} END AS `{c.name}`" if whens else f"{old} AS `{c.name}`")
                acted = stack.enter_context(self._kept(key, self._acted(t, s, on, action, values)))
                deletes = [i for i, w in enumerate(matched) if w.action == "DELETE"]
                by_row = acted.groupBy("__file", "__row").agg(F.count(F.lit(1)).alias("times"), F.count_if(F.col("__action").isin(deletes)).alias("gone"))
                by_file = by_row.groupBy("__file").agg(F.max("times").alias("times"), F.sum("gone").alias("gone"), F.count(F.lit(1)).alias("n")).collect()
                if any(r.times > 1 for r in by_file):
                    raise DuplicateMatch("more than one source row changes the same target row")
                out.deleted = sum(r.gone for r in by_file)
                out.updated = sum(r.n for r in by_file) - out.deleted
                if by_file:
                    after = self._replaced(key, table, acted, {r["__file"] for r in by_file}, acted.where(~F.col("__action").isin(deletes)))
            unmatched = [w for w in m.whens if not w.matched]
            if unmatched:
                fresh = named(self.spark.sql(f"SELECT `{m.source_alias}`.* FROM {s} LEFT ANTI JOIN {t} ON {on}"))
                action = "CASE " + " ".join(f"WHEN {self.text(w.condition) if w.condition else 'true'} THEN {i}" for i, w in enumerate(unmatched)) + " END"
                whole = None
                for i, w in enumerate(unmatched):
                    values = ", ".join(self.text(v) for v in w.values)
                    df = self.spark.sql(f"SELECT {values} FROM {fresh} AS `{m.source_alias}` WHERE ({action}) = {i}")
                    one = self._stored(table, df, [n for n, _ in w.assign] or None)
                    whole = one if whole is None else whole.union(one)
                added, out.inserted = self.view.counted(key, whole)
            if after is not table or added:
                self.view.put(key, table, replace(after, files=after.files + added))
            return out

    def _acted(self, t: str, s: str, on: str, action: str, values: list[str]) -> DataFrame:
        """Target rows that some clause acts on, with their new values."""
        inline = [v.replace("CASE __action", f"CASE ({action})", 1) for v in values]
        return self.spark.sql(f"SELECT __file, __row, {action} AS __action, {', '.join(inline)} FROM {t} JOIN {s} ON {on}").where("__action IS NOT NULL")
