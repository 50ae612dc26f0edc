"""Engine and sessions: text in, DataFrames and counts out."""

from __future__ import annotations

import json
import re
import secrets
import tempfile
import threading
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType

from heronbase.bindings import arguments
from heronbase.errors import Conflict, InvalidValue, NotFound, SessionError, SqlSyntaxError, wrap
from heronbase.lexer import Token, closing, find, literal, spell, split, tokens
from heronbase.operators.dml import Changed, Writer, dotted
from heronbase.plans.classify import classify
from heronbase.plans.rewrite import Rewriter
from heronbase.sources.catalog import DATABASE, SCHEMA, Catalog, Column, Key, View
from heronbase.sources.copy_into import CopyResult, Loader
from heronbase.sources.stages import Stages
from heronbase.statements import History, Statements, Warehouses
from heronbase.types import column_metadata

#: Session parameters and what they are at first.
PARAMETERS = {"TIMEZONE": "UTC", "TIMESTAMP_OUTPUT_FORMAT": "YYYY-MM-DD HH24:MI:SS", "CLIENT_SESSION_KEEP_ALIVE": "false", "QUERY_TAG": "", "GO_QUERY_RESULT_FORMAT": "json"}


_KEPT = ("user", "database", "schema", "token", "master", "parameters", "id", "created_at", "last_accessed_at", "expires_at", "master_expires_at")


@dataclass
class Result:
    columns: list[dict]
    rows: list[tuple]


@dataclass
class Outcome:
    """What a statement came to: a DataFrame, or a number of rows."""

    frame: DataFrame | None = None
    affected: int = 0
    detail: Changed | CopyResult | None = None

    def result(self) -> Result:
        if self.frame is None:
            return Result([{"name": "number of rows affected", "type": "NUMBER", "nullable": False, "precision": 38, "scale": 0}], [(self.affected,)])
        return Result(column_metadata(self.frame.schema), [tuple(r) for r in self.frame.collect()])


def default_warehouse(spark: SparkSession) -> str:
    """The session's warehouse folder if it is set, else a temporary one, which only a local session may use."""
    found = spark.sparkContext.getConf().get("spark.sql.warehouse.dir")
    if found:
        return f"{found.rstrip('/')}/heronbase"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise InvalidValue("a warehouse is needed: executors must reach its files")
    return tempfile.mkdtemp(prefix="heronbase-warehouse-")


class Engine:
    """Catalog, stages, history and sessions over one Spark session."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None, session_ttl: float = 86_400):
        self.spark = spark
        self.catalog = Catalog(spark, warehouse or default_warehouse(spark))
        try:
            self.catalog.create_database(DATABASE, if_not_exists=True)
        except Conflict:  # another engine has just made it
            self.catalog.database(DATABASE)
        self.stages, self.history, self.statements, self.warehouses = Stages(self.catalog), History(self.catalog.store), Statements(spark), Warehouses()
        self.ttl, self.sessions, self.lock = session_ttl, {}, threading.Lock()

    def session(self, user: str = "", database: str = DATABASE, schema: str = SCHEMA) -> Session:
        s = Session(self, user, database.upper(), schema.upper())
        with self.lock:
            self.sessions[s.token] = s
        return s

    def validate(self, token: str) -> Session:
        s = self.sessions.get(token)
        if not s or s.expires_at < time.time():
            self.sessions.pop(token, None)
            raise SessionError("no such session, or it has expired")
        s.last_accessed_at = time.time()
        return s

    def renew(self, master: str) -> Session:
        """A new token for the session of a master token."""
        with self.lock:
            for token, s in list(self.sessions.items()):
                if s.master == master and s.master_expires_at >= time.time():
                    del self.sessions[token]
                    s.token, s.expires_at = secrets.token_hex(32), time.time() + self.ttl
                    self.sessions[s.token] = s
                    return s
        raise SessionError("no such master token, or it has expired")

    def heartbeat(self, token: str) -> Session:
        s = self.validate(token)
        s.expires_at = time.time() + self.ttl
        return s

    def close(self, token: str) -> None:
        if not self.sessions.pop(token, None):
            raise SessionError("no such session")

    def save_sessions(self) -> int:
        """Keeps the live sessions beside the catalog."""
        with self.lock:
            kept = [{k: getattr(s, k) for k in _KEPT} for s in self.sessions.values()]
        self.catalog.store.write(json.dumps(kept).encode(), "sessions.json")
        return len(kept)

    def load_sessions(self) -> int:
        """Takes up kept sessions that have not expired; transactions are not among what is kept."""
        if not self.catalog.store.exists("sessions.json"):
            return 0
        n = 0
        for kept in json.loads(self.catalog.store.read("sessions.json")):
            if kept["expires_at"] >= time.time() and kept["token"] not in self.sessions:
                s = Session(self, kept["user"], kept["database"], kept["schema"])
                for k in _KEPT:
                    setattr(s, k, kept[k])
                self.sessions[s.token] = s
                n += 1
        return n

    def cleanup(self) -> int:
        with self.lock:
            old = [t for t, s in self.sessions.items() if s.expires_at < time.time()]
            for t in old:
                del self.sessions[t]
        return len(old)


@dataclass(eq=False)
class Session:
    engine: Engine
    user: str
    database: str
    schema: str
    token: str = field(default_factory=lambda: secrets.token_hex(32))
    master: str = field(default_factory=lambda: secrets.token_hex(32))
    parameters: dict = field(default_factory=lambda: dict(PARAMETERS))

    def __post_init__(self):
        e = self.engine
        self.id = secrets.token_hex(8)
        self.created_at = self.last_accessed_at = time.time()
        self.expires_at, self.master_expires_at = time.time() + e.ttl, time.time() + 4 * e.ttl
        self.spark = e.spark
        self.view = View(e.catalog)
        self.frames: dict[str, DataFrame] = {}
        self.writer = Writer(self.view, self.key, self._frame, self._text)
        self.loader = Loader(self.writer, e.stages)

    # -- names ---------------------------------------------------------------------------

    def key(self, parts: list[str]) -> Key:
        """The table that a name means: ``table``, ``schema.table``, ``db.schema.table`` or ``DB.SCHEMA_TABLE``."""
        parts = [p.strip().upper() for p in parts]
        if len(parts) > 3 or not all(parts):
            raise InvalidValue(f"no table name: {'.'.join(parts)}")
        if len(parts) == 3:
            return tuple(parts)
        if len(parts) == 2:
            first, last = parts
            if (self.database, first) in self.engine.catalog.schemas and (self.database, first, last) in self.view.tables:
                return self.database, first, last
            if first in self.engine.catalog.databases:
                schemas = [s for d, s in self.engine.catalog.schemas if d == first and last.startswith(s + "_")]
                if schemas:
                    schema = max(schemas, key=len)
                    return first, schema, last[len(schema) + 1 :]
            return self.database, first, last
        return self.database, self.schema, parts[0]

    def register(self, name: str, frame: DataFrame) -> None:
        """Makes a DataFrame queryable under a bare name."""
        self.frames[name.upper()] = frame
        frame.createOrReplaceTempView(self._view_name(name))

    def _view_name(self, name: str) -> str:
        return f"__frame_{self.id}_{name.lower()}"

    def _relation(self, parts: list[str]) -> str | None:
        if len(parts) == 1 and parts[0].upper() in self.frames:
            return self._view_name(parts[0])
        try:
            key = self.key(parts)
        except InvalidValue:
            return None
        table = self.view.tables.get(key)
        if not table:
            return None
        name = re.sub(r"\W", lambda m: f"_{ord(m[0]):x}_", f"__table_{self.id}_{'__'.join(key).lower()}")
        self.view.read(table).createOrReplaceTempView(name)
        return f"`{name}`"

    def _files(self, kind: str, path: str, options: dict[str, str]) -> str:
        """A view of files; CSV files have a header and CSV and JSON a schema that is looked for, unless told otherwise."""
        reader = self.spark.read
        if kind == "csv":
            reader = reader.option("header", options.get("header", "true")).option("inferSchema", options.get("all_varchar", "false") != "true")
            reader = reader.option("sep", options.get("delim", options.get("sep", ","))).option("quote", options.get("quote", '"')).option("escape", options.get("escape", '"')).option("multiLine", True)
        name = f"__files_{self.id}_{abs(hash((kind, path, *sorted(options.items())))):x}"
        (reader.json(path, multiLine=options.get("format") == "array") if kind == "json" else getattr(reader, kind)(path)).createOrReplaceTempView(name)
        return f"`{name}`"

    # -- tables without text -----------------------------------------------------------------

    def create_table(self, name: str, columns: list[Column], if_not_exists: bool = False) -> None:
        """A table of typed columns."""
        self.view.create(self.key(name.split(".")), columns, if_not_exists)

    def insert_data(self, name: str, columns: list[str], rows: list[tuple]) -> int:
        """Appends rows in one write; values are cast to the columns' types."""
        if not rows:
            return 0
        if any(len(r) != len(columns) for r in rows):
            raise InvalidValue("every row needs a value for each column")
        key = self.key(name.split("."))
        kinds = {c.name.upper(): f for c, f in zip(self.view.get(key).columns, self.view.get(key).schema, strict=True)}
        text = [[None if v is None else v if isinstance(v, (bytes, bytearray)) else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in rows]
        schema = ", ".join(f"`{c}` {'binary' if isinstance(kinds.get(c.upper(), None) and kinds[c.upper()].dataType, BinaryType) else 'string'}" for c in columns)
        return self.writer.insert_rows(key, self.spark.createDataFrame([tuple(r) for r in text], schema), columns)

    # -- running -------------------------------------------------------------------------

    def _text(self, items: list[Token]) -> str:
        return self._inlined(spell(Rewriter(self._relation, self._files).statement(items)))

    _args: dict | None = None

    def _inlined(self, text: str) -> str:
        """Parts of a statement that are put together carry their values as literals."""
        if not self._args:
            return text

        def spelt(m):
            v = self._args.get(m[1])
            if v is None:
                return "NULL"
            return str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, (int, float)) else f"cast({literal(str(v))} as {_KINDS.get(type(v).__name__, 'string')})"

        return re.sub(r"(?<![:\w]):(p\d+)\b", spelt, text)

    def _frame(self, items: list[Token]) -> DataFrame:
        return self.spark.sql(self._text(items))

    def translate(self, sql: str) -> str:
        """The statement as Spark gets it."""
        return Rewriter(self._relation, self._files)(sql)

    def query(self, sql: str, bindings: dict | list | None = None) -> DataFrame:
        """A lazy DataFrame of a query."""
        out = self.execute(sql, bindings)
        if out.frame is None:
            raise InvalidValue("the statement is no query")
        return out.frame

    sql = query

    def execute(self, sql: str, bindings: dict | list | None = None) -> Outcome:
        entry = self.engine.history.start(self.id, sql)
        try:
            out = self._execute(sql, bindings)
        except Exception as e:
            self.engine.history.end(entry, error=e)
            raise wrap(e) from e
        self.engine.history.end(entry, out.affected)
        return out

    def _execute(self, sql: str, bindings) -> Outcome:
        items = tokens(sql)
        while items and items[-1].up == ";":
            items.pop()
        if not items:
            raise SqlSyntaxError("empty statement")
        self._args = arguments(bindings)
        marks = iter(range(1, len(items) + 1))
        items = [Token("param", f":{next(marks)}") if t.text == "?" and t.kind == "param" else t for t in items]
        kind, first = classify(sql).kind, items[0].up
        self.engine.catalog.refresh()
        if kind == "query":
            return Outcome(self._query(items))
        if kind == "transaction":
            {"BEGIN": self.view.begin, "START": self.view.begin, "COMMIT": self.view.commit, "ROLLBACK": self.view.rollback}[first]()
            return Outcome()
        if kind in ("create", "drop", "alter"):
            return getattr(self, f"_{kind}")(items)
        if kind == "copy":
            got = self.loader.run(items, (self.database, self.schema))
            return Outcome(affected=got.rows_loaded, detail=got)
        if kind == "merge":
            got = self.writer.merge(items)
            return Outcome(affected=got.affected, detail=got)
        if first == "USE":
            return self._use(items)
        run = {"INSERT": self.writer.insert, "UPDATE": self.writer.update, "DELETE": self.writer.delete, "TRUNCATE": self.writer.truncate}.get(first)
        if not run:
            raise SqlSyntaxError(f"no such statement: {first}")
        got = run(items)
        return Outcome(affected=got.affected, detail=got)

    def _query(self, items: list[Token]) -> DataFrame:
        first = items[0].up
        if [t.up for t in items[:2]] in (["SELECT"], ["SELECT", "FROM"]):
            raise SqlSyntaxError("SELECT needs columns")
        if first == "SHOW":
            return self._show(items)
        if first in ("DESCRIBE", "DESC"):
            return self._describe(items)
        if first == "EXPLAIN":
            return self.spark.sql("EXPLAIN " + spell(Rewriter(self._relation, self._files).statement(items[1:])), args=self._args or None)
        text = spell(Rewriter(self._relation, self._files).statement(items))
        return self.spark.sql(text, args=self._args) if self._args else self.spark.sql(text)

    def _use(self, items: list[Token]) -> Outcome:
        what = items[1].up if items[1].up in ("DATABASE", "SCHEMA", "WAREHOUSE", "ROLE") and len(items) > 2 else ""
        parts, _ = dotted(items, 1 + bool(what))
        parts = [p.upper() for p in parts]
        if what in ("WAREHOUSE", "ROLE"):
            self.parameters[what] = parts[0]
        elif what == "SCHEMA" or len(parts) == 2:
            database = parts[0] if len(parts) == 2 else self.database
            self.engine.catalog.schema(database, parts[-1])
            self.database, self.schema = database, parts[-1]
        else:
            self.engine.catalog.database(parts[0])
            self.database, self.schema = parts[0], SCHEMA
        return Outcome()

    # -- definitions -----------------------------------------------------------------------

    def _create(self, items: list[Token]) -> Outcome:
        at, swap = 1, False
        while items[at].up in ("OR", "REPLACE", "TEMP", "TEMPORARY", "TRANSIENT"):
            swap |= items[at].up == "REPLACE"
            at += 1
        what, at = items[at].up, at + 1
        if what == "FILE":
            what, at = "FORMAT", at + 1
        lenient = [t.up for t in items[at : at + 3]] == ["IF", "NOT", "EXISTS"]
        parts, at = dotted(items, at + 3 * lenient)
        catalog = self.engine.catalog
        rest = items[at:]
        comment = rest[i + 2].value if (i := find(rest, "COMMENT", "=")) >= 0 else ""
        if what == "DATABASE":
            catalog.create_database(parts[0], comment, self.user, lenient)
        elif what == "SCHEMA":
            catalog.create_schema(parts[0] if len(parts) > 1 else self.database, parts[-1], comment, self.user, lenient)
        elif what == "STAGE":
            url = rest[i + 2].value if (i := find(rest, "URL", "=")) >= 0 else ""
            self.engine.stages.create(*self.key(parts), "EXTERNAL" if url else "INTERNAL", url, comment, lenient)
        elif what == "FORMAT":
            kind = next((rest[i + 2].text for i, t in enumerate(rest[:-2]) if t.up == "TYPE"), "CSV").strip("'")
            options = " ".join(t.text for t in rest)
            catalog.create_format(*self.key(parts), kind, options, comment)
        elif what == "TABLE":
            return self._create_table(self.key(parts), rest, lenient, swap, comment)
        elif what == "VIEW":
            as_ = find(rest, "AS")
            self.register(parts[-1], self._frame(rest[as_ + 1 :]))
        else:
            raise SqlSyntaxError(f"can't create {what}")
        return Outcome()

    def _create_table(self, key: Key, rest: list[Token], lenient: bool, swap: bool, comment: str) -> Outcome:
        columns: list[Column] = []
        if rest and rest[0].up == "(":
            end = closing(rest, 0)
            columns, rest = column_definitions(rest[1:end]), rest[end + 1 :]
        as_ = find(rest, "AS")
        if as_ < 0:
            like = find(rest, "LIKE")
            if like >= 0:
                columns = list(self.view.get(self.key(dotted(rest, like + 1)[0])).columns)
            self.view.create(key, columns, lenient, swap, comment)
            return Outcome()
        if lenient and key in self.view.tables:
            return Outcome()
        frame = self._frame(rest[as_ + 1 :])
        if not columns:
            columns = [Column(f.name.upper(), _declared(f.dataType)) for f in frame.schema]
        before = self.view.tables.get(key) if swap else None
        try:
            self.view.create(key, columns, False, swap, comment)
            return Outcome(affected=self.writer.insert_rows(key, frame))
        except Exception:
            if before is not None:
                self.view.put(key, self.view.tables.get(key), before)
            elif key in self.view.tables and not swap:
                self.view.put(key, self.view.tables[key], None)
            raise

    def _drop(self, items: list[Token]) -> Outcome:
        what, at = items[1].up, 2
        if what == "FILE":
            what, at = "FORMAT", 3
        lenient = [t.up for t in items[at : at + 2]] == ["IF", "EXISTS"]
        parts, _ = dotted(items, at + 2 * lenient)
        catalog = self.engine.catalog
        if what == "TABLE":
            self.view.drop(self.key(parts), lenient)
        elif what == "VIEW":
            if not self.frames.pop(parts[-1].upper(), None) and not lenient:
                raise NotFound(f"view {parts[-1]} does not exist")
        elif what == "SCHEMA":
            catalog.drop_schema(parts[0] if len(parts) > 1 else self.database, parts[-1], lenient)
        elif what == "DATABASE":
            catalog.drop_database(parts[0], lenient)
        elif what == "STAGE":
            self.engine.stages.drop(*self.key(parts), lenient)
        elif what == "FORMAT":
            catalog.drop_format(*self.key(parts))
        else:
            raise SqlSyntaxError(f"can't drop {what}")
        return Outcome()

    def _alter(self, items: list[Token]) -> Outcome:
        if items[1].up != "TABLE":
            raise SqlSyntaxError("only tables can be altered")
        parts, at = dotted(items, 2)
        key = self.key(parts)
        table, words = self.view.get(key), [t.up for t in items[at : at + 3]]
        if words[:1] == ["ADD"]:
            at += 1 + (words[1:2] == ["COLUMN"])
            new = column_definitions(items[at + 1 : closing(items, at)] if items[at].up == "(" else items[at:])
            if clash := {c.name.upper() for c in new} & {c.name.upper() for c in table.columns}:
                raise InvalidValue(f"column {sorted(clash)[0]} already exists")
            after = replace(table, columns=table.columns + tuple(new))
        elif words[:1] == ["DROP"]:
            name = items[at + 1 + (words[1:2] == ["COLUMN"])].name.upper()
            left = tuple(c for c in table.columns if c.name.upper() != name)
            if len(left) == len(table.columns) or not left:
                raise InvalidValue(f"can't drop column {name}")
            after = replace(table, columns=left)
        elif words[:2] == ["RENAME", "TO"]:
            other = self.key(dotted(items, at + 2)[0])
            if other in self.view.tables:
                raise InvalidValue(f"table {'.'.join(other)} already exists")
            self.view.put(other, None, table)
            self.view.put(key, table, None)
            return Outcome()
        elif words[:2] == ["SET", "COMMENT"]:
            after = replace(table, comment=items[-1].value)
        else:
            raise SqlSyntaxError(f"can't alter a table so: {spell(items[at:])}")
        self.view.put(key, table, after)
        return Outcome()

    # -- introspection -----------------------------------------------------------------------

    def _show(self, items: list[Token]) -> DataFrame:
        what = next((t.up for t in items[1:] if t.up not in ("TERSE", "FILE")), "")
        catalog, scope = self.engine.catalog, find(items, "IN")
        like = items[i + 1].value if (i := find(items, "LIKE")) >= 0 else "%"
        inside = [p.upper() for p in dotted(items, scope + 1 + (items[scope + 1].up in ("SCHEMA", "DATABASE")))[0]] if scope >= 0 else []
        database = inside[0] if inside else self.database
        if what == "TABLES":
            wanted = tuple(inside) if len(inside) == 2 else (database,) if inside else (self.database, self.schema)
            rows = [(k[2], k[0], k[1], t.table_type, len(t.columns), t.comment) for k, t in sorted(self.view.tables.items()) if k[: len(wanted)] == wanted]
            frame = "name string, database_name string, schema_name string, kind string, columns int, comment string"
        elif what == "SCHEMAS":
            rows, frame = [(s.name, s.parent, s.comment) for s in catalog.list_schemas(database)], "name string, database_name string, comment string"
        elif what == "DATABASES":
            rows, frame = [(d.name, d.owner, d.comment) for d in catalog.list_databases()], "name string, owner string, comment string"
        elif what == "COLUMNS":
            table = self.view.get(self.key(dotted(items, scope + 1 + (items[scope + 1].up == "TABLE"))[0]))
            rows, frame = [(c.name, c.type, c.nullable) for c in table.columns], "name string, type string, nullable boolean"
        elif what == "STAGES":
            rows = [(s.name, s.more["stage_type"], s.more["url"], s.comment) for s in self.engine.stages.list(self.database, self.schema)]
            frame = "name string, type string, url string, comment string"
        elif what == "FORMATS":
            rows = [(f.name, f.more["format_type"], f.more["options"]) for f in catalog.list_formats(self.database, self.schema)]
            frame = "name string, type string, options string"
        elif what == "WAREHOUSES":
            rows, frame = [(w.name, w.state, w.size) for w in self.engine.warehouses.list()], "name string, state string, size string"
        elif what == "PARAMETERS":
            rows, frame = sorted(self.parameters.items()), "key string, value string"
        else:
            return self.spark.sql(spell(items))
        out = self.spark.createDataFrame(rows, frame)
        return out.where(out[out.columns[0]].ilike(like)) if like != "%" else out

    def _describe(self, items: list[Token]) -> DataFrame:
        at = 1 + (items[1].up == "TABLE")
        parts, _ = dotted(items, at)
        if len(parts) == 1 and parts[0].upper() in self.frames:
            rows = [(f.name, f.dataType.simpleString(), "Y" if f.nullable else "N", None, "N") for f in self.frames[parts[0].upper()].schema]
        else:
            rows = [(c.name, c.type, "Y" if c.nullable else "N", c.default, "Y" if c.primary_key else "N") for c in self.view.get(self.key(parts)).columns]
        return self.spark.createDataFrame(rows, "name string, type string, `null?` string, default string, `primary key` string")


_KINDS = {"date": "date", "datetime": "timestamp_ntz", "time": "time", "Decimal": "decimal(38,18)"}


def _declared(kind) -> str:
    """A declared type that stores what a query's column holds."""
    text = kind.simpleString().upper()
    return {"BIGINT": "BIGINT", "STRING": "VARCHAR", "TIMESTAMP": "TIMESTAMP_LTZ", "TIME(6)": "TIME"}.get(text, text if "<" not in text else "VARIANT")


def column_definitions(items: list[Token]) -> list[Column]:
    """Columns of a table's definition, with its table-level primary key."""
    out: list[Column] = []
    keys: set[str] = set()
    ends = {"NOT", "NULL", "DEFAULT", "PRIMARY", "UNIQUE", "COMMENT", "REFERENCES", "CHECK", "COLLATE", "AUTOINCREMENT", "IDENTITY", "CONSTRAINT"}
    for part in split(items):
        while part and part[0].up == "CONSTRAINT":
            part = part[2:]
        if [t.up for t in part[:2]] == ["PRIMARY", "KEY"]:
            keys |= {p[-1].name.upper() for p in split(part[3:-1])}
            continue
        if part[0].up in ("UNIQUE", "FOREIGN", "CHECK"):
            continue
        if part[0].kind not in ("word", "quoted"):
            raise SqlSyntaxError(f"no column: {spell(part)}")
        at = 1
        while at < len(part) and part[at].up not in ends:
            at = closing(part, at) + 1 if part[at].up == "(" else at + 1
        kind, rest = "".join(f" {t.text}" if t.kind == "word" else t.text for t in part[1:at]).strip(), part[at:]
        words = [t.up for t in rest]
        not_null = any(a == "NOT" and b == "NULL" for a, b in zip(words, words[1:], strict=False))
        default = None
        if "DEFAULT" in words:
            i = words.index("DEFAULT") + 1
            j = i + 1
            while j < len(rest) and rest[j].up not in ends:
                j += 1
            default = spell(rest[i:j])
        out.append(Column(part[0].name, kind or "VARCHAR", not not_null, "PRIMARY" in words, default))
    if missing := keys - {c.name.upper() for c in out}:
        raise InvalidValue(f"no such column: {sorted(missing)[0]}")
    return [Column(c.name, c.type, c.nullable, c.primary_key or c.name.upper() in keys, c.default) for c in out]
