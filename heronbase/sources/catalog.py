"""Databases, schemas, tables, stages and file formats, with tables as lists of Parquet files.

A table's state is immutable: its schema and the files that make it up.  A change
writes new files and swaps the state; what is not touched is carried over, so an
insert costs what it inserts, and an update or delete rewrites the files that hold
matching rows.  Readers keep the state that they began with.  A transaction is a map
of states of its own, published in one step.

What is kept is a log: each commit is a small file with the objects that it changes and,
for tables, the data files that come and go.  A commit's number can be claimed once, so
of two engines on one warehouse the later one sees what the other has done, takes it up
where it touches other objects, and raises Conflict where it does not.  Every
``CHECKPOINT`` commits the whole state is written beside the log.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from heronbase.errors import AlreadyExists, Conflict, InvalidValue, NotFound
from heronbase.sources.files import Store
from heronbase.types import spark_type

DATABASE, SCHEMA = "TEST_DB", "PUBLIC"
Key = tuple[str, str, str]


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True
    primary_key: bool = False
    default: str | None = None

    def field(self) -> StructField:
        meta = {"primary_key": self.primary_key} | ({"default": self.default} if self.default is not None else {})
        return StructField(self.name, spark_type(self.type), True, meta)

    def text(self) -> str:
        return f"{self.name}:{self.type}:{str(self.nullable).lower()}:{str(self.primary_key).lower()}:{self.default or ''}"


@dataclass(frozen=True)
class Table:
    id: str
    columns: tuple[Column, ...]
    files: tuple[str, ...] = ()
    comment: str = ""
    created_at: float = 0.0
    owner: str = ""
    table_type: str = "BASE TABLE"

    @property
    def schema(self) -> StructType:
        return StructType([c.field() for c in self.columns])

    def column_definitions(self) -> str:
        return ";".join(c.text() for c in self.columns)


@dataclass
class Named:
    """A database, schema, stage or file format."""

    id: str
    name: str
    parent: str = ""
    comment: str = ""
    owner: str = ""
    created_at: float = 0.0
    more: dict = field(default_factory=dict)


def upper(name: str) -> str:
    name = name.strip().upper()
    if not name:
        raise InvalidValue("a name is needed")
    return name


#: Commits from one copy of the whole state to the next.
CHECKPOINT = 64
KINDS = ("databases", "schemas", "stages", "formats", "tables")


class Catalog:
    """All metadata, as of some commit of the warehouse's log."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.store, self.lock = spark, Store(spark, warehouse), threading.RLock()
        self.databases: dict[str, Named] = {}
        self.schemas: dict[tuple[str, str], Named] = {}
        self.stages: dict[Key, Named] = {}
        self.formats: dict[Key, Named] = {}
        self.tables: dict[Key, Table] = {}
        #: The state of the last commit seen, and its number.
        self.kept: dict[str, dict] = {k: {} for k in KINDS}
        self.at = 0
        whole = [n for n, _ in self.store.files("log") if n.endswith(".whole.json")]
        if whole:
            self._apply(json.loads(self.store.read("log", max(whole))))
            self.at = int(max(whole).split(".")[0])
        self.refresh()

    # -- keeping ---------------------------------------------------------------------

    @staticmethod
    def _file(n: int, kind: str = "") -> str:
        return f"{n:012}{kind}.json"

    def _apply(self, commit: dict) -> dict[str, set]:
        """Takes a commit's changes into the kept and the current state; which objects they are."""
        touched = {}
        for kind in KINDS:
            kept, now, touched[kind] = self.kept[kind], getattr(self, kind), set()
            for name in commit.get("gone", {}).get(kind, []):
                key = name if kind == "databases" else tuple(name)
                kept.pop(key, None), now.pop(key, None)
                touched[kind].add(key)
            for name, data in commit.get("set", {}).get(kind, []):
                key = name if kind == "databases" else tuple(name)
                if kind == "tables":
                    less, more = set(data.pop("less", ())), tuple(data.pop("files"))
                    files = tuple(f for f in kept[key].files if f not in less) if key in kept and data.pop("goes_on", False) else ()
                    data.pop("goes_on", None)
                    kept[key] = now[key] = Table(**data | {"columns": tuple(Column(**c) for c in data["columns"]), "files": files + more})
                else:
                    kept[key] = now[key] = Named(**data)
                touched[kind].add(key)
        return touched

    def refresh(self) -> dict[str, set]:
        """Takes up what others have committed."""
        with self.lock:
            touched: dict[str, set] = {k: set() for k in KINDS}
            while self.store.exists("log", self._file(self.at + 1)):
                for kind, keys in self._apply(json.loads(self.store.read("log", self._file(self.at + 1)))).items():
                    touched[kind] |= keys
                self.at += 1
            return touched

    def _changes(self) -> tuple[dict, dict[str, set]]:
        """What differs from the kept state, as a commit and as sets of keys."""
        commit, keys = {"set": {}, "gone": {}}, {}
        for kind in KINDS:
            kept, now = self.kept[kind], getattr(self, kind)
            new, gone = [k for k, v in now.items() if kept.get(k) is not v], [k for k in kept if k not in now]
            keys[kind] = {*new, *gone}
            plain = lambda k: k if isinstance(k, str) else list(k)
            if gone:
                commit["gone"][kind] = [plain(k) for k in gone]
            if new:
                commit["set"][kind] = [[plain(k), self._delta(kept.get(k), now[k]) if kind == "tables" else asdict(now[k])] for k in new]
        return commit, keys

    @staticmethod
    def _delta(before: Table | None, after: Table) -> dict:
        data = asdict(replace(after, files=()))
        if before is None:
            return data | {"files": list(after.files)}
        had, has = set(before.files), set(after.files)
        return data | {"files": [f for f in after.files if f not in had], "less": [f for f in before.files if f not in has], "goes_on": True}

    def save(self) -> None:
        """Commits what has changed; raises Conflict, and takes the changes back, if another engine has changed one of the same objects."""
        commit, keys = self._changes()
        if not any(keys.values()):
            return
        mine = {k: {x: getattr(self, k).get(x) for x in keys[k]} for k in KINDS}
        while not self.store.claim(json.dumps(commit).encode(), "log", self._file(self.at + 1)):
            touched = self.refresh()
            if clash := [x for k in KINDS for x in touched[k] & keys[k]]:
                for kind in KINDS:
                    setattr(self, kind, dict(self.kept[kind]))
                raise Conflict(f"changed meanwhile: {', '.join(x if isinstance(x, str) else '.'.join(x) for x in sorted(clash, key=str))}")
        self.at += 1
        for kind in KINDS:
            for key, value in mine[kind].items():
                if value is None:
                    self.kept[kind].pop(key, None)
                else:
                    self.kept[kind][key] = value
        if self.at % CHECKPOINT == 0:
            whole = {"set": {k: [[x if isinstance(x, str) else list(x), asdict(v)] for x, v in self.kept[k].items()] for k in KINDS}}
            self.store.write(json.dumps(whole).encode(), "log", self._file(self.at, ".whole"))

    @staticmethod
    def _named(name: str, parent: str = "", comment: str = "", owner: str = "", **more) -> Named:
        return Named(str(uuid.uuid4()), name, parent, comment, owner, time.time(), more)

    # -- databases and schemas ---------------------------------------------------------

    def create_database(self, name: str, comment: str = "", owner: str = "", if_not_exists: bool = False) -> Named:
        with self.lock:
            name = upper(name)
            if name in self.databases:
                if if_not_exists:
                    return self.databases[name]
                raise AlreadyExists(f"database {name} already exists")
            self.databases[name] = self._named(name, comment=comment, owner=owner)
            self.schemas[name, SCHEMA] = self._named(SCHEMA, name)
            self.save()
            return self.databases[name]

    def database(self, name: str) -> Named:
        found = self.databases.get(upper(name)) or next((d for d in self.databases.values() if d.id == name), None)
        if not found:
            raise NotFound(f"database {name} does not exist")
        return found

    def list_databases(self) -> list[Named]:
        return sorted(self.databases.values(), key=lambda d: d.name)

    def comment_database(self, name: str, comment: str) -> None:
        with self.lock:
            found = self.database(name)
            self.databases[found.name] = replace(found, comment=comment)
            self.save()

    def drop_database(self, name: str, if_exists: bool = False) -> None:
        with self.lock:
            name = upper(name)
            if name not in self.databases:
                if if_exists:
                    return
                raise NotFound(f"database {name} does not exist")
            schemas = [k for k in self.schemas if k[0] == name]
            for key in schemas:
                self._forget(key)
            del self.databases[name]
            self.save()
            for key in schemas:
                self._erase(key)

    def create_schema(self, database: str, name: str, comment: str = "", owner: str = "", if_not_exists: bool = False) -> Named:
        with self.lock:
            key = (self.database(database).name, upper(name))
            if key in self.schemas:
                if if_not_exists:
                    return self.schemas[key]
                raise AlreadyExists(f"schema {'.'.join(key)} already exists")
            self.schemas[key] = self._named(key[1], key[0], comment, owner)
            self.save()
            return self.schemas[key]

    def schema(self, database: str, name: str) -> Named:
        key = (upper(database), upper(name))
        if key not in self.schemas:
            raise NotFound(f"schema {'.'.join(key)} does not exist")
        return self.schemas[key]

    def list_schemas(self, database: str) -> list[Named]:
        name = self.database(database).name
        return sorted((s for k, s in self.schemas.items() if k[0] == name), key=lambda s: s.name)

    def drop_schema(self, database: str, name: str, if_exists: bool = False) -> None:
        with self.lock:
            key = (upper(database), upper(name))
            if key not in self.schemas:
                if if_exists:
                    return
                raise NotFound(f"schema {'.'.join(key)} does not exist")
            self._forget(key)
            self.save()
            self._erase(key)

    def _forget(self, key: tuple[str, str]) -> None:
        for held in (self.tables, self.stages, self.formats):
            for k in [k for k in held if k[:2] == key]:
                del held[k]
        del self.schemas[key]

    def _erase(self, key: tuple[str, str]) -> None:
        self.store.delete("tables", *key)
        self.store.delete("stages", *key)

    # -- file formats --------------------------------------------------------------------

    def create_format(self, database: str, schema: str, name: str, kind: str, options: str = "", comment: str = "") -> Named:
        with self.lock:
            self.schema(database, schema)
            key = (upper(database), upper(schema), upper(name))
            if key in self.formats:
                raise AlreadyExists(f"file format {'.'.join(key)} already exists")
            self.formats[key] = self._named(key[2], ".".join(key[:2]), comment, format_type=kind.upper(), options=options)
            self.save()
            return self.formats[key]

    def format(self, database: str, schema: str, name: str) -> Named:
        key = (upper(database), upper(schema), upper(name))
        if key not in self.formats:
            raise NotFound(f"file format {'.'.join(key)} does not exist")
        return self.formats[key]

    def list_formats(self, database: str, schema: str) -> list[Named]:
        return sorted((f for k, f in self.formats.items() if k[:2] == (upper(database), upper(schema))), key=lambda f: f.name)

    def drop_format(self, database: str, schema: str, name: str) -> None:
        with self.lock:
            self.format(database, schema, name)
            del self.formats[upper(database), upper(schema), upper(name)]
            self.save()


class View:
    """A session's sight of the tables: the catalog's, or within a transaction its own."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.spark = catalog, catalog.spark
        self.began: dict[Key, Table] | None = None
        self.own: dict[Key, Table] = {}

    @property
    def tables(self) -> dict[Key, Table]:
        return self.own if self.began is not None else self.catalog.tables

    def begin(self) -> None:
        with self.catalog.lock:
            self.catalog.refresh()
            if self.began is None:
                self.began, self.own = dict(self.catalog.tables), dict(self.catalog.tables)

    def commit(self) -> None:
        with self.catalog.lock:
            if self.began is None:
                return
            began, own = self.began, self.own
            changed = {k for k in began.keys() | own.keys() if began.get(k) is not own.get(k)}
            self.began = None
            self.catalog.refresh()
            if clash := [k for k in changed if self.catalog.tables.get(k) is not began.get(k)]:
                raise Conflict(f"changed meanwhile: {', '.join('.'.join(k) for k in sorted(clash))}")
            for k in changed:
                if k in own:
                    self.catalog.tables[k] = own[k]
                else:
                    self.catalog.tables.pop(k, None)
            if changed:
                self.catalog.save()

    def rollback(self) -> None:
        self.began, self.own = None, {}

    def put(self, key: Key, before: Table | None, after: Table | None) -> None:
        """Swaps a table's state, unless someone else has."""
        with self.catalog.lock:
            if self.tables.get(key) is not before:
                raise Conflict(f"table {'.'.join(key)} was changed meanwhile")
            if after is None:
                self.tables.pop(key, None)
            else:
                self.tables[key] = after
            if self.began is None:
                self.catalog.save()

    def get(self, key: Key) -> Table:
        found = self.tables.get(key)
        if not found:
            raise NotFound(f"table {'.'.join(key)} does not exist")
        return found

    def create(self, key: Key, columns: list[Column], if_not_exists: bool = False, replace_: bool = False, comment: str = "") -> Table:
        self.catalog.schema(*key[:2])
        before = self.tables.get(key)
        if before and not replace_:
            if if_not_exists:
                return before
            raise AlreadyExists(f"table {'.'.join(key)} already exists")
        if not columns:
            raise InvalidValue("a table needs at least one column")
        names = [c.name.upper() for c in columns]
        if len(set(names)) < len(names):
            raise InvalidValue("column names must differ")
        table = Table(str(uuid.uuid4()), tuple(columns), comment=comment, created_at=time.time())
        self.put(key, before, table)
        return table

    def drop(self, key: Key, if_exists: bool = False) -> None:
        before = self.tables.get(key)
        if not before:
            if if_exists:
                return
            raise NotFound(f"table {'.'.join(key)} does not exist")
        self.put(key, before, None)

    def read(self, table: Table) -> DataFrame:
        if not table.files:
            return self.spark.createDataFrame([], table.schema)
        return self.spark.read.schema(table.schema).parquet(*table.files)

    def written(self, key: Key, df: DataFrame) -> tuple[str, ...]:
        """Writes ``df`` as new files of the table."""
        part = ("tables", *key, uuid.uuid4().hex)
        df.write.parquet(self.catalog.store.url(*part))
        return tuple(self.catalog.store.url(*part, name) for name, size in self.catalog.store.files(*part) if name.endswith(".parquet"))

    def counted(self, key: Key, df: DataFrame) -> tuple[tuple[str, ...], int]:
        """The same, and the number of rows, counted as they are written."""
        seen = Observation()
        files = self.written(key, df.observe(seen, F.count(F.lit(1)).alias("n")))
        return files, seen.get["n"]

    def comment(self, key: Key, comment: str) -> None:
        before = self.get(key)
        self.put(key, before, replace(before, comment=comment))
