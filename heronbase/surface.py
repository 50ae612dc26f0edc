"""Parts of the engine that have no result table of their own, as queries: what was found beside what is to be found.

Each does something through the engine's interfaces and tells facts by name; the oracle's
SQL lists the same facts as constants.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heronbase.bindings import value
from heronbase.catalogue import QUERIES, SQL, opened
from heronbase.errors import AlreadyExists, Conflict, DuplicateMatch, EngineError, InvalidValue, NotFound, SessionError, SqlSyntaxError, wrap
from heronbase.operators.dml import parse_merge
from heronbase.plans import classify as C
from heronbase.session import Engine, Session
from heronbase.sources.catalog import Column
from heronbase.sources.copy_into import parse_copy
from heronbase.statements import Statements
from heronbase.types import wire_name

DB, PUBLIC = "TEST_DB", "PUBLIC"


def shown(x: object) -> str:
    if isinstance(x, (list, tuple)):
        return ",".join(map(shown, x))
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


def facts(name: str, expected: dict[str, object]):
    """A query of facts; ``expected`` is what the oracle says."""

    def add(f: Callable[[Session], dict[str, object]]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(opened(spark, sf_dir))
            return spark.createDataFrame([(k, shown(v)) for k, v in found.items()], "fact string, value string")

        quoted = lambda x: "'" + shown(x).replace("'", "''") + "'"
        QUERIES[name] = run
        SQL[name] = f"SELECT * FROM (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in expected.items())}) t(fact, value)"
        return f

    return add


def error(call: Callable, *args, **more) -> str:
    """The kind of error that a call raises."""
    try:
        call(*args, **more)
    except Exception as e:
        return type(wrap(e)).__name__
    return "none"


def table(session: Session, name: str = "t", columns: str = "id INTEGER, name VARCHAR") -> None:
    session.execute(f"CREATE TABLE {name} ({columns})")


def staged(session: Session, **files: str) -> None:
    session.execute("CREATE STAGE st")
    for name, text in files.items():
        session.engine.stages.put(DB, PUBLIC, "st", name.replace("__", "/") + ".csv", text.encode())


def rows(session: Session, sql: str) -> list:
    return sorted((tuple(r) for r in session.query(sql).collect()), key=repr)


# -- statements -----------------------------------------------------------------------------


@facts("api_classify", {
    "SELECT 1": "query,1", "-- x\nWITH a AS (SELECT 1) SELECT * FROM a": "query,1", "(SELECT 1)": "query,1", "VALUES (1)": "query,1", "show tables": "query,1", "DESC t": "query,1", "EXPLAIN SELECT 1": "query,1",
    "INSERT INTO t VALUES (1)": "dml,3", "UPDATE t SET a = 1": "dml,3", "CREATE TABLE t (a INT)": "create,4", "DROP TABLE t": "drop,5", "ALTER TABLE t ADD a INT": "alter,4", "COPY INTO t FROM @s": "copy,3", "MERGE INTO t USING s ON 1=1": "merge,3", "BEGIN": "transaction,3",
})
def _classify(session):
    texts = ["SELECT 1", "-- x\nWITH a AS (SELECT 1) SELECT * FROM a", "(SELECT 1)", "VALUES (1)", "show tables", "DESC t", "EXPLAIN SELECT 1", "INSERT INTO t VALUES (1)", "UPDATE t SET a = 1", "CREATE TABLE t (a INT)", "DROP TABLE t", "ALTER TABLE t ADD a INT", "COPY INTO t FROM @s", "MERGE INTO t USING s ON 1=1", "BEGIN"]
    return {t: (C.classify(t).kind, C.statement_type_id(t)) for t in texts}


@facts("api_statement_helpers", {"create table": "true,true", "drop table": "true,false", "copy": "true,false", "merge": "true,false", "transaction": "true,true,true,false", "begin": "true,true,false", "commit": "true,false", "rollback": "true,false", "query": "true,false", "ddl": "true,true,false"})
def _helpers(session):
    return {
        "create table": [C.is_create_table("create table t (a int)"), C.is_create_table("CREATE OR REPLACE TEMP TABLE t (a INT)")], "drop table": [C.is_drop_table("DROP TABLE t"), C.is_drop_table("DROP SCHEMA t")],
        "copy": [C.is_copy("COPY INTO t FROM @s"), C.is_copy("SELECT 'COPY INTO'")], "merge": [C.is_merge("MERGE INTO t USING s ON a = b"), C.is_merge("SELECT 1")],
        "transaction": [C.is_transaction(x) for x in ("BEGIN", "COMMIT", "ROLLBACK", "SELECT 1")], "begin": [C.is_begin(x) for x in ("BEGIN TRANSACTION", "start transaction", "COMMIT")],
        "commit": [C.is_commit("commit"), C.is_commit("BEGIN")], "rollback": [C.is_rollback("ROLLBACK"), C.is_rollback("COMMIT")], "query": [C.is_query("SELECT 1"), C.is_query("DROP TABLE t")],
        "ddl": [C.is_ddl("CREATE SCHEMA s"), C.is_ddl("ALTER TABLE t ADD a INT"), C.is_ddl("DELETE FROM t")],
    }


@facts("api_parse_merge", {"target": "A,B,T", "alias": "X", "source alias": "S", "actions": "DELETE,UPDATE,INSERT", "conditions": "true,false,true", "set": "V,W", "insert": "ID,V", "no using": "SqlSyntaxError", "no when": "SqlSyntaxError", "insert for matches": "SqlSyntaxError"})
def _parse_merge(session):
    m = parse_merge("MERGE INTO a.b.t x USING (SELECT 1 AS id) AS s ON x.id = s.id WHEN MATCHED AND s.id > 3 THEN DELETE WHEN MATCHED THEN UPDATE SET x.v = CASE WHEN 1 = 1 THEN 2 END, w = 3 WHEN NOT MATCHED AND s.id < 9 THEN INSERT (id, v) VALUES (s.id, 'THEN')")
    return {
        "target": m.target, "alias": m.alias, "source alias": m.source_alias, "actions": [w.action for w in m.whens], "conditions": [bool(w.condition) for w in m.whens], "set": [n for n, _ in m.whens[1].assign], "insert": [n for n, _ in m.whens[2].assign],
        "no using": error(parse_merge, "MERGE INTO t ON a = b WHEN MATCHED THEN DELETE"), "no when": error(parse_merge, "MERGE INTO t USING s ON t.a = s.a"), "insert for matches": error(parse_merge, "MERGE INTO t USING s ON 1=1 WHEN MATCHED THEN INSERT VALUES (1)"),
    }


@facts("dml_merge_counts", {"updated, deleted, inserted, affected": "2,1,1,4", "rows": "1,one,2,two,4,four"})
def _merge_counts(session):
    table(session)
    session.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b'), (3, 'c')")
    got = session.execute("MERGE INTO t USING (SELECT * FROM VALUES (1, 'one'), (2, 'two'), (3, 'x'), (4, 'four') AS v(id, name)) s ON t.id = s.id WHEN MATCHED AND s.id = 3 THEN DELETE WHEN MATCHED THEN UPDATE SET name = s.name WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.id, s.name)")
    return {"updated, deleted, inserted, affected": (got.detail.updated, got.detail.deleted, got.detail.inserted, got.affected), "rows": rows(session, "SELECT * FROM t")}


# -- loading ----------------------------------------------------------------------------------


@facts("api_parse_copy", {
    "target": "D,S,T", "stage": "ST", "path": "in/x", "format": "CSV,|,3,true", "pattern": "a*.csv", "files": "a.csv,b.csv", "on error": "CONTINUE", "flags": "true,RETURN_ERRORS", "null if": "NA,-", "dates": "DD.MM.YYYY",
    "defaults": "CSV,,,\n,0,false,false,ABORT,false,", "odd spacing": "JSON,true,true", "no stage": "SqlSyntaxError",
})
def _parse_copy(session):
    c = parse_copy("COPY INTO d.s.t FROM @st/in/x FILE_FORMAT=(TYPE=CSV, FIELD_DELIMITER = '|' SKIP_HEADER=3 TRIM_SPACE=TRUE NULL_IF=('NA','-') DATE_FORMAT='DD.MM.YYYY') PATTERN='a*.csv' FILES = ('a.csv', 'b.csv') ON_ERROR=CONTINUE PURGE=TRUE VALIDATION_MODE = RETURN_ERRORS")
    d, o = parse_copy("COPY INTO t FROM @st"), parse_copy("copy  into t\nfrom @st file_format=(type=json strip_outer_array  =  true) purge\n=true")
    return {
        "target": c.target, "stage": c.stage, "path": c.path, "format": (c.format.type, c.format.field_delimiter, c.format.skip_header, c.format.trim_space), "pattern": c.pattern, "files": c.files, "on error": c.on_error, "flags": (c.purge, c.validation_mode),
        "null if": c.format.null_if, "dates": c.format.date_format, "defaults": (d.format.type, d.format.field_delimiter, d.format.record_delimiter, d.format.skip_header, d.format.trim_space, d.format.strip_outer_array, d.on_error, d.purge, d.validation_mode),
        "odd spacing": (o.format.type, o.format.strip_outer_array, o.purge), "no stage": error(parse_copy, "COPY INTO t FROM 'x'"),
    }


@facts("copy_result", {"no files": "0,0,0", "loaded": "3,3,2,0", "with a bad file": "1,1", "validated": "2,0,1", "rows": 4})
def _copy_result(session):
    table(session)
    session.execute("CREATE STAGE empty")
    none = session.execute("COPY INTO t FROM @empty").detail
    staged(session, good__a="1,a\n2,b\n", good__b="3,c\n", bad__a="x,y\n", bad__b="4,d\n")
    got = session.execute("COPY INTO t FROM @st/good").detail
    part = session.execute("COPY INTO t FROM @st/bad ON_ERROR = CONTINUE").detail
    checked = session.execute("COPY INTO t FROM @st FILES = ('good/a.csv') VALIDATION_MODE = RETURN_ERRORS").detail
    return {"no files": (none.rows_loaded, none.files_loaded, len(none.errors)), "loaded": (got.rows_loaded, got.rows_inserted, got.files_loaded, len(got.errors)), "with a bad file": (part.files_loaded, len(part.errors)), "validated": (checked.rows_loaded, checked.rows_inserted, checked.files_loaded), "rows": session.query("SELECT COUNT(*) FROM t").first()[0]}


@facts("copy_record_delimiter", {"rows": "1,a,2,b,3,c"})
def _record_delimiter(session):
    table(session)
    staged(session, a="1,a;2,b;3,c")
    session.execute("COPY INTO t FROM @st FILE_FORMAT = (TYPE = CSV RECORD_DELIMITER = ';')")
    return {"rows": rows(session, "SELECT * FROM t")}


@facts("copy_purge", {"validated": "a.csv,b.csv", "by pattern": "b.csv", "rows": 1})
def _purge(session):
    table(session)
    staged(session, a="1,a\n", b="2,b\n")
    left = lambda: [f for f, _ in session.engine.stages.files(DB, PUBLIC, "st")]
    session.execute("COPY INTO t FROM @st VALIDATION_MODE = RETURN_ERRORS PURGE = TRUE")
    first = left()
    session.execute("COPY INTO t FROM @st PATTERN = 'a*' PURGE = TRUE")
    return {"validated": first, "by pattern": left(), "rows": session.query("SELECT COUNT(*) FROM t").first()[0]}


@facts("api_stages", {"created": "ST,INTERNAL,note", "again": "AlreadyExists", "lenient": "none", "listed": "EXT,ST", "dropped": "EXT", "missing": "NotFound", "lenient drop": "none", "files of an external one": "InvalidValue"})
def _stages(session):
    s = session.engine.stages
    session.execute("CREATE STAGE st COMMENT = 'note'")
    session.execute("CREATE STAGE ext URL = 's3://x/'")
    made = s.get(DB, PUBLIC, "st")
    out = {"created": (made.name, made.more["stage_type"], made.comment), "again": error(s.create, DB, PUBLIC, "st"), "lenient": error(session.execute, "CREATE STAGE IF NOT EXISTS st"), "listed": [x.name for x in s.list(DB, PUBLIC)], "files of an external one": error(s.files, DB, PUBLIC, "ext")}
    s.drop(DB, PUBLIC, "st")
    return out | {"dropped": [x.name for x in s.list(DB, PUBLIC)], "missing": error(s.get, DB, PUBLIC, "st"), "lenient drop": error(session.execute, "DROP STAGE IF EXISTS st")}


@facts("api_stage_files", {"listed": "a/b.csv,c.txt", "by pattern": "a/b.csv", "below": "a/b.csv", "read": "xy", "refused": "InvalidValue,InvalidValue,InvalidValue,InvalidValue", "removed": "c.txt", "missing": "NotFound,NotFound"})
def _stage_files(session):
    s, at = session.engine.stages, (DB, PUBLIC, "st")
    s.create(*at)
    s.put(*at, "a/b.csv", b"xy")
    s.put(*at, "c.txt", b"z")
    names = lambda **k: [f for f, _ in s.files(*at, **k)]
    out = {"listed": names(), "by pattern": names(pattern="*.csv"), "below": names(below="a"), "read": s.read(*at, "a/b.csv").decode(), "refused": [error(s.put, *at, x, b"") for x in ("../x", "/x", "a/../b", "")]}
    s.remove(*at, "a/b.csv")
    return out | {"removed": names(), "missing": [error(s.read, *at, "a/b.csv"), error(s.remove, *at, "q")]}


@facts("api_file_formats", {"made": "F,CSV", "again": "AlreadyExists", "listed": "F,G", "dropped": "G", "missing": "NotFound", "used": "1,a"})
def _formats(session):
    c = session.engine.catalog
    session.execute("CREATE FILE FORMAT f TYPE = CSV FIELD_DELIMITER = '|'")
    c.create_format(DB, PUBLIC, "g", "json")
    f = c.format(DB, PUBLIC, "f")
    table(session)
    staged(session, a="1|a\n")
    session.execute("COPY INTO t FROM @st FILE_FORMAT = f")
    out = {"made": (f.name, f.more["format_type"]), "again": error(c.create_format, DB, PUBLIC, "f", "CSV"), "listed": [x.name for x in c.list_formats(DB, PUBLIC)], "used": rows(session, "SELECT * FROM t")}
    session.execute("DROP FILE FORMAT f")
    return out | {"dropped": [x.name for x in c.list_formats(DB, PUBLIC)], "missing": error(c.format, DB, PUBLIC, "f")}


@facts("api_typed_tables", {"inserted": 2, "rows": "1,2.50,true,2024-01-02,2,,false,", "no rows": 0, "ragged": "InvalidValue", "null key": "EngineError", "no such schema": "NotFound"})
def _typed(session):
    session.create_table("typed", [Column("ID", "INTEGER", primary_key=True), Column("V", "NUMBER(10,2)"), Column("B", "BOOLEAN"), Column("D", "DATE")])
    n = session.insert_data("typed", ["id", "v", "b", "d"], [(1, 2.5, True, "2024-01-02"), (2, None, False, None)])
    return {"inserted": n, "rows": rows(session, "SELECT * FROM typed"), "no rows": session.insert_data("typed", ["id"], []), "ragged": error(session.insert_data, "typed", ["id", "v"], [(1,)]), "null key": error(session.insert_data, "typed", ["id"], [(None,)]), "no such schema": error(session.create_table, "test_db.nowhere.t", [Column("A", "INTEGER")])}


# -- catalog ----------------------------------------------------------------------------------


@facts("ddl_drop", {"dropped": "NotFound", "again": "NotFound", "lenient": "none", "schema": "NotFound", "its tables": "NotFound", "database": "NotFound", "other kind": "SqlSyntaxError"})
def _drop(session):
    table(session)
    session.execute("DROP TABLE t")
    out = {"dropped": error(session.query, "SELECT * FROM t"), "again": error(session.execute, "DROP TABLE t"), "lenient": error(session.execute, "DROP TABLE IF EXISTS t"), "other kind": error(session.execute, "DROP FUNCTION f")}
    session.execute("CREATE SCHEMA s")
    table(session, "s.t")
    session.execute("DROP SCHEMA s")
    out |= {"schema": error(session.execute, "USE SCHEMA s"), "its tables": error(session.query, "SELECT * FROM test_db.s.t")}
    session.execute("CREATE DATABASE d")
    session.execute("DROP DATABASE d")
    return out | {"database": error(session.execute, "USE DATABASE d")}


@facts("api_databases", {"created": "D,me,c", "again": "AlreadyExists", "by id": "D", "listed": "D,TEST_DB", "comment": "new", "own schema": "PUBLIC", "dropped": "TEST_DB", "missing": "NotFound", "no name": "InvalidValue"})
def _databases(session):
    c = session.engine.catalog
    d = c.create_database("d", "c", "me")
    out = {"created": (d.name, d.owner, d.comment), "again": error(c.create_database, "D"), "by id": c.database(d.id).name, "listed": [x.name for x in c.list_databases()], "own schema": [x.name for x in c.list_schemas("d")], "no name": error(c.create_database, " ")}
    c.comment_database("d", "new")
    out["comment"] = c.database("d").comment
    c.drop_database("d")
    return out | {"dropped": [x.name for x in c.list_databases()], "missing": error(c.database, "d")}


@facts("api_schemas", {"created": "S,TEST_DB", "again": "AlreadyExists", "listed": "PUBLIC,S", "no database": "NotFound", "dropped": "PUBLIC", "its tables": 0, "its stages": 0})
def _schemas(session):
    c = session.engine.catalog
    s = c.create_schema(DB, "s")
    out = {"created": (s.name, s.parent), "again": error(c.create_schema, DB, "S"), "listed": [x.name for x in c.list_schemas(DB)], "no database": error(c.create_schema, "nope", "s")}
    table(session, "test_db.s.t")
    session.engine.stages.create(DB, "s", "st")
    c.drop_schema(DB, "s")
    return out | {"dropped": [x.name for x in c.list_schemas(DB)], "its tables": len(c.tables), "its stages": len(c.stages)}


@facts("api_tables", {"columns": "ID:INTEGER:true:true:;N:VARCHAR(5):false:false:;V:NUMBER(10,2):true:false:7", "no columns": "InvalidValue", "equal names": "InvalidValue", "no such key": "InvalidValue", "comment": "c", "listed": "T", "or replace": 0, "renamed": "U"})
def _tables(session):
    table(session, "t", "id INTEGER, n VARCHAR(5) NOT NULL, v NUMBER(10,2) DEFAULT 7, PRIMARY KEY (id)")
    session.execute("INSERT INTO t VALUES (1, 'a', 2)")
    view, key = session.view, session.key(["t"])
    view.comment(key, "c")
    out = {"columns": view.get(key).column_definitions(), "comment": view.get(key).comment, "listed": [r.name for r in session.query("SHOW TABLES").collect()], "no columns": error(view.create, session.key(["x"]), []), "equal names": error(session.execute, "CREATE TABLE x (a INT, A INT)"), "no such key": error(session.execute, "CREATE TABLE x (a INT, PRIMARY KEY (b))")}
    session.execute("CREATE OR REPLACE TABLE t (id INTEGER)")
    out["or replace"] = session.query("SELECT COUNT(*) FROM t").first()[0]
    session.execute("ALTER TABLE t RENAME TO u")
    return out | {"renamed": [r.name for r in session.query("SHOW TABLES").collect()]}


@facts("ddl_create_as", {"as": "3,2", "like": "K,N", "lenient": "none", "lenient rows": 3, "again": "AlreadyExists"})
def _create_as(session):
    got = session.execute("CREATE TABLE t AS SELECT * FROM VALUES (1, 'a'), (2, 'b'), (3, 'c') AS v(k, n)")
    session.execute("CREATE TABLE u LIKE t")
    return {"as": (got.affected, len(session.view.get(session.key(["t"])).columns)), "like": [c.name for c in session.view.get(session.key(["u"])).columns], "lenient": error(session.execute, "CREATE TABLE IF NOT EXISTS t AS SELECT 9 AS k"), "lenient rows": session.query("SELECT COUNT(*) FROM t").first()[0], "again": error(session.execute, "CREATE TABLE t AS SELECT 1 AS k")}


@facts("tx_two_engines", {"both see": "1,2,3,1,2,3", "clash": "Conflict", "left": "1,2,3,4"})
def _two_engines(session):
    table(session, "t", "a INTEGER")
    session.execute("INSERT INTO t VALUES (1)")
    other = Engine(session.spark, session.engine.catalog.store.root).session("other")
    session.execute("INSERT INTO t VALUES (2)")
    other.execute("INSERT INTO t VALUES (3)")
    out = {"both see": [*rows(session, "SELECT a FROM t"), *rows(other, "SELECT a FROM t")]}
    session.execute("BEGIN")
    session.execute("DELETE FROM t")
    other.execute("INSERT INTO t VALUES (4)")
    return out | {"clash": error(session.execute, "COMMIT"), "left": rows(session, "SELECT a FROM t")}


@facts("use_names", {"bare": "in s", "back": "in public", "by schema": "in s", "by three": "in s", "joined": "in s", "unknown": "NotFound,NotFound", "kept": "W"})
def _use(session):
    session.execute("CREATE TABLE t AS SELECT 'in public' AS x")
    session.execute("CREATE SCHEMA s")
    session.execute("CREATE TABLE s.t AS SELECT 'in s' AS x")
    one = lambda name: session.query(f"SELECT x FROM {name}").first()[0]
    session.execute("USE SCHEMA s")
    out = {"bare": one("t")}
    session.execute("USE DATABASE test_db")
    session.execute("USE WAREHOUSE w")
    return out | {"back": one("t"), "by schema": one("s.t"), "by three": one("Test_DB.S.T"), "joined": one("TEST_DB.S_T"), "unknown": [error(session.execute, "USE SCHEMA nope"), error(session.execute, "USE DATABASE nope")], "kept": session.parameters["WAREHOUSE"]}


# -- protocol ---------------------------------------------------------------------------------


@facts("bind_kinds", {
    "FIXED 42": "42", "TEXT it's": "it's", "REAL 3.5": "3.5", "BOOLEAN 1": "true", "BOOLEAN no": "false", "DATE 2024-01-02": "2024-01-02", "TIME 01:02:03": "01:02:03", "TIMESTAMP_NTZ 2024-01-02 03:04:05": "2024-01-02 03:04:05", "NULL x": "", " x": "x",
    "FIXED x": "InvalidValue", "REAL 1.2.3": "InvalidValue", "DATE 2024-13-01": "InvalidValue", "TIME 25:00:00": "InvalidValue", "TIMESTAMP now": "InvalidValue", "DATE '; DROP": "InvalidValue", "in text": "42,a :1 ?",
})
def _bind(session):
    out = {}
    for x in ("FIXED 42", "TEXT it's", "REAL 3.5", "BOOLEAN 1", "BOOLEAN no", "DATE 2024-01-02", "TIME 01:02:03", "TIMESTAMP_NTZ 2024-01-02 03:04:05", "NULL x", " x", "FIXED x", "REAL 1.2.3", "DATE 2024-13-01", "TIME 25:00:00", "TIMESTAMP now", "DATE '; DROP"):
        kind, text = x.split(" ", 1)
        wrong = error(value, kind, text)
        out[x] = wrong if wrong != "none" else value(kind, text)
    return out | {"in text": list(session.query("SELECT :1 + 1, 'a :1 ?'", {"1": {"type": "FIXED", "value": "41"}}).first())}


@facts("api_statements", {"made": "pending", "handle": "true", "ran": "running,success,7", "canceled": "canceled,canceled", "cancel after the end": "InvalidValue", "failed": "failed,NotFound", "missing": "NotFound", "forgotten": 1, "left": 2})
def _statements(session):
    s = Statements(session.spark)
    h, i, j = s.create("SELECT 1"), s.create("SELECT 2"), s.create("SELECT 3")
    out = {"made": h.status, "handle": bool(re.fullmatch(r"01[0-9a-f-]{32}", h.id)), "ran": (s.running(h.id).status, s.succeeded(h.id, 7).status, s.get(h.id).result)}
    out |= {"canceled": (s.cancel(i.id).status, s.succeeded(i.id, 1).status), "cancel after the end": error(s.cancel, h.id), "failed": (s.failed(j.id, NotFound("x")).status, type(s.get(j.id).error).__name__), "missing": error(s.get, "nope")}
    h.ended_at = time.time() - s.ttl - 1
    return out | {"forgotten": s.cleanup(), "left": len(s.held)}


@facts("api_history", {"newest first": "FAILED,SUCCESS,SUCCESS", "affected": "0,2,0", "limited": "FAILED", "by session": 3, "of another engine": "FAILED,SUCCESS,SUCCESS", "message": "true", "cleared": 3, "left": 0})
def _history(session):
    table(session)
    session.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')")
    failed = error(session.execute, "SELECT * FROM nowhere")
    h = session.engine.history
    got = h.list(session.id)
    h.flush()
    other = Engine(session.spark, session.engine.catalog.store.root).history
    out = {"newest first": [e.status for e in got], "affected": [e.rows_affected for e in got], "limited": [e.status for e in h.list(limit=1)], "by session": len(h.list(session.id)), "of another engine": [e.status for e in other.list(session.id)], "message": failed == "NotFound" and "NOWHERE" in got[0].error_message.upper()}
    return out | {"cleared": h.clear(time.time() + 1), "left": len(h.list())}


@facts("api_sessions", {"valid": "true", "tokens": "64,64", "master lives": 4, "renewed": "true,SessionError", "closed": "SessionError", "expired": "SessionError", "cleaned": 1, "kept": "2,TEST_DB,other", "loaded": "other"})
def _sessions(session):
    e = session.engine
    other = e.session("other")
    out = {"valid": e.validate(session.token) is session, "tokens": (len(session.token), len(session.master)), "master lives": round((session.master_expires_at - session.created_at) / (session.expires_at - session.created_at))}
    old = session.token
    out["renewed"] = (e.renew(session.master) is session and session.token != old, error(e.validate, old))
    out["kept"] = (e.save_sessions(), other.database, other.user)
    fresh = Engine(session.spark, e.catalog.store.root)
    fresh.load_sessions()
    out["loaded"] = fresh.validate(other.token).user
    e.close(session.token)
    out["closed"] = error(e.validate, session.token)
    other.expires_at = 0
    out["cleaned"] = e.cleanup()
    return out | {"expired": error(e.validate, other.token)}


@facts("api_warehouses", {"created": "WH,SMALL,SUSPENDED,600,true", "default size": "X-SMALL", "resumed": "STARTED", "suspended": "SUSPENDED", "again": "AlreadyExists", "bad size": "InvalidValue", "listed": "OTHER,WH", "dropped": "OTHER", "missing": "NotFound", "shown": "OTHER"})
def _warehouses(session):
    w = session.engine.warehouses
    made = w.create("wh", "small")
    out = {"created": (made.name, made.size, made.state, made.auto_suspend, made.auto_resume), "default size": w.create("other").size, "resumed": w.resume("WH").state, "suspended": w.suspend("wh").state, "again": error(w.create, "WH"), "bad size": error(w.create, "x", "HUGE"), "listed": [x.name for x in w.list()]}
    w.drop("wh")
    return out | {"dropped": [x.name for x in w.list()], "missing": error(w.get, "wh"), "shown": [r.name for r in session.query("SHOW WAREHOUSES").collect()]}


@facts("api_errors", {"syntax": "SqlSyntaxError,42000", "not found": "NotFound,02000", "exists": "AlreadyExists,42710", "value": "InvalidValue,22023", "duplicate": "DuplicateMatch,42P18", "conflict": "Conflict,40001", "session": "SessionError,08001", "other": "EngineError,HY000", "raised": "SqlSyntaxError,SqlSyntaxError,NotFound,NotFound"})
def _errors(session):
    kinds = {"syntax": SqlSyntaxError, "not found": NotFound, "exists": AlreadyExists, "value": InvalidValue, "duplicate": DuplicateMatch, "conflict": Conflict, "session": SessionError, "other": EngineError}
    return {k: (v.__name__, v.state) for k, v in kinds.items()} | {"raised": [error(session.query, x) for x in ("", "SELECT FROM", "SELECT * FROM nowhere", "SELECT nope FROM (SELECT 1 AS a) x")]}


@facts("api_result_types", {"columns": "a:NUMBER,b:NUMBER,c:FLOAT,d:TEXT,e:BOOLEAN,f:DATE,g:TIMESTAMP_NTZ,h:VARIANT,i:ARRAY,j:OBJECT,k:BINARY", "scale": "38,0,10,2", "affected": "number of rows affected,2"})
def _types(session):
    out = session.execute("SELECT 1 AS a, CAST(2 AS NUMBER(10,2)) AS b, CAST(1 AS DOUBLE) AS c, 'x' AS d, true AS e, CAST('2024-01-02' AS DATE) AS f, CAST('2024-01-02' AS TIMESTAMP) AS g, PARSE_JSON('[1]') AS h, ARRAY(1) AS i, MAP('a', 1) AS j, CAST('x' AS BINARY) AS k")
    meta = out.result().columns
    assert [wire_name(f.dataType) for f in out.frame.schema] == [c["type"] for c in meta]
    table(session)
    changed = session.execute("INSERT INTO t VALUES (1, 'a'), (2, 'b')").result()
    return {"columns": [f"{c['name']}:{c['type']}" for c in meta], "scale": [meta[0]["precision"], meta[0]["scale"], meta[1]["precision"], meta[1]["scale"]], "affected": (changed.columns[0]["name"], changed.rows[0][0])}
