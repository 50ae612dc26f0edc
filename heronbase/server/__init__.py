"""HTTP over an engine: the driver protocol and the statements API, on the standard library.

    python -m heronbase.server [port]
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from heronbase.errors import AlreadyExists, EngineError, InvalidValue, NotFound, SessionError, wrap
from heronbase.plans.classify import SELECT, classify
from heronbase.session import Engine, Session
from heronbase.sources.catalog import DATABASE, SCHEMA, Column
from heronbase.statements import CANCELED, FAILED, SUCCESS

OK, PENDING, GONE = "090001", "333334", "000604"


@dataclass
class Reply:
    body: object
    status: int = 200


def value(x: object) -> object:
    """A result value as JSON carries it."""
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, Decimal):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).decode(errors="replace")
    if isinstance(x, (dt.date, dt.time)):
        return x.isoformat(sep=" ") if isinstance(x, dt.datetime) else x.isoformat()
    if hasattr(x, "toJson"):
        return json.loads(x.toJson())
    if hasattr(x, "asDict"):
        return {k: value(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {str(k): value(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [value(v) for v in x]
    return str(x)


def text(x: object) -> str:
    """A result value as the driver protocol carries it: text, nulls empty."""
    x = value(x)
    if x is None:
        return ""
    return str(x).lower() if isinstance(x, bool) else x if isinstance(x, str) else json.dumps(x)


class Routes:
    """What each path does; ``self.table`` maps method and path pattern to a function of (body, token, **names)."""

    def __init__(self, engine: Engine):
        self.engine = engine
        d, s, t, w = "/api/v2/databases", "/{database}/schemas", "/{schema}/tables", "/api/v2/warehouses"
        table: list[tuple[str, str, Callable]] = [
            ("POST", "/session/v1/login-request", self.login), ("POST", "/session/token-request", self.token), ("POST", "/session/renew", self.token),
            ("POST", "/session/heartbeat", self.heartbeat), ("POST", "/session/logout", self.logout), ("POST", "/session/use", self.use), ("POST", "/session", self.logout),
            ("POST", "/queries/v1/query-request", self.query), ("POST", "/queries/v1/abort-request", self.abort), ("POST", "/telemetry/send", lambda body, token: Reply({"success": True})),
            ("GET", "/health", lambda body, token: Reply("OK")),
            ("POST", "/api/v2/statements", self.submit), ("GET", "/api/v2/statements/{handle}", self.statement), ("POST", "/api/v2/statements/{handle}/cancel", self.cancel),
            ("GET", d, self.databases), ("POST", d, self.create_database), ("GET", d + "/{database}", self.database), ("PUT", d + "/{database}", self.alter_database), ("DELETE", d + "/{database}", self.drop_database),
            ("GET", d + s, self.schemas), ("POST", d + s, self.create_schema), ("GET", d + s + "/{schema}", self.schema), ("DELETE", d + s + "/{schema}", self.drop_schema),
            ("GET", d + s + t, self.tables), ("POST", d + s + t, self.create_table), ("GET", d + s + t + "/{table}", self.get_table), ("PUT", d + s + t + "/{table}", self.alter_table), ("DELETE", d + s + t + "/{table}", self.drop_table),
            ("GET", w, self.warehouses), ("POST", w, self.create_warehouse), ("POST", w + "/{warehouse}:resume", self.resume), ("POST", w + "/{warehouse}:suspend", self.suspend),
            ("GET", w + "/{warehouse}", self.warehouse), ("DELETE", w + "/{warehouse}", self.drop_warehouse),
        ]
        self.table = [(m, re.compile(re.sub(r"\{(\w+)\}", r"(?P<\1>[^/:]+)", p)), f) for m, p, f in table]

    def __call__(self, method: str, path: str, body: dict, token: str) -> Reply:
        known = False
        for m, pattern, f in self.table:
            if found := pattern.fullmatch(path.rstrip("/") or "/"):
                known = True
                if m == method:
                    return f(body, token, **found.groupdict())
        return Reply({"code": "000404", "message": "method not allowed" if known else "not found"}, 405 if known else 404)

    # -- driver protocol: errors are replies with status 200 -------------------------------

    def _session(self, token: str) -> Session:
        return self.engine.validate(token)

    def login(self, body, token):
        data = body.get("data") or {}
        if not data.get("LOGIN_NAME") or not data.get("PASSWORD"):
            return failure(SessionError("user name and password are needed"))
        database, schema = (data.get("databaseName") or DATABASE).upper(), (data.get("schemaName") or SCHEMA).upper()
        self.engine.catalog.create_database(database, "Auto-created database", if_not_exists=True)
        self.engine.catalog.create_schema(database, schema, if_not_exists=True)
        s = self.engine.session(data["LOGIN_NAME"], database, schema)
        s.parameters |= {k: text(v) for k, v in (data.get("SESSION_PARAMETERS") or {}).items()}
        return Reply({"success": True, "data": {
            "token": s.token, "masterToken": s.master, "validityInSeconds": int(self.engine.ttl), "masterValidityInSeconds": int(4 * self.engine.ttl), "sessionId": int(s.id, 16) >> 1,
            "parameters": [{"name": k, "value": v} for k, v in s.parameters.items()],
            "sessionInfo": {"databaseName": database, "schemaName": schema, "warehouseName": data.get("warehouseName", ""), "roleName": data.get("roleName", "")},
        }})

    def token(self, body, token):
        s = self.engine.renew(body.get("masterToken") or token)
        return Reply({"success": True, "data": {"sessionToken": s.token, "validityInSeconds": int(self.engine.ttl)}})

    def heartbeat(self, body, token):
        self.engine.heartbeat(token)
        return Reply({"success": True})

    def logout(self, body, token):
        self.engine.close(token)
        return Reply({"success": True})

    def use(self, body, token):
        s = self._session(token)
        database, schema = (body.get("database") or s.database).upper(), (body.get("schema") or SCHEMA).upper()
        self.engine.catalog.schema(database, schema)
        s.database, s.schema = database, schema
        return Reply({"success": True})

    def query(self, body, token):
        s, sql = self._session(token), body.get("sqlText") or ""
        query = "01" + uuid.uuid4().hex
        self.engine.spark.addTag(query)
        try:
            out = s.execute(sql, body.get("bindings"))
            data = {"queryId": query, "sqlState": "00000", "queryResultFormat": "json"}
            if out.frame is not None:
                got = out.result()
                rows = [[text(x) for x in r] for r in got.rows]
                data |= {"statementTypeId": SELECT, "rowtype": got.columns, "rowset": rows, "total": len(rows), "returned": len(rows)}
            else:
                data |= {"statementTypeId": classify(sql).type_id, "total": out.affected, "returned": 0}
        finally:
            self.engine.spark.removeTag(query)
        return Reply({"success": True, "data": data})

    def abort(self, body, token):
        self._session(token)
        if body.get("queryId"):
            self.engine.spark.interruptTag(body["queryId"])
        return Reply({"success": True, "message": "abort requested"})

    # -- statements ------------------------------------------------------------------------

    def submit(self, body, token):
        sql = (body.get("statement") or "").strip()
        if not sql:
            return Reply({"code": InvalidValue.code, "sqlState": InvalidValue.state, "message": "a statement is needed"}, 400)
        h = self.engine.statements.create(sql)
        database, schema = (body.get("database") or DATABASE).upper(), (body.get("schema") or SCHEMA).upper()
        s = Session(self.engine, "", database, schema)
        s.parameters |= body.get("parameters") or {}
        self.engine.statements.running(h.id)
        self.engine.spark.addTag(h.id)
        try:
            out = s.execute(sql, body.get("bindings"))
            self.engine.statements.succeeded(h.id, out.result())
        except Exception as e:
            self.engine.statements.failed(h.id, wrap(e))
        finally:
            self.engine.spark.removeTag(h.id)
        return self.statement(body, token, h.id)

    def statement(self, body, token, handle):
        h = self.engine.statements.get(handle)
        base = {"statementHandle": h.id, "statementStatusUrl": f"/api/v2/statements/{h.id}", "createdOn": int(1000 * h.created_at)}
        if h.status == SUCCESS:
            rows = [[value(x) for x in r] for r in h.result.rows]
            meta = {"numRows": len(rows), "format": "jsonv2", "rowType": [c if c["name"] != "number of rows affected" else c | {"type": "FIXED"} for c in h.result.columns], "partitionInfo": [{"rowCount": len(rows), "uncompressedSize": 0}]}
            return Reply(base | {"code": OK, "sqlState": "00000", "message": "Statement executed successfully.", "resultSetMetaData": meta, "data": rows})
        if h.status == FAILED:
            return Reply(base | {"code": "001007", "sqlState": h.error.state, "message": str(h.error)})
        if h.status == CANCELED:
            return Reply(base | {"code": GONE, "sqlState": "57014", "message": "Statement was canceled."})
        return Reply(base | {"code": PENDING, "sqlState": "00000", "message": "Statement is still running."}, 202)

    def cancel(self, body, token, handle):
        self.engine.statements.cancel(handle)
        return Reply({"code": GONE, "sqlState": "00000", "statementHandle": handle, "message": "Statement canceled."})

    # -- resources -------------------------------------------------------------------------

    @staticmethod
    def _named(x, parent: str = "") -> dict:
        out = {"name": x.name, "comment": x.comment, "owner": x.owner, "created_on": stamp(x.created_at)}
        return out | ({"database_name": x.parent} if parent else {})

    def databases(self, body, token):
        return Reply([self._named(x) for x in self.engine.catalog.list_databases()])

    def create_database(self, body, token):
        return Reply(self._named(self.engine.catalog.create_database(body.get("name") or "", body.get("comment") or "")), 201)

    def database(self, body, token, database):
        return Reply(self._named(self.engine.catalog.database(database)))

    def alter_database(self, body, token, database):
        if body.get("comment") is not None:
            self.engine.catalog.comment_database(database, body["comment"])
        return self.database(body, token, database)

    def drop_database(self, body, token, database):
        self.engine.catalog.drop_database(database)
        return Reply({"code": OK, "message": "dropped"})

    def schemas(self, body, token, database):
        return Reply([self._named(x, "db") for x in self.engine.catalog.list_schemas(database)])

    def create_schema(self, body, token, database):
        return Reply(self._named(self.engine.catalog.create_schema(database, body.get("name") or "", body.get("comment") or ""), "db"), 201)

    def schema(self, body, token, database, schema):
        return Reply(self._named(self.engine.catalog.schema(database, schema), "db"))

    def drop_schema(self, body, token, database, schema):
        self.engine.catalog.drop_schema(database, schema)
        return Reply({"code": OK, "message": "dropped"})

    def _view(self, database: str = DATABASE, schema: str = SCHEMA) -> Session:
        return Session(self.engine, "", database.upper(), schema.upper())

    def _shown(self, key, table) -> dict:
        return {"name": key[2], "database_name": key[0], "schema_name": key[1], "table_type": table.table_type, "comment": table.comment, "owner": table.owner, "created_on": stamp(table.created_at)}

    def tables(self, body, token, database, schema):
        self.engine.catalog.schema(database, schema)
        at = (database.upper(), schema.upper())
        return Reply([self._shown(k, t) for k, t in sorted(self.engine.catalog.tables.items()) if k[:2] == at])

    def create_table(self, body, token, database, schema):
        columns = [Column(c["name"].upper(), c["type"], bool(c.get("nullable", True)), bool(c.get("primary_key")), c.get("default")) for c in body.get("columns") or []]
        key = (database.upper(), schema.upper(), (body.get("name") or "").strip().upper())
        if not key[2]:
            raise InvalidValue("a name is needed")
        return Reply(self._shown(key, self._view().view.create(key, columns, comment=body.get("comment") or "")), 201)

    def get_table(self, body, token, database, schema, table):
        key = (database.upper(), schema.upper(), table.upper())
        return Reply(self._shown(key, self._view().view.get(key)))

    def alter_table(self, body, token, database, schema, table):
        if body.get("comment") is not None:
            self._view().view.comment((database.upper(), schema.upper(), table.upper()), body["comment"])
        return self.get_table(body, token, database, schema, table)

    def drop_table(self, body, token, database, schema, table):
        self._view().view.drop((database.upper(), schema.upper(), table.upper()))
        return Reply({"code": OK, "message": "dropped"})

    @staticmethod
    def _house(w) -> dict:
        return {"name": w.name, "state": w.state, "size": w.size, "type": "STANDARD", "auto_suspend": w.auto_suspend, "auto_resume": w.auto_resume, "comment": w.comment, "created_on": stamp(w.created_at)}

    def warehouses(self, body, token):
        return Reply([self._house(w) for w in self.engine.warehouses.list()])

    def create_warehouse(self, body, token):
        return Reply(self._house(self.engine.warehouses.create(body.get("name") or "", body.get("warehouse_size") or "", body.get("auto_suspend"), body.get("auto_resume"), body.get("comment") or "")), 201)

    def warehouse(self, body, token, warehouse):
        return Reply(self._house(self.engine.warehouses.get(warehouse)))

    def resume(self, body, token, warehouse):
        return Reply(self._house(self.engine.warehouses.resume(warehouse)))

    def suspend(self, body, token, warehouse):
        return Reply(self._house(self.engine.warehouses.suspend(warehouse)))

    def drop_warehouse(self, body, token, warehouse):
        self.engine.warehouses.drop(warehouse)
        return Reply({"code": OK, "message": "dropped"})


def stamp(t: float) -> str:
    return dt.datetime.fromtimestamp(t, dt.UTC).isoformat()


def failure(e: EngineError) -> Reply:
    return Reply({"success": False, "code": e.code, "message": str(e), "data": {"sqlState": e.state}})


def token_of(header: str) -> str:
    """``Bearer x`` or ``<scheme> Token="x"``."""
    if m := re.search(r'Token="([^"]*)"', header):
        return m[1]
    return header.removeprefix("Bearer ").strip()


def status_of(e: EngineError) -> int:
    return 404 if isinstance(e, NotFound) else 409 if isinstance(e, AlreadyExists) else 401 if isinstance(e, SessionError) else 400 if isinstance(e, InvalidValue) else 500


class Handler(BaseHTTPRequestHandler):
    routes: Routes

    def _serve(self) -> None:
        url = urlsplit(self.path)
        size = int(self.headers.get("Content-Length") or 0)
        raw = self.rfile.read(size) if size else b""
        if self.headers.get("Content-Encoding") == "gzip":
            import gzip

            raw = gzip.decompress(raw)
        try:
            body = json.loads(raw) if raw.strip() else {}
            if not isinstance(body, dict):
                raise ValueError
        except ValueError:
            bad = InvalidValue("the body is no JSON object")
            reply = Reply({"code": bad.code, "message": str(bad)}, 400) if url.path.startswith("/api/") else failure(bad)
        else:
            token = token_of(self.headers.get("Authorization") or "") or parse_qs(url.query).get("token", [""])[0]
            try:
                reply = self.routes(self.command, url.path, body, token)
            except Exception as e:
                e = wrap(e)
                reply = Reply({"code": e.code, "sqlState": e.state, "message": str(e)}, status_of(e)) if url.path.startswith("/api/") else failure(e)
        data = reply.body.encode() if isinstance(reply.body, str) else json.dumps(reply.body).encode()
        self.send_response(reply.status)
        self.send_header("Content-Type", "text/plain" if isinstance(reply.body, str) else "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = do_PUT = do_DELETE = _serve

    def log_message(self, *args) -> None:
        pass


def server(engine: Engine, port: int = 8080, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``."""
    return ThreadingHTTPServer((host, port), type("Bound", (Handler,), {"routes": Routes(engine)}))
