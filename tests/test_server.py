import json
import threading
import urllib.error
import urllib.request

import pytest

from heronbase.server import server
from heronbase.session import Engine


@pytest.fixture(scope="module")
def call(spark, tmp_path_factory):
    s = server(Engine(spark, str(tmp_path_factory.mktemp("http") / "w")), 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(method, path, body=None, token=None):
        head = {"Authorization": f'Custom Token="{token}"'} if token else {}
        request = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", json.dumps(body).encode() if body is not None else None, head, method=method)
        try:
            with urllib.request.urlopen(request) as r:
                raw = r.read()
                return r.status, json.loads(raw) if raw[:1] in b"[{" else raw.decode()
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield call
    s.shutdown()


def test_driver_protocol(call):
    assert call("POST", "/session/v1/login-request", {"data": {"LOGIN_NAME": "u"}})[1]["success"] is False
    status, got = call("POST", "/session/v1/login-request", {"data": {"LOGIN_NAME": "u", "PASSWORD": "p", "databaseName": "fresh"}})
    token, master = got["data"]["token"], got["data"]["masterToken"]
    assert status == 200 and got["data"]["sessionInfo"]["databaseName"] == "FRESH"

    def run(sql):
        return call("POST", "/queries/v1/query-request", {"sqlText": sql}, token)[1]

    assert run("CREATE TABLE t (a INTEGER, b VARCHAR)")["success"]
    assert run("INSERT INTO t VALUES (1, NULL), (2, 'x')")["data"]["total"] == 2
    data = run("WITH q AS (SELECT * FROM t) SELECT a, b, IFF(a > 1, true, false) c FROM q ORDER BY a")["data"]
    assert data["rowset"] == [["1", "", "false"], ["2", "x", "true"]] and [c["type"] for c in data["rowtype"]] == ["NUMBER", "TEXT", "BOOLEAN"]
    bad = run("SELECT * FROM nope")
    assert not bad["success"] and bad["data"]["sqlState"] == "02000"
    assert call("POST", "/session/heartbeat", {}, token)[1]["success"]
    token = call("POST", "/session/token-request", {"masterToken": master, "requestType": "RENEW"})[1]["data"]["sessionToken"]
    assert run("SELECT 1")["success"] and call("POST", "/session?delete=true", {}, token)[1]["success"]
    assert not run("SELECT 1")["success"] and not call("POST", "/queries/v1/query-request", {"sqlText": "SELECT 1"}, "x")[1]["success"]


def test_statements(call):
    status, got = call("POST", "/api/v2/statements", {"statement": "SELECT :1 + 1 AS x, NULL AS y, PARSE_JSON('{\"k\": 1}') AS v", "bindings": {"1": {"type": "FIXED", "value": "4"}}})
    assert status == 200 and got["code"] == "090001" and got["data"] == [[5, None, {"k": 1}]]
    assert call("GET", f"/api/v2/statements/{got['statementHandle']}")[1]["data"] == got["data"]
    assert call("POST", f"/api/v2/statements/{got['statementHandle']}/cancel", {})[0] == 400
    made = call("POST", "/api/v2/statements", {"statement": "CREATE TABLE r (a INTEGER)"})[1]
    assert made["data"] == [[0]] and call("GET", f"/api/v2/statements/{made['statementHandle']}")[1]["code"] == "090001"
    assert call("POST", "/api/v2/statements", {"statement": "SELECT nope"})[1]["code"] == "001007"
    assert call("POST", "/api/v2/statements", {"statement": ""})[0] == 400
    assert call("GET", "/api/v2/statements/none")[0] == 404


def test_resources(call):
    assert call("POST", "/api/v2/databases", {"name": "d1", "comment": "c"})[0] == 201 and call("POST", "/api/v2/databases", {"name": "D1"})[0] == 409
    assert call("PUT", "/api/v2/databases/d1", {"comment": "n"})[1]["comment"] == "n"
    assert call("POST", "/api/v2/databases/d1/schemas", {"name": "s"})[0] == 201
    table = {"name": "t", "columns": [{"name": "id", "type": "INTEGER", "primary_key": True}, {"name": "v", "type": "VARCHAR", "nullable": True}]}
    assert call("POST", "/api/v2/databases/d1/schemas/s/tables", table)[0] == 201
    assert [t["name"] for t in call("GET", "/api/v2/databases/d1/schemas/s/tables")[1]] == ["T"]
    assert call("POST", "/api/v2/statements", {"statement": "INSERT INTO t VALUES (1, 'x')", "database": "d1", "schema": "s"})[1]["data"] == [[1]]
    assert call("DELETE", "/api/v2/databases/d1/schemas/s/tables/t")[0] == 200 and call("GET", "/api/v2/databases/d1/schemas/s/tables/t")[0] == 404
    assert call("POST", "/api/v2/warehouses", {"name": "w", "warehouse_size": "SMALL", "auto_suspend": 60})[1]["auto_suspend"] == 60
    assert call("POST", "/api/v2/warehouses/w:resume")[1]["state"] == "STARTED" and call("DELETE", "/api/v2/warehouses/w")[0] == 200
    assert call("GET", "/health") == (200, "OK") and call("GET", "/nothing")[0] == 404 and call("DELETE", "/api/v2/databases")[0] == 405
