import datetime as dt
from decimal import Decimal

import pytest

from heronbase.errors import AlreadyExists, Conflict, DuplicateMatch, EngineError, InvalidValue, NotFound, SqlSyntaxError
from heronbase.operators.dml import parse_merge
from heronbase.session import Engine
from heronbase.sources.copy_into import parse_copy


@pytest.fixture
def shop(session):
    session.execute("CREATE DATABASE analytics_db")
    session.execute("CREATE SCHEMA analytics_db.prod")
    session.execute("USE SCHEMA analytics_db.prod")
    session.execute("CREATE TABLE customers (customer_id INTEGER PRIMARY KEY, name VARCHAR, email VARCHAR, signup_date DATE, is_active BOOLEAN)")
    session.execute("INSERT INTO customers VALUES (1,'Alice Johnson','alice@example.com','2024-01-15',true),(2,'Bob Smith','bob@example.com','2024-02-20',true),(3,'Charlie Brown',NULL,'2024-03-10',false)")
    session.execute("CREATE TABLE orders (order_id INTEGER PRIMARY KEY, customer_id INTEGER, amount DOUBLE, order_date DATE, status VARCHAR)")
    session.execute("INSERT INTO orders VALUES (101,1,150.50,'2024-04-01','completed'),(102,1,200.00,'2024-04-15','completed'),(103,2,75.25,'2024-04-20','pending'),(104,3,300.00,'2024-04-25','canceled')")
    return session


def test_queries(shop, rows):
    assert rows("SELECT name, IFF(is_active, 'Active', 'Inactive') s, COUNT(*) n FROM customers GROUP BY name, is_active ORDER BY name")[0] == ("Alice Johnson", "Active", 1)
    top = rows("SELECT c.name, NVL(c.email, 'none') e, SUM(o.amount) t FROM customers c LEFT JOIN orders o ON c.customer_id = o.customer_id WHERE o.status != 'canceled' GROUP BY c.name, c.email ORDER BY t DESC")
    assert len(top) == 2 and top[0] == ("Alice Johnson", "alice@example.com", 350.5)
    assert rows("SELECT name FROM customers WHERE signup_date < CURRENT_DATE() ORDER BY signup_date LIMIT 1") == [("Alice Johnson",)]
    assert rows("SELECT COUNT(*) FROM ANALYTICS_DB.PROD_CUSTOMERS") == rows("SELECT COUNT(*) FROM analytics_db.prod.customers") == [(3,)]
    assert rows('SELECT "NAME" FROM customers WHERE customer_id = ?', [2]) == [("Bob Smith",)]


def test_changes(shop, rows):
    assert shop.execute("UPDATE customers SET is_active = IFF(customer_id = 3, true, is_active) WHERE customer_id = 3").affected == 1
    assert rows("SELECT is_active FROM customers WHERE customer_id = 3") == [(True,)]
    assert shop.execute("DELETE FROM orders WHERE status = 'canceled'").affected == 1
    assert rows("SELECT COUNT(*) FROM orders WHERE status = 'canceled'") == [(0,)]
    assert shop.execute("DELETE FROM orders WHERE amount > 1e9").affected == 0
    assert shop.execute("UPDATE orders o SET o.amount = 0, status = '{x}' WHERE o.customer_id IN (SELECT customer_id FROM customers WHERE name LIKE 'Bob%')").affected == 1
    assert rows("SELECT status FROM orders WHERE amount = 0") == [("{x}",)]
    assert shop.execute("TRUNCATE TABLE orders").affected == 3
    assert shop.execute("INSERT OVERWRITE INTO orders SELECT 1, 2, 3, '2024-01-01', 'x'").affected == 1


def test_changes_by_other_tables(session, rows):
    session.execute("CREATE TABLE stock (sku INTEGER, qty INTEGER, place VARCHAR)")
    session.execute("INSERT INTO stock VALUES (1, 10, 'a'), (2, 20, 'b')")
    session.execute("INSERT INTO stock VALUES (3, 30, 'c'), (3, 31, 'd')")
    session.execute("CREATE TABLE sold (sku INTEGER, n INTEGER)")
    session.execute("INSERT INTO sold VALUES (1, 4), (3, 5), (9, 9), (NULL, 1)")
    session.execute("CREATE TABLE shops (place VARCHAR, city VARCHAR)")
    session.execute("INSERT INTO shops VALUES ('a', 'x'), ('c', 'y')")
    assert session.execute("UPDATE stock AS s SET s.qty = s.qty - o.n, place = IFF(o.n > 4, 'z', s.place) FROM sold o WHERE s.sku = o.sku AND o.n > :1", [3]).affected == 3
    assert rows("SELECT * FROM stock ORDER BY sku, qty") == [(1, 6, "a"), (2, 20, "b"), (3, 25, "z"), (3, 26, "z")]
    assert session.execute("UPDATE stock SET place = p.city FROM sold JOIN (SELECT * FROM shops WHERE city <> 'y') p ON sold.n = 4 WHERE stock.place = p.place").affected == 1
    assert rows("SELECT place FROM stock WHERE sku = 1") == [("x",)]
    assert session.execute("UPDATE stock SET qty = 0 FROM sold WHERE sold.sku = stock.sku AND sold.n > 100").affected == 0
    session.execute("INSERT INTO sold VALUES (2, 1), (2, 2)")
    assert session.execute("UPDATE stock SET qty = sold.n FROM sold WHERE sold.sku = stock.sku AND stock.sku = 2").affected == 1
    assert rows("SELECT qty IN (1, 2) FROM stock WHERE sku = 2") == [(True,)]
    assert session.execute("DELETE FROM stock s USING sold o, shops p WHERE s.sku = o.sku AND o.n = 5 AND p.city = 'y' AND s.qty = 25").affected == 1
    assert session.execute("DELETE FROM stock USING sold WHERE stock.sku = sold.sku AND sold.n > 4").affected == 1
    assert rows("SELECT sku FROM stock ORDER BY sku") == [(1,), (2,)]


def test_a_condition_is_computed_once(session, rows):
    session.execute("CREATE TABLE t AS SELECT id FROM RANGE(2000)")
    n = session.execute("UPDATE t SET id = -1 WHERE RAND() < 0.5").affected
    assert 0 < n < 2000 and rows("SELECT COUNT(*), COUNT_IF(id = -1) FROM t") == [(2000, n)]
    gone = session.execute("DELETE FROM t WHERE RAND() < 0.5").affected
    assert rows("SELECT COUNT(*) FROM t") == [(2000 - gone,)]


def test_nothing_is_counted(session, rows):
    session.execute("CREATE TABLE t AS SELECT id FROM RANGE(5) WHERE false")
    assert session.execute("INSERT INTO t SELECT id FROM RANGE(5) WHERE id > 9").affected == 0
    assert session.execute("INSERT INTO t SELECT id FROM t").affected == 0
    assert session.execute("INSERT OVERWRITE t SELECT id FROM RANGE(3) LIMIT 0").affected == 0
    assert session.execute("UPDATE t SET id = 1").affected == 0 and session.execute("DELETE FROM t").affected == 0
    assert session.execute("MERGE INTO t USING (SELECT id FROM RANGE(2) WHERE false) s ON t.id = s.id WHEN NOT MATCHED THEN INSERT VALUES (s.id)").affected == 0
    session.execute("CREATE STAGE st")
    assert session.execute("COPY INTO @st/none FROM t FILE_FORMAT = (TYPE = PARQUET)").affected == 0
    assert rows("SELECT COUNT(*) FROM t") == [(0,)]


def test_only_touched_files_are_rewritten(shop):
    for i in (10, 11, 12):
        shop.execute(f"INSERT INTO customers (customer_id, name) VALUES ({i}, 'n{i}')")
    key = shop.key(["customers"])
    before = set(shop.view.get(key).files)
    shop.execute("UPDATE customers SET name = 'new' WHERE customer_id = 11")
    after = set(shop.view.get(key).files)
    assert len(before - after) == 1 and len(before & after) == len(before) - 1


def test_definitions(session, rows):
    session.execute("CREATE TABLE t (a INTEGER NOT NULL, b NUMBER(10,2) DEFAULT 7, c VARCHAR(5), PRIMARY KEY (a))")
    with pytest.raises(AlreadyExists):
        session.execute("CREATE TABLE t (a INTEGER)")
    session.execute("CREATE TABLE IF NOT EXISTS t (a INTEGER)")
    session.execute("INSERT INTO t (a) VALUES (1)")
    assert rows("SELECT * FROM t") == [(1, Decimal("7.00"), None)]
    with pytest.raises(EngineError):
        session.execute("INSERT INTO t VALUES (NULL, 1, 'x')")
    with pytest.raises(InvalidValue):
        session.execute("INSERT INTO t (a, nope) VALUES (1, 2)")
    session.execute("ALTER TABLE t ADD COLUMN d DATE")
    session.execute("INSERT INTO t VALUES (2, 1, 'x', '2024-05-06')")
    assert rows("SELECT a, d FROM t ORDER BY a") == [(1, None), (2, dt.date(2024, 5, 6))]
    session.execute("ALTER TABLE t DROP COLUMN d")
    assert session.query("SELECT * FROM t").columns == ["A", "B", "C"]
    assert [r[0] for r in rows("SHOW TABLES")] == ["T"]
    assert rows("DESCRIBE TABLE t")[0] == ("A", "INTEGER", "N", None, "Y")
    session.execute("DROP TABLE t")
    with pytest.raises(NotFound):
        session.query("SELECT * FROM t")
    with pytest.raises(NotFound):
        session.execute("DROP TABLE t")
    session.execute("DROP TABLE IF EXISTS t")


def test_transactions(session, rows):
    session.execute("CREATE TABLE t (a INTEGER)")
    session.execute("BEGIN")
    session.execute("INSERT INTO t VALUES (1)")
    other = session.engine.session("other")
    assert other.query("SELECT COUNT(*) FROM t").first()[0] == 0 and rows("SELECT COUNT(*) FROM t") == [(1,)]
    session.execute("ROLLBACK")
    assert rows("SELECT COUNT(*) FROM t") == [(0,)]
    session.execute("START TRANSACTION")
    session.execute("INSERT INTO t VALUES (2)")
    session.execute("COMMIT")
    assert other.query("SELECT * FROM t").collect() == [(2,)]
    session.execute("BEGIN")
    session.execute("DELETE FROM t")
    other.execute("INSERT INTO t VALUES (3)")
    with pytest.raises(Conflict):
        session.execute("COMMIT")
    assert rows("SELECT COUNT(*) FROM t") == [(2,)]


def test_catalog_survives(spark, tmp_path):
    one = Engine(spark, str(tmp_path / "w")).session()
    one.execute("CREATE TABLE t (a INTEGER, b VARIANT)")
    one.execute("INSERT INTO t SELECT 1, PARSE_JSON('[1]')")
    two = Engine(spark, str(tmp_path / "w")).session()
    assert two.query("SELECT a, VARIANT_GET(b, '$[0]', 'int') FROM t").collect() == [(1, 1)]


def test_two_engines_on_one_warehouse(spark, tmp_path):
    at = str(tmp_path / "shared")
    one = Engine(spark, at).session()
    one.execute("CREATE TABLE t (a INTEGER, b INTEGER)")
    one.execute("INSERT INTO t VALUES (1, 1), (2, 2)")
    two = Engine(spark, at).session()
    one.execute("INSERT INTO t VALUES (3, 3)")
    two.execute("INSERT INTO t VALUES (4, 4)")
    two.execute("CREATE TABLE u (a INTEGER)")
    for s in (one, two, Engine(spark, at).session()):
        assert sorted(map(tuple, s.query("SELECT * FROM t").collect())) == [(1, 1), (2, 2), (3, 3), (4, 4)]
        assert s.query("SELECT COUNT(*) FROM u").first()[0] == 0
    # both have begun before either commits
    one.execute("BEGIN")
    one.execute("DELETE FROM t WHERE a = 1")
    two.execute("INSERT INTO t VALUES (5, 5)")
    with pytest.raises(Conflict):
        one.execute("COMMIT")
    # a commit that was claimed between reading and writing
    key = one.key(["t"])
    before = one.view.get(key)
    two.execute("DELETE FROM t WHERE a = 2")
    with pytest.raises(Conflict):
        one.view.put(key, before, None)
    one.execute("DROP TABLE u")
    with pytest.raises(NotFound):
        two.query("SELECT * FROM u")
    assert two.query("SELECT COUNT(*) FROM t").first()[0] == 4


def test_log_is_folded(spark, tmp_path, monkeypatch):
    from heronbase.sources import catalog

    monkeypatch.setattr(catalog, "CHECKPOINT", 3)
    engine = Engine(spark, str(tmp_path / "w"))
    for i in range(8):
        engine.catalog.create_database(f"d{i}", comment="c")
    engine.catalog.comment_database("d3", "other")
    engine.catalog.drop_database("d4")
    names = [d.name for d in Engine(spark, str(tmp_path / "w")).catalog.list_databases()]
    assert names == ["D0", "D1", "D2", "D3", "D5", "D6", "D7", "TEST_DB"]
    assert Engine(spark, str(tmp_path / "w")).catalog.database("d3").comment == "other"


MERGE = """MERGE INTO shelves AS w
USING (SELECT sku, LOWER(label) AS label, qty, gone FROM deliveries) AS d
ON w.sku = d.sku
   AND w.sku > 0
WHEN MATCHED AND d.gone
  THEN DELETE
WHEN MATCHED THEN UPDATE SET w.label = CASE WHEN d.label = '' THEN 'none' ELSE d.label END,
  qty = w.qty + d.qty
WHEN NOT MATCHED AND NOT d.gone THEN INSERT (sku, label) VALUES (d.sku, COALESCE(d.label, 'x'))"""


def test_merge(session, rows):
    session.execute("CREATE TABLE shelves (sku INTEGER, label VARCHAR, qty INTEGER)")
    session.execute("INSERT INTO shelves VALUES (1,'a',10),(2,'b',20),(5,'e',50)")
    session.execute("CREATE TABLE deliveries (sku INTEGER, label VARCHAR, qty INTEGER, gone BOOLEAN)")
    session.execute("INSERT INTO deliveries VALUES (1,'NEW',1,false),(2,'x',2,true),(3,'INS',3,false),(4,'no',4,true)")
    got = session.execute(MERGE)
    assert (got.detail.updated, got.detail.deleted, got.detail.inserted, got.affected) == (1, 1, 1, 3)
    assert rows("SELECT * FROM shelves ORDER BY sku") == [(1, "new", 11), (3, "ins", None), (5, "e", 50)]
    session.execute("INSERT INTO deliveries VALUES (5,'p',7,false),(5,'r',8,false)")
    with pytest.raises(DuplicateMatch):
        session.execute("MERGE INTO shelves w USING deliveries d ON w.sku = d.sku WHEN MATCHED THEN UPDATE SET qty = d.qty")
    assert session.execute("MERGE INTO shelves USING deliveries ON shelves.sku = deliveries.sku WHEN NOT MATCHED THEN INSERT VALUES (deliveries.sku, deliveries.label, deliveries.qty)").affected == 2


def test_merge_into_empty_table(session, rows):
    session.execute("CREATE TABLE target (id INTEGER, v VARCHAR)")
    got = session.execute("MERGE INTO target t USING (SELECT 1 AS id, 'x' AS v) s ON t.id = s.id WHEN MATCHED THEN DELETE WHEN NOT MATCHED THEN INSERT (v, id) VALUES (s.v, s.id)")
    assert got.affected == 1 and rows("SELECT * FROM target") == [(1, "x")]


def test_merge_parse():
    m = parse_merge(MERGE)
    assert (m.target, m.alias, m.source_alias, [w.action for w in m.whens]) == (["SHELVES"], "W", "D", ["DELETE", "UPDATE", "INSERT"])
    assert [n for n, _ in m.whens[1].assign] == ["LABEL", "QTY"] and m.whens[0].condition and not m.whens[1].condition
    for bad in ("MERGE t", "MERGE INTO t USING s ON t.a = s.a", "MERGE INTO t ON a = b WHEN MATCHED THEN DELETE", "MERGE INTO t USING s ON 1=1 WHEN MATCHED THEN INSERT VALUES (1)"):
        with pytest.raises(SqlSyntaxError):
            parse_merge(bad)


def put(session, name, text):
    session.engine.stages.put("TEST_DB", "PUBLIC", "ST", name, text.encode())


def test_copy_csv(session, rows):
    session.execute("CREATE STAGE st")
    session.execute("CREATE TABLE t (id INTEGER, name VARCHAR, value DOUBLE)")
    assert session.execute("COPY INTO t FROM @st").affected == 0
    put(session, "a.csv", "1,Alice,10.5\n2,\"Bob, Jr\",20.0\n3,,NA\n")
    put(session, "sub/b.csv", "id,name,value\n4, D ,1\n")
    put(session, "c.txt", "no\n")
    got = session.execute("COPY INTO TEST_DB.PUBLIC.t FROM @st PATTERN='a*' FILE_FORMAT=(TYPE = CSV NULL_IF = ('NA')) PURGE=TRUE").detail
    assert (got.rows_loaded, got.files_loaded) == (3, 1)
    assert session.execute("COPY INTO t FROM @ST/sub FILE_FORMAT = (TYPE=CSV, SKIP_HEADER=1, TRIM_SPACE=TRUE)").affected == 1
    assert rows("SELECT * FROM t ORDER BY id") == [(1, "Alice", 10.5), (2, "Bob, Jr", 20.0), (3, None, None), (4, "D", 1.0)]
    assert [f for f, _ in session.engine.stages.files("TEST_DB", "PUBLIC", "st")] == ["c.txt", "sub/b.csv"]


def test_copy_errors(session, rows):
    session.execute("CREATE STAGE st")
    session.execute("CREATE TABLE t (id INTEGER, name VARCHAR)")
    put(session, "bad.csv", "x,y\n")
    put(session, "good.csv", "1,a\n")
    with pytest.raises(EngineError):
        session.execute("COPY INTO t FROM @st")
    assert rows("SELECT COUNT(*) FROM t") == [(0,)]
    got = session.execute("COPY INTO t FROM @st ON_ERROR = SKIP_FILE").detail
    assert got.files_loaded == 1 and len(got.errors) == 1 and rows("SELECT * FROM t") == [(1, "a")]
    assert session.execute("COPY INTO t FROM @st FILES = ('good.csv') VALIDATION_MODE = RETURN_ERRORS").affected == 1
    assert rows("SELECT COUNT(*) FROM t") == [(1,)]
    put(session, "ragged.csv", "1,2,3\n")
    with pytest.raises(EngineError):
        session.execute("COPY INTO t FROM @st FILES = ('ragged.csv')")
    put(session, "head.csv", "h1\nh2\n7,z\n")
    assert session.execute("COPY INTO t FROM @st PATTERN = 'head*' FILE_FORMAT = (SKIP_HEADER = 2)").affected == 1


def test_copy_skips_records(session, rows):
    session.execute("CREATE STAGE st")
    session.execute("CREATE TABLE t (id INTEGER, name VARCHAR)")
    put(session, "a.csv", 'title,"two\nlines"\r\nid,name\r\n1,a\r\n2,"b\nc"\r\n')
    put(session, "b.csv", "title\nid,name\n3,d")
    put(session, "c.csv", "title\n")
    put(session, "d.csv", "")
    assert session.execute("COPY INTO t FROM @st FILE_FORMAT = (TYPE = CSV SKIP_HEADER = 2)").affected == 3
    assert rows("SELECT id, name FROM t ORDER BY id") == [(1, "a"), (2, "b\nc"), (3, "d")]
    put(session, "wide/e.csv", "".join(f"{i},x\n" for i in range(10, 500)))
    assert session.execute("COPY INTO t FROM @st/wide FILE_FORMAT = (SKIP_HEADER = 3 MULTI_LINE = FALSE)").affected == 487
    assert rows("SELECT MIN(id) FROM t WHERE id > 9") == [(13,)]


def test_copy_json_over_lines(session, rows):
    session.execute("CREATE STAGE st")
    session.execute("CREATE TABLE t (data VARIANT)")
    put(session, "a.json", '[\r\n  {"id": 1,\n   "note": null},\n\n  {"id": 2}\n]\n')
    put(session, "b.json", '\n{\n"id": 3\n}')
    put(session, "blank.json", " \n")
    assert session.execute("COPY INTO t FROM @st FILE_FORMAT = (TYPE = JSON STRIP_OUTER_ARRAY = TRUE STRIP_NULL_VALUES = TRUE)").affected == 3
    assert rows("SELECT TO_JSON(data) FROM t ORDER BY data:id::INT") == [('{"id":1}',), ('{"id":2}',), ('{"id":3}',)]
    assert session.execute("COPY INTO t FROM @st FILES = ('a.json') FILE_FORMAT = (TYPE = JSON)").affected == 2
    put(session, "lines.json", '{"id": 4}\n{"id": 5}\n')
    put(session, "number.json", "7")
    for name in ("lines.json", "number.json"):  # a file is one document
        with pytest.raises(EngineError):
            session.execute(f"COPY INTO t FROM @st FILES = ('{name}') FILE_FORMAT = (TYPE = JSON)")
    assert not [v for v in session.spark.catalog.listTables() if v.name.startswith("__copy")]


def test_copy_json(session, rows):
    session.execute("CREATE STAGE st")
    session.execute("CREATE TABLE t (data VARCHAR)")
    put(session, "a.json", '[{"id": 1, "name": "Alice"}, {"id": 2}, 7]')
    put(session, "b.json", '{"id": 3}')
    session.execute("CREATE FILE FORMAT js TYPE = JSON STRIP_OUTER_ARRAY = TRUE")
    assert session.execute("COPY INTO t FROM @st FILE_FORMAT = js").affected == 3
    assert rows("SELECT PARSE_JSON(data):id::INT AS i FROM t ORDER BY i") == [(1,), (2,), (3,)]
    session.execute("TRUNCATE t")
    assert session.execute("COPY INTO t FROM @st FILES=('a.json') FILE_FORMAT = (TYPE = JSON)").affected == 3
    assert sorted(rows("SELECT data FROM t")) == [('{"$1":7}',), ('{"$1":{"id":1,"name":"Alice"}}',), ('{"$1":{"id":2}}',)]


def test_copy_parse():
    c = parse_copy("COPY INTO db.s.t FROM @stage/path/to FILE_FORMAT=(TYPE=CSV FIELD_DELIMITER='|' SKIP_HEADER=2) PATTERN='*.csv' ON_ERROR='CONTINUE' PURGE = TRUE")
    assert (c.target, c.stage, c.path, c.pattern, c.on_error, c.purge) == (["DB", "S", "T"], ["STAGE"], "path/to", "*.csv", "CONTINUE", True)
    assert (c.format.field_delimiter, c.format.skip_header) == ("|", 2)
    with pytest.raises(SqlSyntaxError):
        parse_copy("COPY INTO t FROM 'x'")


def test_stage_names(session):
    session.execute("CREATE STAGE st")
    stages = session.engine.stages
    for bad in ("../x", "/x", "a/../b", ""):
        with pytest.raises(InvalidValue):
            stages.put("TEST_DB", "PUBLIC", "ST", bad, b"")
    stages.put("TEST_DB", "PUBLIC", "ST", "a/b.csv", b"xy")
    assert stages.read("TEST_DB", "PUBLIC", "ST", "a/b.csv") == b"xy"
    stages.remove("TEST_DB", "PUBLIC", "ST", "a/b.csv")
    with pytest.raises(NotFound):
        stages.read("TEST_DB", "PUBLIC", "ST", "a/b.csv")
    session.execute("CREATE STAGE ext URL = 's3://x/'")
    with pytest.raises(InvalidValue):
        stages.files("TEST_DB", "PUBLIC", "EXT")
    session.execute("DROP STAGE st")


def test_bindings(rows):
    assert rows("SELECT :1 + 1, :2", {"1": {"type": "FIXED", "value": "41"}, "2": {"type": "TEXT", "value": "it's :1 ?"}}) == [(42, "it's :1 ?")]
    assert rows("SELECT ?, ?, ?", [{"type": "BOOLEAN", "value": "1"}, {"type": "REAL", "value": "3.5"}, {"type": "TEXT", "value": None}]) == [(True, 3.5, None)]
    assert rows("SELECT :10 - :1", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]) == [(9,)]
    for kind, bad in (("FIXED", "x"), ("REAL", "1.2.3"), ("DATE", "2024-13-01"), ("DATE", "'; DROP"), ("TIMESTAMP", "now")):
        with pytest.raises(InvalidValue):
            rows("SELECT ?", [{"type": kind, "value": bad}])


def test_functions(rows):
    assert rows("SELECT NVL2('v', 'has', 'no'), NVL2(NULL, 'has', 'no'), IFNULL(NULL, 'd')") == [("has", "no", "d")]
    assert rows("SELECT DATEADD(day, 7, '2024-01-01'), DATEADD(month, 1, '2024-01-31'), DATEADD(hour, 25, '2024-01-01 23:00:00')") == [(dt.datetime(2024, 1, 8), dt.datetime(2024, 2, 29), dt.datetime(2024, 1, 2, 1))]
    assert rows("SELECT DATEDIFF(day, '2024-01-01', '2024-01-10'), DATEDIFF(year, '2023-12-31', '2024-01-01'), DATEDIFF('month', '2024-01-31', '2024-03-01'), DATEDIFF(hour, '2024-01-02', '2024-01-01')") == [(9, 1, 2, -24)]
    assert rows("SELECT LISTAGG(x, ', ') FROM VALUES ('b'), ('a'), (NULL) AS t(x)") == [("a, b",)]
    assert rows("SELECT LISTAGG(DISTINCT x) WITHIN GROUP (ORDER BY x DESC) FROM VALUES ('b'), ('a'), ('b') AS t(x)") == [("ba",)]
    assert rows("SELECT f.value::INT, f.index FROM TABLE(FLATTEN(input => PARSE_JSON('[3, 4]'))) f ORDER BY f.index") == [(3, 0), (4, 1)]
    assert rows("SELECT OBJECT_CONSTRUCT('a', 1, 'b', NULL), CONCAT('x', NULL, 'y'), SUBSTR('hello', 0, 2)") == [('{"a":1,"b":null}', "xy", "h")]
    assert rows("SELECT x FROM VALUES (1), (NULL), (2) AS t(x) ORDER BY x DESC") == [(2,), (1,), (None,)]


def test_history_and_handles(session):
    history, statements = session.engine.history, session.engine.statements
    session.execute("SELECT 1")
    with pytest.raises(NotFound):
        session.execute("SELECT * FROM nowhere")
    assert [e.status for e in history.list(session.id)] == ["FAILED", "SUCCESS"]
    history.flush()
    later = Engine(session.spark, session.engine.catalog.store.root).history
    assert [e.status for e in later.list(session.id)] == ["FAILED", "SUCCESS"] and len(later.list(limit=1)) == 1
    assert history.clear(1e18) == 2 and later.list() == []
    h = statements.create("SELECT 1")
    assert h.id.startswith("01") and len(h.id) == 34 and statements.running(h.id).status == "running"
    assert statements.cancel(h.id).status == "canceled" and statements.succeeded(h.id, 1).status == "canceled"
    with pytest.raises(NotFound):
        statements.get("nope")


def test_warehouses(session):
    w = session.engine.warehouses
    assert w.create("wh", "small").state == "SUSPENDED" and w.resume("WH").state == "STARTED" and w.suspend("wh").state == "SUSPENDED"
    with pytest.raises(AlreadyExists):
        w.create("WH")
    with pytest.raises(InvalidValue):
        w.create("x", "HUGE")
    w.drop("wh")
    assert w.list() == []


def test_errors(session):
    for bad in ("", "SELECT FROM", "FROBNICATE x"):
        with pytest.raises(SqlSyntaxError):
            session.execute(bad)


def test_drop_database_takes_its_children(session):
    session.execute("CREATE DATABASE d")
    session.execute("CREATE TABLE d.public.t (a INTEGER)")
    session.execute("DROP DATABASE d")
    session.execute("CREATE DATABASE d")
    with pytest.raises(NotFound):
        session.query("SELECT * FROM d.public.t")


def test_rows_without_text(session, rows):
    from heronbase.sources.catalog import Column

    session.create_table("typed", [Column("ID", "INTEGER", primary_key=True), Column("V", "NUMBER(10,2)"), Column("B", "BOOLEAN"), Column("D", "DATE")])
    assert session.insert_data("typed", ["id", "v", "b", "d"], [(1, 2.5, True, dt.date(2024, 1, 2)), (2, None, False, None)]) == 2
    assert rows("SELECT * FROM typed ORDER BY id") == [(1, Decimal("2.50"), True, dt.date(2024, 1, 2)), (2, None, False, None)]
    assert session.insert_data("typed", ["id"], []) == 0
    with pytest.raises(InvalidValue):
        session.insert_data("typed", ["id", "v"], [(1,)])


def test_sessions(session, spark):
    engine = session.engine
    assert engine.validate(session.token) is session and engine.heartbeat(session.token) is session
    old = session.token
    assert engine.renew(session.master).token != old
    assert engine.save_sessions() == 1
    other = Engine(spark, engine.catalog.store.root)
    assert other.load_sessions() == 1 and other.validate(session.token).user == "tester"
    session.expires_at = 0
    assert engine.cleanup() == 1
