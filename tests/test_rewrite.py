import pytest

from heronbase.errors import SqlSyntaxError
from heronbase.lexer import tokens
from heronbase.plans import classify as C
from heronbase.plans.rewrite import rewrite


def flat(sql):
    return " ".join(rewrite(sql).split())


@pytest.mark.parametrize("sql, expected", [
    ("SELECT IFF(a > 1, 'x', 'y') FROM t", "SELECT if(a > 1, 'x', 'y') FROM t"),
    ("select iff(a, iff(b, 1, 2), 3)", "select if(a, if(b, 1, 2), 3)"),
    ("SELECT NVL2(a, b) FROM t", "SELECT NVL2 ( a , b ) FROM t"),
    ("SELECT DATEADD(day, 7, d)", "SELECT cast(dateadd(DAY, 7, cast(d as date)) as timestamp_ntz)"),
    ("SELECT TO_VARIANT(x)", "SELECT cast(x as variant)"),
    ("SELECT 1 FROM DUAL", "SELECT 1"),
    ("SELECT 'IFF(a,b,c)' -- NVL(x,y)\n", "SELECT 'IFF(a,b,c)'"),
    ("SELECT 'it''s \\ fine'", "SELECT 'it\\'s \\\\ fine'"),
    ('SELECT "My Col" FROM t', "SELECT `My Col` FROM t"),
    ("SELECT :1, :12", "SELECT :p1 , :p12"),
    ("SELECT a::NUMBER(10,2)", "SELECT a :: decimal(10,2)"),
    ("SELECT a FROM t ORDER BY a, b DESC LIMIT 1", "SELECT a FROM t ORDER BY a NULLS LAST , b DESC NULLS LAST LIMIT 1"),
    ("SELECT a FROM t ORDER BY a NULLS FIRST", "SELECT a FROM t ORDER BY a NULLS FIRST"),
    ("SELECT a FROM t OFFSET 2 ROWS FETCH FIRST ROW ONLY", "SELECT a FROM t LIMIT 1 OFFSET 2"),
    ("SELECT * EXCLUDE a FROM t", "SELECT * EXCEPT (a) FROM t"),
    ("SELECT a FROM t AS x SAMPLE (10) WHERE a > 1", "SELECT a FROM t TABLESAMPLE (10 PERCENT) AS `X` WHERE a > 1"),
    ("SELECT a FROM t USING SAMPLE 5%", "SELECT a FROM t TABLESAMPLE (5 PERCENT) AS `T`"),
    ("SELECT a FROM t TABLESAMPLE BERNOULLI (7) y", "SELECT a FROM t TABLESAMPLE (7 PERCENT) AS `Y`"),
    ("SELECT TO_CHAR(d, 'DD-MON-YYYY')", "SELECT date_format(d, 'dd-MMM-yyyy')"),
    ("SELECT STRFTIME(d, '%Y week')", "SELECT date_format(d, 'yyyy\\' week\\'')"),
])
def test_text(sql, expected):
    assert flat(sql) == expected


def test_questions_count_up():
    assert flat("SELECT ?, '?', ?") == "SELECT :p1 , '?' , :p2"


def test_functions_in_any_statement():
    assert "if(a, 1, 2)" in rewrite("CREATE TABLE t AS WITH x AS (SELECT IFF(a, 1, 2) FROM y) SELECT * FROM x")


@pytest.mark.parametrize("sql", ["", "  -- nothing\n", "SELECT OBJECT_CONSTRUCT('a')", "SELECT (1", "SELECT 'open", "SELECT DATEDIFF(fortnight, a, b)"])
def test_errors(sql):
    with pytest.raises(SqlSyntaxError):
        rewrite(sql)


@pytest.mark.parametrize("sql, kind, type_id", [
    ("SELECT 1", "query", 1), ("  show tables", "query", 1), ("DESC TABLE t", "query", 1), ("EXPLAIN SELECT 1", "query", 1), ("WITH a AS (SELECT 1) SELECT * FROM a", "query", 1),
    ("(SELECT 1)", "query", 1), ("-- c\nSELECT 1", "query", 1), ("VALUES (1)", "query", 1), ("CREATE TABLE t (a INT)", "create", 4), ("DROP TABLE t", "drop", 5), ("ALTER TABLE t ADD a INT", "alter", 4),
    ("COPY INTO t FROM @s", "copy", 3), ("MERGE INTO t USING s ON 1=1 WHEN MATCHED THEN DELETE", "merge", 3), ("BEGIN", "transaction", 3), ("INSERT INTO t VALUES (1)", "dml", 3), ("DESCRIPTION", "dml", 3),
])
def test_classification(sql, kind, type_id):
    got = C.classify(sql)
    assert (got.kind, got.type_id) == (kind, type_id)
    assert got.is_query == (kind == "query") and got.is_ddl == (kind in ("create", "drop", "alter"))


def test_helpers():
    assert C.is_create_table("create or replace table t (a int)") and not C.is_create_table("CREATE VIEW v AS SELECT 1")
    assert C.is_drop_table("DROP TABLE t") and C.is_copy("copy into t from @s") and C.is_merge("MERGE INTO t") and C.is_transaction("COMMIT")
    assert C.is_begin("START TRANSACTION") and C.is_commit("commit;") and C.is_rollback("ROLLBACK")


def test_tokens_keep_literals_whole():
    assert [t.kind for t in tokens("a'b''c'/*x*/\"d\"")] == ["word", "string", "quoted"]
