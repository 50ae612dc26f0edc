"""Queries over the driver's tables, in the dialect, and the SQL that the oracle runs for each."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronbase import functions as D
from heronbase.errors import EngineError
from heronbase.operators.asof import asof_join
from heronbase.session import Engine, Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class _Tables(dict):
    """Frames of a folder's tables, read when first asked for."""

    def __init__(self, session: Session, sf_dir: str):
        super().__init__()
        self.session, self.sf_dir = session, sf_dir

    def __contains__(self, name: object) -> bool:
        if not super().__contains__(name) and str(name).lower() in TABLES:
            self.session.frames = {}
            frame = self.session.spark.read.parquet(f"{self.sf_dir}/{str(name).lower()}.parquet")
            self.session.register(str(name), frame)
            self[name] = frame
            self.session.frames = self
        return super().__contains__(name)


def opened(spark: SparkSession, sf_dir: str) -> Session:
    """A session that sees the folder's tables by name."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir", "").rstrip("/")
    place = f"{warehouse}/heronbase-{tempfile.mktemp(prefix='', dir='').strip('/')}" if warehouse else None
    session = Engine(spark, place).session("driver")
    session.frames = _Tables(session, sf_dir)
    return session


_READERS: WeakKeyDictionary[SparkSession, dict[str, Session]] = WeakKeyDictionary()


def reader(spark: SparkSession, sf_dir: str) -> Session:
    """The session for queries that change nothing: one a folder, so that its tables are looked up once."""
    found = _READERS.setdefault(spark, {})
    if sf_dir not in found:
        found[sf_dir] = opened(spark, sf_dir)
    return found[sf_dir]


def dialect(name: str, text: str, oracle: str | None, bindings: dict | list | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: reader(spark, sf_dir).query(text, bindings)
    if oracle:
        SQL[name] = oracle


def same(name: str, text: str) -> None:
    """Both engines read the text alike."""
    dialect(name, text, text)


def script(name: str, statements: list[str], query: str, oracle: str | None) -> None:
    """Statements that change tables, then a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = opened(spark, sf_dir)
        for s in statements:
            session.execute(s)
        return session.query(query)

    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


def frames(name: str, oracle: str):
    """A query of the DataFrame functions."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        SQL[name] = oracle
        return f

    return add


# -- the flagship ---------------------------------------------------------------------------

FLAGSHIP = """
SELECT c.c_mktsegment,
       IFF(o.o_totalprice > 100000, 'high', 'low')       AS tier,
       COUNT(o.o_orderkey)                               AS n_orders,
       ROUND(SUM(NVL(o.o_totalprice, 0)), 2)             AS revenue,
       MAX(DATEDIFF(month, o.o_orderdate, '2002-01-01')) AS age_months
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
GROUP BY c.c_mktsegment, IFF(o.o_totalprice > 100000, 'high', 'low')
HAVING COUNT(o.o_orderkey) > 0
ORDER BY revenue DESC LIMIT 20
"""
dialect("flagship", FLAGSHIP, """
SELECT c.c_mktsegment, IF(o.o_totalprice > 100000, 'high', 'low') AS tier, COUNT(o.o_orderkey) AS n_orders, ROUND(SUM(COALESCE(o.o_totalprice, 0)), 2) AS revenue,
       MAX(DATE_DIFF('month', CAST(o.o_orderdate AS DATE), DATE '2002-01-01')) AS age_months
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1, 2 HAVING COUNT(o.o_orderkey) > 0 ORDER BY revenue DESC LIMIT 20
""")  # fmt: skip


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


# -- scans, projections, filters ----------------------------------------------------------------

same("scan_all", "SELECT * FROM nation")
same("scan_one_row", "SELECT 1 AS one, 'a' AS letter")
same("scan_project", "SELECT c_custkey AS id, c_name AS name, c_acctbal * 2 AS twice FROM customer")
same("filter_compare", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus != 'F'")
same("filter_in", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
same("filter_null", "SELECT r_regionkey, NULLIF(r_name, 'ASIA') AS name FROM region WHERE NULLIF(r_name, 'ASIA') IS NOT NULL")
dialect("filter_is_null", "SELECT r_regionkey FROM region WHERE NULLIF(r_regionkey, 2) IS NULL", "SELECT r_regionkey FROM region WHERE NULLIF(r_regionkey, 2) IS NULL")
dialect("filter_function", "SELECT o_orderkey FROM orders WHERE IFF(o_totalprice > 100000, o_orderstatus, 'X') = 'F'", "SELECT o_orderkey FROM orders WHERE IF(o_totalprice > 100000, o_orderstatus, 'X') = 'F'")
same("filter_between_like", "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand LIKE 'Brand#1%'")
same("filter_case_cast", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 's' WHEN l_quantity < 30 THEN 'm' ELSE 'l' END AS bucket, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE NOT (l_returnflag = 'A' OR l_linestatus = 'F')")

# -- functions ---------------------------------------------------------------------------------------

dialect("fn_iff", "SELECT o_orderkey, IFF(o_totalprice > 150000, 'high', IFF(o_totalprice > 50000, 'mid', 'low')) AS tier FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS tier FROM orders")
dialect("fn_nvl", "SELECT c_custkey, NVL(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer", "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
dialect("fn_ifnull", "SELECT c_custkey, IFNULL(NULLIF(c_nationkey, 3), -1) AS n FROM customer", "SELECT c_custkey, COALESCE(NULLIF(c_nationkey, 3), -1) AS n FROM customer")
dialect("fn_nvl2", "SELECT c_custkey, NVL2(NULLIF(c_nationkey, 3), 'known', 'unknown') AS n FROM customer", "SELECT c_custkey, IF(NULLIF(c_nationkey, 3) IS NOT NULL, 'known', 'unknown') AS n FROM customer")
for _part, _n in (("day", 7), ("week", 2), ("month", 1), ("quarter", 1), ("year", -1), ("hour", 25)):
    dialect(f"fn_dateadd_{_part}", f"SELECT event_id, DATEADD({_part}, {_n}, ts) AS d FROM events", f"SELECT event_id, CAST(CAST(ts AS DATE) + INTERVAL ({_n}) {_part} AS TIMESTAMP) AS d FROM events")
for _part in ("day", "week", "month", "quarter", "year", "hour", "minute", "second"):
    dialect(f"fn_datediff_{_part}", f"SELECT o_orderkey, DATEDIFF({_part}, o_orderdate, '1998-02-17') AS n FROM orders", f"SELECT o_orderkey, DATE_DIFF('{_part}', CAST(o_orderdate AS DATE), DATE '1998-02-17') AS n FROM orders")
dialect("fn_to_variant", "SELECT event_id, TO_JSON(TO_VARIANT(user_id)) AS v FROM events", "SELECT event_id, CAST(CAST(user_id AS JSON) AS VARCHAR) AS v FROM events")
dialect("fn_parse_json", "SELECT event_id, PARSE_JSON(props):k::BIGINT AS k FROM events", "SELECT event_id, CAST(CAST(props AS JSON)->>'k' AS BIGINT) AS k FROM events")
dialect("fn_object_construct", "SELECT n_nationkey, OBJECT_CONSTRUCT('key', n_nationkey, 'name', NULLIF(n_name, 'FRANCE')) AS o FROM nation", "SELECT n_nationkey, CAST(json_object('key', n_nationkey, 'name', NULLIF(n_name, 'FRANCE')) AS VARCHAR) AS o FROM nation")
dialect("fn_flatten", "SELECT label, ROUND(SUM(CAST(x AS DOUBLE)), 3) AS total, COUNT(*) AS n FROM (SELECT label, FLATTEN(embedding) AS x FROM embeddings) GROUP BY label", "SELECT label, ROUND(SUM(CAST(x AS DOUBLE)), 3) AS total, COUNT(*) AS n FROM (SELECT label, UNNEST(embedding) AS x FROM embeddings) GROUP BY label")
dialect("fn_table_flatten", "SELECT e.vec_id, f.index AS i, ROUND(f.value::DOUBLE, 5) AS x FROM embeddings e, TABLE(FLATTEN(input => e.embedding)) f", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS i, ROUND(CAST(UNNEST(embedding) AS DOUBLE), 5) AS x FROM embeddings")
dialect("fn_concat", "SELECT c_custkey, CONCAT(c_name, ' <', NULLIF(c_mktsegment, 'BUILDING'), '>') AS label FROM customer", "SELECT c_custkey, CONCAT(c_name, ' <', NULLIF(c_mktsegment, 'BUILDING'), '>') AS label FROM customer")
same("fn_string", "SELECT p_partkey, LENGTH(p_name) AS n, SUBSTR(p_name, 2, 3) AS s, UPPER(p_type) AS u, LOWER(p_brand) AS l, REPLACE(p_brand, '#', '-') AS r, TRIM(p_name) AS t, LPAD(p_brand, 12, '*') AS pad FROM part")
same("fn_substr_zero", "SELECT p_partkey, SUBSTR(p_name, 0, 3) AS s FROM part")
same("fn_math", "SELECT l_orderkey, l_linenumber, ROUND(ABS(l_tax - l_discount), 4) AS d, CAST(FLOOR(l_quantity / 7) AS BIGINT) AS f, CAST(CEIL(l_quantity / 7) AS BIGINT) AS c, CAST(l_orderkey % 7 AS BIGINT) AS m, ROUND(POWER(l_quantity, 2), 2) AS p, ROUND(SQRT(l_extendedprice), 6) AS s FROM lineitem")
same("fn_date", "SELECT event_id, CAST(EXTRACT(year FROM ts) AS BIGINT) AS y, CAST(EXTRACT(hour FROM ts) AS BIGINT) AS h, CAST(LAST_DAY(CAST(ts AS DATE)) AS VARCHAR) AS l FROM events")
dialect("fn_nested", "SELECT c_custkey, NVL2(NULLIF(c_nationkey, 1), IFF(c_acctbal > 0, CONCAT('+', c_name), 'neg'), 'N/A') AS x FROM customer WHERE NVL(NULLIF(c_mktsegment, 'X'), 'q') != 'q'", "SELECT c_custkey, IF(NULLIF(c_nationkey, 1) IS NOT NULL, IF(c_acctbal > 0, CONCAT('+', c_name), 'neg'), 'N/A') AS x FROM customer WHERE COALESCE(NULLIF(c_mktsegment, 'X'), 'q') != 'q'")
dialect("fn_literals_untouched", "SELECT 'IFF(a, b, c) -- :1 ?' AS a, 'it''s' AS b /* NVL(x, y) */ FROM dual", "SELECT 'IFF(a, b, c) -- :1 ?' AS a, 'it''s' AS b")
dialect("fn_current", "SELECT CURRENT_DATE() <= CURRENT_DATE AS d, CURRENT_TIMESTAMP() >= CURRENT_TIMESTAMP AS t", "SELECT true AS d, true AS t")

# -- aggregates ------------------------------------------------------------------------------------------

dialect("agg_listagg", "SELECT user_id, LISTAGG(DISTINCT event_type, ',') AS kinds FROM events GROUP BY user_id", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
dialect("agg_listagg_nulls", "SELECT n_regionkey, LISTAGG(NULLIF(n_name, 'CHINA'), '; ') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(NULLIF(n_name, 'CHINA'), '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
same("agg_group", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS disc FROM lineitem GROUP BY l_returnflag, l_linestatus")
same("agg_expr_group", "SELECT CAST(FLOOR(l_quantity / 10) AS BIGINT) AS bucket, COUNT(*) AS n FROM lineitem GROUP BY CAST(FLOOR(l_quantity / 10) AS BIGINT)")
dialect("agg_alias_group", "SELECT IFF(o_totalprice > 100000, 'h', 'l') AS tier, COUNT(*) AS n FROM orders GROUP BY tier", "SELECT IF(o_totalprice > 100000, 'h', 'l') AS tier, COUNT(*) AS n FROM orders GROUP BY tier")
dialect("agg_conditional", "SELECT o_orderpriority, CAST(SUM(IFF(o_orderstatus = 'F', 1, 0)) AS BIGINT) AS f FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, CAST(SUM(IF(o_orderstatus = 'F', 1, 0)) AS BIGINT) AS f FROM orders GROUP BY o_orderpriority")
same("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
same("agg_global", "SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, MIN(value) AS lo, MAX(value) AS hi FROM events")
same("agg_statistics", "SELECT event_type, ROUND(STDDEV(value), 4) AS sd, ROUND(VARIANCE(value), 3) AS var, ROUND(MEDIAN(value), 6) AS med, BOOL_AND(value > -1e9) AS all_big, BOOL_OR(value < 0) AS any_neg FROM events GROUP BY event_type")
same("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("agg_cube", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")

# -- joins -----------------------------------------------------------------------------------------------

same("join_inner", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
same("join_three", "SELECT n.n_name, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
dialect("join_left_filter", "SELECT c.c_custkey, NVL(c.c_name, 'x') AS name, ROUND(SUM(o.o_totalprice), 2) AS total FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus != 'F' GROUP BY c.c_custkey, c.c_name", "SELECT c.c_custkey, COALESCE(c.c_name, 'x') AS name, ROUND(SUM(o.o_totalprice), 2) AS total FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus != 'F' GROUP BY c.c_custkey, c.c_name")
dialect("join_expr", "SELECT COUNT(*) AS n FROM customer c JOIN supplier s ON NVL(c.c_nationkey, -1) = NVL(s.s_nationkey, -2)", "SELECT COUNT(*) AS n FROM customer c JOIN supplier s ON COALESCE(c.c_nationkey, -1) = COALESCE(s.s_nationkey, -2)")
same("join_right", "SELECT n.n_name, r.r_regionkey FROM (SELECT * FROM nation WHERE n_nationkey < 8) n RIGHT JOIN region r ON n.n_regionkey = r.r_regionkey")
same("join_full", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey")
same("join_cross", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
same("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
same("join_using", "SELECT n_nationkey, COUNT(*) AS n FROM (SELECT n_nationkey FROM nation) a JOIN (SELECT s_nationkey AS n_nationkey FROM supplier) b USING (n_nationkey) GROUP BY n_nationkey")
same("join_semi", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
same("join_anti", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXTRACT(year FROM o.o_orderdate) = 1996)")

# -- windows, sorts, sets, subqueries ------------------------------------------------------------------------

same("window_rank", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dr FROM orders")
same("window_frame", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev, FIRST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events")
same("window_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
same("window_qualify_alias", "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders QUALIFY rn <= 2")
same("sort_nulls_last", "SELECT c_custkey, NULLIF(c_mktsegment, 'BUILDING') AS seg FROM customer ORDER BY seg, c_custkey")
same("sort_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
same("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
dialect("limit_zero", "SELECT * FROM orders LIMIT 0", "SELECT * FROM orders LIMIT 0")
same("distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
same("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
same("set_union_all", "SELECT r_regionkey AS k FROM region UNION ALL SELECT n_regionkey FROM nation")
same("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
same("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
same("cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 1000000) SELECT c.c_name, ROUND(top.t, 2) AS t FROM top JOIN customer c ON c.c_custkey = top.o_custkey")
same("derived_table", "SELECT s, COUNT(*) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_totalprice > 50000) x GROUP BY s")
same("scalar_subquery", "SELECT o_orderkey, ROUND(o_totalprice - (SELECT AVG(o_totalprice) FROM orders), 2) AS above FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
same("correlated_subquery", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT AVG(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)")
same("in_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
same("pivoted", "SELECT l_returnflag, CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o, CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f FROM lineitem GROUP BY l_returnflag")

dialect("pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (COUNT(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))", "SELECT l_returnflag, NULLIF(COUNT(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0) AS o, NULLIF(COUNT(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0) AS f FROM lineitem GROUP BY l_returnflag")
dialect("unpivot", "SELECT * FROM (SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS cust, CAST(o_orderkey % 7 AS BIGINT) AS rest FROM orders) UNPIVOT (v FOR k IN (cust, rest))", "SELECT o_orderkey, 'cust' AS k, CAST(o_custkey AS BIGINT) AS v FROM orders UNION ALL SELECT o_orderkey, 'rest', CAST(o_orderkey % 7 AS BIGINT) FROM orders")
same("recursive_cte", "WITH RECURSIVE up(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM up WHERE n < 20) SELECT n, total FROM up")
same("join_natural", "SELECT COUNT(*) AS n FROM (SELECT n_nationkey AS k FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k FROM supplier) b")
same("join_range", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR")
_ASOF = "SELECT e.event_id, o.event_id AS last_view FROM events e LEFT JOIN events o ON o.user_id = e.user_id AND o.event_type = 'view' AND o.ts < e.ts QUALIFY ROW_NUMBER() OVER (PARTITION BY e.event_id ORDER BY o.ts DESC NULLS LAST, o.event_id DESC NULLS LAST) = 1"
# both sides in one sorted list: at equal times the rows that ask stand before those that answer
dialect("join_asof", """
SELECT event_id, last_view FROM (
  SELECT event_id, asks, LAST_VALUE(view_id) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, asks DESC, view_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view
  FROM (SELECT event_id, user_id, ts, 1 AS asks, NULL::BIGINT AS view_id FROM events UNION ALL SELECT NULL, user_id, ts, 0, event_id FROM events WHERE event_type = 'view') x
) y WHERE asks = 1
""", _ASOF)  # fmt: skip
same("window_ntile", "SELECT o_orderkey, NTILE(4) OVER (ORDER BY o_totalprice, o_orderkey) AS q, ROUND(CUME_DIST() OVER (ORDER BY o_totalprice, o_orderkey), 9) AS c, ROUND(PERCENT_RANK() OVER (ORDER BY o_totalprice, o_orderkey), 9) AS p FROM orders")
same("window_range", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY CAST(EXTRACT(day FROM ts) AS BIGINT) RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM events")
same("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
same("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
dialect("agg_any_array", "SELECT n_regionkey, ANY_VALUE(n_regionkey) AS a, ARRAY_TO_STRING(ARRAY_SORT(ARRAY_AGG(n_name)), ',') AS names, ARRAY_SIZE(ARRAY_AGG(DISTINCT n_name)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, ANY_VALUE(n_regionkey) AS a, ARRAY_TO_STRING(LIST_SORT(ARRAY_AGG(n_name)), ',') AS names, CAST(len(ARRAY_AGG(DISTINCT n_name)) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
dialect("agg_approx", "SELECT event_type, ABS(APPROX_COUNT_DISTINCT(user_id) - COUNT(DISTINCT user_id)) <= 0.15 * COUNT(DISTINCT user_id) + 1 AS near, ABS(APPROX_QUANTILE(value, 0.5) - MEDIAN(value)) <= STDDEV(value) AS mid FROM events GROUP BY event_type", "SELECT DISTINCT event_type, true AS near, true AS mid FROM events")
same("agg_percentile", "SELECT event_type, ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY value), 6) AS p90, CAST(PERCENTILE_DISC(0.5) WITHIN GROUP (ORDER BY event_id) AS BIGINT) AS d50 FROM events GROUP BY event_type")
same("agg_filter", "SELECT o_orderstatus, COUNT(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus")
same("agg_distinct_mixed", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS c, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_orderdate) AS lo, MAX(o_orderdate) AS hi FROM orders GROUP BY o_orderstatus")
same("agg_grouping", "SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag) AS BIGINT) AS gr, CAST(GROUPING(l_linestatus) AS BIGINT) AS gl, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("agg_grouping_id", "SELECT l_returnflag, l_linestatus, CAST(GROUPING_ID(l_returnflag, l_linestatus) AS BIGINT) AS g, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
dialect("sort_fetch", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 10 ROWS FETCH NEXT 20 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
same("filter_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%1%' OR p_brand ILIKE 'brand#1_'")
same("fn_try_cast", "SELECT p_partkey, TRY_CAST(SPLIT_PART(p_brand, '#', 2) AS INTEGER) AS n, TRY_CAST(p_brand AS INTEGER) AS bad FROM part")
same("fn_date_trunc", "SELECT event_id, CAST(DATE_TRUNC('month', ts) AS TIMESTAMP) AS m, CAST(DATE_TRUNC('hour', ts) AS TIMESTAMP) AS h, CAST(DATE_TRUNC('week', ts) AS TIMESTAMP) AS w FROM events")
dialect("fn_to_char", "SELECT event_id, TO_CHAR(ts, 'YYYY-MM-DD HH24:MI:SS') AS d, TO_VARCHAR(ts, 'DD/MM/YY') AS e FROM events", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS d, strftime(ts, '%d/%m/%y') AS e FROM events")
same("fn_string_more", "SELECT c_custkey, RPAD(c_mktsegment, 12, '.') AS r, CONCAT(UPPER(SUBSTR(c_mktsegment, 1, 1)), LOWER(SUBSTR(c_mktsegment, 2, 20))) AS t, LTRIM(c_name) AS l, STARTS_WITH(c_name, 'C') AS s, ASCII(c_name) AS a, REPEAT('x', 3) AS x, LEFT(c_name, 3) AS le, RIGHT(c_name, 3) AS ri FROM customer")
same("fn_math_more", "SELECT l_orderkey, l_linenumber, ROUND(LN(l_quantity), 6) AS ln, ROUND(LOG10(l_quantity), 6) AS lg, ROUND(EXP(l_tax), 6) AS e, ROUND(SIN(l_quantity) + COS(l_quantity) + ATAN2(l_tax, l_quantity), 6) AS t, SIGN(l_tax - l_discount) AS s, GREATEST(l_tax, l_discount) AS g, LEAST(l_tax, l_discount) AS le FROM lineitem")
same("window_nth", "SELECT event_id, NTH_VALUE(event_type, 2) OVER w AS second, LAST_VALUE(event_id) OVER w AS last, LEAD(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
dialect("fn_array", "SELECT p_partkey, ARRAY_CONTAINS(SPLIT(p_name, ' '), 'green') AS g, ARRAY_TO_STRING(SLICE(SPLIT(p_name, ' '), 1, 2), '+') AS two, ARRAY_SIZE(SPLIT(p_name, ' ')) AS n, ELEMENT_AT(ARRAY(p_size, 7, p_size), 1) AS first, ARRAY_TO_STRING(ARRAY_SORT(ARRAY_DISTINCT(ARRAY(p_size, 7, p_size))), ',') AS s FROM part", "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'green') AS g, array_to_string(string_split(p_name, ' ')[1:2], '+') AS two, CAST(len(string_split(p_name, ' ')) AS INTEGER) AS n, [p_size, 7, p_size][1] AS first, array_to_string(list_sort(list_distinct([p_size, 7, p_size])), ',') AS s FROM part")
dialect("fn_map_struct", "SELECT n_nationkey, MAP('k', n_name, 'r', 'x')['k'] AS v, ELEMENT_AT(MAP('k', n_name), 'none') AS missing, NAMED_STRUCT('a', n_regionkey, 'b', n_name).a AS a, ARRAY_TO_STRING(MAP_KEYS(MAP('k', 1, 'l', 2)), '') AS keys FROM nation", "SELECT n_nationkey, MAP {'k': n_name, 'r': 'x'}['k'] AS v, CAST(NULL AS VARCHAR) AS missing, struct_pack(a := n_regionkey, b := n_name).a AS a, 'kl' AS keys FROM nation")
dialect("fn_json", "SELECT event_id, GET_JSON_OBJECT(props, '$.k') AS k, SCHEMA_OF_VARIANT(PARSE_JSON(props):k) AS kind, ARRAY_TO_STRING(JSON_OBJECT_KEYS(props), ',') AS keys FROM events", "SELECT event_id, props::JSON->>'$.k' AS k, CASE json_type(props::JSON, '$.k') WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(props::JSON, '$.k') END AS kind, array_to_string(json_keys(props), ',') AS keys FROM events")
dialect("scan_exclude", "SELECT * EXCLUDE (c_name, c_acctbal) FROM customer WHERE c_nationkey = 3", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 3")
same("fn_engine_dates", "SELECT event_id, STRFTIME(ts, '%d.%m.%Y %H:%M') AS f, DATE_DIFF('hour', ts, TIMESTAMP '2024-06-01 00:30:00') AS h, DATE_DIFF('month', ts, TIMESTAMP '2024-06-01 00:30:00') AS m FROM events")
dialect("fn_engine_arrays", "SELECT p_partkey, ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT(p_brand, '#'), x -> UPPER(x)), '|') AS u, ARRAY_SIZE(LIST_FILTER(ARRAY_CONSTRUCT(p_size, 3, 30), x -> x > 10)) AS big, STRPOS(p_brand, '#') AS at, ARRAY_SIZE(ARRAY_CAT(ARRAY_CONSTRUCT(1), ARRAY_CONSTRUCT(2, 3))) AS n FROM part", "SELECT p_partkey, array_to_string(list_transform(string_split(p_brand, '#'), lambda x: upper(x)), '|') AS u, CAST(len(list_filter([p_size, 3, 30], lambda x: x > 10)) AS INTEGER) AS big, CAST(strpos(p_brand, '#') AS INTEGER) AS at, 3::INTEGER AS n FROM part")
dialect("fn_to_date", "SELECT o_orderkey, CAST(TO_DATE(TO_CHAR(o_orderdate, 'DD/MM/YYYY'), 'DD/MM/YYYY') AS VARCHAR) AS d FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders")
dialect("fn_unnest", "SELECT label, COUNT(*) AS n FROM (SELECT label, UNNEST(embedding) AS x FROM embeddings) y WHERE x > 0 GROUP BY label", "SELECT label, COUNT(*) AS n FROM (SELECT label, UNNEST(embedding) AS x FROM embeddings) y WHERE x > 0 GROUP BY label")
dialect("sample_share", "SELECT COUNT(*) BETWEEN 0.2 * (SELECT COUNT(*) FROM lineitem) AND 0.4 * (SELECT COUNT(*) FROM lineitem) AS near FROM lineitem SAMPLE (30)", "SELECT true AS near")
dialect("sample_rows", "SELECT COUNT(*) AS n, COUNT(DISTINCT s.l_orderkey) > 1 AS several FROM lineitem AS s TABLESAMPLE (50 ROWS) JOIN orders o ON o.o_orderkey = s.l_orderkey", "SELECT 50::BIGINT AS n, true AS several")
dialect("fn_regexp", "SELECT p_partkey, REGEXP_REPLACE(p_brand, '[0-9]', 'x') AS b, SPLIT_PART(p_name, ' ', 1) AS w, REVERSE(p_brand) AS r, CAST(POSITION('#' IN p_brand) AS BIGINT) AS place FROM part", "SELECT p_partkey, REGEXP_REPLACE(p_brand, '[0-9]', 'x', 'g') AS b, SPLIT_PART(p_name, ' ', 1) AS w, REVERSE(p_brand) AS r, CAST(POSITION('#' IN p_brand) AS BIGINT) AS place FROM part")

# -- bindings ---------------------------------------------------------------------------------------------------

dialect("bind_numbered", "SELECT o_orderkey FROM orders WHERE o_totalprice > :1 AND o_orderstatus = :2 AND o_orderdate >= :3", "SELECT o_orderkey FROM orders WHERE o_totalprice > 150000.5 AND o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01'", {"1": {"type": "REAL", "value": "150000.5"}, "2": {"type": "TEXT", "value": "F"}, "3": {"type": "DATE", "value": "1996-01-01"}})
dialect("bind_question", "SELECT n_nationkey FROM nation WHERE n_regionkey = ? OR n_name = ?", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2 OR n_name = 'FRANCE'", [{"type": "FIXED", "value": "2"}, {"type": "TEXT", "value": "FRANCE"}])

# -- changes of tables --------------------------------------------------------------------------------------------

_ALL = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM s"
_COPY = "CREATE TABLE s AS SELECT * FROM supplier"
script("dml_insert", ["CREATE TABLE n (k INTEGER PRIMARY KEY, name VARCHAR(25), r INTEGER DEFAULT 9)", "INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation", "INSERT INTO n (name, k) VALUES ('ATLANTIS', 100), ('MU', 101)"], "SELECT k, name, r FROM n", "SELECT n_nationkey AS k, n_name AS name, n_regionkey AS r FROM nation UNION ALL VALUES (100, 'ATLANTIS', 9), (101, 'MU', 9)")
script("dml_update", [_COPY, "UPDATE s SET s_acctbal = IFF(s_acctbal < 0, 0, s_acctbal * 2), s_name = CONCAT(s_name, '!') WHERE s_nationkey IN (1, 2, 3)"], _ALL, "SELECT s_suppkey, CASE WHEN s_nationkey IN (1, 2, 3) THEN CONCAT(s_name, '!') ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey IN (1, 2, 3) THEN IF(s_acctbal < 0, 0, s_acctbal * 2) ELSE s_acctbal END AS s_acctbal FROM supplier")
script("dml_delete", [_COPY, "DELETE FROM s WHERE s_acctbal < 1000"], _ALL, "SELECT * FROM supplier WHERE NOT s_acctbal < 1000")
script("dml_update_from", [_COPY, "UPDATE s SET s_acctbal = s.s_acctbal + n.n_regionkey, s_name = n.n_name FROM nation n WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey > 1"], _ALL, "SELECT s_suppkey, CASE WHEN n_regionkey > 1 THEN n_name ELSE s_name END AS s_name, s_nationkey, CASE WHEN n_regionkey > 1 THEN s_acctbal + n_regionkey ELSE s_acctbal END AS s_acctbal FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
script("dml_delete_using", [_COPY, "DELETE FROM s USING nation n, region r WHERE n.n_nationkey = s.s_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_regionkey < 2"], _ALL, "SELECT supplier.* FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey IS NULL OR n_regionkey >= 2")
_LINES = "CREATE TABLE l AS SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem"
script("dml_update_large", [_LINES, "UPDATE l SET l_quantity = l_quantity + 1, l_returnflag = 'Z' WHERE l_orderkey % 3 = 0"], "SELECT l_returnflag, COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS q FROM l GROUP BY l_returnflag", "SELECT IF(l_orderkey % 3 = 0, 'Z', l_returnflag) AS l_returnflag, COUNT(*) AS n, CAST(SUM(IF(l_orderkey % 3 = 0, l_quantity + 1, l_quantity)) AS BIGINT) AS q FROM lineitem GROUP BY 1")
script("dml_merge_large", [_LINES, "MERGE INTO l USING (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 0) o ON l.l_orderkey = o.o_orderkey WHEN MATCHED AND o.o_custkey % 2 = 0 THEN DELETE WHEN MATCHED THEN UPDATE SET l_quantity = 0"], "SELECT COUNT(*) AS n, CAST(SUM(l_quantity) AS BIGINT) AS q FROM l", "SELECT COUNT(*) AS n, CAST(SUM(IF(o_orderkey IS NULL, l_quantity, 0)) AS BIGINT) AS q FROM lineitem LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 5 = 0) ON l_orderkey = o_orderkey WHERE o_orderkey IS NULL OR o_custkey % 2 <> 0")
script("ddl_view", ["CREATE VIEW big AS SELECT c_custkey, IFF(c_acctbal > 5000, 'y', 'n') AS rich FROM customer"], "SELECT rich, COUNT(*) AS n FROM big GROUP BY rich", "SELECT IF(c_acctbal > 5000, 'y', 'n') AS rich, COUNT(*) AS n FROM customer GROUP BY 1")
script("show_schemas", ["CREATE DATABASE d", "CREATE SCHEMA d.a COMMENT = 'x'"], "SHOW SCHEMAS IN DATABASE d", "SELECT * FROM (VALUES ('A', 'D', 'x'), ('PUBLIC', 'D', '')) AS t(name, database_name, comment)")
script("dml_truncate", [_COPY, "TRUNCATE TABLE s"], "SELECT COUNT(*) AS n FROM s", "SELECT 0::BIGINT AS n")
script("dml_merge", [_COPY, """
MERGE INTO s AS t USING (SELECT s_suppkey AS k, s_nationkey AS n, CONCAT('new ', s_name) AS name FROM supplier WHERE s_suppkey % 3 = 0
                         UNION ALL SELECT s_suppkey + 1000000, s_nationkey, s_name FROM supplier WHERE s_suppkey % 10 = 0) AS u
ON t.s_suppkey = u.k
WHEN MATCHED AND u.n = 5 THEN DELETE
WHEN MATCHED AND t.s_acctbal > 5000 THEN UPDATE SET t.s_name = u.name, s_acctbal = 0
WHEN MATCHED THEN UPDATE SET s_name = u.name
WHEN NOT MATCHED AND u.n < 20 THEN INSERT (s_suppkey, s_name, s_nationkey) VALUES (u.k, UPPER(u.name), u.n)
"""], _ALL, """
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN CONCAT('new ', s_name) ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_suppkey % 3 = 0 AND s_acctbal > 5000 THEN 0 ELSE s_acctbal END AS s_acctbal
FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_nationkey = 5)
UNION ALL SELECT s_suppkey + 1000000, UPPER(s_name), s_nationkey, NULL FROM supplier WHERE s_suppkey % 10 = 0 AND s_nationkey < 20
""")  # fmt: skip
script("ddl_alter_add", ["CREATE TABLE r AS SELECT * FROM region", "ALTER TABLE r ADD COLUMN note VARCHAR(10)", "INSERT INTO r VALUES (99, 'X', 'y')"], "SELECT r_regionkey, r_name, note FROM r", "SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region UNION ALL VALUES (99, 'X', 'y')")
script("tx_commit", [_COPY, "BEGIN", "DELETE FROM s WHERE s_nationkey = 1", "COMMIT"], "SELECT COUNT(*) AS n FROM s", "SELECT COUNT(*) AS n FROM supplier WHERE s_nationkey <> 1")
script("tx_rollback", [_COPY, "BEGIN TRANSACTION", "DELETE FROM s", "ROLLBACK"], "SELECT COUNT(*) AS n FROM s", "SELECT COUNT(*) AS n FROM supplier")
script("copy_csv", ["CREATE STAGE st", "COPY INTO @st/regions FROM region FILE_FORMAT = (TYPE = CSV)", "CREATE TABLE r (r_regionkey INTEGER, r_name VARCHAR)", "COPY INTO r FROM @st/regions PATTERN = '*.csv' FILE_FORMAT = (TYPE = CSV FIELD_DELIMITER = ',')"], "SELECT r_regionkey, r_name FROM r", "SELECT * FROM region")
script("copy_parquet", ["CREATE STAGE st", "COPY INTO @st/n FROM nation FILE_FORMAT = (TYPE = PARQUET)", "CREATE TABLE r (n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER)", "COPY INTO r FROM @st/n PATTERN = '*.parquet' FILE_FORMAT = (TYPE = PARQUET)"], "SELECT n_nationkey, n_name, n_regionkey FROM r", "SELECT * FROM nation")


def loads(name: str, files: dict[str, str], statements: list[str], query: str, oracle: str, fails: str = "") -> None:
    """COPY of staged files of fixed content; with ``fails``, the last statement must raise that kind of error."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = opened(spark, sf_dir)
        session.execute("CREATE STAGE st")
        for file, text in files.items():
            session.engine.stages.put(session.database, session.schema, "st", file, text.encode())
        for s in statements[:-1] if fails else statements:
            session.execute(s)
        kind = ""
        if fails:
            try:
                session.execute(statements[-1])
            except EngineError as e:
                kind = type(e).__name__
        out = session.query(query)
        return out.withColumn("error", F.lit(kind)) if fails else out

    QUERIES[name], SQL[name] = run, oracle


_T = "CREATE TABLE t (id INTEGER, name VARCHAR)"
_ROWS = "SELECT id, name FROM t"
loads("copy_json", {"a.json": '[{"id": 1, "name": "x"}, {"id": 2}, 7]'}, ["CREATE TABLE j (data VARIANT)", "COPY INTO j FROM @st FILE_FORMAT = (TYPE = JSON STRIP_OUTER_ARRAY = TRUE)"], "SELECT data:id::INTEGER AS id, data:name::VARCHAR AS name FROM j", "SELECT * FROM (VALUES (1, 'x'), (2, NULL)) t(id, name)")
loads("copy_json_multiline", {"a.json": '[\n {"id": 1,\n  "name": "x"},\n\n {"id": 2}\n]\n', "b.json": '{\n "id": 3\n}'}, ["CREATE TABLE j (data VARIANT)", "COPY INTO j FROM @st FILE_FORMAT = (TYPE = JSON STRIP_OUTER_ARRAY = TRUE)"], "SELECT data:id::INTEGER AS id, data:name::VARCHAR AS name FROM j", "SELECT * FROM (VALUES (1, 'x'), (2, NULL), (3, NULL)) t(id, name)")
loads("copy_json_array_wrapped", {"a.json": '[\n {"id": 1},\n 7, "s"]'}, ["CREATE TABLE j (data VARCHAR)", "COPY INTO j FROM @st FILE_FORMAT = (TYPE = JSON)"], "SELECT data FROM j", """SELECT * FROM (VALUES ('{"$1":{"id":1}}'), ('{"$1":7}'), ('{"$1":"s"}')) t(data)""")
loads("copy_csv_skip_header", {"a.csv": 'made by,"hand\nand eye"\nid,name\n1,a\n2,"b\nc"\n', "b.csv": "x\nid,name\n3,d\n"}, [_T, "COPY INTO t FROM @st FILE_FORMAT = (TYPE = CSV SKIP_HEADER = 2)"], _ROWS, "SELECT * FROM (VALUES (1, 'a'), (2, 'b' || chr(10) || 'c'), (3, 'd')) t(id, name)")
loads("copy_csv_options", {"a.csv": " 1 | NA \n2|-\n", "sub/b.csv": "3|x\n", "c.txt": "9|no\n"}, [_T, "COPY INTO t FROM @st PATTERN='*.csv' FILE_FORMAT=(TYPE = CSV, FIELD_DELIMITER='|' NULL_IF = ('NA', '-') TRIM_SPACE=TRUE) PURGE = TRUE"], _ROWS, "SELECT * FROM (VALUES (1, NULL), (2, NULL), (3, 'x')) t(id, name)")
loads("copy_csv_dates", {"a.csv": "31.12.2023,2024-01-02 03:04:05\n"}, ["CREATE TABLE t (d DATE, ts TIMESTAMP)", "COPY INTO t FROM @st FILE_FORMAT = (TYPE = CSV DATE_FORMAT = 'DD.MM.YYYY' TIMESTAMP_FORMAT = 'YYYY-MM-DD HH24:MI:SS')"], "SELECT CAST(d AS VARCHAR) AS d, ts FROM t", "SELECT '2023-12-31' AS d, TIMESTAMP '2024-01-02 03:04:05' AS ts")
loads("copy_on_error", {"a.csv": "1,a\n", "b.csv": "x,b\n", "c.csv": "3,c\n"}, [_T, "COPY INTO t FROM @st ON_ERROR = SKIP_FILE"], _ROWS, "SELECT * FROM (VALUES (1, 'a'), (3, 'c')) t(id, name)")
loads("copy_abort", {"a.csv": "1,a\n", "b.csv": "x,b\n"}, [_T, "COPY INTO t FROM @st"], "SELECT COUNT(*) AS n FROM t", "SELECT 0::BIGINT AS n, 'EngineError' AS error", "EngineError")
loads("copy_files", {"a.csv": "1,a\n", "b.csv": "2,b\n", "in/c.csv": "3,c\n"}, [_T, "CREATE FILE FORMAT f TYPE = CSV", "COPY INTO t FROM @st FILES = ('b.csv') FILE_FORMAT = (FORMAT_NAME = 'f')", "COPY INTO t FROM @st/in FILE_FORMAT = f"], _ROWS, "SELECT * FROM (VALUES (2, 'b'), (3, 'c')) t(id, name)")
loads("copy_validate", {"a.csv": "1,a\n"}, [_T, "COPY INTO t FROM @st VALIDATION_MODE = RETURN_ERRORS"], "SELECT COUNT(*) AS n FROM t", "SELECT 0::BIGINT AS n")
loads("dml_merge_duplicate", {}, [_T, "INSERT INTO t VALUES (1, 'a')", "MERGE INTO t USING (SELECT 1 AS id, n_name FROM nation) s ON t.id = s.id WHEN MATCHED THEN UPDATE SET name = s.n_name"], _ROWS, "SELECT 1 AS id, 'a' AS name, 'DuplicateMatch' AS error", "DuplicateMatch")
loads("dml_not_null", {}, ["CREATE TABLE t (id INTEGER NOT NULL, name VARCHAR)", "INSERT INTO t VALUES (1, 'a')", "INSERT INTO t SELECT NULLIF(n_nationkey, 3), n_name FROM nation"], _ROWS, "SELECT 1 AS id, 'a' AS name, 'EngineError' AS error", "EngineError")


def _readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that COPY has unloaded, read by the table functions."""
    session = opened(spark, sf_dir)
    session.execute("CREATE STAGE st")
    for kind in ("csv", "json", "parquet"):
        session.execute(f"COPY INTO @st/{kind} FROM nation FILE_FORMAT = (TYPE = {kind}{' SKIP_HEADER = 1' * (kind == 'csv')})")
    at = session.engine.stages.directory(session.database, session.schema, "st")
    of = [f"SELECT '{k}' AS kind, n_nationkey, n_name FROM READ_{k}('{at}/{k}') x WHERE n_regionkey = 1" for k in ("csv", "json", "parquet")]
    return session.query(" UNION ALL ".join(of))


QUERIES["scan_files"], SQL["scan_files"] = _readers, "SELECT kind, n_nationkey, n_name FROM nation, (VALUES ('csv'), ('json'), ('parquet')) k(kind) WHERE n_regionkey = 1"
script("show_tables", [_COPY, "CREATE TABLE a (x INTEGER)"], "SHOW TABLES", "SELECT * FROM (VALUES ('A', 'TEST_DB', 'PUBLIC', 'BASE TABLE', 1, ''), ('S', 'TEST_DB', 'PUBLIC', 'BASE TABLE', 4, '')) AS t(name, database_name, schema_name, kind, columns, comment)")
script("describe_table", ["CREATE TABLE d (id INTEGER PRIMARY KEY, name VARCHAR(20) NOT NULL, v NUMBER(10,2) DEFAULT 1)"], "DESCRIBE TABLE d", """SELECT * FROM (VALUES ('ID', 'INTEGER', 'Y', NULL, 'Y'), ('NAME', 'VARCHAR(20)', 'N', NULL, 'N'), ('V', 'NUMBER(10,2)', 'Y', '1', 'N')) AS t(name, type, "null?", "default", "primary key")""")
dialect("describe_frame", "DESC nation", """SELECT * FROM (VALUES ('n_nationkey', 'int', 'Y', CAST(NULL AS VARCHAR), 'N'), ('n_name', 'string', 'Y', NULL, 'N'), ('n_regionkey', 'int', 'Y', NULL, 'N')) AS t(name, type, "null?", "default", "primary key")""")


def _explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan's text is Spark's, without any name of the dialect's own."""
    plan = opened(spark, sf_dir).query("EXPLAIN SELECT IFF(r_regionkey > 1, 'a', 'b') AS x FROM region QUALIFY ROW_NUMBER() OVER (ORDER BY r_name) = 1")
    text = F.upper("plan")
    return plan.select(text.contains("PHYSICAL PLAN").alias("has_plan"), text.contains("PARQUET").alias("scans_files"), (text.contains("IFF(") | text.contains("QUALIFY")).alias("has_dialect"))


QUERIES["explain"], SQL["explain"] = _explain, "SELECT true AS has_plan, true AS scans_files, false AS has_dialect"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = opened(spark, sf_dir)
    session.execute("SELECT COUNT(*) FROM region")
    session.execute(_COPY)
    try:
        session.execute("SELECT FROM nowhere")
    except Exception:
        pass
    return session.engine.history.frame(spark).groupBy("status").agg(F.count("*").alias("n"))


QUERIES["query_history"], SQL["query_history"] = _history, "SELECT * FROM (VALUES ('SUCCESS', 2::BIGINT), ('FAILED', 1::BIGINT)) AS t(status, n)"


# -- the functions as DataFrame columns -------------------------------------------------------------------------------


@frames("df_functions", "SELECT o_orderkey, IF(o_totalprice > 100000, 'high', 'low') AS tier, COALESCE(NULLIF(o_orderstatus, 'F'), '?') AS st, IF(NULLIF(o_orderstatus, 'F') IS NOT NULL, 1, 0) AS known, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS TIMESTAMP) AS due, DATE_DIFF('quarter', CAST(o_orderdate AS DATE), DATE '1998-02-17') AS q, CONCAT(o_orderstatus, '-', NULL, o_orderpriority) AS c FROM orders")
def _df_functions(t):
    st = F.nullif(F.col("o_orderstatus"), F.lit("F"))
    return t("orders").select(
        "o_orderkey", D.iff(F.col("o_totalprice") > 100000, "high", "low").alias("tier"), D.nvl(st, "?").alias("st"), D.nvl2(st, 1, 0).alias("known"),
        D.dateadd("month", 1, "o_orderdate").alias("due"), D.datediff("quarter", "o_orderdate", F.lit("1998-02-17")).alias("q"),
        D.concat("o_orderstatus", F.lit("-"), F.lit(None), "o_orderpriority").alias("c"),
    )


@frames("df_aggregates", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, CAST(json_object('r', n_regionkey, 'x', NULL) AS VARCHAR) AS o FROM nation GROUP BY n_regionkey")
def _df_aggregates(t):
    by = t("nation").groupBy("n_regionkey").agg(D.listagg("n_name", ", ").alias("names"))
    return by.select("n_regionkey", "names", D.object_construct("r", F.col("n_regionkey"), "x", F.lit(None).cast("int")).alias("o"))


@frames("df_flatten", "SELECT vec_id, COUNT(*) AS n FROM (SELECT vec_id, UNNEST(embedding) AS x FROM embeddings) WHERE x > 0 GROUP BY vec_id")
def _df_flatten(t):
    return t("embeddings").select("vec_id", D.flatten("embedding").alias("x")).where("x > 0").groupBy("vec_id").agg(F.count("*").alias("n"))


@frames("df_asof", _ASOF)
def _df_asof(t):
    events = t("events")
    views = events.where("event_type = 'view'").select("user_id", "ts", "event_id")
    return asof_join(events, views, ["user_id"], "ts", "ts", ["event_id"], strict=True).select("event_id", F.col("match.event_id").alias("last_view"))
