"""All registered queries of the relational surface, and their SQL for DuckDB.

An entry is SQL text that both engines read alike, or a pair (Spark, DuckDB) where their spellings differ, or a
function and DuckDB's SQL where the query goes through the DataFrame API or the engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import TABLES
from . import engine_queries

_Entry = str | tuple[str | Callable[[SparkSession, str], DataFrame], str | None]

_REVENUE = "l_extendedprice * (1 - l_discount)"

SQL: dict[str, _Entry] = {
    # scans and projections
    "scan_project": "SELECT n_nationkey, n_name FROM nation",
    "scan_count_star": "SELECT COUNT(*) AS n FROM lineitem",
    "dual_select": "SELECT 1 + 2 AS three, 'a' || 'b' AS ab",
    "point_lookup": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 4242",
    # predicates
    "filter_compare": "SELECT p_partkey, p_size FROM part WHERE p_size >= 40 AND p_retailprice < 1500 AND p_brand <> 'Brand#11'",
    "filter_and_or_not": "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT o_orderpriority = '1-URGENT'",
    "filter_in": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)",
    "filter_not_in": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)",
    "filter_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 15",
    "filter_not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "filter_is_null": "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation WHERE NULLIF(n_regionkey, 2) IS NULL OR NULLIF(n_regionkey, 0) IS NOT NULL",
    "filter_null_logic": "SELECT n_nationkey FROM nation WHERE NOT (NULLIF(n_regionkey, 2) = 1) AND (NULLIF(n_regionkey, 3) > 0 OR n_nationkey < 9)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%'",
    "filter_not_like": "SELECT c_custkey FROM customer WHERE c_mktsegment NOT LIKE 'A%'",
    "filter_like_ci": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'building%'",
    "filter_and_residual": "SELECT o_orderkey FROM orders WHERE o_orderkey = 77 AND o_totalprice < 0",
    # scalar operators
    "expr_arith": "SELECT l_orderkey, l_partkey, l_suppkey, ROUND(l_extendedprice * (1 - l_discount) + l_tax, 4) AS v FROM lineitem",
    "expr_modulo": "SELECT o_orderkey, o_orderkey % 7 AS m, -o_orderkey % 7 AS neg FROM orders",
    "expr_int_div": ("SELECT o_orderkey, o_orderkey / 7 AS d FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS d FROM orders"),
    "expr_neg": "SELECT c_custkey, ROUND(-c_acctbal, 2) AS neg FROM customer",
    "expr_concat_op": "SELECT n_nationkey, n_name || '/' || NULLIF(n_name, 'FRANCE') AS two FROM nation",
    "expr_case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS size_class FROM part",
    "expr_case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status FROM orders",
    "expr_case_no_else_null": "SELECT n_nationkey, CASE NULLIF(n_regionkey, 2) WHEN 2 THEN 'two' WHEN 1 THEN 'one' END AS r FROM nation",
    "expr_cast": "SELECT p_partkey, CAST(p_size AS BIGINT) AS b, CAST(p_size AS DOUBLE) AS d, CAST(p_size AS VARCHAR(20)) AS s FROM part",
    "expr_cast_lenient": ("SELECT p_partkey, COALESCE(TRY_CAST(p_brand AS INT), 0) AS bad, COALESCE(TRY_CAST(CAST(p_size AS STRING) AS INT), 0) AS good FROM part", "SELECT p_partkey, COALESCE(TRY_CAST(p_brand AS INT), 0) AS bad, COALESCE(TRY_CAST(CAST(p_size AS VARCHAR) AS INT), 0) AS good FROM part"),
    # strings and conditionals
    "fn_upper_lower": "SELECT p_partkey, UPPER(p_name) AS u, LOWER(p_brand) AS l FROM part",
    "fn_trim": "SELECT n_nationkey, TRIM('  ' || n_name || ' ') AS t, LTRIM('  ' || n_name) AS l, RTRIM(n_name || '  ') AS r FROM nation",
    "fn_length": "SELECT doc_id, CAST(CHAR_LENGTH(text) AS BIGINT) AS n FROM documents",
    "fn_substring": "SELECT p_partkey, SUBSTRING(p_name, 2, 4) AS s, SUBSTRING(p_name, 3) AS tail FROM part",
    "fn_left_right": "SELECT p_partkey, LEFT(p_name, 3) AS l, RIGHT(p_name, 3) AS r FROM part",
    "fn_replace": "SELECT p_partkey, REPLACE(p_brand, 'Brand', 'B') AS b FROM part",
    "fn_reverse": "SELECT n_nationkey, REVERSE(n_name) AS r FROM nation",
    "fn_pad": "SELECT n_nationkey, LPAD(n_name, 12, '*') AS l, RPAD(n_name, 5, '-') AS r FROM nation",
    "fn_concat": ("SELECT n_nationkey, CONCAT(n_name, '-', NULLIF(n_name, 'FRANCE')) AS c FROM nation", "SELECT n_nationkey, n_name || '-' || NULLIF(n_name, 'FRANCE') AS c FROM nation"),
    "fn_nullif_coalesce_if": ("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS c, IF(n_regionkey > 2, 'hi', 'lo') AS i, IFNULL(NULLIF(n_name, 'FRANCE'), 'none') AS n FROM nation", "SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 1), -1) AS c, CASE WHEN n_regionkey > 2 THEN 'hi' ELSE 'lo' END AS i, COALESCE(NULLIF(n_name, 'FRANCE'), 'none') AS n FROM nation"),
    "fn_greatest_least": "SELECT n_nationkey, GREATEST(n_nationkey, 7, n_regionkey) AS g, LEAST(n_nationkey, 7, n_regionkey) AS l FROM nation",
    "fn_position": "SELECT p_partkey, CAST(POSITION('a' IN p_name) AS BIGINT) AS p FROM part",
    # mathematics
    "fn_abs_sign": "SELECT c_custkey, ABS(c_acctbal) AS a, CAST(SIGN(c_acctbal) AS INT) AS s FROM customer",
    "fn_round": "SELECT c_custkey, CAST(ROUND(c_acctbal) AS BIGINT) AS r0, ROUND(c_acctbal, 1) AS r1 FROM customer",
    "fn_ceil_floor": "SELECT c_custkey, CAST(CEIL(c_acctbal) AS BIGINT) AS c, CAST(FLOOR(c_acctbal) AS BIGINT) AS f FROM customer",
    "fn_power_sqrt": "SELECT p_partkey, POWER(p_size, 2) AS p, ROUND(SQRT(p_size), 8) AS s FROM part",
    "fn_mod": "SELECT p_partkey, MOD(p_size, 7) AS m FROM part",
    # dates
    "fn_year_month_day": "SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INT) AS y, CAST(MONTH(o_orderdate) AS INT) AS m, CAST(DAY(o_orderdate) AS INT) AS d FROM orders",
    "fn_date_add_sub": ("SELECT o_orderkey, CAST(DATE_ADD(CAST(o_orderdate AS DATE), 30) AS STRING) AS a, CAST(DATE_SUB(CAST(o_orderdate AS DATE), 7) AS STRING) AS s FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS a, CAST(CAST(o_orderdate AS DATE) - 7 AS VARCHAR) AS s FROM orders"),
    "fn_datediff": ("SELECT l_orderkey, l_partkey, CAST(DATEDIFF(l_shipdate, o_orderdate) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "SELECT l_orderkey, l_partkey, CAST(DATEDIFF('day', o_orderdate, l_shipdate) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "fn_extract": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(QUARTER FROM o_orderdate) AS INT) AS q FROM orders",
    "fn_now": ("SELECT n_nationkey, GETDATE() >= TIMESTAMP '2020-01-01 00:00:00' AND CURDATE() >= DATE '2020-01-01' AND NOW() IS NOT NULL AS later, LEN(NEWID()) AS id_length FROM nation", "SELECT n_nationkey, true AS later, 36 AS id_length FROM nation"),
    "fn_date_add_keeps_time": ("SELECT event_id, DATE_ADD(ts, 3) AS later, DATE_SUB(ts, 40) AS earlier FROM events", "SELECT event_id, ts + INTERVAL 3 DAY AS later, ts - INTERVAL 40 DAY AS earlier FROM events"),
    # joins
    "join_inner": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal > 5000",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 350000) o ON c.c_custkey = o.o_custkey",
    "join_right": "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 8000) c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey",
    "join_full": "SELECT c.c_custkey, o.o_orderkey FROM (SELECT * FROM customer WHERE c_acctbal > 5000) c FULL OUTER JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_comma": "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey",
    "join_self": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey + 20 < b.n_nationkey",
    "join_multikey": "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey = b.l_partkey",
    "join_multiway": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_nested": "SELECT c_custkey, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'",
    "join_null_keys": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation) a JOIN (SELECT n_nationkey, NULLIF(n_regionkey, 2) AS k FROM nation) b ON a.k = b.k",
    "join_using": "SELECT r_regionkey, n_name FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) n JOIN region USING (r_regionkey)",
    "join_natural": "SELECT r_name, n_name FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) n NATURAL JOIN region",
    "join_bigint_int": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_suppkey = n_nationkey",
    # subqueries
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)",
    "anti_not_in_null": "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT NULLIF(r_regionkey, 1) FROM region)",
    "semi_exists": "SELECT COUNT(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100)",
    "anti_not_exists": "SELECT COUNT(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)",
    "corr_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_totalprice > 250000)",
    "scalar_subquery": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part)",
    "corr_scalar": "SELECT p_partkey FROM part p WHERE p_retailprice >= (SELECT MAX(q.p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "subquery_in_select": "SELECT n_nationkey, (SELECT CAST(COUNT(*) AS BIGINT) FROM region) AS regions FROM nation",
    "subquery_in_having": "SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > (SELECT COUNT(*) * 1.5 / COUNT(DISTINCT o_custkey) FROM orders)",
    # aggregation
    "agg_global": "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi FROM lineitem",
    "agg_global_empty": "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, AVG(l_quantity) AS a FROM lineitem WHERE l_quantity < 0",
    "agg_group": "SELECT l_returnflag, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag",
    "agg_group_multi": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_expr": "SELECT o_orderkey % 100 AS k, COUNT(*) AS n FROM orders GROUP BY o_orderkey % 100",
    "agg_group_case": "SELECT CASE WHEN p_size < 25 THEN 's' ELSE 'l' END AS c, COUNT(*) AS n FROM part GROUP BY CASE WHEN p_size < 25 THEN 's' ELSE 'l' END",
    "agg_group_ordinal": "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY 1",
    "agg_group_null_key": "SELECT NULLIF(n_regionkey, 2) AS k, COUNT(*) AS n, COUNT(NULLIF(n_regionkey, 2)) AS some FROM nation GROUP BY NULLIF(n_regionkey, 2)",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_count_distinct": "SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem",
    "agg_sum_avg_distinct": "SELECT CAST(SUM(DISTINCT p_size) AS BIGINT) AS s, ROUND(AVG(DISTINCT p_size), 6) AS a FROM part",
    "agg_min_max_string": "SELECT MIN(p_name) AS lo, MAX(p_name) AS hi FROM part",
    "agg_expr_over_agg": f"SELECT l_returnflag, ROUND(SUM({_REVENUE}) / COUNT(*), 4) AS mean, ROUND(AVG(l_tax), 4) AS tax FROM lineitem GROUP BY l_returnflag",
    "agg_after_join": "SELECT n_name, COUNT(*) AS n, ROUND(SUM(c_acctbal), 2) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "distinct_rows": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "agg_group_ci": "SELECT LOWER(c_mktsegment) AS seg, COUNT(*) AS n FROM customer GROUP BY LOWER(c_mktsegment)",
    # windows
    "win_row_number": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders",
    "win_rank": "SELECT o_orderkey, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r FROM orders",
    "win_dense_rank": "SELECT o_orderkey, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS r FROM orders",
    "win_lag": "SELECT event_id, LAG(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events",
    "win_lead": "SELECT event_id, LEAD(event_type, 2) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events",
    "win_lag_default": "SELECT event_id, LAG(event_type, 1, 'none') OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events",
    "win_ntile": "SELECT o_orderkey, CAST(NTILE(5) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS t FROM orders",
    "win_sum_running": "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS s FROM orders",
    "win_sum_partition": "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey) AS BIGINT) AS s FROM orders",
    "win_avg": "SELECT event_id, ROUND(AVG(value) OVER (PARTITION BY user_id), 6) AS a FROM events",
    "win_count": "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id, event_type) AS n FROM events",
    "win_min_max": "SELECT event_id, MIN(value) OVER (PARTITION BY user_id) AS lo, MAX(value) OVER (PARTITION BY user_id) AS hi FROM events",
    "win_order_nulls": ("SELECT n_nationkey, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC, n_nationkey) AS BIGINT) AS rn FROM nation", "SELECT n_nationkey, CAST(ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) DESC NULLS LAST, n_nationkey) AS BIGINT) AS rn FROM nation"),
    "win_over_agg": "SELECT o_custkey, COUNT(*) AS n, CAST(RANK() OVER (PARTITION BY COUNT(*) ORDER BY o_custkey) AS BIGINT) AS r FROM orders GROUP BY o_custkey",
    # sorting and limits
    "sort_multi": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 40",
    "sort_desc_nulls": ("SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r DESC, n_nationkey LIMIT 22", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r DESC NULLS LAST, n_nationkey LIMIT 22"),
    "sort_asc_nulls": ("SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r, n_nationkey LIMIT 22", "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY r ASC NULLS LAST, n_nationkey LIMIT 22"),
    "sort_by_alias": "SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice DESC, p_partkey LIMIT 25",
    "sort_by_unselected": "SELECT p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "limit_projection": "SELECT n_name FROM (SELECT n_name, n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5) t",
    # set operations
    "union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "union_nested": "(SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region) UNION ALL SELECT n_nationkey FROM nation",
    "union_order_limit": "SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier ORDER BY k DESC LIMIT 12",
    "intersect_except": "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_regionkey FROM nation",
    # common table expressions and derived tables
    "cte_simple": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey",
    "cte_chained": "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT * FROM a WHERE n > 10) SELECT n, COUNT(*) AS c FROM b GROUP BY n",
    "cte_multi_ref": "WITH a AS (SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey) SELECT x.n_regionkey AS r, y.n AS other FROM a x JOIN a y ON x.n_regionkey = y.n_regionkey",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t",
    "derived_table": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) d WHERE n > 10",
    "derived_nested": "SELECT MAX(n) AS top FROM (SELECT k, COUNT(*) AS n FROM (SELECT o_custkey AS k FROM orders) a GROUP BY k) b",
    # text search: words and phrases are substrings of the lower-cased text
    "fts_contains_word": ("SELECT doc_id FROM documents WHERE CONTAINS(text, 'the')", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the')"),
    "fts_contains_all": ("SELECT doc_id FROM documents WHERE CONTAINS(text, 'the and tion')", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')"),
    "fts_contains_phrase": ("SELECT doc_id FROM documents WHERE CONTAINS(text, '\"rights reserved\"')", "SELECT doc_id FROM documents WHERE contains(lower(text), 'rights reserved')"),
    "fts_contains_prefix": ("SELECT doc_id FROM documents WHERE CONTAINS(text, 'wor*')", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|\\s)wor')"),
    "fts_freetext_any": ("SELECT doc_id FROM documents WHERE FREETEXT(text, 'idiot licensed')", "SELECT doc_id FROM documents WHERE contains(lower(text), 'idiot') OR contains(lower(text), 'licensed')"),
    # the engine's own statements, returned as frames
    **engine_queries.SQL,
    # beyond the reference
    "extra_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "extra_event_windows": ("SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, event_type, COUNT(*) AS n FROM events GROUP BY CAST(ts AS DATE), event_type", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, COUNT(*) AS n FROM events GROUP BY CAST(ts AS DATE), event_type"),
    # composites
    "tpch_q1": f"SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM({_REVENUE}), 2) AS sum_disc, ROUND(AVG(l_quantity), 6) AS avg_qty, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": f"SELECT l_orderkey, ROUND(SUM({_REVENUE}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q5": f"SELECT r_name, ROUND(SUM({_REVENUE}), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING SUM({_REVENUE}) > 0 ORDER BY revenue DESC, r_name LIMIT 10",
    "tpch_q6": "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24",
    "tpch_q10": f"SELECT c_custkey, n_name, ROUND(SUM({_REVENUE}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
}


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query through the engine, over the folder's tables as they lie there."""
    used = tuple(t for t in TABLES if re.search(rf"\b{t}\b", text))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = engine_queries.session(spark)
        for name in used:
            engine.attach(name, f"{sf_dir}/{name}.parquet")
        return engine.sql(text)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    first = {k: v if isinstance(v, str) else v[0] for k, v in SQL.items()}
    return {k: _run(v) if isinstance(v, str) else v for k, v in first.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v if isinstance(v, str) else v[1] for k, v in SQL.items() if isinstance(v, str) or v[1] is not None}
