"""Registered queries that go through the engine's statements: a script over copies of tables, and what it leaves behind."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine, EngineError
from ..sources.tables import load


def session(spark: SparkSession, profile: str = "standard") -> Engine:
    """An engine over a fresh folder of the shared storage; a temporary one only where the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lakewright-")
        atexit.register(shutil.rmtree, folder, True)
        base = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", base)
    return Engine(spark, f"{base.rstrip('/')}/engine-{uuid.uuid4().hex}", profile)


def _engine(spark: SparkSession, sf_dir: str, *names: str, profile: str = "standard") -> Engine:
    engine = session(spark, profile)
    for name in names:
        engine.import_frame(f"own_{name}", load(spark, sf_dir, name))
    return engine


def script(tables: str, statements: str, asked: str, profile: str = "standard") -> Callable[[SparkSession, str], DataFrame]:
    """A query: own copies of tables, statements run over them, and what is asked then. A statement after "!" must fail."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _engine(spark, sf_dir, *tables.split(), profile=profile)
        for s in statements.split("\n"):
            if not s.strip().startswith("!"):
                e.script(s)
                continue
            try:
                e.execute(s.strip()[1:])
            except EngineError:
                continue
            raise AssertionError(f"{s} went through")
        return e.sql(asked)

    return query


_REGION = "SELECT r_regionkey, r_name FROM own_region"
_FAMILY = """CREATE TABLE p (k INT PRIMARY KEY); CREATE TABLE c (n_nationkey INT PRIMARY KEY, n_regionkey INT REFERENCES p(k) ON DELETE {})
INSERT INTO p SELECT r_regionkey FROM own_region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM own_nation
{}DELETE FROM p WHERE k = 2"""

#: name: (query, DuckDB's SQL)
SQL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "dml_insert": (script("region", "INSERT INTO own_region (r_regionkey, r_name) VALUES (100, 'ATLANTIS')", "SELECT * FROM own_region"), "SELECT * FROM region UNION ALL SELECT 100, 'ATLANTIS'"),
    "dml_update": (script("nation", "UPDATE own_nation SET n_name = UPPER(n_name) || '!' WHERE n_regionkey = 1", "SELECT * FROM own_nation"), "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) || '!' ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "dml_update_literal": (script("nation", "UPDATE own_nation SET n_name = 'a WHERE b' WHERE n_name = (SELECT MIN(n_name) FROM own_nation WHERE n_regionkey = 1)", "SELECT * FROM own_nation"), "SELECT n_nationkey, CASE WHEN n_name = (SELECT min(n_name) FROM nation WHERE n_regionkey = 1) THEN 'a WHERE b' ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "dml_update_subquery": (script("nation region", "UPDATE own_nation SET n_name = (SELECT MAX(r_name) FROM own_region WHERE r_regionkey = 3) WHERE n_regionkey IN (SELECT r_regionkey FROM own_region WHERE r_regionkey > 2)", "SELECT * FROM own_nation"), "SELECT n_nationkey, CASE WHEN n_regionkey > 2 AND n_regionkey IN (SELECT r_regionkey FROM region) THEN (SELECT max(r_name) FROM region WHERE r_regionkey = 3) ELSE n_name END AS n_name, n_regionkey FROM nation"),
    "dml_update_join": (script("nation region", "UPDATE n SET n.n_name = r.r_name || '/' || n.n_name FROM own_nation n JOIN own_region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey < 2", "SELECT * FROM own_nation"), "SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN r_name || '/' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "dml_update_join_mysql": (script("customer nation", "UPDATE own_customer c JOIN own_nation n ON c.c_nationkey = n.n_nationkey SET c.c_mktsegment = n.n_name WHERE n.n_regionkey = 0", "SELECT c_custkey, c_mktsegment FROM own_customer"), "SELECT c_custkey, CASE WHEN n_regionkey = 0 THEN n_name ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "dml_delete": (script("supplier", "DELETE FROM own_supplier WHERE s_acctbal < 0", "SELECT * FROM own_supplier"), "SELECT * FROM supplier WHERE NOT coalesce(s_acctbal < 0, false)"),
    "dml_delete_join": (script("customer nation", "DELETE c FROM own_customer c JOIN own_nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1", "SELECT c_custkey FROM own_customer"), "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)"),
    "dml_upsert": (script("region", "CREATE UNIQUE INDEX u ON own_region (r_regionkey)\nINSERT INTO own_region VALUES (1, 'NEW'), (50, 'FIFTY') ON DUPLICATE KEY UPDATE r_name = VALUES(r_name)", _REGION), "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'NEW' ELSE r_name END AS r_name FROM region UNION ALL SELECT 50, 'FIFTY'"),
    "dml_upsert_second_key": (script("region", "CREATE TABLE o (id INT AUTO_INCREMENT PRIMARY KEY, k VARCHAR(40) UNIQUE, v INT)\nINSERT INTO o (k, v) SELECT r_name, r_regionkey FROM own_region\nINSERT INTO o (k, v) SELECT r_name, 100 FROM own_region WHERE r_regionkey > 1 ON DUPLICATE KEY UPDATE k = VALUES(k), v = v + VALUES(v)", "SELECT k, v FROM o"), "SELECT r_name AS k, r_regionkey + CASE WHEN r_regionkey > 1 THEN 100 ELSE 0 END AS v FROM region"),
    "dml_upsert_in_turn": (script("", "CREATE TABLE o (k INT PRIMARY KEY, v INT)\nINSERT INTO o VALUES (1, 10)\nINSERT INTO o VALUES (1, 1), (2, 2), (1, 3), (2, 5) ON DUPLICATE KEY UPDATE v = v * 2 + VALUES(v)", "SELECT k, v FROM o"), "SELECT 1 AS k, 45 AS v UNION ALL SELECT 2, 9"),
    "dml_on_conflict_update": (script("region", "CREATE UNIQUE INDEX u ON own_region (r_regionkey)\nINSERT INTO own_region VALUES (1, 'ON CONFLICT'), (2, 'x'), (50, 'FIFTY') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = EXCLUDED.r_name || '+' || own_region.r_name WHERE own_region.r_regionkey < 2", _REGION), "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'ON CONFLICT+' || r_name ELSE r_name END AS r_name FROM region UNION ALL SELECT 50, 'FIFTY'"),
    "dml_on_conflict_nothing": (script("region", "CREATE UNIQUE INDEX u ON own_region (r_regionkey)\nINSERT INTO own_region VALUES (1, 'NEW'), (50, 'FIFTY') ON CONFLICT DO NOTHING", _REGION), "SELECT * FROM region UNION ALL SELECT 50, 'FIFTY'"),
    "dml_replace": (script("region", "CREATE UNIQUE INDEX u ON own_region (r_regionkey)\nREPLACE INTO own_region VALUES (1, 'first'), (1, 'last'), (50, 'FIFTY')", _REGION), "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'last' ELSE r_name END AS r_name FROM region UNION ALL SELECT 50, 'FIFTY'"),
    "dml_truncate": (script("region", "TRUNCATE TABLE own_region", "SELECT COUNT(*) AS n FROM own_region"), "SELECT COUNT(*) AS n FROM region WHERE false"),
    "txn_rollback": (script("region", "BEGIN; DELETE FROM own_region; INSERT INTO own_region VALUES (9, 'X'); ROLLBACK", _REGION), "SELECT * FROM region"),
    "txn_savepoint": (script("region", "BEGIN; DELETE FROM own_region WHERE r_regionkey = 0; SAVEPOINT s; DELETE FROM own_region; ROLLBACK TO SAVEPOINT s; COMMIT", _REGION), "SELECT * FROM region WHERE r_regionkey <> 0"),
    "constraint_key": (script("nation", "CREATE TABLE k (id INT PRIMARY KEY, name VARCHAR(40) UNIQUE)\nINSERT INTO k SELECT n_nationkey, n_name FROM own_nation\n! INSERT INTO k VALUES (3, 'other')\n! INSERT INTO k SELECT n_nationkey + 100, n_name FROM own_nation\n! UPDATE k SET id = 1", "SELECT id, name FROM k"), "SELECT n_nationkey AS id, n_name AS name FROM nation"),
    "constraint_check": (script("part", "CREATE TABLE k (id INT, size INT CHECK (size > 0))\nINSERT INTO k SELECT p_partkey, p_size FROM own_part\n! INSERT INTO k VALUES (1, 0)\n! UPDATE k SET size = size - 1000\nINSERT INTO k VALUES (-1, NULL)", "SELECT id, size FROM k"), "SELECT p_partkey AS id, p_size AS size FROM part UNION ALL SELECT -1, NULL"),
    "constraint_foreign_key": (script("nation region", "CREATE TABLE p (k INT PRIMARY KEY); CREATE TABLE c (id INT, k INT REFERENCES p(k))\nINSERT INTO p SELECT r_regionkey FROM own_region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM own_nation\n! INSERT INTO c VALUES (1, 77)\n! UPDATE c SET k = 78 WHERE id = 1\n! UPDATE p SET k = 79 WHERE k = 1\n! DROP TABLE p", "SELECT id, k FROM c"), "SELECT n_nationkey AS id, n_regionkey AS k FROM nation"),
    "constraint_default": (script("nation", "CREATE TABLE d (id INT, s VARCHAR(20) DEFAULT 'none' NOT NULL, n INT DEFAULT 7)\nINSERT INTO d (id) SELECT n_nationkey FROM own_nation\nINSERT INTO d VALUES (100, DEFAULT, 1)\n! INSERT INTO d VALUES (101, NULL, 1)", "SELECT id, s, n FROM d"), "SELECT n_nationkey AS id, 'none' AS s, 7 AS n FROM nation UNION ALL SELECT 100, 'none', 1"),
    "auto_increment": (script("nation", "CREATE TABLE a (id INT AUTO_INCREMENT PRIMARY KEY, v INT)\nINSERT INTO a (v) VALUES (5), (6)\nINSERT INTO a VALUES (10, 7)\nINSERT INTO a (v) SELECT 1 FROM own_nation\nINSERT INTO a (v) SELECT LAST_INSERT_ID()", "SELECT COUNT(*) AS n, MIN(id) AS lo, MAX(id) AS hi, COUNT(DISTINCT id) AS ids, MAX(v) AS last_id FROM a"), "SELECT count(*) + 4 AS n, 1 AS lo, 11 + count(*) AS hi, count(*) + 4 AS ids, 10 + count(*) AS last_id FROM nation"),
    "fk_cascade": (script("region nation", _FAMILY.format("CASCADE", ""), "SELECT n_nationkey, n_regionkey FROM c"), "SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey <> 2"),
    "fk_set_null": (script("region nation", _FAMILY.format("SET NULL", ""), "SELECT n_nationkey, n_regionkey FROM c"), "SELECT n_nationkey, NULLIF(n_regionkey, 2) AS n_regionkey FROM nation"),
    "fk_restrict": (script("region nation", _FAMILY.format("RESTRICT", "! "), "SELECT n_nationkey, n_regionkey FROM c"), "SELECT n_nationkey, n_regionkey FROM nation"),
    "partition_range_read": (script("orders", "CREATE TABLE p (o_orderkey BIGINT, o_totalprice DOUBLE) PARTITION BY RANGE (o_orderkey) (PARTITION a VALUES LESS THAN (2000), PARTITION b VALUES LESS THAN (4000), PARTITION c VALUES LESS THAN MAXVALUE)\nINSERT INTO p SELECT o_orderkey, o_totalprice FROM own_orders", "SELECT o_orderkey, o_totalprice FROM p WHERE o_orderkey >= 2000 AND o_orderkey < 2500"), "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 2000 AND o_orderkey < 2500"),
    "partition_update": (script("orders", "CREATE TABLE p (o_orderkey BIGINT, n INT) PARTITION BY RANGE (o_orderkey) (PARTITION a VALUES LESS THAN (2000), PARTITION b VALUES LESS THAN (4000))\nINSERT INTO p SELECT o_orderkey, 0 FROM own_orders\nUPDATE p SET n = 1 WHERE o_orderkey BETWEEN 2100 AND 2200\nDELETE FROM p WHERE o_orderkey < 50\nUPDATE p SET o_orderkey = o_orderkey + 3000 WHERE o_orderkey < 100", "SELECT o_orderkey, n FROM p"), "SELECT CAST(CASE WHEN o_orderkey < 100 THEN o_orderkey + 3000 ELSE o_orderkey END AS BIGINT) AS o_orderkey, CASE WHEN o_orderkey BETWEEN 2100 AND 2200 THEN 1 ELSE 0 END AS n FROM orders WHERE o_orderkey >= 50"),
    "sequence_nextval": (script("", "CREATE SEQUENCE s START WITH 10 INCREMENT BY 5\nCREATE TABLE t (a INT, b INT)\nINSERT INTO t SELECT NEXTVAL('s'), NEXTVAL('s')\nINSERT INTO t SELECT NEXTVAL('s'), NEXTVAL('s')", "SELECT a, b FROM t"), "SELECT 10 AS a, 15 AS b UNION ALL SELECT 20, 25"),
    "analyze_stats": (script("nation", "CREATE TABLE s (k INT, name VARCHAR(40)); INSERT INTO s SELECT NULLIF(n_regionkey, 2), n_name FROM own_nation", "ANALYZE TABLE s"), "SELECT 'k' AS column_name, count(*) AS row_count, count(DISTINCT nullif(n_regionkey, 2)) AS distinct_count, count(*) - count(nullif(n_regionkey, 2)) AS null_count, CAST(min(nullif(n_regionkey, 2)) AS VARCHAR) AS min_value, CAST(max(nullif(n_regionkey, 2)) AS VARCHAR) AS max_value FROM nation UNION ALL SELECT 'name', count(*), count(DISTINCT n_name), count(*) - count(n_name), min(n_name), max(n_name) FROM nation"),
    "view_query": (script("nation", "CREATE VIEW per_region AS SELECT n_regionkey, COUNT(*) AS n FROM own_nation GROUP BY n_regionkey", "SELECT * FROM per_region"), "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey"),
    "insert_select_result": (script("nation", "CREATE TABLE few (n_nationkey INT NOT NULL, n_name VARCHAR(40)); INSERT INTO few SELECT n_nationkey, n_name FROM own_nation WHERE n_regionkey = 3", "SELECT * FROM few"), "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3"),
    "alter_table": (script("nation", "ALTER TABLE own_nation ADD COLUMN extra INT DEFAULT 5; ALTER TABLE own_nation RENAME COLUMN n_name TO name; ALTER TABLE own_nation DROP COLUMN n_regionkey; ALTER TABLE own_nation MODIFY COLUMN n_nationkey BIGINT", "SELECT n_nationkey, name, extra FROM own_nation"), "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name AS name, 5 AS extra FROM nation"),
    "temp_table": (script("nation", "CREATE TABLE #few (k INT, n VARCHAR(40)); INSERT INTO #few SELECT n_nationkey, n_name FROM own_nation WHERE n_nationkey < 4; DELETE FROM #few WHERE k = 2", "SELECT k, n FROM #few"), "SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey IN (0, 1, 3)"),
    "information_schema": (script("nation", "CREATE TABLE t (a INT NOT NULL, b VARCHAR(9) DEFAULT 'x')", "SELECT table_name, column_name, ordinal_position, is_nullable FROM INFORMATION_SCHEMA.COLUMNS WHERE table_name = 't'"), "SELECT 't' AS table_name, 'a' AS column_name, 1 AS ordinal_position, 'NO' AS is_nullable UNION ALL SELECT 't', 'b', 2, 'YES'"),
    "trigger_after": (script("nation", "CREATE TABLE t (k INT); CREATE TABLE log (m VARCHAR(20))\nCREATE TRIGGER a ON t AFTER INSERT AS BEGIN INSERT INTO log VALUES ('inserted') END\nCREATE TRIGGER b AFTER DELETE ON t BEGIN INSERT INTO log VALUES ('deleted'); END\nINSERT INTO t SELECT n_nationkey FROM own_nation\nINSERT INTO t VALUES (1)\nDELETE FROM t WHERE k > 5", "SELECT m, COUNT(*) AS n FROM log GROUP BY m"), "SELECT 'inserted' AS m, 2 AS n UNION ALL SELECT 'deleted', 1"),
    "procedure_arguments": (script("nation", "CREATE TABLE t (k INT, s VARCHAR(20))\nCREATE PROCEDURE put @low INT, @s VARCHAR(20) = 'none' AS BEGIN INSERT INTO t SELECT n_nationkey, @s FROM own_nation WHERE n_nationkey >= @low; END\nEXEC put 20, 'a;b'\nCALL put(23)", "SELECT k, s FROM t"), "SELECT n_nationkey AS k, 'a;b' AS s FROM nation WHERE n_nationkey >= 20 UNION ALL SELECT n_nationkey, 'none' FROM nation WHERE n_nationkey >= 23"),
    "prepared": (script("nation", "PREPARE q FROM 'SELECT n_nationkey FROM own_nation WHERE n_regionkey = ? AND n_name <> ?'", "EXECUTE q USING 2, 'JAPAN'"), "SELECT n_nationkey FROM nation WHERE n_regionkey = 2 AND n_name <> 'JAPAN'"),
    "cursor_fetch": (script("nation", "DECLARE c CURSOR FOR SELECT n_nationkey, n_name FROM own_nation ORDER BY n_nationkey\nOPEN c; FETCH NEXT FROM c", "FETCH NEXT FROM c"), "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 1"),
    "tsql_top": (script("orders", "", "SELECT TOP 7 [o_orderkey], CAST(LEN(ISNULL(o_orderpriority, N'')) AS BIGINT) AS n FROM [dbo].[own_orders] WITH (NOLOCK) ORDER BY o_orderkey"), "SELECT o_orderkey, CAST(length(o_orderpriority) AS BIGINT) AS n FROM orders ORDER BY o_orderkey LIMIT 7"),
    "tsql_top_derived": (script("nation", "", "SELECT n.n_nationkey FROM own_nation n JOIN (SELECT TOP 1 n_regionkey AS r FROM own_nation ORDER BY n_nationkey DESC) x ON n.n_regionkey = x.r"), "SELECT n_nationkey FROM nation WHERE n_regionkey = (SELECT n_regionkey FROM nation ORDER BY n_nationkey DESC LIMIT 1)"),
    "limit_comma": (script("nation", "", "SELECT n_nationkey FROM own_nation ORDER BY n_nationkey LIMIT 3, 5"), "SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3"),
    "fetch_first": (script("nation", "", "SELECT n_nationkey FROM own_nation ORDER BY n_name DESC OFFSET 2 ROWS FETCH NEXT 4 ROWS ONLY"), "SELECT n_nationkey FROM nation ORDER BY n_name DESC LIMIT 4 OFFSET 2"),
    "compat_like": (script("customer", "", "SELECT c_custkey FROM own_customer WHERE c_mktsegment LIKE 'building%'", "compat"), "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'building%'"),
    "compat_group_ci": (script("customer", "UPDATE own_customer SET c_mktsegment = LOWER(c_mktsegment) WHERE c_custkey % 2 = 0", "SELECT c_mktsegment, COUNT(*) AS n FROM own_customer GROUP BY c_mktsegment", "compat"), "SELECT min(CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END) AS c_mktsegment, COUNT(*) AS n FROM customer GROUP BY lower(c_mktsegment)"),
    "compat_not_in_null": (script("nation", "", "SELECT n_nationkey FROM own_nation WHERE n_regionkey NOT IN (1, NULL)", "compat"), "SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (1)"),
    "compat_scalars": (script("part", "", "SELECT p_partkey, CAST(p_brand AS INT) AS bad, SUBSTRING(p_name, 0, 3) AS s, GREATEST(p_size, NULLIF(p_size, 7)) AS g, SQRT(20 - p_size) AS q, ROUND(p_retailprice) AS r FROM own_part", "compat"), "SELECT p_partkey, 0 AS bad, substring(p_name, 1, 3) AS s, CASE WHEN p_size <> 7 THEN p_size END AS g, CASE WHEN p_size <= 20 THEN sqrt(20 - p_size) END AS q, CAST(round(p_retailprice) AS BIGINT) AS r FROM part"),
}
