"""Statements of the engine: constraints, actions, transactions, procedures, dialects."""

import uuid

import pytest

from lakewright.engine import Engine, EngineError
from lakewright.functions import scalars, textsearch
from lakewright.plans import dialect


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_keys_checks_and_defaults(e):
    e.script("CREATE TABLE t (id INT PRIMARY KEY, age INT CHECK (age >= 0), name VARCHAR(20) DEFAULT 'none' NOT NULL)")
    e.execute("INSERT INTO t (id, age) VALUES (1, 5), (2, NULL)")
    for bad in ("INSERT INTO t VALUES (1, 1, 'x')", "INSERT INTO t VALUES (3, -5, 'x')", "INSERT INTO t VALUES (4, 1, NULL)", "UPDATE t SET age = -1 WHERE id = 1", "UPDATE t SET id = 1"):
        with pytest.raises(EngineError):
            e.execute(bad)
    assert rows(e.table("t").select("id", "name")) == [(1, "none"), (2, "none")]


def test_update_and_delete_with_subqueries(e):
    e.script("CREATE TABLE a (id INT, v INT); CREATE TABLE b (id INT); INSERT INTO a VALUES (1, 10), (2, 20), (3, 30); INSERT INTO b VALUES (1), (3)")
    assert e.execute("UPDATE a SET v = id, id = v WHERE id IN (SELECT id FROM b)").rows_affected == 2
    assert rows(e.table("a")) == [(2, 20), (10, 1), (30, 3)]
    assert e.execute("DELETE FROM a WHERE v > 2").rows_affected == 2


@pytest.mark.parametrize("rule, left", [("CASCADE", [(3, 2, 300)]), ("SET NULL", [(1, None, 100), (2, None, 200), (3, 2, 300)])])
def test_foreign_keys(e, rule, left):
    e.script(f"CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT, pid INT REFERENCES p(id) ON DELETE {rule}, v INT); INSERT INTO p VALUES (1), (2); INSERT INTO c VALUES (1, 1, 100), (2, 1, 200), (3, 2, 300)")
    with pytest.raises(EngineError):
        e.execute("INSERT INTO c VALUES (9, 77, 1)")
    e.execute("DELETE FROM p WHERE id = 1")
    assert sorted(rows(e.table("c")), key=str) == sorted(left, key=str)


def test_restrict_and_deep_cascade(e):
    e.script("CREATE TABLE a (id INT PRIMARY KEY); CREATE TABLE b (id INT PRIMARY KEY, a INT REFERENCES a(id) ON DELETE CASCADE); CREATE TABLE c (b INT REFERENCES b(id))")
    e.script("INSERT INTO a VALUES (1); INSERT INTO b VALUES (5, 1); INSERT INTO c VALUES (5)")
    with pytest.raises(EngineError):
        e.execute("DELETE FROM a")
    assert e.table("b").count() == 1
    e.script("DELETE FROM c; DELETE FROM a")
    assert e.table("b").count() == 0


def test_transactions_and_reopening(e, spark):
    e.script("CREATE TABLE t (id INT); INSERT INTO t VALUES (1); BEGIN; INSERT INTO t VALUES (2); SAVEPOINT s; INSERT INTO t VALUES (3); ROLLBACK TO s; COMMIT")
    assert rows(e.table("t")) == [(1,), (2,)]
    e.script("BEGIN; TRUNCATE TABLE t; ROLLBACK")
    assert rows(Engine(spark, e.folder).table("t")) == [(1,), (2,)]


def test_a_lost_race_is_told(e, spark):
    e.execute("CREATE TABLE t (id INT)")
    other = Engine(spark, e.folder)
    e.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(EngineError):
        other.execute("INSERT INTO t VALUES (2)")


def test_auto_increment_upsert_and_replace(e):
    e.execute("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, v INT)")
    assert e.execute("INSERT INTO t (v) VALUES (7)").last_insert_id == 1
    e.execute("INSERT INTO t (v) VALUES (8)")
    e.execute("INSERT INTO t VALUES (1, 50) ON DUPLICATE KEY UPDATE v = v + VALUES(v)")
    e.execute("REPLACE INTO t VALUES (2, 9)")
    e.execute("INSERT IGNORE INTO t VALUES (2, 1000)")
    assert rows(e.table("t")) == [(1, 57), (2, 9)]


def test_procedures_triggers_cursors_and_prepared(e):
    e.script("CREATE TABLE t (id INT); CREATE TABLE log (m VARCHAR(9)); CREATE TRIGGER g AFTER INSERT ON t BEGIN INSERT INTO log VALUES ('in'); END; CREATE PROCEDURE p AS BEGIN INSERT INTO t VALUES (1); INSERT INTO t VALUES (2); END; CALL p")
    assert e.table("log").count() == 2
    e.script("PREPARE q FROM 'SELECT id FROM t WHERE id > ?'; DECLARE c CURSOR FOR SELECT id FROM t ORDER BY id; OPEN c")
    assert rows(e.execute("EXECUTE q USING 1").frame) == [(2,)]
    assert [rows(e.execute("FETCH NEXT FROM c").frame) for _ in range(2)] == [[(1,)], [(2,)]]
    assert e.execute("FETCH NEXT FROM c").message == "DONE"


def test_alter_views_sequences_and_catalog(e, tmp_path):
    e.script("CREATE TABLE t (id INT, v INT); INSERT INTO t VALUES (1, 2); ALTER TABLE t ADD COLUMN w INT DEFAULT 5; ALTER TABLE t RENAME COLUMN v TO u; CREATE VIEW x AS SELECT u + w AS s FROM t")
    assert rows(e.sql("SELECT s FROM x")) == [(7,)]
    e.execute("CREATE SEQUENCE s START WITH 3 INCREMENT BY 2")
    assert rows(e.sql("SELECT NEXTVAL('s') AS a, NEXTVAL('s') AS b")) == [(3, 5)]
    assert rows(e.sql("SHOW TABLES")) == [("t",)]
    assert [r[0] for r in e.sql("DESCRIBE t").collect()] == ["id", "u", "w"]
    assert e.sql("EXPLAIN SELECT * FROM t").count() > 1
    e.execute(f"BACKUP TO 'file://{tmp_path}/copy'")
    e.script(f"DROP TABLE t; RESTORE FROM 'file://{tmp_path}/copy'")
    assert e.table("t").count() == 1


def test_dialects_leave_literals_alone():
    assert dialect.rewrite("SELECT TOP 3 [a], LEN(N'[dbo].x; TOP 5') FROM [dbo].[t] WITH (NOLOCK)") == "SELECT `a`, char_length('[dbo].x; TOP 5') FROM `t` LIMIT 3"
    assert dialect.statements("a 'x;y'; b -- c;\n; ") == ["a 'x;y'", "b"]
    assert dialect.rewrite("SELECT ISNULL(a, 'ISNULL(') AS x") == "SELECT coalesce(a, 'ISNULL(') AS x"


def test_compat_functions(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("12x", "Abc def", None), ("7", "ghi", 3)], "a string, b string, n int")
    got = df.select(scalars.lenient_cast(F.col("a"), "int"), scalars.like(F.col("b"), "abc%", True), scalars.substring(F.col("b"), 0, 2, True), scalars.greatest(F.col("n"), F.lit(1), compat=True), scalars.sqrt(F.lit(-1.0)), scalars.in_list(F.col("n"), [1, None], True, True))
    assert [tuple(r) for r in got.collect()] == [(0, True, "Ab", None, None, None), (7, False, "gh", 3, None, True)]
    found = df.select(textsearch.contains(F.col("b"), "de* abc"), textsearch.contains(F.col("b"), '"c d"'), textsearch.freetext(F.col("b"), "zzz ghi"))
    assert [tuple(r) for r in found.collect()] == [(True, True, False), (False, False, True)]
