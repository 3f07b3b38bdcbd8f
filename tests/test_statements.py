"""The engine's front end: spellings, semantics, upserts, joins in DML, triggers, procedures, races, partitions, profiles."""

import threading
import uuid

import pytest

from lakewright.engine import Engine, EngineError, LostRace


@pytest.fixture
def e(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def one(e, sql):
    return e.sql(sql).first()[0]


def test_whole_numbers_divide_as_such(e):
    e.script("CREATE TABLE t (a INT, b BIGINT, d DOUBLE); INSERT INTO t VALUES (7, 2, 2.0)")
    assert tuple(e.sql("SELECT 7/2, a/b, -a/b, a*3/b, a/d, (a+1)/b, SUM(a)/COUNT(*), AVG(a)/2, CAST(d AS INT)/4, 7.0/2 FROM t GROUP BY a, b, d").first()) == (3, 3, -3, 10, 3.5, 4, 7, 3.5, 0, 3.5)


def test_nulls_come_last_both_ways(e):
    e.script("CREATE TABLE t (v INT); INSERT INTO t VALUES (2), (NULL), (1)")
    assert [r[0] for r in e.sql("SELECT v FROM t ORDER BY v").collect()] == [1, 2, None]
    assert [r[0] for r in e.sql("SELECT v FROM t ORDER BY v DESC").collect()] == [2, 1, None]
    assert [r[0] for r in e.sql("SELECT v FROM t ORDER BY v NULLS FIRST").collect()] == [None, 1, 2]
    assert rows(e.sql("SELECT v, ROW_NUMBER() OVER (ORDER BY v DESC) FROM t")) == [(1, 2), (2, 1), (None, 3)]


def test_limits_stay_with_their_select(e):
    e.script("CREATE TABLE t (v INT); INSERT INTO t VALUES (1), (2), (3), (4)")
    assert one(e, "SELECT COUNT(*) FROM t JOIN (SELECT TOP 1 v AS w FROM t ORDER BY v DESC) x ON w >= v") == 4
    assert rows(e.sql("SELECT v FROM t ORDER BY v LIMIT 1, 2")) == [(2,), (3,)]
    assert rows(e.sql("SELECT v FROM t ORDER BY v OFFSET 2 ROWS FETCH NEXT 1 ROWS ONLY")) == [(3,)]
    assert rows(e.sql("SELECT v FROM t ORDER BY v FETCH FIRST 2 ROWS ONLY")) == [(1,), (2,)]
    assert rows(e.sql("SELECT TOP (1) v FROM t WHERE v = 4 UNION ALL SELECT TOP 1 v FROM t WHERE v = 2")) == [(2,), (4,)]


def test_search_and_dates(e):
    e.script("CREATE TABLE t (s VARCHAR(90), at DATETIME); INSERT INTO t VALUES ('The quick Fox', '2024-01-30 10:11:12'), (NULL, NULL)")
    assert tuple(e.sql("SELECT CONTAINS(s, 'fox quick'), CONTAINS(s, '\"quick fox\"'), CONTAINS(s, 'qui*'), FREETEXT(s, 'dog the'), FREETEXT(s, 'cat') FROM t WHERE s IS NOT NULL").first()) == (True, True, True, True, False)
    assert one(e, "SELECT COUNT(*) FROM t WHERE CONTAINS(s, 'fox')") == 1
    got = e.sql("SELECT DATE_ADD(at, 3), DATE_SUB(at, 30), DATE_ADD(at, INTERVAL 1 HOUR) FROM t WHERE s IS NOT NULL").first()
    assert [str(x) for x in got] == ["2024-02-02 10:11:12", "2023-12-31 10:11:12", "2024-01-30 11:11:12"]


def test_literals_are_never_read(e):
    e.script("CREATE TABLE t (id INT PRIMARY KEY, s VARCHAR(90)); CREATE TABLE u (id INT, v INT); INSERT INTO u VALUES (1, 10), (2, 20)")
    e.execute("INSERT INTO t VALUES (1, 'a ON CONFLICT b'), (2, 'x ON DUPLICATE KEY UPDATE y'), (3, 'it''s; WHERE')")
    e.execute("UPDATE t SET s = 'new WHERE id = 9' WHERE id = 3")
    e.execute("UPDATE t SET s = (SELECT CAST(MAX(v) AS VARCHAR(9)) FROM u WHERE u.id = 2) WHERE s = 'a ON CONFLICT b'")
    assert rows(e.table("t")) == [(1, "20"), (2, "x ON DUPLICATE KEY UPDATE y"), (3, "new WHERE id = 9")]
    e.execute("DELETE FROM t WHERE s = 'new WHERE id = 9' OR s LIKE 'x FROM%'")
    assert e.table("t").count() == 2


def test_upsert_on_any_key_in_turn(e):
    e.execute("CREATE TABLE o (id INT AUTO_INCREMENT PRIMARY KEY, k VARCHAR(20) UNIQUE, v INT)")
    e.execute("INSERT INTO o (k, v) VALUES ('a', 1), ('b', 2)")
    e.execute("INSERT INTO o (k, v) VALUES ('b', 5), ('c', 7), ('c', 8) ON DUPLICATE KEY UPDATE v = v + VALUES(v)")
    assert rows(e.table("o").select("k", "v")) == [("a", 1), ("b", 7), ("c", 15)]
    e.execute("INSERT INTO o (k, v) VALUES ('a', 99) ON CONFLICT (k) DO UPDATE SET v = EXCLUDED.v + 1")
    e.execute("INSERT INTO o (k, v) VALUES ('a', 1) ON CONFLICT (k) DO UPDATE SET v = EXCLUDED.v WHERE o.v < 50")
    e.execute("INSERT INTO o (k, v) VALUES ('a', 1), ('d', 4) ON CONFLICT DO NOTHING")
    assert rows(e.table("o").select("k", "v")) == [("a", 100), ("b", 7), ("c", 15), ("d", 4)]
    with pytest.raises(EngineError):
        e.execute("INSERT INTO o (k, v) VALUES ('a', 1) ON CONFLICT (v) DO NOTHING")
    e.execute("REPLACE INTO o (id, k, v) VALUES (1, 'b', 0)")  # meets one row by each key: both go
    assert rows(e.table("o").select("id", "k", "v"))[0] == (1, "b", 0) and e.table("o").count() == 3


def test_changes_by_joins(e):
    e.script("CREATE TABLE t (id INT, v INT, s VARCHAR(9)); CREATE TABLE u (id INT, w INT); INSERT INTO t VALUES (1, 1, 'a'), (2, 2, 'b'), (3, 3, 'c'); INSERT INTO u VALUES (1, 10), (3, 30)")
    assert e.execute("UPDATE x SET x.v = u.w FROM t x JOIN u ON x.id = u.id WHERE u.w > 10").rows_affected == 1
    assert e.execute("UPDATE t a JOIN u b ON a.id = b.id SET a.v = a.v + b.w, a.s = 'SET' WHERE a.id = 1").rows_affected == 1
    assert rows(e.table("t")) == [(1, 11, "SET"), (2, 2, "b"), (3, 30, "c")]
    assert e.execute("UPDATE t SET v = u.w FROM u WHERE u.id = t.id").rows_affected == 2
    assert e.execute("DELETE x FROM t x JOIN u ON u.id = x.id WHERE u.w = 30").rows_affected == 1
    assert e.execute("DELETE FROM t WHERE id IN (SELECT id FROM u)").rows_affected == 1
    assert rows(e.table("t")) == [(2, 2, "b")]


def test_temporary_tables_are_private(e, spark):
    e.script("CREATE TABLE #x (a INT); INSERT INTO #x VALUES (1), (2)")
    assert one(e, "SELECT SUM(a) FROM #x") == 3 and rows(e.sql("SHOW TABLES")) == []
    e.execute("CREATE TABLE y (a INT)")
    other = Engine(spark, e.folder)
    with pytest.raises(Exception, match="x"):
        other.execute("INSERT INTO #x VALUES (3)")
    e.execute("DROP TABLE #x")


@pytest.mark.parametrize("spelling", ["ON t AFTER {} AS", "AFTER {} ON t", "ON t BEFORE {} AS", "BEFORE {} ON t FOR EACH ROW"])
def test_triggers(e, spelling):
    e.script("CREATE TABLE t (id INT PRIMARY KEY, p INT REFERENCES t(id) ON DELETE CASCADE); CREATE TABLE log (m VARCHAR(20))")
    for event in ("INSERT", "UPDATE", "DELETE"):
        e.execute(f"CREATE TRIGGER g{event} {spelling.format(event)} BEGIN INSERT INTO log VALUES ('{event.lower()}') END")
    e.script("INSERT INTO t VALUES (1, NULL); INSERT INTO t VALUES (1, NULL) ON DUPLICATE KEY UPDATE p = NULL; REPLACE INTO t VALUES (2, NULL); UPDATE t SET p = 1 WHERE id = 2; DELETE FROM t WHERE id = 1")
    said = [r[0] for r in rows(e.table("log"))]
    assert said.count("insert") >= 2 and said.count("update") >= 2 and said.count("delete") == 2 and e.table("t").count() == 0


def test_procedures_take_arguments(e):
    e.execute("CREATE TABLE t (a INT, s VARCHAR(20))")
    e.execute("CREATE PROCEDURE put @a INT, @s VARCHAR(20) = 'none' AS BEGIN INSERT INTO t VALUES (@a, @s); SELECT TOP 1 a / 2 AS h FROM t WHERE a = @a; END")
    assert e.execute("EXEC put 7, '@a; x'").frame.first()[0] == 3
    e.execute("EXEC put @a = 9")
    e.execute("CALL put(11, 'y')")
    assert rows(e.table("t")) == [(11, "y"), (7, "@a; x"), (9, "none")]
    with pytest.raises(EngineError):
        e.execute("EXEC put")


def test_a_lost_race_reloads(e, spark):
    e.execute("CREATE TABLE t (id INT)")
    other = Engine(spark, e.folder)
    e.execute("INSERT INTO t VALUES (1)")
    with pytest.raises(LostRace):
        other.execute("INSERT INTO t VALUES (2)")
    other.execute("INSERT INTO t VALUES (2)")
    e.reload()
    assert rows(e.table("t")) == [(1,), (2,)]


def test_a_crash_leaves_nothing_half_written(e, spark, monkeypatch):
    e.script("CREATE TABLE t (id INT); INSERT INTO t VALUES (1)")
    fs, p = e._fs(f"{e.folder}/versions/open-dead")
    fs.create(p, False).close()  # a writer that died before its rename
    again = Engine(spark, e.folder)
    assert rows(again.table("t")) == [(1,)]
    again.execute("INSERT INTO t VALUES (2)")
    assert Engine(spark, e.folder).table("t").count() == 2


def test_one_of_many_writers_wins(e, spark):
    e.execute("CREATE TABLE t (id INT)")
    sessions, won = [Engine(spark, e.folder) for _ in range(4)], []

    def write(k):
        try:
            sessions[k].execute(f"INSERT INTO t VALUES ({k})")
            won.append((k,))
        except LostRace:
            pass

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert won and rows(Engine(spark, e.folder).table("t")) == sorted(won)


def test_referenced_tables_stay(e):
    e.script("CREATE TABLE p (id INT PRIMARY KEY); CREATE TABLE c (id INT REFERENCES p(id))")
    with pytest.raises(EngineError):
        e.execute("DROP TABLE p")
    e.script("DROP TABLE c; DROP TABLE p")


def test_information_schema(e):
    e.script("CREATE TABLE t (a INT NOT NULL, b VARCHAR(9) DEFAULT 'x'); CREATE VIEW v AS SELECT a FROM t")
    assert rows(e.sql("SELECT table_name, table_type FROM INFORMATION_SCHEMA.TABLES")) == [("t", "BASE TABLE"), ("v", "VIEW")]
    assert rows(e.sql("SELECT column_name, is_nullable FROM information_schema.columns WHERE table_name = 't'")) == [("a", "NO"), ("b", "YES")]


def test_partitions_are_read_and_rewritten_alone(e):
    e.execute("CREATE TABLE t (id INT, v INT) PARTITION BY RANGE (id) (PARTITION a VALUES LESS THAN (100), PARTITION b VALUES LESS THAN (200), PARTITION c VALUES LESS THAN MAXVALUE)")
    e.script("INSERT INTO t VALUES (5, 1), (150, 2), (250, 3), (NULL, 4)")
    assert len(e._table("t").paths) == 3
    asked = e.sql("SELECT v FROM t WHERE id >= 120 AND id < 180")
    assert rows(asked) == [(2,)] and len(asked.inputFiles()) == 1
    assert len(e.sql("SELECT v FROM t WHERE id >= 120 OR v = 1").inputFiles()) == 3
    assert rows(e.sql("SELECT v FROM t WHERE id BETWEEN 200 AND 300")) == [(3,)]
    before = {p for p in e._table("t").paths if not p.endswith("=1")}
    e.execute("UPDATE t SET v = 20 WHERE id = 150")
    assert before <= set(e._table("t").paths) and rows(e.table("t").select("v")) == [(1,), (20,), (3,), (4,)]
    e.execute("DELETE FROM t WHERE id = 150")
    assert rows(e.table("t").select("v")) == [(1,), (3,), (4,)]


def test_compat_profile(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/c", profile="compat")
    e.script("CREATE TABLE t (id INT, s VARCHAR(20), n INT, d DOUBLE); INSERT INTO t VALUES (1, 'Abc', NULL, 2.5), (2, 'abc', 5, -4.0), (3, 'x', 7, 9.0)")
    assert rows(e.sql("SELECT id FROM t WHERE s LIKE 'ABC%'")) == [(1,), (2,)]
    assert rows(e.sql("SELECT id FROM t WHERE n NOT IN (5, NULL)")) == [(3,)]
    assert rows(e.sql("SELECT s, COUNT(*) AS c FROM t GROUP BY s")) == [("Abc", 2), ("x", 1)]
    assert rows(e.sql("SELECT DISTINCT s FROM t")) == [("Abc",), ("x",)] and one(e, "SELECT COUNT(DISTINCT s) FROM t") == 2
    assert tuple(e.sql("SELECT CAST('12x' AS INT), SUBSTRING('hello', 0, 2), GREATEST(1, NULL), SQRT(-1.0), ROUND(2.5), TRIM(' \\t a\\n ')").first()) == (0, "he", None, None, 3, "a")
    e.script("CREATE TABLE d (at DATETIME, n INT); INSERT INTO d VALUES ('2024-05-06 07:08:09', '3'), ('never', 'many')")
    assert [str(r[0]) for r in e.sql("SELECT at FROM d ORDER BY at").collect()] == ["1970-01-01 00:00:00", "2024-05-06 07:08:09"]
    assert one(Engine(spark, f"file://{tmp_path}/s"), "SELECT 'Abc' LIKE 'abc'") is False


def test_scripts_by_go_and_insert_set(e):
    e.script("CREATE TABLE t (a INT, b INT DEFAULT 4)\nGO\nINSERT INTO t SET a = 1\nGO\nINSERT INTO t VALUES (2, DEFAULT)")
    assert rows(e.table("t")) == [(1, 4), (2, 4)]


def test_ids_are_numbered_in_the_order_given(e, spark):
    e.script("CREATE TABLE t (id INT AUTO_INCREMENT PRIMARY KEY, v INT); INSERT INTO t (v) VALUES (30), (10), (20)")
    assert rows(e.table("t")) == [(1, 30), (2, 10), (3, 20)]
    e.attach("many", _written(spark, e.folder, spark.range(0, 1000, 1, 7).selectExpr("cast(id as int) v")))
    e.execute("INSERT INTO t (v) SELECT v FROM many")
    assert sorted(r[0] for r in e.table("t").select("id").collect()) == list(range(1, 1004))


def _written(spark, folder, df):
    df.write.parquet(f"{folder}/many")
    return f"{folder}/many"
