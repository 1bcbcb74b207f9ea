import datetime
from decimal import Decimal

import pytest

from marlstone.database import Database
from marlstone.engine import Engine
from marlstone.errors import ConstraintViolation, DuplicateKey, OperationalError, SqlError, TableExists, TableNotFound, WriteConflict
from marlstone.functions.render import render, rendered, type_chars
from marlstone.spec import parse_create, parse_type


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


@pytest.fixture
def t(engine):
    engine.sql("CREATE TABLE t (pk INT PRIMARY KEY, a INT, b FLOAT, c TEXT)")
    engine.sql("INSERT INTO t VALUES (1, 10, 1.5, 'x'), (2, 20, NULL, 'y'), (3, 30, 2.5, NULL)")
    return engine


def test_types():
    assert parse_type("SMALLINT") == ("bigint", None) and parse_type("varchar(5)") == ("string", 5) and parse_type("real") == ("double", None)
    assert parse_type("decimal") == ("decimal(38,0)", None) and parse_type("NUMERIC(50, 60)") == ("decimal(38,38)", None)
    with pytest.raises(SqlError):
        parse_type("json")


def test_definitions():
    s = parse_create("CREATE TABLE x (a INT, b VARCHAR(3) NOT NULL DEFAULT 'it''s', CHECK (a > (1 + 2)), PRIMARY KEY (a))")
    assert s.key == "a" and not s.column("A").nullable and s.checks == ["a > (1 + 2)"] and s.column("b").default == "'it''s'"
    for bad in ("CREATE TABLE x (a INT PRIMARY KEY, b INT PRIMARY KEY)", "CREATE TABLE x (a INT, b INT, PRIMARY KEY (a, b))", "CREATE TABLE x (a INT UNIQUE)", "CREATE TABLE x (a INT, A TEXT)"):
        with pytest.raises(SqlError):
            parse_create(bad)


def test_changes(t):
    t.sql("UPDATE t SET a = a + 1, c = 'z' WHERE b IS NOT NULL")
    assert t.affected == 2
    t.sql("DELETE FROM t WHERE pk = 2")
    assert rows(t, "SELECT * FROM t ORDER BY pk") == [(1, 11, 1.5, "z"), (3, 31, 2.5, "z")]
    t.sql("INSERT INTO t SELECT pk + 10, a, b, c FROM t")
    assert rows(t, "SELECT count(*), sum(a) FROM t") == [(4, 84)]


def test_inserts_are_atomic(t):
    for bad in ("INSERT INTO t VALUES (9, 1, 1, 'a'), (1, 1, 1, 'b')", "INSERT INTO t VALUES (9, 1, 1, 'a'), (9, 1, 1, 'b')"):
        with pytest.raises(DuplicateKey):
            t.sql(bad)
    assert rows(t, "SELECT count(*) FROM t") == [(3,)]


def test_key_updates_move_the_row(t):
    t.sql("UPDATE t SET pk = pk + 1")
    assert rows(t, "SELECT pk, a FROM t ORDER BY pk") == [(2, 10), (3, 20), (4, 30)]
    with pytest.raises(DuplicateKey):
        t.sql("UPDATE t SET pk = 2 WHERE pk = 3")


def test_constraints(engine):
    engine.sql("CREATE TABLE p (id INT PRIMARY KEY, name VARCHAR(4) NOT NULL, age INT CHECK (age >= 0), s TEXT DEFAULT 'new', lo INT, hi INT, CHECK (lo <= hi))")
    engine.sql("INSERT INTO p (id, name) VALUES (1, 'äöüß')")
    assert rows(engine, "SELECT s, age FROM p") == [("new", None)]
    for bad in ("(2, NULL, 1, 'a', 1, 1)", "(2, 'abcde', 1, 'a', 1, 1)", "(2, 'a', -1, 'a', 1, 1)", "(2, 'a', 1, 'a', 2, 1)", "(NULL, 'a', 1, 'a', 1, 1)"):
        with pytest.raises(ConstraintViolation):
            engine.sql(f"INSERT INTO p VALUES {bad}")
    with pytest.raises(ConstraintViolation):
        engine.sql("UPDATE p SET age = -5")
    assert rows(engine, "SELECT count(*) FROM p") == [(1,)]


def test_catalog(t):
    with pytest.raises(TableExists):
        t.sql("CREATE TABLE T (x INT)")
    t.sql("TRUNCATE TABLE t")
    assert rows(t, "SELECT count(*) FROM t") == [(0,)]
    t.sql("INSERT INTO t VALUES (1, 1, 1, 'again')")
    t.sql("DROP TABLE t")
    with pytest.raises(TableNotFound):
        t.sql("DELETE FROM t")
    with pytest.raises(SqlError):
        t.sql("SELECT 1; SELECT 2")


def test_exact_decimals_and_dates(engine):
    engine.sql("CREATE TABLE d (id INT PRIMARY KEY, price DECIMAL(10,2), day DATE, at TIMESTAMP)")
    engine.sql("INSERT INTO d VALUES (1, 9.99, DATE '1999-12-31', TIMESTAMP_NTZ '2024-01-01 10:00:00.123456'), (2, 1234.50, DATE '9999-12-31', NULL), (3, -0.01, NULL, NULL)")
    assert rows(engine, "SELECT sum(price) FROM d") == [(Decimal("1244.48"),)]
    assert rows(engine, "SELECT day, at FROM d WHERE day < DATE '2000-01-01'") == [(datetime.date(1999, 12, 31), datetime.datetime(2024, 1, 1, 10, 0, 0, 123456))]


def test_keyless_tables_hide_their_row_id(engine):
    engine.sql("CREATE TABLE log (msg TEXT, level INT)")
    engine.sql("INSERT INTO log VALUES ('a', 1), ('a', 1)")
    engine.sql("INSERT INTO log VALUES ('b', 2)")
    assert rows(engine, "SELECT * FROM log ORDER BY level, msg") == [("a", 1), ("a", 1), ("b", 2)]
    ids = [r["_rowid"] for r in engine.db.table("log", hidden=True).collect()]
    assert len(set(ids)) == 3
    engine.sql("DELETE FROM log WHERE msg = 'a'")
    assert rows(engine, "SELECT * FROM log") == [("b", 2)]


def test_snapshots(t):
    with t.db.pin() as csn:
        t.sql("UPDATE t SET a = 0")
        t.sql("DELETE FROM t WHERE pk = 1")
        assert t.db.table("t", csn).agg({"a": "sum"}).first()[0] == 60
        t.db.compact("t")
        t.db.vacuum()
        assert t.db.table("t", csn).count() == 3
    assert rows(t, "SELECT sum(a), count(*) FROM t") == [(0, 2)]
    assert t.db.get("t", 1) is None and t.db.get("t", 2)["a"] == 0
    t.db.vacuum()
    assert rows(t, "SELECT count(*) FROM t") == [(2,)]


def test_compaction_makes_reads_plain_scans(t):
    t.sql("UPDATE t SET a = 5 WHERE pk = 1")
    assert "Aggregate" in t.db.table("t")._jdf.queryExecution().toString()
    assert t.db.compaction_due("t")
    before = rows(t, "SELECT * FROM t ORDER BY pk")
    assert t.db.compact("t") and rows(t, "SELECT * FROM t ORDER BY pk") == before
    assert "Aggregate" not in t.db.table("t")._jdf.queryExecution().toString()
    assert {r["table"]: r["parts"] for r in t.db.stats().collect()} == {"t": 1}


def test_key_ranges_equal_a_full_scan(t):
    assert sorted(r["pk"] for r in t.db.scan_key_range("t", 2, 3).collect()) == [2]
    assert t.db.scan_key_range("t", None, 3).count() == 2
    assert "GreaterThanOrEqual(pk,2)" in t.db.scan_key_range("t", 2, None)._jdf.queryExecution().toString()


def test_reopening_and_orphans(t, spark):
    import os

    os.makedirs(t.db._path("data", "orphan"))
    again = Database(spark, t.db.root)
    assert again.table_names() == ["t"] and again.table("t").count() == 3


def test_backup(t, spark, tmp_path):
    t.db.backup(str(tmp_path / "copy"))
    t.sql("DELETE FROM t")
    back = Database.restore(spark, str(tmp_path / "copy"), str(tmp_path / "restored"))
    assert back.table("t").count() == 3


def test_transactions(t, spark):
    other = Engine(spark, t.db)
    t.sql("BEGIN")
    with pytest.raises(OperationalError):
        t.sql("BEGIN")
    t.sql("INSERT INTO t VALUES (7, 70, 0, 'n')")
    t.sql("UPDATE t SET a = 71 WHERE pk = 7")
    t.sql("DELETE FROM t WHERE pk = 1")
    assert rows(t, "SELECT pk, a FROM t ORDER BY pk") == [(2, 20), (3, 30), (7, 71)]
    assert rows(other, "SELECT count(*) FROM t") == [(3,)]
    with pytest.raises(DuplicateKey):
        t.sql("INSERT INTO t VALUES (7, 0, 0, 'n')")
    t.sql("COMMIT")
    assert rows(other, "SELECT pk FROM t ORDER BY pk") == [(2,), (3,), (7,)]
    t.sql("BEGIN")
    t.sql("DELETE FROM t")
    t.sql("ROLLBACK")
    assert rows(t, "SELECT count(*) FROM t") == [(3,)]
    with pytest.raises(OperationalError):
        t.sql("COMMIT")


def test_the_first_committer_wins(t, spark):
    a, b, c = t, Engine(spark, t.db), Engine(spark, t.db)
    for e in (a, b, c):
        e.sql("BEGIN")
    a.sql("UPDATE t SET a = 1 WHERE pk = 1")
    b.sql("UPDATE t SET a = 2 WHERE pk = 1")
    c.sql("UPDATE t SET a = 3 WHERE pk = 3")
    a.sql("COMMIT")
    with pytest.raises(WriteConflict):
        b.sql("COMMIT")
    c.sql("COMMIT")
    assert rows(t, "SELECT pk, a FROM t ORDER BY pk") == [(1, 1), (2, 20), (3, 3)]


COPY = [
    ('1,"a,b ""c""",x\n2,,""\n', "", [(1, 'a,b "c"', "x"), (2, None, "")]),
    ('1,"NULL",NULL\n\n2,,""\n', " WITH (NULL 'NULL')", [(1, "NULL", None), (2, "", "")]),
    ('id|n|t\n1|"q|r"|\n', " WITH (FORMAT csv, HEADER true, DELIMITER '|')", [(1, "q|r", None)]),
    ("id;n;t\n1;-;x\n", " CSV HEADER DELIMITER ';' NULL '-'", [(1, None, "x")]),
]


@pytest.mark.parametrize("text, options, expected", COPY)
def test_copy(engine, tmp_path, text, options, expected):
    (tmp_path / "f.csv").write_text(text)
    engine.sql("CREATE TABLE n (id INT PRIMARY KEY, note TEXT, tag TEXT)")
    engine.sql(f"COPY n FROM '{tmp_path}/f.csv'{options}")
    assert engine.affected == len(expected)
    assert rows(engine, "SELECT * FROM n ORDER BY id") == expected


def test_copy_defaults_and_errors(engine, tmp_path):
    (tmp_path / "f.csv").write_text("1\n2\n")
    (tmp_path / "g.csv").write_text("3,x\n")
    engine.sql("CREATE TABLE n (id INT PRIMARY KEY, s TEXT DEFAULT 'new', age INT CHECK (age >= 0))")
    engine.sql(f"COPY n (id) FROM '{tmp_path}/f.csv'")
    assert rows(engine, "SELECT s FROM n") == [("new",), ("new",)]
    with pytest.raises(Exception, match=r"(?i)cast|malformed|invalid"):
        engine.sql(f"COPY n (id, age) FROM '{tmp_path}/g.csv'")
    with pytest.raises(SqlError):
        engine.sql("COPY n TO 'x'")
    assert rows(engine, "SELECT count(*) FROM n") == [(2,)]


def test_rendering(t):
    assert rendered(t.sql("SELECT pk, b, c, a > 15 AS big FROM t ORDER BY pk")) == [["1", "1.5", "x", "0"], ["2", "NULL", "y", "1"], ["3", "2.5", "NULL", "1"]]
    assert render(2.0) == "2.0" and render(datetime.date(2024, 1, 2)) == "2024-01-02"
    assert type_chars(t.sql("SELECT pk, b, c FROM t").schema) == "IRT"


@pytest.mark.parametrize("seed", range(3))
def test_metamorphic(engine, seed):
    import random

    r = random.Random(seed)
    engine.sql("CREATE TABLE m (pk INT PRIMARY KEY, a INT, c TEXT)")
    data = ", ".join(f"({i}, {r.choice(['NULL', r.randrange(-50, 50)])}, 's{r.randrange(5)}')" for i in range(80))
    engine.sql(f"INSERT INTO m VALUES {data}")
    k = r.randrange(-20, 20)
    one = lambda q: rows(engine, q)[0][0]
    p = f"a > {k}"
    total = one("SELECT count(*) FROM m")
    parts = [one(f"SELECT count(*) FROM m WHERE {x}") for x in (p, f"NOT ({p})", f"({p}) IS NULL")]
    assert sum(parts) == total  # the three truth values part the rows
    assert parts[0] == one(f"SELECT count(CASE WHEN {p} THEN 1 END) FROM m") == one(f"SELECT count(*) FROM m WHERE NOT NOT ({p})")
    lo, av, hi = rows(engine, "SELECT min(a), avg(a), max(a) FROM m")[0]
    assert lo <= av <= hi
    assert one("SELECT count(DISTINCT c) FROM m") <= total
    top = rows(engine, "SELECT pk FROM m ORDER BY a NULLS LAST, pk")
    assert rows(engine, "SELECT pk FROM m ORDER BY a NULLS LAST, pk LIMIT 7") == top[:7]
    engine.sql(f"DELETE FROM m WHERE {p}")
    assert one("SELECT count(*) FROM m") == total - parts[0]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_key_filters_reach_the_scans_of_a_changed_table(engine):
    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, v TEXT)")
    engine.sql("INSERT INTO t SELECT id, CAST(id AS STRING) FROM range(100)")
    engine.sql("UPDATE t SET v = 'new' WHERE k % 10 = 0")
    engine.sql("DELETE FROM t WHERE k % 7 = 0")
    for df in (engine.db.scan_key_range("t", 20, 30), engine.sql("SELECT * FROM t WHERE k >= 20 AND k < 30")):
        text = plan(df)
        scans = [x for x in text[text.index("Physical Plan") :].split("\n") if "FileScan" in x]
        assert scans and sum("GreaterThanOrEqual(k,20), LessThan(k,30)" in x for x in scans) >= 2
        # the unchanged rows aren't shuffled: what changed is broadcast to them
        assert "BroadcastHashJoin" in text
        assert sorted((r["k"], r["v"]) for r in df.collect()) == [(k, "new" if k % 10 == 0 else str(k)) for k in range(20, 30) if k % 7]


def test_bare_aggregates_come_from_footers_until_rows_change(engine):
    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, v DOUBLE)")
    engine.sql("INSERT INTO t SELECT id, id / 2 FROM range(50)")
    df = engine.sql("SELECT count(*) AS n, min(k) AS lo, max(v) AS hi FROM t")
    assert "PushedAggregation: [COUNT(*), MIN(k), MAX(v)]" in plan(df) and tuple(df.first()) == (50, 0, 24.5)
    engine.sql("DELETE FROM t WHERE k >= 40")
    assert tuple(engine.sql("SELECT count(*) AS n, min(k) AS lo, max(v) AS hi FROM t").first()) == (40, 0, 19.5)


def test_many_changed_keys_are_not_broadcast(engine, monkeypatch):
    from marlstone import database

    monkeypatch.setattr(database, "BROADCAST_KEYS", 3)
    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, v BIGINT)")
    engine.sql("INSERT INTO t SELECT id, id FROM range(30)")
    engine.sql("UPDATE t SET v = 0 WHERE k < 10")
    engine.sql("DELETE FROM t WHERE k = 5")
    engine.sql("INSERT INTO t VALUES (5, 55)")
    assert {r["k"]: r["v"] for r in engine.sql("SELECT * FROM t").collect()} == {k: 55 if k == 5 else 0 if k < 10 else k for k in range(30)}


def test_a_key_that_comes_and_goes(engine):
    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, v BIGINT)")
    for i in range(3):
        engine.sql(f"INSERT INTO t VALUES (1, {i})")
        assert [r["v"] for r in engine.sql("SELECT v FROM t").collect()] == [i]
        engine.sql("DELETE FROM t WHERE k = 1")
        assert engine.sql("SELECT v FROM t").count() == 0
        if i == 1:
            engine.db.compact("t")


def test_opening_reads_only_the_log_after_the_checkpoint(engine, spark, monkeypatch):
    from marlstone.database import Database

    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY)")
    for i in range(3):
        engine.sql(f"INSERT INTO t VALUES ({i})")
    assert not engine.db.checkpoint_due() and engine.db.checkpoint() == 4
    engine.sql("INSERT INTO t VALUES (9)")
    again, read = Database(spark, engine.db.root), []
    entry = again._entry
    monkeypatch.setattr(again, "_entry", lambda c: read.append(c) or entry(c))
    assert again.csn() == 5 and {r["k"] for r in again.table("t").collect()} == {0, 1, 2, 9} and read == [5]
    assert again.table("t", 2).count() == 1  # older snapshots are still there


def test_a_conflict_survives_compaction_and_vacuum(engine):
    import pytest

    from marlstone.engine import Engine
    from marlstone.errors import WriteConflict

    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, v BIGINT)")
    engine.sql("INSERT INTO t VALUES (1, 1), (2, 2)")
    other = Engine(engine.spark, engine.db)
    other.sql("BEGIN")
    other.sql("UPDATE t SET v = 5 WHERE k = 1")
    engine.sql("DELETE FROM t WHERE k = 1")
    engine.db.compact("t")
    engine.db.vacuum()
    with pytest.raises(WriteConflict):
        other.sql("COMMIT")


def test_qualify_and_groups(engine):
    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY, g BIGINT)")
    engine.sql("INSERT INTO t SELECT id, id % 3 FROM range(12)")
    rows = engine.sql("SELECT k, g FROM t WHERE k > 2 QUALIFY row_number() OVER (PARTITION BY g ORDER BY k DESC) = 1 ORDER BY k").collect()
    assert [tuple(r) for r in rows] == [(9, 0), (10, 1), (11, 2)]
    rows = engine.sql("SELECT k, sum(k) OVER (ORDER BY g GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM t x WHERE x.k < 6 ORDER BY k").collect()
    assert [tuple(r) for r in rows] == [(0, 3), (1, 8), (2, 12), (3, 3), (4, 8), (5, 12)]
