import json

from marlstone.engine import Engine
from marlstone.streaming.changes import ChangeStream, Worker, Workers, changes, jsonl_sink, stream


def test_insert_update_delete(engine):
    engine.sql("CREATE TABLE acc (id INT PRIMARY KEY, bal INT)")
    sub = ChangeStream(engine.db)
    engine.sql("INSERT INTO acc VALUES (1, 100)")
    engine.sql("UPDATE acc SET bal = 250 WHERE id = 1")
    engine.sql("DELETE FROM acc WHERE id = 1")
    got = sub.poll()
    assert [(c["op"], c["old"] and c["old"]["bal"], c["new"] and c["new"]["bal"]) for c in got] == [("insert", None, 100), ("update", 100, 250), ("delete", 250, None)]
    assert [c["csn"] for c in got] == sorted(c["csn"] for c in got) and sub.poll() == []


def test_tables_are_filtered_and_upserts_are_told_apart(engine, spark):
    engine.sql("CREATE TABLE a (id INT PRIMARY KEY)")
    engine.sql("CREATE TABLE b (id INT PRIMARY KEY, v INT)")
    engine.sql("INSERT INTO a VALUES (1)")
    engine.db.upsert("b", spark.createDataFrame([(1, 1)], "id long, v long"))
    engine.db.upsert("b", spark.createDataFrame([(1, 2), (2, 2)], "id long, v long"))
    assert changes(engine.db).count() == 4
    assert sorted(r["op"] for r in changes(engine.db, table="B").collect()) == ["insert", "insert", "update"]


def test_a_transaction_is_one_batch(engine, spark):
    engine.sql("CREATE TABLE x (id INT PRIMARY KEY, v INT)")
    engine.sql("BEGIN")
    engine.sql("INSERT INTO x VALUES (1, 1)")
    engine.sql("ROLLBACK")
    assert changes(engine.db).count() == 0
    engine.sql("BEGIN")
    engine.sql("INSERT INTO x VALUES (1, 1)")
    engine.sql("INSERT INTO x VALUES (2, 2)")
    engine.sql("UPDATE x SET v = 5 WHERE id = 1")
    assert changes(engine.db).count() == 0
    engine.sql("COMMIT")
    got = changes(engine.db).collect()
    assert {r["op"] for r in got} == {"insert"} and len({r["csn"] for r in got}) == 1 and len(got) == 2


class Ledger(Worker):
    def __init__(self):
        self.rows, self.commits = {}, []

    def apply(self, change):
        if change["new"] is None:
            self.rows.pop(change["old"]["id"], None)
        else:
            self.rows[change["new"]["id"]] = change["new"]["bal"]

    def on_commit(self, csn):
        self.commits.append(csn)


def test_worker_follows_and_stops(engine):
    engine.sql("CREATE TABLE acc (id INT PRIMARY KEY, bal INT)")
    reg = Workers(engine.db)
    w = reg.register("ledger", Ledger(), "acc")
    engine.sql("INSERT INTO acc VALUES (1, 100), (2, 250)")
    engine.sql("UPDATE acc SET bal = 400 WHERE id = 1")
    engine.sql("DELETE FROM acc WHERE id = 2")
    w.settle()
    assert w.query(lambda x: dict(x.rows)) == {1: 400} and w.cursor == engine.db.csn()
    assert w.query(lambda x: x.commits) == [2, 3, 4] and reg.workers() == ["ledger"]
    assert reg.stop_worker("ledger") and reg.workers() == []
    engine.sql("DELETE FROM acc")
    assert w.query(lambda x: dict(x.rows)) == {1: 400}


def test_json_lines(engine, tmp_path, spark):
    engine.sql("CREATE TABLE p (id INT PRIMARY KEY, name TEXT, amt DECIMAL(6,2))")
    engine.sql("INSERT INTO p VALUES (1, 'a', 9.50)")
    engine.sql("UPDATE p SET amt = 12.25")
    q = jsonl_sink(engine.db, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    lines = sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).select("value").collect())
    assert len(lines) == 2 and '"amt":9.50' in lines[0] and '"amt":12.25' in lines[1] and '"old":{' in lines[1]
    assert list(json.loads(lines[0])) == ["table", "op", "csn", "old", "new"]


def test_streamed_aggregate_equals_batch(engine, spark, tmp_path):
    engine.sql("CREATE TABLE e (id INT PRIMARY KEY, k INT)")
    for lo in (0, 10):
        engine.sql("INSERT INTO e VALUES " + ", ".join(f"({i}, {i % 3})" for i in range(lo, lo + 10)))
    q = stream(engine.db, "e").groupBy("op").count().writeStream.outputMode("complete").format("memory").queryName("agg").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("agg").collect()[0]["count"] == 20


def test_windows(spark, sf):
    from marlstone.streaming.windows import sessions, sliding, tumbling

    ev = spark.read.parquet(f"{sf}/events.parquet")
    assert tumbling(ev, "ts", "1 hour", ["event_type"]).agg({"n": "sum"}).first()[0] == ev.count()
    assert sessions(ev, "ts", "30 minutes", ["user_id"]).agg({"n": "sum"}).first()[0] == ev.count()
    assert sliding(ev, "ts", "2 hours", "1 hour", []).agg({"n": "sum"}).first()[0] == 2 * ev.count()


def test_dbapi(engine, spark):
    import pytest

    from marlstone import dbapi

    con = dbapi.connect(engine.db.root, spark, autocommit=False)
    cur = con.cursor()
    cur.execute("CREATE TABLE u (email TEXT PRIMARY KEY, age INT, ok BOOLEAN)")
    cur.executemany("INSERT INTO u VALUES (?, ?, ?)", [("o'x?\\", 5, True), ("b", None, False)])
    assert cur.rowcount == 2
    assert dbapi.connect(engine.db.root, spark).execute("SELECT count(*) FROM u").fetchone() == (0,)
    con.commit()
    cur.execute("SELECT email, age, ok FROM u WHERE age = ?", (5,))
    assert [d[0] for d in cur.description] == ["email", "age", "ok"] and cur.fetchall() == [("o'x?\\", 5, True)] and cur.fetchone() is None
    con.execute("DELETE FROM u")
    con.close()
    assert Engine(spark, engine.db).sql("SELECT count(*) AS n FROM u").first()["n"] == 2
    with pytest.raises(dbapi.InterfaceError):
        con.cursor()
    with pytest.raises(dbapi.ProgrammingError):
        dbapi.connect(engine.db.root, spark).execute("SELECT nothing FROM u")


def test_changes_of_a_writer_that_died_after_its_commit_arrive(engine, monkeypatch):
    """The commit is published, but its changes didn't move yet: batch reads see them, streams after the next commit."""
    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY)")
    monkeypatch.setattr(engine.db, "_settle_feed", lambda: None)
    engine.sql("INSERT INTO t VALUES (1)")
    monkeypatch.undo()
    assert changes(engine.db, table="t").count() == 1
    engine.sql("INSERT INTO t VALUES (2)")
    seen = stream(engine.db, "t").writeStream.format("memory").queryName("late_feed").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert engine.spark.table("late_feed").count() == 2


def test_changes_after_a_callback_error_still_come(engine, capsys):
    from marlstone.streaming.changes import on_change

    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY)")
    seen = []

    def fails_once(old, new):
        seen.append((old, new))
        if len(seen) == 1:
            raise ValueError("not this one")

    with on_change(engine.db, "t", fails_once) as s:
        engine.sql("INSERT INTO t VALUES (1)")
        engine.sql("DELETE FROM t")
        s.settle()
        assert s.is_running() and s.errors == 1 and seen == [(None, {"k": 1}), ({"k": 1}, None)]
    assert not s.is_running() and "not this one" in capsys.readouterr().err


def test_waiting_for_a_change_ends(engine):
    import pytest

    from marlstone.streaming.changes import ChangeStream

    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY)")
    with ChangeStream(engine.db, "t") as s:
        with pytest.raises(TimeoutError):
            s.recv(0.1)
        engine.sql("INSERT INTO t VALUES (7)")
        assert s.recv(10)["new"] == {"k": 7}
    assert s.recv() is None and list(s) == []


def test_a_growing_file_is_followed_line_by_line(tmp_path):
    from marlstone.streaming.tail import Tail

    log, cursor = tmp_path / "log.jsonl", str(tmp_path / "cursor")
    assert list(Tail(str(log), cursor).poll()) == []
    log.write_text('{"a": 1}\n\n{"a": 2}\n{"a": ')
    assert [x["a"] for x in Tail(str(log), cursor, block=3).poll()] == [1, 2]
    with log.open("a") as f:
        f.write("3}\n")
    assert [x["a"] for x in Tail(str(log), cursor).follow(idle=0.2)] == [3]


def test_a_commit_is_spread_and_goes_to_a_frame_worker_whole(engine, spark):
    from pyspark.sql import functions as F

    from marlstone.streaming.changes import FrameWorker, Workers, _in_order

    rows = spark.range(2000).selectExpr("CAST(7 AS BIGINT) AS csn", "CAST(NULL AS STRING) AS old", "CAST(id AS STRING) AS new")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = _in_order(rows).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts > 1  # by csn alone it is one

    class Counts(FrameWorker):
        def __init__(self):
            self.got, self.commits = [], []

        def apply_commit(self, csn, changes):
            self.got.append((csn, changes.count()))

        def on_commit(self, csn):
            self.commits.append(csn)

    engine.sql("CREATE TABLE t (k BIGINT PRIMARY KEY)")
    engine.sql("INSERT INTO t VALUES (1), (2)")
    engine.sql("DELETE FROM t WHERE k = 1")
    workers = Workers(engine.db)
    w = workers.register("counts", Counts(), "t")
    w.settle()
    assert w.query(lambda x: (x.got, x.commits)) == ([(2, 2), (3, 1)], [2, 3])
    workers.stop_worker("counts")


def test_rows_of_the_tail_and_of_the_worker_are_not_held_by_the_driver(spark, sf):
    from marlstone.plans import planes

    for name in ("t_jsonl_sink_and_tail", "t_worker"):
        plan = planes.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
        assert "FileScan parquet" in plan and "LocalTableScan" not in plan and "ExistingRDD" not in plan
