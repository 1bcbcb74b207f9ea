"""Tables, transactions, streams, stored graphs and applications as named queries with their oracles.

Each query makes a database of its own, changes it through the engine and returns what is in it; the
oracle says the same of the tables that it was loaded from.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dbapi
from ..apps import aml, ccr, reco
from ..database import Database
from ..engine import Engine
from ..errors import ConstraintViolation, DataError, DuplicateKey, WriteConflict
from ..graph.store import GraphStore
from ..sources import feed
from ..streaming import changes as cdc
from ..streaming import tail
from .lineage import shared_dir, written
from .relational import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS = "CREATE TABLE o (k BIGINT PRIMARY KEY, cust BIGINT NOT NULL, status VARCHAR(1), price DOUBLE CHECK (price >= 0), day TIMESTAMP)"
ROWS = "SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders"


def folder(spark: SparkSession) -> str:
    """A new folder for a database, in the shared one; the tables' commits need a mounted file system."""
    at = shared_dir(spark)
    if at.startswith("file:"):
        at = at[5:].replace("//", "/", 1) if at.startswith("file://") else at[5:]
    elif "://" in at:
        raise ValueError(f"tables need a mounted file system, not {at}")
    path = os.path.join(at, f"db-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def _source(spark: SparkSession, d: str, name: str, sql: str) -> DataFrame:
    table(spark, f"{d}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return _source(spark, d, "orders", ROWS.replace("CAST(o_orderdate AS TIMESTAMP)", "CAST(o_orderdate AS TIMESTAMP_NTZ)"))


def loaded(spark: SparkSession, d: str) -> Engine:
    """An engine with all orders in table o."""
    e = Engine(spark, folder(spark))
    e.sql(ORDERS)
    e.db.bulk_load("o", orders(spark, d))
    return e


def plane(oracle: str):
    """Registers a query under its name with this oracle; {o} stands for the orders as a table."""

    def of(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = oracle.replace("{o}", f"({ROWS})")
        return fn

    return of


# loading and reading


@plane("SELECT * FROM {o}")
def t_bulk_load(spark, d) -> DataFrame:
    return loaded(spark, d).sql("SELECT * FROM o")


@plane("SELECT k, cust, price FROM {o} WHERE cust % 3 = 0 UNION ALL SELECT -k - 1, cust, price FROM {o} WHERE k % 50 = 0")
def t_insert_select(spark, d) -> DataFrame:
    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE i (k BIGINT PRIMARY KEY, cust INT, price DOUBLE DEFAULT 1.5)")
    orders(spark, d).createOrReplaceTempView("src_o")
    e.sql("INSERT INTO i SELECT k, cust, price FROM src_o WHERE cust % 3 = 0")
    e.sql("INSERT INTO i (price, k, cust) SELECT price, -k - 1, cust FROM src_o WHERE k % 50 = 0")
    return e.sql("SELECT k, cust, price FROM i")


@plane("SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(7 AS BIGINT), 'none', CAST(2.50 AS DECIMAL(9,2))), (2, NULL, 'it''s', 0.00), (3, 7, NULL, 1.10)) AS v(a, b, c, d)")
def t_insert_values_defaults(spark, d) -> DataFrame:
    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE v (a INT PRIMARY KEY, b INT DEFAULT 7, c TEXT DEFAULT 'none', d DECIMAL(9,2) DEFAULT 0)")
    e.sql("INSERT INTO v (a, d) VALUES (1, 2.5)")
    e.sql("INSERT INTO v (a, b, c) VALUES (2, NULL, 'it''s')")
    e.sql("INSERT INTO v (a, c, d) VALUES (3, NULL, 1.1)")
    return e.sql("SELECT * FROM v")


@plane("SELECT k, cust, CASE WHEN k % 7 = 0 THEN 'U' ELSE status END AS status, CASE WHEN k % 7 = 0 THEN price * 2 ELSE price END AS price FROM {o}")
def t_update(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("UPDATE o SET price = price * 2, status = 'U' WHERE k % 7 = 0")
    return e.sql("SELECT k, cust, status, price FROM o")


@plane("SELECT CASE WHEN k % 11 = 0 THEN -k - 1 ELSE k END AS k, cust FROM {o}")
def t_update_key(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("UPDATE o SET k = 0 - k - 1 WHERE k % 11 = 0")
    return e.sql("SELECT k, cust FROM o")


@plane("SELECT k, price FROM {o} WHERE NOT (price < 50000 OR k % 5 = 1)")
def t_delete(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("DELETE FROM o WHERE price < 50000 OR k % 5 = 1")
    return e.sql("SELECT k, price FROM o")


@plane("SELECT k, cust, CASE WHEN k % 4 = 0 THEN price + 1 ELSE price END AS price FROM {o} UNION ALL SELECT k + 10000000, cust, price FROM {o} WHERE k % 9 = 0")
def t_upsert(spark, d) -> DataFrame:
    e, src = loaded(spark, d), orders(spark, d)
    e.db.upsert("o", src.where("k % 4 = 0").withColumn("price", F.col("price") + 1).unionByName(src.where("k % 9 = 0").withColumn("k", F.col("k") + 10_000_000)))
    return e.sql("SELECT k, cust, price FROM o")


@plane("SELECT k, CASE WHEN k <= 40 THEN 0.0 ELSE price END AS price FROM {o} WHERE k NOT IN (SELECT k FROM {o} WHERE k > 40 ORDER BY k LIMIT 5)")
def t_by_key_writes(spark, d) -> DataFrame:
    e, src = loaded(spark, d), orders(spark, d)
    e.db.update("o", src.where("k <= 40").withColumn("price", F.lit(0.0)))
    e.db.delete("o", [r["k"] for r in src.where("k > 40").orderBy("k").limit(5).collect()])
    return e.sql("SELECT k, price FROM o")


@plane("SELECT k, cust FROM {o} WHERE k % 2 = 0 UNION ALL SELECT k, cust FROM {o} WHERE k % 3 = 0 UNION ALL SELECT k, cust FROM {o} WHERE k % 2 = 0")
def t_keyless_rows(spark, d) -> DataFrame:
    e, src = Engine(spark, folder(spark)), orders(spark, d)
    e.sql("CREATE TABLE h (k BIGINT, cust BIGINT)")
    for m in (2, 3, 2):
        e.db.insert("h", src.where(f"k % {m} = 0").select("k", "cust"))
    return e.sql("SELECT k, cust FROM h")


@plane("SELECT k, cust, status, price, day FROM {o} WHERE k >= 100 AND k < 400 AND k % 3 <> 0")
def t_key_range_after_changes(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("DELETE FROM o WHERE k % 3 = 0")
    return e.db.scan_key_range("o", 100, 400)


@plane("SELECT k, price + 1 AS price FROM {o} WHERE k = 77")
def t_point_lookup(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("UPDATE o SET price = price + 1 WHERE k < 200")
    row = e.db.get("o", 77)
    return spark.createDataFrame([(row["k"], row["price"])] if row else [], "k long, price double")


@plane("SELECT count(*) AS n, count(k) AS nk, min(k) AS lo, max(k) AS hi FROM {o}")
def t_metadata(spark, d) -> DataFrame:
    return loaded(spark, d).sql("SELECT count(*) AS n, count(k) AS nk, min(k) AS lo, max(k) AS hi FROM o")


@plane("SELECT k FROM {o} WHERE k < 60 OR (k >= 300 AND k < 340)")
def t_part_pruning(spark, d) -> DataFrame:
    e, src = Engine(spark, folder(spark)), orders(spark, d)
    e.sql(ORDERS)
    for lo, hi in ((0, 100), (100, 300), (300, 1 << 40)):
        e.db.insert("o", src.where((F.col("k") >= lo) & (F.col("k") < hi)))
    return e.sql("SELECT k FROM o WHERE k < 60 OR (k >= 300 AND k < 340)")


# definitions, constraints, transactions


@plane("SELECT * FROM (VALUES ('a', 0), ('c', 0)) AS v(name, n)")
def t_create_drop_truncate(spark, d) -> DataFrame:
    e, src = Engine(spark, folder(spark)), orders(spark, d)
    for t in "abc":
        e.sql(f"CREATE TABLE {t} (k BIGINT PRIMARY KEY)")
        e.db.insert(t, src.select("k"))
    e.sql("TRUNCATE TABLE a")
    e.sql("DROP TABLE b")
    e.sql("DROP TABLE c")
    e.sql("CREATE TABLE c (k INT)")
    return spark.createDataFrame([(t, e.sql(f"SELECT * FROM {t}").count()) for t in e.db.table_names()], "name string, n int")


@plane("SELECT * FROM (VALUES ('check', 'ConstraintViolation'), ('double key', 'DuplicateKey'), ('known key', 'DuplicateKey'), ('length', 'ConstraintViolation'), ('not null', 'ConstraintViolation'), ('null key', 'ConstraintViolation'), ('type', 'DataError')) AS v(rule, error)")
def t_constraints(spark, d) -> DataFrame:
    e = loaded(spark, d)
    before, rows = e.db.csn(), []
    tries = {
        "check": "INSERT INTO o (k, cust, price) VALUES (-1, 1, -5)", "not null": "INSERT INTO o (k, cust) VALUES (-1, NULL)", "null key": "INSERT INTO o (k, cust) VALUES (NULL, 1)",
        "length": "UPDATE o SET status = 'long' WHERE k < 100", "double key": "INSERT INTO o (k, cust) VALUES (-1, 1), (-1, 2)", "known key": "INSERT INTO o (k, cust) SELECT min(k), 1 FROM o",
        "type": "UPDATE o SET cust = 'x' || status WHERE k < 100",
    }
    for name, sql in tries.items():
        try:
            e.sql(sql)
        except (ConstraintViolation, DuplicateKey, DataError) as x:
            rows.append((name, type(x).__name__))
    return spark.createDataFrame(rows if e.db.csn() == before else [], "rule string, error string")


@plane("SELECT k, CASE WHEN k % 8 = 0 THEN 'T' ELSE status END AS status FROM {o} WHERE k % 10 <> 3 UNION ALL SELECT -k - 1, 'N' FROM {o} WHERE k % 6 = 0")
def t_transaction(spark, d) -> DataFrame:
    e = loaded(spark, d)
    for sql in ("BEGIN", "INSERT INTO o SELECT -k - 1, cust, 'N', price, day FROM o WHERE k % 6 = 0", "UPDATE o SET status = 'T' WHERE k >= 0 AND k % 8 = 0", "DELETE FROM o WHERE k >= 0 AND k % 10 = 3", "COMMIT"):
        e.sql(sql)
    return e.sql("SELECT k, status FROM o")


@plane("SELECT count(*) AS n, CAST(count(*) AS BIGINT) AS seen_inside, 0 AS left_over FROM {o}")
def t_rollback(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("BEGIN")
    e.sql("DELETE FROM o WHERE k % 2 = 0")
    e.sql("INSERT INTO o SELECT -k, cust, status, price, day FROM o")
    inside = e.sql("SELECT count(*) AS n FROM o WHERE k % 2 <> 0").first()["n"]
    odd = e.sql("SELECT count(*) AS n FROM o WHERE k >= 0 AND k % 2 <> 0").first()["n"]
    e.sql("ROLLBACK")
    left = e.sql("SELECT count(*) AS n FROM o WHERE k < 0").first()["n"]
    n = e.sql("SELECT count(*) AS n FROM o").first()["n"]
    return spark.createDataFrame([(n, n + inside - 2 * odd, left)], "n long, seen_inside long, left_over int")


@plane("SELECT * FROM (VALUES ('first', 'done'), ('other key', 'done'), ('same key', 'WriteConflict')) AS v(who, what)")
def t_conflicts(spark, d) -> DataFrame:
    e = loaded(spark, d)
    k = [r["k"] for r in orders(spark, d).orderBy("k").limit(2).collect()]
    one, two, three = (Engine(spark, e.db) for _ in range(3))
    for x, key in ((one, k[0]), (two, k[0]), (three, k[1])):
        x.sql("BEGIN")
        x.sql(f"UPDATE o SET price = price + 1 WHERE k = {key}")
    rows = []
    for name, x in (("first", one), ("same key", two), ("other key", three)):
        try:
            x.sql("COMMIT")
            rows.append((name, "done"))
        except WriteConflict as err:
            rows.append((name, type(err).__name__))
        e.db.compact("o")  # what it moves conflicts with nobody
    return spark.createDataFrame(rows, "who string, what string")


# versions


@plane("SELECT 'all' AS v, k, price FROM {o} UNION ALL SELECT 'updated', k, CASE WHEN k % 2 = 0 THEN 0.0 ELSE price END FROM {o} UNION ALL SELECT 'deleted', k, CASE WHEN k % 2 = 0 THEN 0.0 ELSE price END FROM {o} WHERE k % 5 <> 0")
def t_snapshots(spark, d) -> DataFrame:
    e = loaded(spark, d)
    at = [e.db.csn()]
    for sql in ("UPDATE o SET price = 0 WHERE k % 2 = 0", "DELETE FROM o WHERE k % 5 = 0"):
        e.sql(sql)
        at.append(e.db.csn())
    out = None
    for name, csn in zip(("all", "updated", "deleted"), at, strict=True):
        part = e.db.table("o", csn).select(F.lit(name).alias("v"), "k", "price")
        out = part if out is None else out.unionAll(part)
    return out


@plane("SELECT k, price FROM {o}")
def t_pin_outlives_vacuum(spark, d) -> DataFrame:
    e = loaded(spark, d)
    pin = e.db.pin()
    at = pin.__enter__()
    e.sql("UPDATE o SET price = -0.0 WHERE k > 0")
    e.db.compact("o")
    e.db.vacuum()
    return e.db.table("o", at).select("k", "price")


@plane("SELECT k, CASE WHEN k % 3 = 0 THEN 1.0 ELSE price END AS price FROM {o} WHERE k % 7 <> 0")
def t_compaction(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("UPDATE o SET price = 1 WHERE k % 3 = 0")
    e.sql("DELETE FROM o WHERE k % 7 = 0")
    e.db.compact("o")
    e.db.vacuum()
    return Database(spark, e.db.root).table("o").select("k", "price")


@plane("SELECT * FROM (VALUES ('o', CAST(1 AS BIGINT), (SELECT count(*) FROM orders), FALSE), ('p', 9, 9, TRUE)) AS v(\"table\", parts, versions, compaction_due)")
def t_stats(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("CREATE TABLE p (k BIGINT PRIMARY KEY)")
    for i in range(9):
        e.sql(f"INSERT INTO p VALUES ({i})")
    return e.db.stats().select("table", "parts", "versions", "compaction_due")


@plane("SELECT k, price FROM {o} WHERE k % 2 = 1 UNION ALL SELECT -1, 2.0")
def t_reopen_after_checkpoint(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("DELETE FROM o WHERE k % 2 = 0")
    e.db.checkpoint()
    e.sql("INSERT INTO o (k, cust, price) VALUES (-1, 1, 2)")
    again = Database(spark, e.db.root)
    return again.table("o").select("k", "price")


@plane("SELECT k, price FROM {o} UNION ALL SELECT -1, NULL")
def t_backup_restore(spark, d) -> DataFrame:
    e = loaded(spark, d)
    e.sql("INSERT INTO o (k, cust) VALUES (-1, 1)")
    to = folder(spark)
    e.db.backup(os.path.join(to, "copy"))
    e.sql("DELETE FROM o")
    return Database.restore(spark, os.path.join(to, "copy"), os.path.join(to, "back")).table("o").select("k", "price")


@plane("SELECT * FROM (VALUES ('commits', 4), ('compactions', 1), ('conflicts', 0), ('flushes', 1), ('left', 0)) AS v(what, n)")
def t_metrics_and_durability(spark, d) -> DataFrame:
    db = Database(spark, folder(spark), durability="async")
    db.create("CREATE TABLE m (k BIGINT PRIMARY KEY)")
    for i in range(2):
        db.insert("m", spark.range(10 * i, 10 * i + 10).withColumnRenamed("id", "k"))
    db.compact("m")
    db.flush()
    found = {k: int(db.metrics[k]) for k in ("commits", "compactions", "conflicts", "flushes")} | {"left": db.flush()}
    return spark.createDataFrame(sorted(found.items()), "what string, n int")


@plane("SELECT * FROM (VALUES ('o', 'cust', 'bigint', FALSE), ('o', 'day', 'timestamp_ntz', TRUE), ('o', 'k', 'bigint', FALSE), ('o', 'price', 'double', TRUE), ('o', 'status', 'string', TRUE)) AS v(tbl, col, type, nullable)")
def t_catalog(spark, d) -> DataFrame:
    e = Engine(spark, folder(spark))
    e.sql(ORDERS)
    return spark.createDataFrame([(t, c.name, c.type, c.nullable) for t in e.db.table_names() for c in e.db.spec(t).columns], "tbl string, col string, type string, nullable boolean")


# COPY


def _csv(spark, d, options: dict) -> str:
    path = folder(spark) + "/csv"
    orders(spark, d).select("k", "cust", F.when(F.col("k") % 3 == 0, F.lit(None)).when(F.col("k") % 3 == 1, F.concat(F.lit('a "b", '), "status")).otherwise(F.col("status")).alias("status"), "price").write.options(**options).csv(path)
    return path


_COPIED = "SELECT k, cust, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'a \"b\", ' || status ELSE status END AS status, price, CAST(5 AS BIGINT) AS extra FROM {o}"
_COPY = "CREATE TABLE c (k BIGINT PRIMARY KEY, cust INT, status TEXT, price DOUBLE, extra INT DEFAULT 5)"


@plane(_COPIED)
def t_copy_csv(spark, d) -> DataFrame:
    e = Engine(spark, folder(spark))
    e.sql(_COPY)
    e.sql(f"COPY c (k, cust, status, price) FROM '{_csv(spark, d, {'header': True, 'escape': '\"', 'nullValue': ''})}' WITH (FORMAT csv, HEADER)")
    return e.sql("SELECT * FROM c")


@plane(_COPIED)
def t_copy_null_marker(spark, d) -> DataFrame:
    e = Engine(spark, folder(spark))
    e.sql(_COPY)
    e.sql(f"COPY c (k, cust, status, price) FROM '{_csv(spark, d, {'escape': '\"', 'sep': '|', 'nullValue': 'NIL'})}' WITH (FORMAT csv, DELIMITER '|', NULL 'NIL')")
    return e.sql("SELECT * FROM c")


# changes

_FEED = "SELECT 'o' AS \"table\", 'insert' AS op, CAST(2 AS BIGINT) AS csn, k, NULL AS old_price, price AS new_price FROM {o} UNION ALL SELECT 'o', 'update', 3, k, price, price + 1 FROM {o} WHERE k % 4 = 0 UNION ALL SELECT 'o', 'delete', 4, k, CASE WHEN k % 4 = 0 THEN price + 1 ELSE price END, NULL FROM {o} WHERE k % 6 = 0"


def _changed(spark, d) -> Engine:
    e = loaded(spark, d)
    e.sql("UPDATE o SET price = price + 1 WHERE k % 4 = 0")
    e.sql("DELETE FROM o WHERE k % 6 = 0")
    return e


def _flat(df: DataFrame) -> DataFrame:
    at = lambda side, kind, f: F.get_json_object(side, f"$.{f}").cast(kind)
    return df.select("table", "op", "csn", F.coalesce(at("new", "long", "k"), at("old", "long", "k")).alias("k"), at("old", "double", "price").alias("old_price"), at("new", "double", "price").alias("new_price"))


@plane(_FEED)
def t_changes(spark, d) -> DataFrame:
    return _flat(cdc.changes(_changed(spark, d).db, table="o"))


@plane("SELECT * FROM (" + _FEED + ") WHERE csn > 2 AND csn <= 3")
def t_changes_between(spark, d) -> DataFrame:
    return _flat(cdc.changes(_changed(spark, d).db, 2, 3))


@plane("SELECT op, count(*) AS n, count(DISTINCT csn) AS commits FROM (SELECT 'insert' AS op, 1 AS csn FROM {o} WHERE k % 6 = 0 UNION ALL SELECT 'update', 1 FROM {o} WHERE k % 8 = 0 AND k % 10 <> 3 UNION ALL SELECT 'delete', 1 FROM {o} WHERE k % 10 = 3) GROUP BY op")
def t_changes_of_a_transaction(spark, d) -> DataFrame:
    e = loaded(spark, d)
    after = e.db.csn()
    for sql in ("BEGIN", "INSERT INTO o SELECT -k - 1, cust, 'N', price, day FROM o WHERE k % 6 = 0", "UPDATE o SET status = 'T' WHERE k >= 0 AND k % 8 = 0", "DELETE FROM o WHERE k >= 0 AND k % 10 = 3", "COMMIT"):
        e.sql(sql)
    return cdc.changes(e.db, after).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("csn").alias("commits"))


@plane("SELECT op, count(*) AS n, CAST(sum(k) AS BIGINT) AS keys FROM (" + _FEED + ") GROUP BY op")
def t_jsonl_sink_and_tail(spark, d) -> DataFrame:
    """Changes as JSON lines, written by one stream and read by another."""
    db, at = _changed(spark, d).db, folder(spark)
    cdc.jsonl_sink(db, f"{at}/lines", f"{at}/sink").trigger(availableNow=True).start().awaitTermination()
    rows = tail.stream_jsonl(spark, f"{at}/lines")
    # as files: a stream's memory table is held by the driver
    rows.writeStream.format("parquet").option("path", f"{at}/read").option("checkpointLocation", f"{at}/tail").trigger(availableNow=True).start().awaitTermination()
    return _flat(spark.read.schema(rows.schema).parquet(f"{at}/read")).groupBy("op").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))


class _Totals(cdc.FrameWorker):
    """Each key's price, in a table that every commit's changes make anew."""

    def __init__(self, spark: SparkSession):
        self.price = written(spark.createDataFrame([], "k long, price double"), "totals")
        self.commits: list[int] = []
        self.passes: list[int] = []

    def apply_commit(self, csn: int, changes: DataFrame) -> None:
        at = lambda side, kind, f: F.get_json_object(side, f"$.{f}").cast(kind)
        new = changes.select(F.coalesce(at("new", "long", "k"), at("old", "long", "k")).alias("k"), at("new", "double", "price").alias("n_price"), F.col("new").isNotNull().alias("stays"))
        both = self.price.join(new, "k", "full").where("coalesce(stays, true)")
        self.price = written(both.select("k", F.when(F.col("stays"), F.col("n_price")).otherwise(F.col("price")).alias("price")), "totals", instead_of=self.price)

    def on_commit(self, csn: int) -> None:
        self.commits.append(csn)

    def on_pass(self, csn: int) -> None:
        self.passes.append(csn)


@plane("SELECT k, CASE WHEN k % 4 = 0 THEN price + 1 ELSE price END AS price, '[2, 3, 4] [3]' AS commits FROM {o} WHERE k % 6 <> 0")
def t_worker(spark, d) -> DataFrame:
    workers = cdc.Workers(_changed(spark, d).db)
    w = workers.register("totals", _Totals(spark), "o", pass_every=2)
    w.settle()
    prices, commits = w.query(lambda x: (x.price, f"{x.commits} {x.passes}"))
    workers.stop_worker("totals")
    return prices.withColumn("commits", F.lit(commits))


@plane("SELECT * FROM (VALUES ('callback', CAST(3 AS BIGINT)), ('iterated', 3), ('late', 0), ('polled', 3)) AS v(how, n)")
def t_subscriptions(spark, d) -> DataFrame:
    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE s (k BIGINT PRIMARY KEY)")
    got: list[dict] = []
    called, polled, iterated = cdc.on_change(e.db, "s", lambda old, new: got.append(new)), cdc.ChangeStream(e.db, "s"), cdc.ChangeStream(e.db)
    e.sql("INSERT INTO s VALUES (1), (2)")
    e.sql("INSERT INTO s VALUES (3)")
    called.settle()
    called.close()
    one = [iterated.recv(30), iterated.next_timeout(30), iterated.try_recv()]
    late = iterated.next_timeout(0.1)
    rows = [("callback", len(got)), ("iterated", len({x["new"]["k"] for x in one})), ("late", int(late is not None)), ("polled", len(polled.poll()))]
    return spark.createDataFrame(rows, "how string, n long")


@plane("SELECT op, count(*) AS n FROM (" + _FEED + ") GROUP BY op")
def t_change_counts_streamed(spark, d) -> DataFrame:
    """A continuing aggregation over the feed, one micro-batch after another."""
    name = f"counts_{uuid.uuid4().hex}"
    cdc.stream(_changed(spark, d).db, "o").groupBy("op").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@plane("SELECT k, price FROM {o} WHERE k % 2 = 0")
def t_no_change_without_its_commit(spark, d) -> DataFrame:
    """A writer dies after writing its changes and before its commit: nobody sees them."""
    e, src = Engine(spark, folder(spark)), orders(spark, d).select("k", "price")
    e.sql("CREATE TABLE f (k BIGINT PRIMARY KEY, price DOUBLE)")

    def dies(ops):
        raise OSError("no space left")

    live, e.db._publish = e.db._publish, dies
    try:
        e.db.insert("f", src.where("k % 2 = 1"))
    except OSError:
        e.db._publish = live
    e.db.insert("f", src.where("k % 2 = 0"))
    return cdc.changes(e.db, table="f").select(F.get_json_object("new", "$.k").cast("long").alias("k"), F.get_json_object("new", "$.price").cast("double").alias("price"))


# access by other means


@plane("SELECT k, cust, price FROM {o} WHERE cust = 7 AND price > 1000.5 UNION ALL SELECT -5, 7, 1.25")
def t_dbapi(spark, d) -> DataFrame:
    with_rows = loaded(spark, d)
    c = dbapi.connect(with_rows.db.root, spark, autocommit=False)
    c.execute("INSERT INTO o (k, cust, price) VALUES (?, ?, ?)", (-5, 7, 1.25))
    c.commit()
    c.execute("DELETE FROM o WHERE cust = ?", (7,))
    c.rollback()
    rows = c.execute("SELECT k, cust, price FROM o WHERE cust = ? AND (price > ? OR k < 0)", (7, 1000.5)).fetchall()
    c.close()
    return spark.createDataFrame([tuple(r) for r in rows], "k long, cust long, price double")


_EDGES = "SELECT o_custkey AS src, o_orderkey % 100 AS dst, max(o_totalprice) AS weight FROM orders GROUP BY 1, 2"


def _stored(spark, d) -> GraphStore:
    g = GraphStore(Database(spark, folder(spark)), "g")
    g.add_edges(_source(spark, d, "orders", _EDGES.replace("max(", "min(")))
    g.add_edges(_source(spark, d, "orders", _EDGES))  # replaces every weight
    return g


@plane("SELECT CAST(src AS BIGINT) AS src, CAST(dst AS BIGINT) AS dst, weight FROM (" + _EDGES + ")")
def g_stored_view(spark, d) -> DataFrame:
    return _stored(spark, d).view().edges


@plane("SELECT DISTINCT o_orderkey % 100 AS id FROM orders WHERE o_custkey = 7 UNION SELECT 55")
def g_stored_out_neighbors(spark, d) -> DataFrame:
    g = _stored(spark, d)
    g.add_edge(7, 55, 2.0)
    return g.out_neighbors(7)


# applications and their feeds

TX = "SELECT l_orderkey * 10 + l_linenumber AS txn_id, l_partkey AS src, l_suppkey AS dst, l_extendedprice AS amount, l_shipdate AS ts FROM lineitem"


def _tx(spark, d) -> DataFrame:
    return _source(spark, d, "lineitem", TX)


@plane("SELECT dst AS account, count(DISTINCT src) AS senders, CAST(count_if(amount >= 9000 AND amount < 10000) AS BIGINT) AS near FROM (" + TX + ") GROUP BY dst HAVING count(DISTINCT src) >= 8 AND count_if(amount >= 9000 AND amount < 10000) >= 5")
def x_structuring(spark, d) -> DataFrame:
    return aml.structuring(_tx(spark, d))


@plane("SELECT src AS account, count(DISTINCT dst) AS receivers FROM (" + TX + ") GROUP BY src HAVING count(DISTINCT dst) >= 15")
def x_fan_out(spark, d) -> DataFrame:
    return aml.fan_out(_tx(spark, d))


@plane("SELECT CAST(count_if(amount >= 9000 AND amount < 10000) AS BIGINT) AS near, CAST(count_if(amount >= 50000) AS BIGINT) AS large FROM (" + TX + ")")
def x_velocity(spark, d) -> DataFrame:
    return aml.velocity(_tx(spark, d))


@plane("SELECT DISTINCT account FROM (SELECT src AS account, dst AS bad FROM (" + TX + ") UNION ALL SELECT dst, src FROM (" + TX + ")) WHERE bad % 37 = 5")
def x_known_bad(spark, d) -> DataFrame:
    tx = _tx(spark, d)
    bad = tx.select(F.explode(F.array("src", "dst")).alias("id")).where("id % 37 = 5").distinct()
    return aml.known_bad_contacts(tx, bad)


@plane("SELECT src AS account, 'fan_out' AS typology FROM (" + TX + ") GROUP BY src HAVING count(DISTINCT dst) >= 15 AND src % 2 = 1")
def x_alert_dedup(spark, d) -> DataFrame:
    found = aml.fan_out(_tx(spark, d)).select("account", F.lit("fan_out").alias("typology"))
    return aml.new_alerts(found.unionAll(found), found.where("account % 2 = 0"))


@plane("SELECT i * 1000 + 1000000 AS component, list_transform(range(0, 5), lambda j: 1000000 + i * 1000 + j) AS members FROM range(0, 3) r(i)")
def x_planted_rings(spark, d) -> DataFrame:
    tx = feed.transactions(spark, 2000).unionAll(feed.suspicious(spark))
    return aml.graph(tx).laundering_cycles()


@plane("SELECT 1100000 + i * 1000 AS account FROM range(0, 4) r(i)")
def x_planted_structuring(spark, d) -> DataFrame:
    return aml.structuring(feed.transactions(spark, 2000, accounts=50_000).unionAll(feed.suspicious(spark))).select("account")


@plane("SELECT 1200000 + i * 1000 AS account FROM range(0, 2) r(i)")
def x_planted_fan_out(spark, d) -> DataFrame:
    return aml.fan_out(feed.transactions(spark, 2000, accounts=50_000).unionAll(feed.suspicious(spark))).select("account")


_DEAL = "SELECT l_suppkey AS counterparty, l_partkey AS instrument, l_quantity AS notional, l_extendedprice / l_quantity AS trade_price FROM lineitem"
_TICK = "SELECT l_partkey AS instrument, l_extendedprice / l_quantity AS price, {key} AS tick_id FROM lineitem"
_SPARK_KEY = "struct(l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice)"
_DUCK_KEY = "struct_pack(a := l_shipdate, b := l_orderkey, c := l_linenumber, d := l_suppkey, e := l_extendedprice)"
_MTM = "SELECT d.counterparty, sum(d.notional * (p.price - d.trade_price)) AS mtm FROM (" + _DEAL + ") d JOIN (SELECT instrument, arg_max(price, tick_id) AS price FROM (" + _TICK.replace("{key}", _DUCK_KEY) + ") GROUP BY instrument) p ON p.instrument = d.instrument GROUP BY d.counterparty"


def _exposures(spark, d) -> DataFrame:
    return ccr.exposures(_source(spark, d, "lineitem", _DEAL), _source(spark, d, "lineitem", _TICK.replace("{key}", _SPARK_KEY)))


@plane("SELECT counterparty, round(mtm, 2) AS mtm FROM (" + _MTM + ")")
def x_exposure(spark, d) -> DataFrame:
    return _exposures(spark, d).select("counterparty", F.round("mtm", 2).alias("mtm"))


@plane("SELECT counterparty FROM (" + _MTM + ") WHERE greatest(mtm, 0) > 1000 * (counterparty % 5)")
def x_breaches(spark, d) -> DataFrame:
    e = _exposures(spark, d)
    return ccr.breaches(e, e.select("counterparty", (F.col("counterparty") % 5 * 1000).cast("double").alias("limit"))).select("counterparty")


@plane("SELECT user_id AS book, event_id AS step, CASE WHEN len(w) >= 32 THEN list_reverse_sort(w)[CAST(floor(len(w) * 0.01) AS INT) + 1] END AS var99 FROM (SELECT user_id, event_id, list(-value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 511 PRECEDING AND CURRENT ROW) AS w FROM (SELECT user_id % 16 AS user_id, event_id, value FROM events WHERE value IS NOT NULL))")
def x_var_window(spark, d) -> DataFrame:
    pnl = _source(spark, d, "events", "SELECT user_id % 16 AS book, event_id AS step, value AS pnl FROM events")
    return ccr.historical_var(pnl, book="book")


@plane("SELECT l_partkey AS item_id, count(DISTINCT o_custkey) AS users FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_partkey ORDER BY users DESC, item_id LIMIT 10")
def x_trending(spark, d) -> DataFrame:
    return reco.trending(_shop(spark, d))


def _shop(spark, d):
    table(spark, f"{d}/orders.parquet").createOrReplaceTempView("orders")
    return reco.bipartite(_source(spark, d, "lineitem", "SELECT o_custkey AS user_id, l_partkey AS item_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey"))


@plane("WITH e AS (SELECT DISTINCT o_custkey AS u, l_partkey AS i FROM orders JOIN lineitem ON o_orderkey = l_orderkey), dg AS (SELECT u, count(*) AS n FROM e GROUP BY u HAVING count(*) > 1) SELECT y.i AS item_id, round(sum(1 / ln(dg.n)), 9) AS score FROM e x JOIN dg ON dg.u = x.u JOIN e y ON y.u = x.u AND y.i <> 7 WHERE x.i = 7 GROUP BY y.i ORDER BY sum(1 / ln(dg.n)) DESC, y.i LIMIT 5")
def x_similar_items(spark, d) -> DataFrame:
    return reco.similar_items(_shop(spark, d), 7).select("item_id", F.round("score", 9).alias("score"))


@plane("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 3) AS balance FROM events")
def running_balance(spark, d) -> DataFrame:
    return _source(spark, d, "events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 3) AS balance FROM events")


@plane("SELECT k, r.v AS v FROM (SELECT user_id % 40 AS k, arg_max(struct_pack(op := event_type, v := value), event_id) AS r FROM events GROUP BY user_id % 40)")
def snapshot_asof(spark, d) -> DataFrame:
    """The latest event of each key, through upserts in three commits."""
    e = Engine(spark, folder(spark))
    e.sql("CREATE TABLE s (k BIGINT PRIMARY KEY, v DOUBLE)")
    src = _source(spark, d, "events", "SELECT user_id % 40 AS k, event_id, value AS v FROM events")
    for i in range(3):
        part = src.where(f"event_id % 3 <= {i}").groupBy("k").agg(F.max_by("v", "event_id").alias("v"))
        e.db.upsert("s", part)
    return e.sql("SELECT k, v FROM s")

