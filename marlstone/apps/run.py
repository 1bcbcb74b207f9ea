"""The three applications as programs over synthetic feeds, through tables, the change stream and graphs.

    python -m marlstone.apps.run aml --root /tmp/bank --rows 20000
    python -m marlstone.apps.run ccr --root /tmp/risk
    python -m marlstone.apps.run reco --root /tmp/shop

Each prints one line of JSON: what it found, and how long loading and analysis took.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..session import local
from ..sources import feed
from ..streaming.changes import Workers
from . import aml, ccr, reco

ACCOUNTS = 1_000_000


def run_aml(spark: SparkSession, root: str, rows: int) -> dict:
    """Background payments with planted rings, structuring and fan-out: alerts go into a table as they are found, each once."""
    e = Engine(spark, root)
    e.sql("CREATE TABLE tx (txn_id BIGINT PRIMARY KEY, src BIGINT NOT NULL, dst BIGINT NOT NULL, amount DECIMAL(14,2) CHECK (amount > 0), ts TIMESTAMP)")
    e.sql("CREATE TABLE alerts (id TEXT PRIMARY KEY, account BIGINT NOT NULL, typology TEXT NOT NULL)")
    workers = Workers(e.db)
    live = workers.register("aml", aml.AmlWorker(), "tx")
    t = time.perf_counter()
    e.db.bulk_load("tx", feed.transactions(spark, rows))
    e.db.insert("tx", feed.suspicious(spark))
    loaded = time.perf_counter() - t
    tx = e.db.table("tx")
    t = time.perf_counter()
    found = kinds(tx)
    fresh = aml.new_alerts(found, e.db.table("alerts"))
    e.db.insert("alerts", fresh.select(F.concat_ws(":", "typology", F.col("account").cast("string")).alias("id"), "account", "typology"))
    took = time.perf_counter() - t
    live.settle()
    streamed = live.query(lambda w: len(w.alerts))
    workers.stop_worker("aml")
    per = {r["typology"]: r["n"] for r in e.db.table("alerts").groupBy("typology").agg(F.count("*").alias("n")).collect()}
    return {"transactions": tx.count(), "alerts": per, "streamed_alerts": streamed, "load_s": round(loaded, 2), "detect_s": round(took, 2)}


def kinds(tx: DataFrame) -> DataFrame:
    """(account, typology) of what the batch detectors find."""
    ring = aml.graph(tx).laundering_cycles().select(F.explode("members").alias("account"), F.lit("ring").alias("typology"))
    near = aml.structuring(tx).select("account", F.lit("structuring").alias("typology"))
    return ring.unionAll(near).unionAll(aml.fan_out(tx).select("account", F.lit("fan_out").alias("typology")))


def run_ccr(spark: SparkSession, root: str, rows: int) -> dict:
    """Trades marked against ticks with a planted shock; limits, and a cascade of defaults over interbank debts."""
    e = Engine(spark, root)
    e.sql("CREATE TABLE ticks (tick_id BIGINT PRIMARY KEY, instrument BIGINT, price DECIMAL(14,4), ts TIMESTAMP)")
    e.sql("CREATE TABLE trades (trade_id BIGINT PRIMARY KEY, counterparty BIGINT, instrument BIGINT, notional DOUBLE, trade_price DECIMAL(14,4))")
    t = time.perf_counter()
    e.db.bulk_load("ticks", feed.ticks(spark, rows, shock_at=rows // 2))
    e.db.bulk_load("trades", feed.trades(spark, max(200, rows // 20)))
    loaded = time.perf_counter() - t
    t = time.perf_counter()
    exposure = ccr.exposures(e.db.table("trades"), e.db.table("ticks"))
    limits = exposure.select("counterparty", F.lit(50_000.0).alias("limit"))
    over = ccr.breaches(exposure, limits).count()
    debts = spark.range(20).select(F.col("id").alias("debtor"), ((F.col("id") * 7 + 3) % 20).alias("creditor"), (F.lit(50.0) + F.col("id")).alias("amount"))
    assets = spark.range(20).select("id", F.when(F.col("id") % 6 == 0, 0.0).otherwise(60.0).alias("assets"))
    defaults = ccr.cascade(debts, assets).where("defaulted").count()
    return {"ticks": rows, "breaches": over, "defaults": defaults, "load_s": round(loaded, 2), "detect_s": round(time.perf_counter() - t, 2)}


def run_reco(spark: SparkSession, root: str, rows: int) -> dict:
    """Interactions with planted groups: the share of recommendations within the user's own group."""
    e = Engine(spark, root)
    e.sql("CREATE TABLE acts (id BIGINT PRIMARY KEY, user_id BIGINT, item_id BIGINT, kind TEXT, ts TIMESTAMP)")
    t = time.perf_counter()
    e.db.bulk_load("acts", feed.interactions(spark, rows))
    loaded = time.perf_counter() - t
    t = time.perf_counter()
    g = reco.bipartite(e.db.table("acts"))
    got = [r["item_id"] for r in reco.recommend_items(g, 3).collect()]
    top = [r["item_id"] for r in reco.trending(g).collect()]
    return {"interactions": rows, "recommended": got, "own_group": sum(i % 10 == 3 for i in got), "trending": top, "load_s": round(loaded, 2), "detect_s": round(time.perf_counter() - t, 2)}


PROGRAMS = {"aml": run_aml, "ccr": run_ccr, "reco": run_reco}


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    p.add_argument("program", choices=PROGRAMS)
    p.add_argument("--root", required=True)
    p.add_argument("--rows", type=int, default=5000)
    a = p.parse_args(args)
    print(json.dumps({"program": a.program} | PROGRAMS[a.program](local(), a.root, a.rows)))


if __name__ == "__main__":
    main()
