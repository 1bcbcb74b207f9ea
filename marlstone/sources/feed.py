"""Synthetic feeds, the same rows for the same seed, with planted signals for the applications to find."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_S = 1_700_000_000


def _hash(key: str, seed: int, salt: int, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(n))


def transactions(spark: SparkSession, count: int, seed: int = 42, accounts: int = 5000, first_id: int = 0) -> DataFrame:
    """(txn_id, src, dst, amount, ts): background payments that always go to a higher account, so they hold no cycle."""
    df = spark.range(first_id, first_id + count).withColumnRenamed("id", "txn_id")
    src = _hash("txn_id", seed, 1, accounts - 1)
    df = df.withColumn("src", src).withColumn("dst", F.col("src") + 1 + F.pmod(_hash("txn_id", seed, 2, 1 << 30), F.lit(accounts) - 1 - F.col("src")))
    return df.select("txn_id", "src", "dst", (_hash("txn_id", seed, 3, 800000) / 100).cast("decimal(14,2)").alias("amount"), F.timestamp_seconds(F.lit(BASE_S) + F.col("txn_id")).cast("timestamp_ntz").alias("ts"))


def suspicious(spark: SparkSession, rings: int = 3, ring: int = 5, structurers: int = 4, deposits: int = 12, fans: int = 2, receivers: int = 30, first_account: int = 1_000_000, first_id: int = 10**9) -> DataFrame:
    """Planted signals as transactions: rings of payments, many senders just below the limit, and one account that pays many.

    Rings are accounts first_account + 1000 i + 0 .. ring - 1; collectors of structured deposits are
    first_account + 100000 + 1000 i, their senders the accounts after them; fans likewise from + 200000.
    """
    one = lambda n, m, src, dst, amount, salt: spark.range(n * m).select(
        (F.lit(first_id + salt * 10**7) + F.col("id")).alias("txn_id"), src(F.floor(F.col("id") / m), F.col("id") % m).cast("long").alias("src"), dst(F.floor(F.col("id") / m), F.col("id") % m).cast("long").alias("dst"), amount.cast("decimal(14,2)").alias("amount")
    )
    at = lambda base: lambda i, j: F.lit(first_account + base) + 1000 * i + j
    turn = one(rings, ring, at(0), lambda i, j: at(0)(i, (j + 1) % ring), F.lit(20000), 0)
    near = one(structurers, deposits, lambda i, j: at(100_000)(i, j + 1), lambda i, j: at(100_000)(i, F.lit(0)), 9000 + F.col("id") % 900, 1)
    fan = one(fans, receivers, lambda i, j: at(200_000)(i, F.lit(0)), lambda i, j: at(200_000)(i, j + 1), 100 + F.col("id") % 400, 2)
    return turn.unionAll(near).unionAll(fan).withColumn("ts", F.timestamp_seconds(F.lit(BASE_S) + F.col("txn_id") % 100_000).cast("timestamp_ntz"))


def ticks(spark: SparkSession, count: int, instruments: int = 50, seed: int = 42, shock_at: int | None = None, shock: float = 0.6) -> DataFrame:
    """(tick_id, instrument, price, ts): prices about 100 + 10 instrument; from ``shock_at`` on every fifth instrument trades at ``shock`` of that."""
    df = spark.range(count).withColumnRenamed("id", "tick_id").withColumn("instrument", F.col("tick_id") % instruments)
    price = (100 + 10 * F.col("instrument")) * (0.98 + _hash("tick_id", seed, 1, 4000) / 100_000)
    if shock_at is not None:
        price = F.when((F.col("tick_id") >= shock_at) & (F.col("instrument") % 5 == 0), price * shock).otherwise(price)
    return df.select("tick_id", "instrument", price.cast("decimal(14,4)").alias("price"), F.timestamp_seconds(F.lit(BASE_S) + F.col("tick_id")).cast("timestamp_ntz").alias("ts"))


def trades(spark: SparkSession, count: int, instruments: int = 50, counterparties: int = 20, seed: int = 42) -> DataFrame:
    """(trade_id, counterparty, instrument, notional, trade_price): at the price that ``ticks`` moves about."""
    df = spark.range(count).withColumnRenamed("id", "trade_id").withColumn("instrument", _hash("trade_id", seed, 1, instruments))
    size = (_hash("trade_id", seed, 3, 2001) - 1000).cast("double")
    return df.select("trade_id", _hash("trade_id", seed, 2, counterparties).alias("counterparty"), "instrument", size.alias("notional"), (100 + 10 * F.col("instrument")).cast("decimal(14,4)").alias("trade_price"))


def interactions(spark: SparkSession, count: int, users: int = 500, items: int = 200, groups: int = 10, seed: int = 42) -> DataFrame:
    """(id, user_id, item_id, kind, ts): four of five within the user's group of items (user_id % groups == item_id % groups), so good recommendations are in it."""
    df = spark.range(count).withColumn("user_id", _hash("id", seed, 1, users))
    own = _hash("id", seed, 3, max(1, items // groups)) * groups + F.col("user_id") % groups
    item = F.when(_hash("id", seed, 2, 5) < 4, own).otherwise(_hash("id", seed, 4, items))
    kind = F.element_at(F.array(F.lit("view"), F.lit("view"), F.lit("cart"), F.lit("buy")), (_hash("id", seed, 5, 4) + 1).cast("int"))
    return df.select("id", "user_id", item.alias("item_id"), kind.alias("kind"), F.timestamp_seconds(F.lit(BASE_S) + F.col("id")).cast("timestamp_ntz").alias("ts"))


def main(args: list[str] | None = None) -> None:
    """Payments with planted signals, into a table ``tx`` of a database or as JSON lines below a folder."""
    from ..engine import Engine
    from ..session import local

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--count", type=int, default=10_000)
    p.add_argument("--seed", type=int, default=42)
    to = p.add_mutually_exclusive_group(required=True)
    to.add_argument("--db", help="folder of the database")
    to.add_argument("--sink", help="folder of the JSON lines")
    a = p.parse_args(args)
    spark = local()
    rows = transactions(spark, a.count, a.seed).unionAll(suspicious(spark))
    if a.sink:
        rows.write.mode("append").json(a.sink)
    else:
        db = Engine(spark, a.db).db
        db.table_or_create("CREATE TABLE tx (txn_id BIGINT PRIMARY KEY, src BIGINT NOT NULL, dst BIGINT NOT NULL, amount DECIMAL(14,2), ts TIMESTAMP)")
        db.bulk_load("tx", rows)


if __name__ == "__main__":
    main()
