"""Counterparty and market risk over trades, ticks, limits and interbank debts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph.view import GraphView


def latest_prices(ticks: DataFrame) -> DataFrame:
    """(instrument, price) of each instrument's last tick."""
    return ticks.groupBy("instrument").agg(F.max_by("price", "tick_id").alias("price"))


def exposures(trades: DataFrame, ticks: DataFrame) -> DataFrame:
    """(counterparty, mtm): every trade at the last price, netted by counterparty."""
    priced = trades.join(latest_prices(ticks), "instrument")
    return priced.groupBy("counterparty").agg(F.sum(F.col("notional") * (F.col("price").cast("double") - F.col("trade_price").cast("double"))).alias("mtm"))


def breaches(exposure: DataFrame, limits: DataFrame) -> DataFrame:
    """Counterparties whose positive exposure is above their limit."""
    return exposure.join(limits, "counterparty").where(F.greatest("mtm", F.lit(0.0)) > F.col("limit"))


def historical_var(pnl: DataFrame, window: int = 512, least: int = 32, tail: float = 0.01, book: str | None = None) -> DataFrame:
    """(book,) step, var99: the loss at the tail of a book's last ``window`` results; null with fewer than ``least``.

    pnl: (step, pnl) and the ``book`` column, if there is one: books are windows of their own, spread
    over the cluster.  Null results are left out.  The answer at a step is the (floor(n * tail) + 1)-th
    largest of its n losses.
    """
    names = [book] if book else []
    pnl = pnl.where(F.col("pnl").isNotNull())
    w = (Window.partitionBy(book) if book else Window.partitionBy()).orderBy("step").rowsBetween(1 - window, 0)
    at = (F.floor(F.col("n") * F.lit(tail)) + 1).cast("int")
    losses = pnl.select(*names, "step", F.collect_list(-F.col("pnl")).over(w).alias("w")).withColumn("n", F.size("w"))
    return losses.select(*names, "step", F.when(F.col("n") >= least, F.element_at(F.sort_array("w", asc=False), at)).alias("var99"))


def debts(interbank: DataFrame) -> GraphView:
    """Debtor to creditor, amounts summed."""
    return GraphView.frozen(interbank.groupBy(F.col("debtor").alias("src"), F.col("creditor").alias("dst")).agg(F.sum("amount").alias("weight")))


def systemic(interbank: DataFrame) -> DataFrame:
    """(id, rank) of the most important bank."""
    return debts(interbank).pagerank(30, 0.85).orderBy(F.desc("rank"), "id").limit(1)


def cascade(interbank: DataFrame, assets: DataFrame) -> DataFrame:
    """Clearing payments and defaults; assets: (id, assets)."""
    return debts(interbank).eisenberg_noe(assets)


def circular(interbank: DataFrame) -> DataFrame:
    """Rings of mutual debt."""
    return debts(interbank).laundering_cycles()
