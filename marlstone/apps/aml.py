"""Money-laundering detection over a transaction table (txn_id, src, dst, amount, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph.view import GraphView
from ..streaming.changes import Worker

NEAR_LOW, NEAR_HIGH, LARGE = 9000, 10000, 50000


def near_threshold(amount="amount"):
    return (F.col(amount) >= NEAR_LOW) & (F.col(amount) < NEAR_HIGH)


def structuring(tx: DataFrame, senders: int = 8, deposits: int = 5) -> DataFrame:
    """(account, senders, near): many distinct senders and many deposits just below the reporting limit."""
    per = tx.groupBy(F.col("dst").alias("account")).agg(F.countDistinct("src").alias("senders"), F.count_if(near_threshold()).alias("near"))
    return per.where((F.col("senders") >= senders) & (F.col("near") >= deposits))


def fan_out(tx: DataFrame, receivers: int = 15) -> DataFrame:
    """(account, receivers): accounts that pay many distinct others."""
    return tx.groupBy(F.col("src").alias("account")).agg(F.countDistinct("dst").alias("receivers")).where(F.col("receivers") >= receivers)


def known_bad_contacts(tx: DataFrame, known_bad: DataFrame) -> DataFrame:
    """(account): those that dealt with a known-bad account, in either direction."""
    bad = known_bad.select(F.col("id").alias("bad"))
    ends = tx.select(F.col("src").alias("account"), F.col("dst").alias("bad")).unionAll(tx.select(F.col("dst").alias("account"), F.col("src").alias("bad")))
    return ends.join(bad, "bad", "left_semi").select("account").distinct()


def graph(tx: DataFrame) -> GraphView:
    """Accounts as vertices, the sum sent as weight."""
    return GraphView.frozen(tx.groupBy("src", "dst").agg(F.sum("amount").alias("weight")))


def velocity(tx: DataFrame) -> DataFrame:
    """(near, large): deposits just below the limit, and large ones."""
    return tx.agg(F.count_if(near_threshold()).alias("near"), F.count_if(F.col("amount") >= LARGE).alias("large"))


def scores(tx: DataFrame, known_bad: DataFrame, iterations: int = 50) -> DataFrame:
    """(account, score) above 0.5, highest first: risk from known-bad accounts, rings, fan-in, fan-out and contacts, fused."""
    g = graph(tx)
    risk = g.personalized_pagerank(known_bad.select("id"), iterations)
    top = risk.agg(F.max("rank")).first()[0] or 1.0
    flag = lambda df, n: df.select("account").distinct().withColumn(n, F.lit(1))
    ring = g.laundering_cycles().select(F.explode("members").alias("account"))
    all_ = g.vertices().withColumnRenamed("id", "account").join(risk.select(F.col("id").alias("account"), (F.col("rank") / top).alias("risk")), "account", "left")
    for df, n in ((ring, "ring"), (structuring(tx), "fan_in"), (fan_out(tx), "fan_out"), (known_bad_contacts(tx, known_bad), "contact")):
        all_ = all_.join(flag(df, n), "account", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = 3 * z("risk") + 3 * z("ring") + 2.5 * z("fan_in") + 2 * z("fan_out") + z("contact")
    return all_.select("account", score.alias("score")).where("score > 0.5").orderBy(F.desc("score"), "account")


def new_alerts(found: DataFrame, alerts: DataFrame) -> DataFrame:
    """Alerts (account, typology) that aren't there yet, each once."""
    return found.select("account", "typology").distinct().join(alerts, ["account", "typology"], "left_anti")


class AmlWorker(Worker):
    """Per-account state kept up to date from the transactions' change stream; alerts are raised once per account and kind."""

    def __init__(self, known_bad: set[int] = frozenset(), senders: int = 8, deposits: int = 5, receivers: int = 15):
        self.bad, self.limits = set(known_bad), (senders, deposits, receivers)
        self.senders: dict[int, set[int]] = {}
        self.receivers: dict[int, set[int]] = {}
        self.near: dict[int, int] = {}
        self.alerts: dict[tuple[int, str], int] = {}
        self._csn = 0

    def _raise(self, account: int, kind: str, csn: int) -> None:
        self.alerts.setdefault((account, kind), csn)

    def apply(self, change: dict) -> None:
        row = change["new"]
        if change["op"] != "insert" or row is None:
            return
        src, dst, amount, csn = row["src"], row["dst"], float(row["amount"]), change["csn"]
        self.senders.setdefault(dst, set()).add(src)
        self.receivers.setdefault(src, set()).add(dst)
        self.near[dst] = self.near.get(dst, 0) + (NEAR_LOW <= amount < NEAR_HIGH)
        s, d, r = self.limits
        if len(self.senders[dst]) >= s and self.near[dst] >= d:
            self._raise(dst, "structuring", csn)
        if len(self.receivers[src]) >= r:
            self._raise(src, "fan_out", csn)
        if src in self.bad or dst in self.bad:
            self._raise(src if dst in self.bad else dst, "known_bad", csn)
