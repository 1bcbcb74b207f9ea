import pytest

from marlstone.apps import aml, ccr, reco
from marlstone.sources.feed import transactions
from marlstone.streaming.changes import Workers


@pytest.fixture(scope="module")
def tx(spark):
    planted = [(1000 + i, 501 + i % 9, 500, 9500.0) for i in range(9)] + [(2000 + i, 700 + i, 700 + (i + 1) % 4, 20000.0) for i in range(4)] + [(3000 + i, 800, 801 + i, 100.0) for i in range(16)]
    rows = spark.createDataFrame([(a, b, c, d) for a, b, c, d in planted], "txn_id long, src long, dst long, amount double")
    noise = transactions(spark, 200, accounts=5000).selectExpr("txn_id", "src + 100000 AS src", "dst + 100000 AS dst", "CAST(amount AS DOUBLE) AS amount")
    return rows.unionAll(noise).selectExpr("txn_id", "src", "dst", "CAST(amount AS DECIMAL(14,2)) AS amount").cache()


def test_laundering_signals(tx, spark):
    bad = spark.createDataFrame([(501, "listed")], "id long, reason string")
    assert [r["account"] for r in aml.structuring(tx).collect()] == [500]
    assert [r["account"] for r in aml.fan_out(tx).collect()] == [800]
    assert [r["account"] for r in aml.known_bad_contacts(tx, bad).collect()] == [500]
    assert [r["members"] for r in aml.graph(tx).laundering_cycles().collect()] == [[700, 701, 702, 703]]
    top = {r["account"]: r["score"] for r in aml.scores(tx, bad, 10).collect()}
    assert {500, 501, 700, 701, 702, 703, 800} <= set(top) and not any(a > 100000 for a in top)
    assert aml.velocity(tx).first()["near"] >= 9
    found = spark.createDataFrame([(1, "ring"), (1, "ring"), (2, "ring")], "account long, typology string")
    assert aml.new_alerts(found, found.limit(1)).count() == 1


def test_streamed_alerts_agree_with_batch(engine, tx):
    engine.sql("CREATE TABLE transactions (txn_id INT PRIMARY KEY, src INT NOT NULL, dst INT NOT NULL, amount DECIMAL(14,2) CHECK (amount > 0))")
    w = Workers(engine.db).register("aml", aml.AmlWorker({501}), "transactions")
    engine.db.insert("transactions", tx.where("txn_id < 1005 AND src < 100000 AND amount > 0"))
    engine.db.insert("transactions", tx.where("txn_id >= 1005 AND src < 100000 AND amount > 0"))
    w.settle()
    w.stop()
    assert set(w.query(lambda x: x.alerts)) == {(500, "structuring"), (800, "fan_out"), (500, "known_bad")}


def test_risk(spark):
    ticks = spark.createDataFrame([(1, "A", 10.0), (2, "A", 12.0), (3, "B", 5.0)], "tick_id long, instrument string, price double")
    trades = spark.createDataFrame([(1, 1, "A", 100.0, 10.0), (2, 1, "B", 10.0, 7.0), (3, 2, "A", -50.0, 10.0)], "trade_id long, counterparty long, instrument string, notional double, trade_price double")
    got = {r["counterparty"]: r["mtm"] for r in ccr.exposures(trades, ticks).collect()}
    assert got == {1: 180.0, 2: -100.0}
    limits = spark.createDataFrame([(1, 150.0), (2, 10.0)], "counterparty long, limit double")
    assert [r["counterparty"] for r in ccr.breaches(ccr.exposures(trades, ticks), limits).collect()] == [1]
    pnl = spark.range(200).selectExpr("id AS step", "CAST(-id AS DOUBLE) AS pnl")
    var = {r["step"]: r["var99"] for r in ccr.historical_var(pnl).collect()}
    assert var[30] is None and var[31] == 31.0 and var[199] == 197.0
    bank = spark.createDataFrame([(2, 3, 100.0), (3, 4, 100.0), (6, 7, 10.0), (7, 8, 10.0), (8, 6, 10.0)], "debtor long, creditor long, amount double")
    assert [r["members"] for r in ccr.circular(bank).collect()] == [[6, 7, 8]]
    lost = ccr.cascade(bank, spark.createDataFrame([(2, 40.0)], "id long, assets double")).where("defaulted")
    assert {2, 3} <= {r["id"] for r in lost.collect()}
    assert ccr.systemic(bank).count() == 1


def test_recommendations(spark):
    rows = [(u, i) for u in range(1, 6) for i in (100, 101, 102)] + [(13, 100), (13, 101), (20, 1), (21, 1), (22, 1), (23, 1), (24, 1), (25, 1), (26, 1), (27, 1)]
    g = reco.bipartite(spark.createDataFrame(rows, "user_id long, item_id long"))
    assert reco.recommend_items(g, 13, 3).first()["item_id"] == 102
    assert reco.trending(g, 1).first()["item_id"] == 1
    assert {r["item_id"] for r in reco.similar_items(g, 100).collect()} == {101, 102}


def test_programs_find_what_is_planted(spark, tmp_path):
    from marlstone.apps import run

    got = run.run_aml(spark, str(tmp_path / "aml"), 500)
    assert got["alerts"] == {"ring": 15, "structuring": 4, "fan_out": 2} and got["streamed_alerts"] >= 6
    got = run.run_ccr(spark, str(tmp_path / "ccr"), 2000)
    assert got["defaults"] > 0
    got = run.run_reco(spark, str(tmp_path / "reco"), 3000)
    assert got["own_group"] >= 0.6 * len(got["recommended"]) > 0
