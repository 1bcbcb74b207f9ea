import pytest
from compare import same_rows

from marlstone.plans import relational


@pytest.mark.parametrize("name", sorted(relational.QUERIES))
def test_agrees_with_sql(spark, sf, duck, name):
    same_rows(relational.QUERIES[name](spark, sf), duck, relational.ORACLES[name])


def plan(df):
    return df._jdf.queryExecution().toString()


def test_point_lookup_reaches_the_scan(spark, sf):
    assert "EqualTo(o_orderkey,77)" in plan(relational.QUERIES["point_lookup"](spark, sf))


def test_range_reads_only_its_columns(spark, sf):
    text = plan(relational.QUERIES["key_range"](spark, sf))
    assert "GreaterThanOrEqual(o_orderkey,100)" in text and "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in text


def test_top_k_is_not_a_full_sort(spark, sf):
    assert "TakeOrderedAndProject" in plan(relational.QUERIES["topk"](spark, sf))


def test_count_and_bounds_come_from_footers(spark, sf):
    from pyspark.sql import functions as F

    from marlstone.session import metadata_reads

    df = metadata_reads(spark, f"{sf}/orders.parquet").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    assert "PushedAggregation: [COUNT(*), MIN(o_orderkey), MAX(o_orderkey)]" in plan(df)
    assert df.first()["n"] == spark.read.parquet(f"{sf}/orders.parquet").count()


def test_date_functions_agree_beyond_the_smallest_tables(spark, tmp_path):
    import duckdb

    at = f"{tmp_path}/orders.parquet"
    spark.sql("SELECT id AS o_orderkey, timestamp_ntz'1995-01-31 10:00:00' + make_interval(0, 0, 0, CAST(id % 700 AS INT)) AS o_orderdate FROM range(1990, 2030)").write.parquet(at)
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{at}/*.parquet'")
    same_rows(relational.QUERIES["date_functions"](spark, str(tmp_path)), c, relational.ORACLES["date_functions"])


def test_percentiles_need_no_task_that_holds_a_group(spark):
    from marlstone.plans.percentiles import percentiles

    df = spark.sql("SELECT CASE id % 4 WHEN 3 THEN NULL ELSE id % 4 END AS g, CASE WHEN id % 4 <> 2 THEN CAST(id * 7919 % 211 / 8 AS DOUBLE) END AS v FROM range(4003)")
    df.createOrReplaceTempView("for_percentiles")
    want = spark.sql("SELECT g, median(v) AS a, percentile_cont(0.9) WITHIN GROUP (ORDER BY v) AS b FROM for_percentiles GROUP BY g")
    got = percentiles(df, "g", "v", {"a": 0.5, "b": 0.9})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and "percentile(" not in plan(got)
    assert "percentile(" not in plan(relational.QUERIES["median_percentile"](spark, "/root/testdata/sf0.001"))
