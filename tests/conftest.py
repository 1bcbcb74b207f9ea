import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from marlstone.session import builder

    conf = {"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    # many small jobs: compiling less costs less than what it would save
    conf |= {"spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1 -XX:+UseSerialGC", "spark.sql.codegen.wholeStage": "false"}
    s = builder("tests").master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def engine(spark, tmp_path):
    from marlstone.engine import Engine

    return Engine(spark, str(tmp_path / "db"))


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    from marlstone.plans.relational import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c
