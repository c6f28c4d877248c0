from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def many_partitions(spark):
    """Keep every shuffle partition, so that distributed steps really meet several of them."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "false")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


@pytest.fixture(scope="session")
def portfolio(spark):
    """Twenty applicants with exactly known facts."""
    i = F.col("id")
    application = spark.range(20).select(
        (i + 100000).alias("SK_ID_CURR"),
        (i % 5 == 0).cast("long").alias("TARGET"),
        F.when(i < 10, "M").when(i < 19, "F").otherwise("XNA").alias("CODE_GENDER"),
        F.when(i < 10, -8000).otherwise(365243).cast("long").alias("DAYS_EMPLOYED"),
        (-(i + 20) * 365).alias("DAYS_BIRTH"),
        F.when(i > 0, 50000.0 + i * 1000).alias("AMT_INCOME_TOTAL"),
        (100000.0 + i * 5000).alias("AMT_CREDIT"),
        F.when(i < 12, "Cash loans").otherwise("Revolving loans").alias("NAME_CONTRACT_TYPE"),
        F.when(i % 2 == 0, 0.1).otherwise(0.9).alias("EXT_SOURCE_2"),
        F.when(i < 15, 1.5).alias("APARTMENTS_AVG"),
    )
    bureau = spark.range(15).select(
        (i + 100000).alias("SK_ID_CURR"),
        (i + 5000000).alias("SK_ID_BUREAU"),
        F.lit("Active").alias("CREDIT_ACTIVE"),
        F.when(i < 5, 1000.0).otherwise(0.0).alias("AMT_CREDIT_SUM_OVERDUE"),
    )
    previous = spark.range(15).select(
        (i + 100000).alias("SK_ID_CURR"),
        (i + 1000000).alias("SK_ID_PREV"),
        F.when(i < 5, "Refused").otherwise("Approved").alias("NAME_CONTRACT_STATUS"),
    )
    installments = spark.range(15).select(
        (i + 100000).alias("SK_ID_CURR"),
        (i + 1000000).alias("SK_ID_PREV"),
        F.lit(-100.0).alias("DAYS_INSTALMENT"),
        F.when(i < 5, -80.0).otherwise(-110.0).alias("DAYS_ENTRY_PAYMENT"),
    )
    return {
        "application_train": application,
        "bureau": bureau,
        "previous_application": previous,
        "installments_payments": installments,
    }


def rows(df):
    return [tuple(r) for r in df.collect()]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
