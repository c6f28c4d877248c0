from __future__ import annotations

from pyspark.sql import functions as F

from creditloom.operators.adhoc import credits_by_gender
from creditloom.operators.heavy_keys import heavy_keys, join_parents
from tests.conftest import plan_of


def tables(spark, hot):
    clients = spark.range(400).select(F.col("id").alias("SK_ID_CURR"), F.when(F.col("id") % 3 == 0, "M").otherwise("F").alias("CODE_GENDER"))
    owner = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 450) if hot else F.col("id") % 450
    credits = spark.range(60_000).select(owner.cast("long").alias("SK_ID_CURR"), F.col("id").alias("SK_ID_BUREAU"))
    return clients, credits


def test_a_client_with_a_third_of_all_rows_fills_no_task(spark, many_partitions):
    clients, credits = tables(spark, True)
    assert [r[0] for r in heavy_keys(credits, "SK_ID_CURR").collect()] == [7]
    joined = join_parents(credits, clients, "SK_ID_CURR")
    sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    plain = credits.join(clients, "SK_ID_CURR")
    assert sorted(map(tuple, joined.select("SK_ID_CURR", "SK_ID_BUREAU", "CODE_GENDER").collect())) == sorted(
        map(tuple, plain.select("SK_ID_CURR", "SK_ID_BUREAU", "CODE_GENDER").collect())
    )
    got = {r["CODE_GENDER"]: r["credits"] for r in credits_by_gender(clients, credits).collect()}
    assert got == {r["CODE_GENDER"]: r["n"] for r in plain.groupBy("CODE_GENDER").agg(F.countDistinct("SK_ID_BUREAU").alias("n")).collect()}


def test_even_tables_and_empty_ones_are_joined_plainly(spark):
    clients, credits = tables(spark, False)
    assert heavy_keys(credits, "SK_ID_CURR") is None
    assert "Union" not in plan_of(join_parents(credits, clients, "SK_ID_CURR"))
    assert join_parents(credits.limit(0), clients, "SK_ID_CURR").count() == 0
    unowned = credits.withColumn("SK_ID_CURR", F.lit(None).cast("long"))
    assert join_parents(unowned, clients, "SK_ID_CURR").count() == 0
