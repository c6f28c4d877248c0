"""Logical credit tables derived from the generated retail tables.

The operators are written against the credit schema. The only data at hand is an order-processing schema,
so each credit table is a declarative projection of it: customers become applicants, orders become external
credits and earlier applications, order lines become monthly histories and repayments, and events become
card statements. Everything is lazy, and only the columns a query needs reach the Parquet scans.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_RAW_SCHEMAS = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
}

# Fixed values of the binding.
_REFERENCE_DATE = "2001-11-05"
UNLABELLED_ID_SHIFT = 1_000_000


def _every(key: Column, step: int) -> Column:
    return key % F.lit(step) == F.lit(0)


def _unless(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def _applicants(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    balance = F.col("c_acctbal")
    credit = F.lit(50000.0) + (k * 7919 % 1000) * 900
    return customer.select(
        k.alias("SK_ID_CURR"),
        (balance < 0).cast("long").alias("TARGET"),
        F.when(_every(k, 10), "Revolving loans").otherwise("Cash loans").alias("NAME_CONTRACT_TYPE"),
        F.when(_every(k, 500), "XNA").when(_every(k, 3), "M").otherwise("F").alias("CODE_GENDER"),
        F.col("c_mktsegment").alias("NAME_EDUCATION_TYPE"),
        _unless(_every(k, 6), F.col("c_mktsegment")).alias("OCCUPATION_TYPE"),
        (k % 4).alias("CNT_CHILDREN"),
        (k % 5).cast("double").alias("CNT_FAM_MEMBERS"),
        F.when(_every(k, 211), 0.0)
        .when(~_every(k, 50), F.lit(30000.0) + F.lit(20.0) * F.abs(balance))
        .alias("AMT_INCOME_TOTAL"),
        credit.alias("AMT_CREDIT"),
        _unless(_every(k, 89), credit / (k % 20 + 10)).alias("AMT_ANNUITY"),
        F.when(_every(k, 101) & ~_every(k, 97), 0.0)
        .when(~_every(k, 97), F.lit(45000.0) + (k * 7919 % 1000) * 850)
        .alias("AMT_GOODS_PRICE"),
        (-(k * 31 % 18000) - 7300).alias("DAYS_BIRTH"),
        F.when(_every(k, 6), F.lit(365243).cast("long")).otherwise(-(k * 17 % 9000)).alias("DAYS_EMPLOYED"),
        (-(k * 13 % 12000)).cast("double").alias("DAYS_REGISTRATION"),
        (-(k * 11 % 6000)).alias("DAYS_ID_PUBLISH"),
        _unless(_every(k, 2), (k * 37 % 1000) / 1000.0).alias("EXT_SOURCE_1"),
        _unless(
            _every(k, 450),
            F.lit(0.5) * (balance + 1000) / 11000 + F.lit(0.5) * (k * 41 % 1000) / 1000,
        ).alias("EXT_SOURCE_2"),
        _unless(_every(k, 5), (k * 43 % 1000) / 1000.0).alias("EXT_SOURCE_3"),
        _unless(k % 9 < 5, F.col("c_nationkey") / F.lit(25.0)).alias("APARTMENTS_AVG"),
    )


def _order_day() -> Column:
    return F.datediff(F.col("o_orderdate").cast("date"), F.lit(_REFERENCE_DATE).cast("date")).cast("long")


def _bureau(orders: DataFrame) -> DataFrame:
    o, price, day = F.col("o_orderkey"), F.col("o_totalprice"), _order_day()
    priority = F.col("o_orderpriority")
    return orders.filter(F.col("o_orderstatus") == "F").select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        o.alias("SK_ID_BUREAU"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "Active")
        .when(priority == "5-LOW", "Sold")
        .otherwise("Closed")
        .alias("CREDIT_ACTIVE"),
        priority.alias("CREDIT_TYPE"),
        day.alias("DAYS_CREDIT"),
        F.when(_every(o, 37), o % 90).otherwise(F.lit(0).cast("long")).alias("CREDIT_DAY_OVERDUE"),
        _unless(_every(o, 3), price * F.lit(0.02)).alias("AMT_CREDIT_MAX_OVERDUE"),
        (o % 3).alias("CNT_CREDIT_PROLONG"),
        price.alias("AMT_CREDIT_SUM"),
        _unless(_every(o, 7), price * (o % 10) / 10).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(_every(o, 40), price * F.lit(0.01)).otherwise(0.0).alias("AMT_CREDIT_SUM_OVERDUE"),
        (day + o % 30).alias("DAYS_CREDIT_UPDATE"),
        _unless(_every(o, 4), price / 12).alias("AMT_ANNUITY"),
    )


def _bureau_balance(lineitem: DataFrame) -> DataFrame:
    line, quantity = F.col("l_linenumber").cast("long"), F.col("l_quantity")
    return lineitem.select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        (line * -3).alias("MONTHS_BALANCE"),
        F.when(F.col("l_returnflag") == "A", "C")
        .when(quantity < 5, "X")
        .when(quantity < 30, "0")
        .otherwise((line % 5 + 1).cast("string"))
        .alias("STATUS"),
    )


def _previous_application(orders: DataFrame) -> DataFrame:
    o, price = F.col("o_orderkey"), F.col("o_totalprice")
    tenth, fifth = o % 10, o % 5
    return orders.filter(F.col("o_orderstatus") == "P").select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        o.alias("SK_ID_PREV"),
        F.when(tenth < 6, "Approved")
        .when(tenth < 8, "Refused")
        .when(tenth == 8, "Canceled")
        .otherwise("Unused offer")
        .alias("NAME_CONTRACT_STATUS"),
        F.when(_every(o, 33), 0.0).otherwise(price).alias("AMT_APPLICATION"),
        (price * (o % 40 + 80) / 100).alias("AMT_CREDIT"),
        _unless(_every(o, 2), price * F.lit(0.1)).alias("AMT_DOWN_PAYMENT"),
        (o % 55 + 6).cast("double").alias("CNT_PAYMENT"),
        _order_day().alias("DAYS_DECISION"),
        F.when(fifth == 0, "XAP")
        .when(fifth == 1, "XNA")
        .when(fifth == 2, "HC")
        .when(fifth == 3, "LIMIT")
        .alias("CODE_REJECT_REASON"),
    )


def _lines_of(lineitem: DataFrame, orders: DataFrame, status: str) -> DataFrame:
    chosen = orders.filter(F.col("o_orderstatus") == status)
    return lineitem.join(chosen, F.col("l_orderkey") == F.col("o_orderkey"))


def _installments(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    part, price = F.col("l_partkey"), F.col("l_extendedprice")
    due = _order_day().cast("double") + F.col("l_linenumber") * 30
    unpaid = _every(part, 200)
    paid = F.when(F.col("l_linestatus") == "O", price * (F.lit(1.0) - F.col("l_discount"))).otherwise(price)
    return _lines_of(lineitem, orders, "P").select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderkey").alias("SK_ID_PREV"),
        due.alias("DAYS_INSTALMENT"),
        _unless(unpaid, due + part % 61 - 25).alias("DAYS_ENTRY_PAYMENT"),
        price.alias("AMT_INSTALMENT"),
        _unless(unpaid, paid).alias("AMT_PAYMENT"),
    )


def _credit_card(events: DataFrame) -> DataFrame:
    event, kind, value = F.col("event_id"), F.col("event_type"), F.col("value")
    zero = F.lit(0).cast("long")
    return events.select(
        F.col("user_id").alias("SK_ID_CURR"),
        (F.col("user_id") * 10 + event % 3).alias("SK_ID_PREV"),
        (value * 100).alias("AMT_BALANCE"),
        F.when(kind == "signup", zero).otherwise(event % 7 * 1000 + 5000).alias("AMT_CREDIT_LIMIT_ACTUAL"),
        _unless(kind == "view", value).alias("AMT_DRAWINGS_CURRENT"),
        (event % 12).alias("CNT_DRAWINGS_CURRENT"),
        F.when(kind == "error", event % 45).otherwise(zero).alias("SK_DPD"),
    )


def _pos_cash(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    part = F.col("l_partkey")
    zero = F.lit(0).cast("long")
    return _lines_of(lineitem, orders, "O").select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderkey").alias("SK_ID_PREV"),
        (-F.col("l_linenumber")).cast("long").alias("MONTHS_BALANCE"),
        _unless(_every(part, 50), F.col("l_quantity")).alias("CNT_INSTALMENT_FUTURE"),
        F.when(_every(part, 29), part % 60).otherwise(zero).alias("SK_DPD"),
        F.when(_every(part, 58), part % 15).otherwise(zero).alias("SK_DPD_DEF"),
    )


class Testbed(Mapping[str, DataFrame]):
    """Credit tables by name, each built when first asked for."""

    __test__ = False

    _BUILDERS = {
        "application_train": lambda t: _applicants(t.raw("customer")),
        "application_test": lambda t: _applicants(t.raw("customer"))
        .drop("TARGET")
        .withColumn("SK_ID_CURR", F.col("SK_ID_CURR") + UNLABELLED_ID_SHIFT),
        "bureau": lambda t: _bureau(t.raw("orders")),
        "bureau_balance": lambda t: _bureau_balance(t.raw("lineitem")),
        "previous_application": lambda t: _previous_application(t.raw("orders")),
        "installments_payments": lambda t: _installments(t.raw("lineitem"), t.raw("orders")),
        "credit_card_balance": lambda t: _credit_card(t.raw("events")),
        "pos_cash_balance": lambda t: _pos_cash(t.raw("lineitem"), t.raw("orders")),
    }

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.location = sf_dir.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A generated table, with its schema stated so that opening it costs no Spark job."""
        return self.spark.read.schema(_RAW_SCHEMAS[name]).parquet(f"{self.location}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._BUILDERS[name](self)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._BUILDERS)

    def __len__(self) -> int:
        return len(self._BUILDERS)
