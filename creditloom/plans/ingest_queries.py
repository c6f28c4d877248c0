"""Registered queries: scanning, loading, auditing and publishing."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from creditloom.plans.registry import query
from creditloom.sources.csv_files import scan_csv
from creditloom.sources.ingest import build_portfolio, load_table, open_portfolio, row_count_audit
from creditloom.sources.intermediate import checkpoint_root
from creditloom.sources.manifest import SourceTable

_PORTFOLIO = (
    "application_train",
    "application_test",
    "bureau",
    "bureau_balance",
    "previous_application",
    "installments_payments",
    "credit_card_balance",
    "pos_cash_balance",
)


def _fresh_folder(t, label: str) -> str:
    return f"{checkpoint_root(t.spark)}/{label}-{uuid.uuid4().hex}"


def _as_csv(t, names) -> tuple[str, dict[str, int]]:
    """The folder of the written files, and the rows that went into each, counted on the way."""
    folder, rows = _fresh_folder(t, "csv"), {}
    for name in names:
        counted = Observation()
        t[name].observe(counted, F.count(F.lit(1)).alias("rows")).write.option("header", True).csv(f"{folder}/{name}.csv")
        rows[name] = counted.get.get("rows", 0)
    return folder, rows


@query("csv_scan")
def _csv_scan(t) -> DataFrame:
    """Applications written as CSV and read back with inferred types."""
    return scan_csv(t.spark, f"{_as_csv(t, ['application_train'])[0]}/application_train.csv")


@query("load_table")
def _load_table(t) -> DataFrame:
    """Refused earlier applications, selected while loading and laid out by client."""
    refused = F.col("NAME_CONTRACT_STATUS") == "Refused"
    return load_table(t["previous_application"], _fresh_folder(t, "load"), refused, by_client=True)


@query("ingest_rowcount_audit")
def _rowcount_audit(t) -> DataFrame:
    """Loaded tables against the row counts of what they were loaded from.

    Credits and earlier applications take only some of the orders, so the audit reports them as short.
    """
    raw = {
        "application_train": "customer",
        "application_test": "customer",
        "bureau": "orders",
        "bureau_balance": "lineitem",
        "previous_application": "orders",
        "installments_payments": "lineitem",
        "credit_card_balance": "events",
        "pos_cash_balance": "lineitem",
    }
    stated = [
        t.raw(source)
        .agg(F.count(F.lit(1)).alias("expected_rows"))
        .select(F.lit(name).alias("table_name"), "expected_rows")
        for name, source in raw.items()
    ]
    return row_count_audit(t, reduce(DataFrame.unionByName, stated))


@query("published_portfolio")
def _published_portfolio(t) -> DataFrame:
    """A full cycle: CSV files, load, audit, publish, open; rows per table of what was published."""
    (raw, rows), warehouse = _as_csv(t, _PORTFOLIO), _fresh_folder(t, "warehouse")
    manifest = [SourceTable(n, f"{n}.csv", rows[n], n) for n in _PORTFOLIO]
    build_portfolio(t.spark, raw, warehouse, manifest)
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in open_portfolio(t.spark, warehouse).items()
    ]
    return reduce(DataFrame.unionByName, counts)
