"""Building a portfolio: load every table, audit the row counts, then publish all of it at once.

Each build writes to a folder of its own. Readers follow the newest entry of a small publication log, which is
written only after every check has passed, so a build that fails half-way, or is still running, is invisible,
and the previous one stays readable.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.operators.application import ID
from creditloom.operators.restriction import restrict_to_clients
from creditloom.operators.sampling import hash_percent_sample, stratified_sample
from creditloom.sources.csv_files import scan_csv
from creditloom.sources.manifest import MANIFEST, SourceTable

_LOG_SCHEMA = "build string, published_at timestamp, tables array<string>"


class IncompleteLoad(RuntimeError):
    """The loaded row counts are not the published ones."""


def load_table(source: DataFrame, path: str, predicate: Column | None = None, by_client: bool = False) -> DataFrame:
    """Write ``source`` (the part selected during the scan) as Parquet, replacing what was there, and open it.

    ``by_client`` lays rows out by client id, so that file statistics prune lookups. The row hash completes
    the sort key: a client holding much of the table is then spread over several files.
    """
    chosen = source if predicate is None else source.filter(predicate)
    if by_client and ID in chosen.columns:
        order = [F.col(ID), F.xxhash64(*[F.col(c) for c in chosen.columns])]
        chosen = chosen.repartitionByRange(*order).sortWithinPartitions(ID)
    chosen.write.mode("overwrite").parquet(path)
    return source.sparkSession.read.schema(source.schema).parquet(path)


def row_count_audit(tables: Mapping[str, DataFrame], expected: DataFrame) -> DataFrame:
    """``table_name, expected_rows, actual_rows, matches`` for every loaded table with a stated count.

    ``expected`` has ``table_name, expected_rows``; tables without a stated count are not checked, and stated
    tables that were not loaded are left out.
    """
    counted = [
        df.agg(F.count(F.lit(1)).alias("actual_rows")).select(F.lit(name).alias("table_name"), "actual_rows")
        for name, df in tables.items()
    ]
    actual = reduce(DataFrame.unionByName, counted)
    stated = expected.filter(F.col("expected_rows").isNotNull())
    return stated.join(actual, "table_name").select(
        "table_name",
        "expected_rows",
        "actual_rows",
        (F.col("expected_rows") == F.col("actual_rows")).alias("matches"),
    )


def reduced_portfolio(tables: Mapping[str, DataFrame], size: int) -> dict[str, DataFrame]:
    """Every table cut down to a stratified sample of clients; unlabelled applicants are thinned by hash."""
    clients = stratified_sample(tables["application_train"], size)
    kept = {"application_train": clients} | restrict_to_clients(tables, clients)
    if "application_test" in tables:
        kept["application_test"] = hash_percent_sample(tables["application_test"])
    return kept


def build_portfolio(
    spark: SparkSession,
    raw_dir: str,
    warehouse: str,
    manifest: Sequence[SourceTable] = MANIFEST,
    sample_size: int | None = None,
    by_client: bool = False,
) -> dict[str, DataFrame]:
    """Load, audit and publish. With ``sample_size`` a reduced portfolio is built and counts are not audited."""
    build = uuid.uuid4().hex
    sources = {t.name: scan_csv(spark, f"{raw_dir}/{t.filename}", t.encoding, multi_line=t.multi_line) for t in manifest}
    if sample_size is not None:
        sources = reduced_portfolio(sources, sample_size)
    loaded = {
        name: load_table(df, f"{warehouse}/builds/{build}/{name}", by_client=by_client)
        for name, df in sources.items()
    }
    if sample_size is None:
        stated = [(t.name, t.expected_rows) for t in manifest]
        expected = spark.createDataFrame(stated, "table_name string, expected_rows long")
        # At most one row per table.
        problems = row_count_audit(loaded, expected).filter(~F.col("matches")).collect()
        if problems:
            listed = "; ".join(f"{r['table_name']}: {r['actual_rows']} of {r['expected_rows']}" for r in problems)
            raise IncompleteLoad(listed)
    publish(spark, warehouse, build, list(loaded))
    return loaded


def publish(spark: SparkSession, warehouse: str, build: str, tables: Sequence[str]) -> None:
    entry = [(build, datetime.now(timezone.utc), list(tables))]
    spark.createDataFrame(entry, _LOG_SCHEMA).coalesce(1).write.mode("append").json(f"{warehouse}/published")


def published_build(spark: SparkSession, warehouse: str) -> tuple[str, list[str]] | None:
    """The newest published build and its tables; None when nothing was ever published."""
    try:
        log = spark.read.schema(_LOG_SCHEMA).json(f"{warehouse}/published")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    newest = log.agg(F.max(F.struct("published_at", "build", "tables")).alias("entry")).first()["entry"]
    return None if newest is None else (newest["build"], list(newest["tables"]))


def open_portfolio(spark: SparkSession, warehouse: str) -> dict[str, DataFrame]:
    """The tables of the newest published build."""
    found = published_build(spark, warehouse)
    if found is None:
        raise FileNotFoundError(f"nothing has been published in {warehouse}")
    build, tables = found
    return {name: spark.read.parquet(f"{warehouse}/builds/{build}/{name}") for name in tables}
