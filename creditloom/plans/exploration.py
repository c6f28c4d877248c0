"""Everything an exploratory report shows, as result tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.operators import quality, segments
from creditloom.sources.artifacts import write_results
from creditloom.sources.manifest import DESCRIPTIONS

# Tables profiled for missing values and rows of that list that are shown.
PROFILED = ("application_train", "bureau", "previous_application")
SHOWN_MISSING = 40


def insight_rows(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every available insight's segments in one table ``insight_id, segment, applicants, default_rate``."""
    parts = []
    for insight in segments.insights():
        if insight.available(tables):
            found = insight.rows(tables)
            parts.append(
                found.select(
                    F.lit(insight.id).alias("insight_id"),
                    F.col(found.columns[0]).cast("string").alias("segment"),
                    "applicants",
                    "default_rate",
                )
            )
    return reduce(DataFrame.unionByName, parts)


def exploration_results(tables: Mapping[str, DataFrame], shown_missing: int = SHOWN_MISSING) -> dict[str, DataFrame]:
    profiled = [t for t in PROFILED if t in tables]
    return {
        "table_summary": quality.table_summary(tables, DESCRIPTIONS),
        "feature_categories": quality.column_profile(tables["application_train"], "application_train"),
        "missing_values": quality.missing_values(tables, profiled).limit(shown_missing),
        "data_quality_findings": quality.quality_report(tables["application_train"]),
        "insight_segments": insight_rows(tables),
        "insight_headlines": segments.insight_headlines(tables),
    }


def write_exploration(tables: Mapping[str, DataFrame], folder: str, format: str = "json") -> None:
    write_results(exploration_results(tables), folder, format)
