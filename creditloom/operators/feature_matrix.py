"""The wide feature table and lookups into it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from creditloom.operators.application import ID, LABEL, with_derived_features
from creditloom.operators.history import SUMMARIES
from creditloom.operators.restriction import restrict_to_clients
from creditloom.sources.intermediate import materialise


def feature_matrix(tables: Mapping[str, DataFrame], source: str = "application_train") -> DataFrame:
    """One row per application: raw columns, derived features and the six history summaries.

    Every summary leaves its aggregate hash-partitioned by client, which is the partitioning the joins ask
    for; the only extra exchange is the application table's own. Clients without history keep NULLs.
    """
    applications = with_derived_features(tables[source])
    summaries = [build(tables) for build in SUMMARIES.values()]
    return reduce(lambda left, right: left.join(right, ID, "left"), summaries, applications)


def model_inputs(matrix: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric and categorical feature names; the id and the label are never inputs."""
    fields = [f for f in matrix.schema.fields if f.name not in (ID, LABEL)]
    categorical = [f.name for f in fields if isinstance(f.dataType, StringType)]
    return [f.name for f in fields if f.name not in categorical], categorical


def _matching(applications: DataFrame, ids: DataFrame | Sequence[int]) -> DataFrame:
    if isinstance(ids, DataFrame):
        return applications.join(ids.select(ID), ID, "left_semi")
    return applications.filter(F.col(ID).isin([int(i) for i in ids]))


def applicant_lookup(
    tables: Mapping[str, DataFrame],
    ids: DataFrame | Sequence[int],
    labelled: str = "application_train",
    unlabelled: str = "application_test",
) -> DataFrame:
    """Feature rows of the given clients, taken from the labelled table where it has them.

    A short list of ids becomes a filter pushed into both application scans; a DataFrame of ids becomes a semi
    join. Either way the history tables are cut down to those clients before they are summarised.
    """
    found = _matching(tables[labelled], ids)
    missing = _matching(tables[unlabelled], ids).join(found.select(ID), ID, "left_anti")
    spine = found.withColumn("SOURCE_TABLE", F.lit(labelled)).unionByName(
        missing.withColumn("SOURCE_TABLE", F.lit(unlabelled)), allowMissingColumns=True
    )
    # Stored once: every history is cut down by it.
    spine = materialise(spine, "spine")
    return feature_matrix(restrict_to_clients(tables, spine) | {"spine": spine}, "spine")
