"""Named queries: functions of a session and a data folder that return a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from creditloom.sources.testbed import Testbed

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}


def query(name: str) -> Callable[[Callable[[Testbed], DataFrame]], Callable[[Testbed], DataFrame]]:
    """Register a function of the credit tables under ``name``."""

    def register(build: Callable[[Testbed], DataFrame]) -> Callable[[Testbed], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = lambda spark, sf_dir: build(Testbed(spark, sf_dir))
        return build

    return register
