"""Result tables written for other programs."""

from __future__ import annotations

from pyspark.sql import DataFrame

FORMATS = ("parquet", "json")


def write_results(results: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """Write each result under its name; Spark's commit protocol keeps partial output invisible."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    for name, df in results.items():
        df.write.mode("overwrite").format(format).save(f"{folder}/{name}")
