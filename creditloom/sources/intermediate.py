"""Intermediate tables written to the shared checkpoint folder.

A range exchange picks its boundaries by sampling, so a plan that is evaluated twice may split its rows
differently the second time. Results that must stay put between two evaluations are therefore written once to
the folder named by ``spark.checkpoint.dir`` and read back; they survive the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, tempfile.TemporaryDirectory] = {}


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one is made only for a local session that names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    application = spark.conf.get("spark.app.id")
    if application not in _local_folders:
        _local_folders[application] = tempfile.TemporaryDirectory(prefix="creditloom-")
    return _local_folders[application].name


def materialise(df: DataFrame, label: str, by: str | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the stored copy; ``by`` names a column whose values get folders of their own.

    ``codec`` is the compression, the session's if not given.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by, compression=codec)
    stored = spark.read.schema(df.schema).parquet(path)
    # Folders' values come last when they are read.
    return stored if by is None else stored.select(df.columns)


def release(df: DataFrame) -> None:
    """Delete a table that ``materialise`` has stored, once nothing reads it any more."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        inside = system.makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toUri().getPath()
        if path.toUri().getPath().startswith(f"{inside}/"):
            system.delete(path, True)
