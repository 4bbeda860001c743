"""Tables in the session's shared folder that cut a lineage, and their removal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of ``spark.checkpoint.dir``, else one in the warehouse.

    A warehouse on a local disk is refused where executors run elsewhere, as they could not read each other's files.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    if path.getFileSystem(sc._jsc.hadoopConfiguration()).getScheme() == "file" and not sc.master.startswith("local"):
        raise ValueError("no shared folder: set spark.checkpoint.dir, or a warehouse that all executors see")
    return where


def new_folder(spark: SparkSession) -> str:
    """The name of a new folder in the shared one, deleted at the latest when the driver ends."""
    sc = spark.sparkContext
    where = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def stored(df: DataFrame) -> DataFrame:
    """df, written once and read from there: lost executors cost nothing, and no later job computes it again. See `dropped`."""
    where = new_folder(df.sparkSession)
    df.write.parquet(where)
    out = df.sparkSession.read.schema(df.schema).parquet(where)
    out.stored_at = where
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `stored` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
