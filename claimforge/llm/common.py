"""Helpers shared by the training-data operators: checkpoints, Arrow text buffers, column hygiene."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


SPLIT, SPLIT_BYTES = "spark.sql.files.maxPartitionBytes", 24 << 20


def tune(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, which bounds what workers and the JVM hold of long texts; and no large parts of files in a task.

    Tables between stages are compressed, and their rows take long: with parts of 128 MB, some gigabytes make hardly more tasks than there are cores, and
    a second round of few tasks doubles a stage's time.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(SPLIT)) > SPLIT_BYTES:
        spark.conf.set(SPLIT, str(SPLIT_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which a cluster shares as well."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes a data frame to the shared folder and reads it.

    The data survive lost executors and the lineage ends here; the write's shuffle files go with it. `discard` deletes the table once nothing reads it any more;
    the file system does so at the latest when the driver ends.
    """
    spark = df.sparkSession
    tune(spark)
    sc = spark.sparkContext
    where = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # for this write only: results that are read bit by bit need their shuffles longer
    try:
        df.write.option("compression", "zstd").parquet(where)
    finally:
        spark.conf.set(CLEANUP, before)
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out.table_path = where
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `cut` that no later query reads."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df.table_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column without copying; nulls count as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def parts(batches, column: str = "text", size: int = 4 << 20):
    """Batches cut into runs of rows with about so many bytes of text, which bounds a worker's memory (a longer text is one run)."""
    for batch in batches:
        _, off = utf8(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j


_RELEASED = [0.0]


def release() -> None:
    """Gives memory that Arrow and malloc hold for later back, twice a second at most; several workers share an executor's allowance."""
    if time.monotonic() - _RELEASED[0] < 0.5:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass
    _RELEASED[0] = time.monotonic()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that workers find it wherever the driver runs."""
    tune(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = Path(__file__).resolve().parents[1]
    where = Path(tempfile.mkdtemp(prefix="package-")) / f"{top.name}.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    sc.addPyFile(str(where))


def keyed(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """The key as long and the named columns only, so that extra columns with clashing names never meet in a join."""
    ship(df.sparkSession)
    return df.select(F.col(key).cast("long").alias(key), *[F.col(c) for c in columns])
