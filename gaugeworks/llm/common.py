"""What several operators share: the shared folder, shipping this package to executors, slices of text."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds this package to the files that Spark sends to its Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    target = os.path.join(tempfile.mkdtemp(), "gaugeworks_llm_files.zip")
    with zipfile.ZipFile(target, "w") as z:
        # all of it: a worker finds the package in one place, whoever sends it first
        for folder, _, files in os.walk(os.path.join(top, "gaugeworks")):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own, in local mode alone: a cluster has to name its folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="gaugeworks-checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: cuts lineage, survives lost executors.

    What the write shuffled is not needed afterwards, so Spark is asked to remove those files when it ends.
    """
    return stored_at(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of stored_at() that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stored(), with the table's path, for removed()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def lists(spark: SparkSession, least: int = 512) -> int:
    """Number of hash buckets for packed shuffles; follows spark.sql.shuffle.partitions, which grows with the data."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of an Arrow string column: (first row, UTF-8 bytes, offsets of the rows in them) for runs of rows.

    A run holds about `most` bytes and one row at least; a null counts as empty.
    """
    column = column.cast(pa.large_string())
    if not len(column):
        return
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64, count=len(column) + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, side="right")) - 1)
        yield first, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
