"""Where intermediate results live: the folder that ``spark.checkpoint.dir`` names, shared by all executors, and the cache."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import deque

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_KEPT: deque[DataFrame] = deque()
#: Frames kept at once; the oldest is given up first, and computed again if it is still read.
MOST_KEPT = 32
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where none is set and the session is local, as in tests, one of this machine's is used."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not (own := spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(own)
        atexit.register(_remove, own.removeprefix("file://"))
    return own


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that is removed when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    return path


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # its session has ended
            pass


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: compressed, read by column, and there whatever executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """``written``, moved once to as many buckets of a key as shuffles have parts: joins on the key read it where it lies. The catalog
    knows the table only until it is opened."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.repartition(parts, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"drop table {table}")  # the files stay, as the path is given
    return found


def keep(df: DataFrame, now: bool = False) -> DataFrame:
    """Caches a frame that a plan reads more than once. Lost parts are computed again from its lineage. ``now`` computes it at
    once: stages that start together would each compute the parts that no other executor has ready."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    if now:
        df.count()
    _KEPT.append(df)
    while len(_KEPT) > MOST_KEPT:
        try:
            _KEPT.popleft().unpersist()
        except Exception:  # its session has ended
            pass
    return df


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once for each Spark application."""
    import os
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_quern_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="quern-code-")
    atexit.register(_remove, folder)
    with zipfile.ZipFile(path := os.path.join(folder, "quern.zip"), "w") as to:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    to.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._quern_shipped = True
