"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "20g") -> SparkSession:
    """A local session with the settings the engine is tested under; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("carex")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WRITTEN: list[tuple] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: what the session names in spark.checkpoint.dir.

    Only where that is unset on a local master (tests, a laptop) a temporary one is made.
    """
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not re.fullmatch(r"local(\[[^,]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if folder is None:
        folder = tempfile.mkdtemp(prefix="carex-", dir=os.environ.get("TMPDIR"))
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def work_folder(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there is deleted like materialised tables."""
    path = f"{shared_folder(spark)}/carex-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialise(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write `df` once as a table in the shared folder and return a frame that reads it back.

    Lineage is cut, a lost executor costs nothing, later readers take only the columns they need, and the planner
    knows the size. The tables are deleted when the session's process ends, or before by `clear_materialised`.
    by: columns that name the table's partitions.
    """
    path = work_folder(df.sparkSession)
    df.write.partitionBy(*(by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_materialised() -> None:
    """Delete all tables that `materialise` has written. Frames that read them can no longer be used."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001
            return  # the session has ended; the folder is its owner's


atexit.register(clear_materialised)
