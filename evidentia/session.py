"""Helpers that depend on the session: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local one only where it is unset and Spark runs locally."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="evidentia-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the shared folder, unless the session already names one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(fresh_path(spark))


def _delete_written() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session is gone
            return


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and read it from there, so that a lost executor replays nothing.

    The table goes when Python ends. A table rather than checkpoint(): its plan starts anew, whereas a checkpoint keeps
    the constraints of the plans before it, which grow without bound over the rounds of a loop.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes when Python ends."""
    folder = f"{shared_folder(spark)}/evidentia-{spark.sparkContext.applicationId}"
    if not _written:
        atexit.register(_delete_written)
    if (spark, folder) not in _written:
        _written.append((spark, folder))
    return f"{folder}/{uuid.uuid4().hex}"


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, which is counted; else as it is.

    The count stops after ``max_rows`` + 1 rows.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
