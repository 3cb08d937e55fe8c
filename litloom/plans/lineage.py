"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``. Where none is set, a temporary one, but only in local mode (tests); on a cluster no other node would see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="litloom-"))
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Removes the tables that ``cut`` has written so far, for long sessions: what was made from them can't be read any more."""
    jvm = spark.sparkContext._jvm
    while _written:
        where = jvm.org.apache.hadoop.fs.Path(_written.pop())
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _release_at_exit(spark: SparkSession) -> None:
    try:
        release(spark)
    except Exception:  # the session is gone: its folder is the cluster's to clean
        _written.clear()


def cut(df: DataFrame, group_mb: int = 0) -> DataFrame:
    """``df`` written as a compressed table in the shared folder and read again, without its lineage.

    Unlike a checkpoint of rows, the table is columnar: later readers take only the columns they use, and its size is
    known to the planner. It stays until ``release`` or the end of the session's Python. Readers hold up to 4096 rows of a
    row group at once: for rows so wide that these don't fit, ``group_mb`` ends the groups at about so many compressed MB.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    sizes = {"parquet.block.size": group_mb << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 16} if group_mb else {}
    df.write.options(compression="zstd", **sizes).parquet(path)
    if not _written:
        atexit.register(_release_at_exit, spark)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hinted(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (counted, and no further than that), else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
