"""Session-level helpers: reading tables, cutting lineage, size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table may be broadcast when it has at most this many rows (of a few hundred bytes each).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodeweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone by now
        pass


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table into the shared folder and read it back.

    The lineage ends there, so a lost executor costs no recomputation of what came before, and
    several later actions share one computation. The table is removed by release(), at the latest when the driver ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/lodeweave-{os.getpid()}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    atexit.register(_remove, spark, folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._lodeweave_folder = folder
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables of cut() at once. Only when all that reads them has been computed, by a later cut() or an action."""
    for df in tables:
        _remove(df.sparkSession, df._lodeweave_folder)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to have at most `rows` rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer: for costly work on each row of small tables.

    Inputs with more partitions, and plans that shuffle anyway, stay as they are, so nothing large is moved.
    """
    plan = df._jdf.queryExecution()
    if "Exchange" in plan.executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if plan.toRdd().getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
