"""Support for iterative plans: tables in the shared folder, and convergence fingerprints."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it.

    Where the session names none, one is made if everything runs in this process (``local[n]``); on a cluster
    that is an error: executors would write where nobody else looks.
    """
    jsc = spark.sparkContext._jsc.sc()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and jsc.getCheckpointDir().isDefined():
        base = jsc.getCheckpointDir().get()
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(base)
    return base


#: Makes Spark delete the shuffle files of a query when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: plans stay short and lost executors cost nothing.

    The shuffle files of the write go with it; those of other queries stay as the session has them.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "tables", f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def forget(*tables: DataFrame | None) -> None:
    """Delete what ``cut`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path is not None:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def fingerprint(df: DataFrame, *cols: str) -> tuple[int, int]:
    """(row count, order-free sum of row hashes): equal for equal bags of rows."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")).first()
    return int(row["n"]), int(row["h"] or 0)
