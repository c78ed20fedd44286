"""Session and lineage helpers.

The builder here is for local runs and tests.  On a cluster the caller
owns the session; the library only *reads* its settings (shuffle
partitions, checkpoint directory) and never points at a machine-local
folder unless the setting is unset (tests, local benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "limnos", driver_memory: str = "8g") -> SparkSession:
    """Local session with AQE, skew-join handling and the UI off."""
    builder = (
        SparkSession.builder.master(master or "local[8]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        # delete reliable checkpoint files once their DataFrames are garbage-collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder
    (HDFS/S3/ABFS) and is used as is; if it is unset there, this raises.
    Only for a local master with the setting unset (tests, local benches)
    a scratch folder is created and registered.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: iterative operators need a shared folder "
                           "(HDFS/S3/ABFS) that every executor can read; a machine-local folder is only "
                           "used for local masters")
    local = tempfile.mkdtemp(prefix="limnos-ckpt-", dir=os.environ.get("LIMNOS_SCRATCH", "/tmp"))
    spark.conf.set(CHECKPOINT_CONF, local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint to the shared checkpoint directory.

    Used by iterative operators (sequential fences, chained equations) so
    a lost executor recomputes from the checkpoint, not the whole chain.
    Never ``localCheckpoint``: its blocks die with the executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``df`` as a new table in the shared folder, read back.

    One pass (a checkpoint takes two) and its size is known to the planner; it stays until the caller
    clears the folder."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
