"""Session helpers.

Library code never changes session settings; these helpers are for tests, the
bench and local runs.  On a cluster the session arrives configured and
``spark.checkpoint.dir`` names a shared folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "scorebook") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SCOREBOOK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` is set to a shared folder and used as is;
    a fresh local folder is made only when nothing is configured (tests, local runs).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    # found again through the context: the session does not let this setting be changed
    path = tempfile.mkdtemp(prefix="scorebook-ckpt-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table under ``spark.checkpoint.dir`` and read it back.

    For a table that several steps of one plan read: it is computed once, its lineage ends there,
    and nothing is left in the cache.  The folder is the cluster's to empty."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scorebook/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
