"""Session helpers for tests, the bench and the examples.

Library functions never create a session themselves; they use the one their
input ``DataFrame`` belongs to.  The checkpoint folder comes from
``spark.checkpoint.dir`` (a shared folder on a cluster).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  driver_memory: str = "8g", app: str = "riskspark",
                  extra: dict[str, str] | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.config(map=extra or {}).master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; an error if it names none."""
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``checkpoint_dir``; a local master whose session names none (tests) gets a scratch folder."""
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and (sc.master == "local" or sc.master.startswith("local[")):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskspark-shared-"))
    return checkpoint_dir(spark)


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` as written to the shared folder: later steps read it there, and ids that depend on its
    partitions stay as they are when an executor is lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
