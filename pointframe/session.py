"""Session construction and the small pieces of session state that operators consult."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "pointframe", memory: str = "8g") -> SparkSession:
    """A single-JVM session with the settings that tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Leave the cluster's spark.checkpoint.dir alone; set one only where it is unset on a single machine, as in tests."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("a cluster needs a shared folder in spark.checkpoint.dir")
    spark.sparkContext.setCheckpointDir(os.path.join(os.environ.get("TMPDIR", "/tmp"), "pointframe-checkpoints"))


def shared_folder(spark: SparkSession, stem: str) -> str:
    """The name of a new folder beside the checkpoints, which all machines share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{stem}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and return it with a lineage that starts there.

    With spark.cleaner.referenceTracking.cleanCheckpoints, its files go once nothing refers to it any more.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
