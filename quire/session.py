"""Session helpers: a local session for tests and durable cuts of lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no spark.checkpoint.dir (tests, local runs).
LOCAL_CHECKPOINTS = "/tmp/quire-checkpoints"


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session on this machine, as the tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, our own only on one machine where that is
    unset; a cluster that names none is an error, as a folder of one machine would lose data there."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or LOCAL_CHECKPOINTS).rstrip("/")


_TIDIED: set[str] = set()


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when the driver's Python ends in good order."""
    path = f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}"
    if path not in _TIDIED:
        _TIDIED.add(path)
        atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # the session is gone already
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, compressed and columnar, which checkpoint() is not.
    The folder belongs to this application and is not read by any other.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
