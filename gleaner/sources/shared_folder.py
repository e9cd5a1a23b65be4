"""The folder that driver and executors share: scratch tables and indexes that go when the application ends, and files' states."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def find_package(spark: SparkSession) -> None:
    """Python workers on this machine find this package, wherever the driver was started."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it names none, a folder in the warehouse, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"


def hadoop(spark: SparkSession, path: str) -> tuple:
    """The path as Hadoop's object, and its file system."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def temporary(spark: SparkSession) -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    target, system = hadoop(spark, path)
    system.deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = temporary(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def snapshot(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another tuple once the table has changed."""
    target, system = hadoop(spark, path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in system.listStatus(target)))
