"""Folders for files that tasks on several machines write and read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a folder of its own only for a session on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="weekpulse-")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path to write to. It is removed when the driver ends, since results are read from it later."""
    parent = f"{shared_folder(spark)}/weekpulse/{purpose}-{uuid.uuid4().hex}"
    files, path = file_system(spark, parent)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{parent}/rows"


def remove(spark: SparkSession, folder: str) -> None:
    files, path = file_system(spark, folder)
    files.delete(path, True)


def folders(spark: SparkSession, folder: str) -> list[str]:
    """The names of what is in a folder; none if there is no such folder."""
    files, path = file_system(spark, folder)
    return [status.getPath().getName() for status in files.listStatus(path)] if files.exists(path) else []


def exists(spark: SparkSession, place: str) -> bool:
    files, path = file_system(spark, place)
    return files.exists(path)


def file_system(spark: SparkSession, folder: str) -> tuple:
    """Hadoop's file system of the folder, which Spark itself writes with, and the folder's path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path
