"""Tables that are replaced as a whole: each version is a folder of its own, and one small file names the current one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "current"


def _paths(spark: SparkSession, path: str):
    """The file system that `path` lies in, and the paths of the pointer and of a new one beside it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    return files, at(f"{path}/{POINTER}"), at(f"{path}/.{POINTER}-{uuid.uuid4().hex}")


def publish(df: DataFrame, path: str) -> str:
    """Write a new version of the table at `path` and make it the current one; returns the version's name.

    The pointer is replaced by one rename after all rows are written, so a reader
    sees the old rows or the new ones and a write that fails leaves the old version
    current. Old versions stay for readers that have begun; `prune` removes them.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    files, pointer, fresh = _paths(spark, path)
    jvm = spark.sparkContext._jvm
    flags = jvm.java.util.EnumSet.of(jvm.org.apache.hadoop.fs.CreateFlag.CREATE)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.CreateOpts, 0)
    out = files.create(fresh, flags, options)
    out.write(bytearray(version.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fresh, pointer, over)
    return version


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version; None before the first one."""
    files, pointer, _ = _paths(spark, path)
    if not files.util().exists(pointer):
        return None
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current version. The frame stays with that version whatever is published later."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no version at {path}")
    return spark.read.parquet(f"{path}/{version}")


def prune(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> list[str]:
    """Remove all versions but the current one and those to keep; returns the names removed."""
    files, _, _ = _paths(spark, path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    spared, gone = {current(spark, path), *keep}, []
    for status in files.util().listStatus(at(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in spared:
            files.delete(status.getPath(), True)
            gone.append(name)
    return gone
