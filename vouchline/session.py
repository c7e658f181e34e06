"""Spark session settings and the shared working folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with the settings this library expects. On a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName("vouchline")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared folder (`spark.checkpoint.dir`). A session of one machine may do without that setting."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local[") and spark.conf.get("spark.master", "") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="vouchline-")
    return os.path.join(shared, f"{name}-{os.urandom(6).hex()}")


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below `path` that Spark has written to the end; none if there is no such path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [entry.getPath() for entry in files.listStatus(root) if entry.isDirectory()]
    return sorted(p.getName() for p in names if files.exists(hadoop.Path(p, "_SUCCESS")))


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def remove_path(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def move_path(spark: SparkSession, path: str, into: str) -> None:
    """Move a folder, if there is one, into the folder `into`, which is made if it is missing. Nothing is copied."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, target = hadoop.Path(path), hadoop.Path(into)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    if files.exists(place) and not files.rename(place, hadoop.Path(target, place.getName())):
        raise OSError(f"cannot move {path} into {into}")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind: else those stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
