"""Session helpers: a builder for stand-alone runs and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "quantloom") -> SparkSession:
    """A session for tests and benchmarks. On a cluster use the session that spark-submit configures."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.log.level", "ERROR")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (master ``local``: tests, a laptop) a temporary folder is made,
    remembered for the session and removed when Python ends. On a cluster it has to be named.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quantloom.shared.dir", None)
    if not configured:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="quantloom-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("quantloom.shared.dir", configured)
    return configured


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def remove_path(spark: SparkSession, path: str, below: str | None = None) -> None:
    """Delete a folder made by :func:`work_path` (or one below ``below``), in whatever store it is, once nothing reads it any more."""
    above = (below or shared_dir(spark)).rstrip("/") + "/"
    if not path.startswith(above):
        raise ValueError(f"{path} is not below {above}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def make_marker(spark: SparkSession, path: str) -> None:
    """Create an empty file; it is there or not, so it can commit what was written before."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False).close()


def shuffle_width(spark: SparkSession) -> int:
    """Partition count for explicit repartitioning ahead of a fan-out, which AQE would otherwise size by input bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
