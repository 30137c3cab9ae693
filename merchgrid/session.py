"""Session helpers: local test session and durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a write's shuffle files go when the write ends, and not when the driver collects its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", app: str = "merchgrid") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    n = cores if cores.isdigit() else "8"
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.merchgrid.scan.partitions", n)  # local tables are single row groups, which a scan can't split
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MERCHGRID_DRIVER_MEMORY", "12g"))
        .config("spark.checkpoint.dir", os.environ.get("MERCHGRID_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="merchgrid-ckpt-"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites cost more than the plan
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; only a session in one process may lack the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="merchgrid-ckpt-")  # the setting can't be given to a session that runs
    return f"{folder.rstrip('/')}/files-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names.

    A session in one process that lacks the setting is given a folder of its own; a cluster must name a shared one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="merchgrid-ckpt-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def _written(parts: tuple[DataFrame, ...], path: str) -> DataFrame:
    spark = parts[0].sparkSession
    with _cleaned(spark):
        for part in parts:
            part.write.mode("append").parquet(path, compression="zstd")
    return spark.read.schema(parts[0].schema).parquet(path)


def written(*parts: DataFrame) -> DataFrame:
    """Cut lineage with a Parquet table below ``spark.checkpoint.dir``.

    Several frames of the same columns are written one after another into the one table, so the disk holds the shuffle
    files of one at a time.
    """
    return _written(parts, scratch(parts[0].sparkSession))


@contextmanager
def held(*parts: DataFrame) -> Iterator[DataFrame]:
    """The same table for the steps inside the block only: it is deleted at the end, so no frame that reads it may leave."""
    spark, path = parts[0].sparkSession, scratch(parts[0].sparkSession)
    try:
        yield _written(parts, path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
