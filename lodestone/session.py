"""Spark sessions for scripts and tests, and the cut of lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Settings every query may rely on. AQE sizes the partitions after a shuffle and splits skewed ones.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestone")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _shared_folder(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it is unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local["):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it from there, so that a lost executor costs no recomputation."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def side_by_side(spark: SparkSession, *makers: Callable[[], DataFrame]) -> list[DataFrame]:
    """What the makers give, made at the same time: their jobs are too small to keep a cluster busy one after another."""
    with ThreadPoolExecutor(max(1, len(makers))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(m)) for m in makers]]


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once an application, for sessions that weren't started with it on their path."""
    import zipfile

    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")), "lodestone.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    whole = os.path.join(folder, name)
                    out.write(whole, os.path.join("lodestone", os.path.relpath(whole, here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
