"""Session settings: UTC, AQE, Arrow and a modest shuffle width for one machine."""

from __future__ import annotations

import os
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """The running session, or a new one; ``conf`` keys use ``__`` for dots.

    On a cluster leave ``master`` unset: spark-submit's settings then hold.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def default_pcount(spark: SparkSession) -> int:
    """Partitions of a source for which none are asked."""
    return spark.sparkContext.defaultParallelism


def executor_count(spark: SparkSession) -> int:
    """Executors that are there now, the driver of a local session included."""
    return len(list(spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos()))


def executors(spark: SparkSession) -> list[str]:
    """host:port of the executors that are there now, the driver among them."""
    return sorted(f"{x.host()}:{x.port()}" for x in spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos())


def await_executors(spark: SparkSession, n: int, timeout: float = 60.0) -> int:
    """Waits until ``n`` executors are there, the driver of a local session included, or the time is over; how many there are."""
    end = time.monotonic() + timeout
    while executor_count(spark) < n and time.monotonic() < end:
        time.sleep(0.1)
    return executor_count(spark)


def free_heaps(spark: SparkSession) -> None:
    """Executors collect their garbage and give the free part of their heaps back to the machine, which a JVM else holds until it ends: for the begin of work
    whose Python workers need that memory. One task a core, dealt out in turn, so that each executor has some; a busy cluster may pass over one."""
    n = default_pcount(spark)
    spark.range(0, n, 1, n).select(F.call_function("reflect", F.lit("java.lang.System"), F.lit("gc"))).collect()


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, in case their path does not name it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
