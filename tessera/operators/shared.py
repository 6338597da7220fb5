"""Caching, shared values and what tasks report back."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from typing import Any

from pyspark import AccumulatorParam, StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

LEVELS = {"memory": StorageLevel.MEMORY_AND_DISK, "disk": StorageLevel.DISK_ONLY, "memory_only": StorageLevel.MEMORY_ONLY}


def cache(df: DataFrame, location: str | None = "memory") -> DataFrame:
    """Keeps the rows from first use; an empty location lets go of them."""
    if not location:
        return uncache(df)
    if location not in LEVELS:
        raise ValueError(f"unknown location {location!r}")
    return df.persist(LEVELS[location])


def uncache(df: DataFrame, block: bool = False) -> DataFrame:
    return df.unpersist(block)


def is_cached(df: DataFrame) -> bool:
    return df.is_cached


def broadcast(spark: SparkSession, value: Any):
    """A read-only value for Python functions; frames join by ``lookup_join``."""
    return spark.sparkContext.broadcast(value)


class _Monoid(AccumulatorParam):
    def __init__(self, zero: Any, merge: Callable):
        self._zero, self._merge = zero, merge

    def zero(self, value):
        return self._zero

    def addInPlace(self, a, b):  # noqa: N802
        return self._merge(a, b)


MONOIDS = {
    "sum": _Monoid(0, lambda a, b: a + b),
    "product": _Monoid(1, lambda a, b: a * b),
    "or": _Monoid(0, lambda a, b: a | b),
    "and": _Monoid(-1, lambda a, b: a & b),
    "set": _Monoid(frozenset(), lambda a, b: a | b),
}


def accumulator(spark: SparkSession, initial: Any = 0, kind: str | tuple[Any, Callable] = "sum"):
    """A value that tasks add to, by a commutative operation of MONOIDS or one given as (zero, merge); exact in actions, where repeated tasks count once."""
    return spark.sparkContext.accumulator(initial, MONOIDS[kind] if isinstance(kind, str) else _Monoid(*kind))


def observe(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Aggregates that come with the next action at no job of their own."""
    seen = Observation(name)
    return df.observe(seen, *(v.alias(k) for k, v in metrics.items())), seen


def partitioned_values(df: DataFrame, value: Column) -> DataFrame:
    """partition, value: an aggregate of each partition; repeated tasks give the same row."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(value.alias("value"))


@contextmanager
def described(spark: SparkSession, text: str):
    """Jobs started inside carry this description."""
    spark.sparkContext.setJobDescription(text)
    try:
        yield
    finally:
        spark.sparkContext.setJobDescription(None)


@contextmanager
def profiled(spark: SparkSession, kind: str = "perf"):
    """CPU (``perf``) or memory profiles of the Python functions that run inside; see ``spark.profile.show()``."""
    before = spark.conf.get("spark.sql.pyspark.udf.profiler", None)
    spark.conf.set("spark.sql.pyspark.udf.profiler", kind)
    try:
        yield spark.profile
    finally:
        spark.conf.unset("spark.sql.pyspark.udf.profiler") if before is None else spark.conf.set("spark.sql.pyspark.udf.profiler", before)
