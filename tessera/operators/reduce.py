"""Whole-dataset reductions. Eager ones return Python values; those of Python callables combine on the map side first."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import Key, as_column

#: Below this error the built-in counter needs too much memory; a sketch of fixed size is used instead.
LEAST_RSD = 0.01


def _values(df: DataFrame, key: Key = None):
    return df.select(as_column(df, key).alias("v")).rdd.map(lambda r: r[0])


def aggregate(df: DataFrame, local: Column | Callable[[Iterable], Any], comb: Callable[[Iterable], Any] | None = None, key: Key = None) -> Any:
    """A built-in aggregate; or ``local`` of each partition's values and ``comb`` of the partials on the driver (one a partition)."""
    if isinstance(local, Column):
        return df.agg(local).first()[0]
    partials = _values(df, key).mapPartitions(lambda it: _partial(local, it)).collect()
    if not partials:
        raise ValueError("dataset is empty")
    return (comb or local)(partials)


def _partial(local: Callable, it: Iterable) -> Iterable:
    """``local`` of an iterator of the partition's values; nothing of an empty partition."""
    rows = iter(it)
    for head in rows:
        return [local(itertools.chain([head], rows))]
    return []


def combine(df: DataFrame, zero: Any, merge_value: Callable, merge_combs: Callable, key: Key = None) -> Any:
    """Each partition folds from ``zero``; the partials are merged without it."""
    import copy
    from functools import reduce as fold

    partials = _values(df, key).mapPartitions(lambda it: [fold(merge_value, it, copy.deepcopy(zero))]).collect()
    return fold(merge_combs, partials)


def reduce_(df: DataFrame, f: Callable, key: Key = None) -> Any:
    return _values(df, key).reduce(f)


def tree_aggregate(df: DataFrame, zero: Any, merge_value: Callable, merge_combs: Callable, depth: int = 2, key: Key = None) -> Any:
    """Partials are merged on the executors in ``depth`` levels."""
    return _values(df, key).treeAggregate(zero, merge_value, merge_combs, depth)


tree_combine = tree_aggregate


def tree_reduce(df: DataFrame, f: Callable, depth: int = 2, key: Key = None) -> Any:
    return _values(df, key).treeReduce(f, depth)


def tree_sum(df: DataFrame, column: Column, groups: int = 32) -> DataFrame:
    """A sum in two levels of Catalyst aggregates: by salt, then of the partial sums."""
    salted = df.select(F.pmod(F.xxhash64(*df.columns), F.lit(groups)).alias("salt"), column.alias("v"))
    return salted.groupBy("salt").agg(F.sum("v").alias("v")).agg(F.sum("v").alias("total"))


def count(df: DataFrame) -> int:
    return df.count()


def sum_(df: DataFrame, key: Key = None) -> Any:
    """0 for an empty dataset."""
    return df.agg(F.coalesce(F.sum(as_column(df, key)), F.lit(0))).first()[0]


def _some(value: Any) -> Any:
    if value is None:
        raise ValueError("dataset is empty")
    return value


def max_(df: DataFrame, key: Key = None, by: Key = None) -> Any:
    """The largest value, or the value with the largest ``by``."""
    value = as_column(df, key)
    return _some(df.agg(F.max(value) if by is None else F.max_by(value, as_column(df, by))).first()[0])


def min_(df: DataFrame, key: Key = None, by: Key = None) -> Any:
    value = as_column(df, key)
    return _some(df.agg(F.min(value) if by is None else F.min_by(value, as_column(df, by))).first()[0])


def mean(df: DataFrame, key: Key = None) -> float:
    return _some(df.agg(F.avg(as_column(df, key))).first()[0])


def count_distinct(df: DataFrame, key: Key = None) -> int:
    """Distinct values, a null among them counting as one."""
    return df.select(as_column(df, key).alias("v")).distinct().count()


def count_distinct_approx(df: DataFrame, key: Key = None, error_rate: float = 0.05) -> int:
    """Distinct values within about ``error_rate``; rates below LEAST_RSD use a sketch of 2^21 registers at most."""
    value = as_column(df, key)
    if error_rate >= LEAST_RSD:
        return df.agg(F.approx_count_distinct(value, min(error_rate, 0.39))).first()[0]
    import math

    log_k = min(21, max(4, math.ceil(math.log2((1.04 / error_rate) ** 2))))
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(value, F.lit(log_k)))).first()[0]


def count_by_value(df: DataFrame, key: Key = None) -> DataFrame:
    return df.groupBy(as_column(df, key).alias("value")).agg(F.count("*").alias("count"))
