"""Keyed grouping, reduction and top-n over frames with columns key and value. Built-in aggregates combine on the map side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import Key, as_column, collected


def group_by(df: DataFrame, key: Key) -> DataFrame:
    """key, values: whole rows of each key. The array of a key must fit a task; flat aggregates need no such array."""
    return df.groupBy(as_column(df, key).alias("key")).agg(collected(as_column(df, None)).alias("values"))


def group_by_key(df: DataFrame, order: bool = False) -> DataFrame:
    """key, values: the values of each key, nulls too (first, with ``order``)."""
    made = collected(F.col("value"))
    return df.groupBy("key").agg((F.sort_array(made) if order else made).alias("values"))


def aggregate_by_key(df: DataFrame, local: Column | Callable, comb: Callable | None = None, schema: str | None = None, name: str = "value") -> DataFrame:
    """A built-in aggregate of ``value``; or two Python functions of pandas frames: ``local`` on the map side, ``comb`` (default ``local``) on its partials.

    With Python functions ``schema`` describes both the partials and the result, and has the column key.
    """
    if isinstance(local, Column):
        return df.groupBy("key").agg(local.alias(name))

    def partial(frames):
        for frame in frames:
            for _, own in frame.groupby("key", dropna=False, sort=False):
                yield local(own)

    return df.mapInPandas(partial, schema).groupBy("key").applyInPandas(comb or local, schema)


#: Neighbouring rows whose values of one key are folded together first.
FOLD_ROWS = 4096


def combine_by_key(
    df: DataFrame, create: Callable[[Column], Column], merge_value: Callable[[Column, Column], Column], merge_combs: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None
) -> DataFrame:
    """A fold of each key's values (nulls too) in Catalyst, from ``create`` of a first one. Blocks of FOLD_ROWS rows are folded first and ``merge_combs``
    joins their results, so that no list grows with a key's values."""

    def folded(values: Column, first: Callable[[Column], Column], f: Callable[[Column, Column], Column], last: Callable[[Column], Column] | None) -> Column:
        rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
        return F.aggregate(rest, first(values[0]), f, last) if last else F.aggregate(rest, first(values[0]), f)

    blocks = df.select("key", "value", F.floor(F.monotonically_increasing_id() / FOLD_ROWS).alias("block"))
    partial = blocks.groupBy("key", "block").agg(collected(F.col("value")).alias("v")).select("key", folded(F.col("v"), create, merge_value, None).alias("c"))
    whole = partial.groupBy("key").agg(collected(F.col("c")).alias("v"))
    return whole.select("key", folded(F.col("v"), lambda c: c, merge_combs, finish).alias("value"))


def combine_by_key_rdd(df: DataFrame, create: Callable, merge_value: Callable, merge_combs: Callable, schema: str) -> DataFrame:
    """Any Python combiner, merged on the map side."""
    return df.select("key", "value").rdd.map(tuple).combineByKey(create, merge_value, merge_combs).toDF(schema)


def reduce_by_key(df: DataFrame, f: Callable | str, schema: str | None = None) -> DataFrame:
    """``sum``, ``min``, ``max``, ``count`` or a bit aggregate by name; with a schema any associative Python function."""
    if isinstance(f, str):
        return df.groupBy("key").agg(getattr(F, f)("value").alias("value"))
    return df.select("key", "value").rdd.map(tuple).reduceByKey(f).toDF(schema or df.select("key", "value").schema)


def _top(df: DataFrame, n: int, order: list[Column], nested: bool) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order)).cast("long")).where(F.col("rank") <= n)
    if not nested:
        return ranked
    return ranked.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("values"))


def nlargest_by_key(df: DataFrame, n: int, by: Column | None = None, ties: list[str] | None = None, nested: bool = False) -> DataFrame:
    """The n largest values of each key with their rank, limited on the map side first; ``ties`` are broken by further columns, ascending."""
    return _top(df, n, [(by if by is not None else F.col("value")).desc(), *map(F.asc, ties or [])], nested)


def nsmallest_by_key(df: DataFrame, n: int, by: Column | None = None, ties: list[str] | None = None, nested: bool = False) -> DataFrame:
    return _top(df, n, [(by if by is not None else F.col("value")).asc(), *map(F.asc, ties or [])], nested)
