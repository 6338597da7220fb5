"""Unions, products, joins, cogroups, positional zips and distinct rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import Key, as_column

#: A side may be broadcast when Spark's own estimate of its size is below this.
BROADCAST_BYTES = 64 << 20


def union(df: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, duplicates kept."""
    for other in others:
        df = df.union(other)
    return df


def product(df: DataFrame, *others: DataFrame) -> DataFrame:
    """Every combination of rows: the caller asks for exactly that many."""
    for other in others:
        df = df.crossJoin(other)
    return df


def product_partitions(df: DataFrame, other: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f(rows, other_rows)`` for each pair of partitions, as lists of rows."""
    pair = df.rdd.glom().cartesian(other.rdd.glom())
    return pair.flatMap(lambda x: [tuple(y) if isinstance(y, tuple | list) else (y,) for y in f(*x)]).toDF(schema)


def join(left: DataFrame, right: DataFrame, on: str | list[str] = "key", how: str = "inner", null_safe: bool = False, nested: bool = False) -> DataFrame:
    """Flat rows of an equi-join (any ``how``). ``null_safe``: null keys match each other. ``nested``: key and the list of (left, right) pairs."""
    names = [on] if isinstance(on, str) else list(on)
    if nested:
        a = left.groupBy(*names).agg(F.collect_list(F.struct(*(c for c in left.columns if c not in names))).alias("__l"))
        b = right.groupBy(*names).agg(F.collect_list(F.struct(*(c for c in right.columns if c not in names))).alias("__r"))
        pairs = F.flatten(F.transform("__l", lambda x: F.transform("__r", lambda y: F.struct(x.alias("left"), y.alias("right")))))
        return a.join(b, names).select(*names, pairs.alias("pairs"))
    if not null_safe:
        return left.join(right, names, how)
    other = right.withColumnsRenamed({n: f"__{n}" for n in names})
    condition = F.lit(True)
    for n in names:
        condition = condition & F.col(n).eqNullSafe(F.col(f"__{n}"))
    return left.join(other, condition, how).drop(*(f"__{n}" for n in names))


def cogroup(*frames: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """key, values_0 .. values_n: the values of each input, in one shuffle; keys of any input, empty arrays where one has none."""
    tagged = [f.select(F.col(key).alias("key"), F.lit(i).alias("i"), F.col(value).alias("v")) for i, f in enumerate(frames)]
    whole = union(tagged[0], *tagged[1:])
    kept = lambda i: F.collect_list(F.when(F.col("i") == i, F.struct("v")))  # noqa: E731 -- a struct, so that null values stay
    return whole.groupBy("key").agg(*(F.transform(kept(i), lambda x: x["v"]).alias(f"values_{i}") for i in range(len(frames))))


def cogroup_apply(left: DataFrame, right: DataFrame, f: Callable, schema: str, key: str = "key") -> DataFrame:
    """``f(left_frame, right_frame)`` of pandas frames for each key."""
    return left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(f, schema)


def zip_(left: DataFrame, right: DataFrame, order_left: Key = None, order_right: Key = None) -> DataFrame:
    """Pairs by position. With orders given, by rank (the shorter side ends it); else by physical position, which must agree."""
    from .elements import key_by_idx

    if order_left is None:
        a, b = (f.select(as_column(f, None).alias("v")) for f in (left, right))
        schema = T.StructType([T.StructField("left", a.schema["v"].dataType), T.StructField("right", b.schema["v"].dataType)])
        return a.rdd.zip(b.rdd).map(lambda x: (x[0][0], x[1][0])).toDF(schema)
    a = key_by_idx(left, order_left).withColumnRenamed("value", "left")
    b = key_by_idx(right, order_right).withColumnRenamed("value", "right")
    return a.join(b, "key")


def zip_partitions(left: DataFrame, right: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``f(left_frame, right_frame)`` of pandas frames for partitions of the same number."""
    a = left.withColumn("__p", F.spark_partition_id())
    b = right.withColumn("__p", F.spark_partition_id())
    return a.groupBy("__p").cogroup(b.groupBy("__p")).applyInPandas(lambda x, y: f(x.drop(columns="__p"), y.drop(columns="__p")), schema)


def distinct(df: DataFrame, key: Key = None, order_by: Column | None = None) -> DataFrame:
    """Distinct rows; with a key one row of each key: the first by ``order_by``, else any."""
    if key is None:
        return df.distinct()
    if order_by is None and isinstance(key, str | list):
        return df.dropDuplicates([key] if isinstance(key, str) else list(key))
    if order_by is None:
        first = F.any_value(F.struct(*df.columns))
        return df.groupBy(as_column(df, key).alias("__k")).agg(first.alias("r")).select("r.*")
    w = Window.partitionBy(as_column(df, key)).orderBy(order_by)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def lookup_join(df: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A map-side join where the dimension's estimated size is below BROADCAST_BYTES, otherwise a shuffled one."""
    size = int(str(dimension._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.join(F.broadcast(dimension) if size <= BROADCAST_BYTES else dimension, on, how)


def intersect(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.intersect(other)


def subtract(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.subtract(other)
