"""Element and partition transformations. Columns stay visible to Catalyst; a Python callable needs a schema and runs in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import Key, as_column, collected, python_rows, truthy
from tessera.storage import stored


def _names(schema: str | T.StructType) -> list[str]:
    return T._parse_datatype_string(schema).names if isinstance(schema, str) else schema.names


def map_(df: DataFrame, *columns: Column | str | Callable, schema: str | None = None) -> DataFrame:
    """One row to one row: select columns, or apply a Python function to each row."""
    if schema:
        return df.mapInArrow(python_rows(columns[0], _names(schema)), schema)
    return df.select(*(as_column(df, c) for c in columns))


def starmap(df: DataFrame, f: Callable, schema: str | None = None, name: str = "value") -> DataFrame:
    """``f`` of the row's columns as arguments: a Column-valued function, or with a schema any Python one."""
    if schema:
        return df.mapInArrow(python_rows(lambda row: f(*row), _names(schema)), schema)
    return df.select(as_column(df, f).alias(name))


def pluck(df: DataFrame, index: int | str | list, column: str, default: Any = None, name: str = "value") -> DataFrame:
    """Items of an array (from 0), map or struct column; a list of indexes gives an array. ``default`` stands for what is missing."""
    kind = df.schema[column].dataType

    def item(i):
        got = F.col(column)[i] if isinstance(kind, T.StructType) else F.try_element_at(column, F.lit(i + 1 if isinstance(kind, T.ArrayType) else i))
        return got if default is None else F.coalesce(got, F.lit(default))

    return df.select((F.array(*map(item, index)) if isinstance(index, list) else item(index)).alias(name))


def flatmap(df: DataFrame, key: Key = None, schema: str | None = None, name: str = "value") -> DataFrame:
    """One row to many: explode an array column, or a Python function's iterable."""
    if schema:
        return df.mapInArrow(python_rows(key, _names(schema), many=True), schema)
    return df.select(F.explode(as_column(df, key)).alias(name))


def map_partitions(df: DataFrame, f: Callable[[Iterator], Iterable], schema: str) -> DataFrame:
    """``f`` of an iterator of pandas frames."""
    return df.mapInPandas(f, schema)


def map_partitions_with_index(df: DataFrame, f: Callable[[int, Iterator], Iterable], schema: str) -> DataFrame:
    def run(frames):
        from pyspark import TaskContext

        return f(TaskContext.get().partitionId(), frames)

    return df.mapInPandas(run, schema)


class Part(NamedTuple):
    """A partition as its task sees it."""

    idx: int
    attempt: int


def map_partitions_with_part(df: DataFrame, f: Callable[[Part, Iterator], Iterable], schema: str) -> DataFrame:
    def run(frames):
        from pyspark import TaskContext

        task = TaskContext.get()
        return f(Part(task.partitionId(), task.attemptNumber()), frames)

    return df.mapInPandas(run, schema)


def glom(df: DataFrame, key: Key = None) -> DataFrame:
    """One row per non-empty partition: partition, values. For partitions that fit a task, as the whole list does by nature."""
    return df.select(F.spark_partition_id().alias("partition"), as_column(df, key).alias("v")).groupBy("partition").agg(collected(F.col("v")).alias("values"))


def concat(df: DataFrame, column: str, sep: str = "", order_by: str | None = None) -> DataFrame:
    """One string per partition, ``sep`` after every element; ordered by ``order_by`` where given."""
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise ValueError("only strings can be joined")
    order = F.col(order_by) if order_by else F.monotonically_increasing_id()
    rows = df.select(F.spark_partition_id().alias("partition"), F.struct(order.alias("o"), F.col(column).alias("v")).alias("x"))
    joined = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["v"]), sep), F.lit(sep))
    return rows.groupBy("partition").agg(joined.alias("value"))


def pipe(df: DataFrame, command: str, column: str, writer: Callable[[Any], str] = str, reader: Callable[[str], Any] | None = None, schema: str = "value string") -> DataFrame:
    """Each partition's values through an external program, one line each; a failing program fails the task. ``writer`` makes a line of a value, ``reader``
    a row (a tuple by ``schema``) of a line that came back."""
    lines = df.select(column).rdd.map(lambda r: writer(r[0])).pipe(command, checkCode=True)
    return lines.map(reader or (lambda x: (x,))).toDF(schema)


def filter_(df: DataFrame, condition: Column | Callable | None = None, column: str | None = None) -> DataFrame:
    """Rows that meet the condition; without one, rows whose ``column`` (or only column) is true as Python sees it."""
    if condition is None:
        name = column or df.columns[0]
        return df.where(truthy(F.col(name), df.schema[name].dataType))
    return df.where(as_column(df, condition))


starfilter = filter_


def mask_partitions(df: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Rows of the partitions whose number meets the condition."""
    return df.where(keep(F.spark_partition_id()))


def key_by(df: DataFrame, key: Key) -> DataFrame:
    return df.select(as_column(df, key).alias("key"), as_column(df, None).alias("value"))


def with_value(df: DataFrame, value: Any) -> DataFrame:
    """key: the row; value: a column of it or a constant."""
    made = as_column(df, value) if isinstance(value, Column) or callable(value) else F.lit(value)
    return df.select(as_column(df, None).alias("key"), made.alias("value"))


def key_by_id(df: DataFrame) -> DataFrame:
    """Unique, not dense: 64-bit numbers that need no job."""
    return df.select(F.monotonically_increasing_id().alias("key"), as_column(df, None).alias("value"))


def key_by_idx(df: DataFrame, order_by: Key = None) -> DataFrame:
    """Dense numbers from 0, by ``order_by`` (ties in any order) or else by position. The rows are written once with their place in their partition, so that
    counts and numbers are of one execution; offsets are a number a partition, and no task sees all rows."""
    value = as_column(df, None).alias("value")
    if order_by is not None:
        df = df.select(as_column(df, order_by).alias("o"), value).orderBy("o")
        value = F.col("value")
    # The partition's number is in the upper bits, the place in the lower 33.
    placed = stored(df.select(F.monotonically_increasing_id().alias("m"), value), "numbered")
    part, place = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    before, seen = [], 0
    for r in sorted(placed.groupBy(part.alias("p")).count().collect()):
        before += [F.lit(r["p"]), F.lit(seen)]
        seen += r["count"]
    start = F.create_map(*before)[part] if before else F.lit(0)
    return placed.select((start + place).cast("long").alias("key"), "value")


def keys(df: DataFrame) -> DataFrame:
    return df.select("key")


def values(df: DataFrame) -> DataFrame:
    return df.select("value")


def map_keys(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("key", f(F.col("key")))


def map_values(df: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return df.withColumn("value", f(F.col("value")))


def pluck_values(df: DataFrame, index: int | str, default: Any = None) -> DataFrame:
    """The item ``index`` of each value."""
    item = pluck(df.select("value"), index, "value", default).columns
    kind = df.schema["value"].dataType
    got = F.col("value")[index] if isinstance(kind, T.StructType) else F.try_element_at("value", F.lit(index + 1 if isinstance(kind, T.ArrayType) else index))
    return df.select("key", (got if default is None else F.coalesce(got, F.lit(default))).alias(item[0]))


def pluck_each_value(df: DataFrame, index: int | str) -> DataFrame:
    """The item ``index`` of every member of each value (an array)."""
    return df.select("key", F.transform("value", lambda x: x[index]).alias("value"))


def flatmap_values(df: DataFrame, f: Callable[[Column], Column] | None = None, keep_keys: bool = False) -> DataFrame:
    """Members of the values; without the keys unless asked for."""
    value = F.explode(f(F.col("value")) if f else F.col("value")).alias("value")
    return df.select("key", value) if keep_keys else df.select(value)


def filter_bykey(df: DataFrame, f: Callable[[Column], Column] | None = None) -> DataFrame:
    return df.where(f(F.col("key"))) if f else filter_(df, column="key")


def filter_byvalue(df: DataFrame, f: Callable[[Column], Column] | None = None) -> DataFrame:
    return df.where(f(F.col("value"))) if f else filter_(df, column="value")


def as_dataframe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A struct ``value`` as columns of its own, renamed where names are given."""
    if len(df.columns) == 1 and isinstance(df.schema[0].dataType, T.StructType):
        df = df.select(f"{df.columns[0]}.*")
    return df.toDF(*columns) if columns else df


def column(df: DataFrame, name: str) -> DataFrame:
    if name not in df.columns:
        raise KeyError(name)
    return df.select(name)


def assign(df: DataFrame, other: DataFrame | None = None, **made: Column | Callable) -> DataFrame:
    """New columns, added in the order of their names; before them those of ``other``, row by row by position. A column of ``other`` takes the place of one
    of that name."""
    if other is not None:
        own = [f"value.`{c}`" for c in df.columns if c not in other.columns]
        left, right = (key_by_idx(x.select(F.struct(*x.columns).alias("row"))) for x in (df, other))
        if left.count() != right.count():
            raise ValueError("the datasets differ in length")
        df = left.join(right.withColumnRenamed("value", "other"), "key").select(*own, "other.*")
    return df.withColumns({k: as_column(df, made[k]) for k in sorted(made)})


def from_sample(df: DataFrame, sample) -> DataFrame:
    """``df`` with the names and types of a pandas sample frame."""
    schema = df.sparkSession.createDataFrame(sample).schema
    return df.toDF(*schema.names).select(*(F.col(f.name).cast(f.dataType) for f in schema.fields))
