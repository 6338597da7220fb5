"""The convention "column name, Column or callable", and truthiness as Python knows it."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Key = str | Column | Sequence[str] | Callable[..., Column] | None


def as_column(df: DataFrame, key: Key) -> Column:
    """A name or list of names as a column (a list as a struct), a callable applied to all columns, None as the whole row."""
    if key is None:
        return F.struct(*df.columns) if len(df.columns) > 1 else F.col(df.columns[0])
    if isinstance(key, Column):
        return key
    if isinstance(key, str):
        return F.col(key)
    if callable(key):
        made = key(*(F.col(c) for c in df.columns))
        if not isinstance(made, Column):
            raise TypeError("a callable must give a Column; for plain Python functions give a schema")
        return made
    return F.struct(*key)


def collected(value: Column) -> Column:
    """All values of a group as an array, nulls too, which ``collect_list`` alone leaves out."""
    return F.transform(F.collect_list(F.struct(value.alias("v"))), lambda x: x["v"])


def truthy(column: Column, kind: T.DataType) -> Column:
    """Python's truth value of a column of this type: null, zero, false and empty are false."""
    if isinstance(kind, T.BooleanType):
        test = column
    elif isinstance(kind, T.NumericType):
        test = column != 0
    elif isinstance(kind, T.StringType | T.BinaryType):
        test = F.length(column) > 0
    elif isinstance(kind, T.ArrayType | T.MapType):
        test = F.size(column) > 0
    else:
        test = column.isNotNull()
    return F.coalesce(test, F.lit(False))


def python_rows(f: Callable[[Any], Any], names: Sequence[str], many: bool = False) -> Callable:
    """An Arrow batch function that applies ``f`` to each row (a value where there is one column, else a tuple) and yields tuples or values."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = columns[0] if len(columns) == 1 else list(zip(*columns, strict=True))
            made = [y for x in rows for y in f(x)] if many else [f(x) for x in rows]
            if len(names) == 1:
                made = [(x,) for x in made]
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in made] for i, n in enumerate(names)})

    return run


# Small column functions for callers that pass functions around.


def identity(x: Column) -> Column:
    return x


def neg(x: Column) -> Column:
    return -x


def inc(x: Column) -> Column:
    return x + 1


def double(x: Column) -> Column:
    return x * 2


def is_even(x: Column) -> Column:
    return x % 2 == 0


def is_odd(x: Column) -> Column:
    return x % 2 != 0


def all_equal(x: Column) -> Column:
    """Whether the members of an array are one value; true for an empty one."""
    return F.size(F.array_distinct(x)) <= 1
