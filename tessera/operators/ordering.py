"""Sorting, top-n, sampling and partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import Key, as_column


def sort(df: DataFrame, key: Key = None, reverse: bool = False, pcount: int | None = None) -> DataFrame:
    """A global sort: ranges from a sample, then a sort inside each."""
    order = as_column(df, key)
    order = order.desc() if reverse else order.asc()
    return df.orderBy(order) if pcount is None else df.repartitionByRange(pcount, order).sortWithinPartitions(order)


def nlargest(df: DataFrame, n: int, key: Key = None, ties: list[str] | None = None) -> DataFrame:
    """Each partition keeps its n best before any row moves."""
    return df.orderBy(as_column(df, key).desc(), *map(F.asc, ties or [])).limit(n)


def nsmallest(df: DataFrame, n: int, key: Key = None, ties: list[str] | None = None) -> DataFrame:
    return df.orderBy(as_column(df, key).asc(), *map(F.asc, ties or [])).limit(n)


def take(df: DataFrame, n: int) -> list[Row]:
    return df.take(n)


def itake(df: DataFrame, n: int) -> Iterator[Row]:
    return df.limit(n).toLocalIterator()


def first(df: DataFrame) -> Row:
    row = df.first()
    if row is None:
        raise ValueError("dataset is empty")
    return row


def sample(df: DataFrame, fraction: float, with_replacement: bool = False, seed: int | None = None) -> DataFrame:
    if not 0 <= fraction <= 1:
        raise ValueError("fraction must be between 0 and 1")
    if fraction == 0:
        return df.limit(0)
    if fraction == 1 and not with_replacement:
        return df
    return df.sample(with_replacement, fraction, seed)


def sample_by_hash(df: DataFrame, fraction: float, seed: str = "") -> DataFrame:
    """A sample that depends on the rows only, not on their partitions: rows whose hash falls into the fraction."""
    key = F.md5(F.concat_ws("|", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns)))
    return df.where(F.conv(F.substring(key, 1, 13), 16, 10).cast("long") < F.lit(int(fraction * (1 << 52))))


def sample_by(df: DataFrame, column: str, fractions: dict, seed: int | None = None) -> DataFrame:
    """A fraction for each stratum; other strata are left out."""
    return df.sampleBy(column, fractions, seed)


def take_sample(df: DataFrame, num: int, with_replacement: bool = False, seed: int | None = None) -> list[Row]:
    return df.rdd.takeSample(with_replacement, num, seed)


def shuffle(df: DataFrame, pcount: int, key: Key = None, partitioner: Callable[[Column], Column] | None = None, sorted_: bool = True) -> DataFrame:
    """Rows dealt by key hash, or to the partition that ``partitioner`` numbers (modulo pcount), sorted by key inside each unless told otherwise."""
    column = as_column(df, key)
    dealt = df.repartitionById(pcount, F.pmod(partitioner(column), F.lit(pcount)).cast("int")) if partitioner else df.repartition(pcount, column)
    return dealt.sortWithinPartitions(column) if sorted_ else dealt


def coalesce_parts(df: DataFrame, pcount: int) -> DataFrame:
    """Neighbouring partitions merged without a shuffle."""
    if pcount < 1:
        raise ValueError("pcount must be positive")
    return df.coalesce(pcount)
