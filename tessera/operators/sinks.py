"""Actions that bring rows to the driver or write them. The collect_* writers stream partitions through the driver, the save_* ones write on executors."""

from __future__ import annotations

import gzip
import json
import pickle
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import Key, as_column


def collect(df: DataFrame, parts: bool = False) -> list:
    return df.rdd.glom().collect() if parts else df.collect()


def icollect(df: DataFrame) -> Iterator[Row]:
    """Rows in order, one partition at a time, the next one fetched ahead."""
    return df.toLocalIterator(prefetchPartitions=True)


def collect_as_map(df: DataFrame, parts: bool = False) -> dict | list[dict]:
    """key to value; of equal keys the largest value, so the result does not depend on order. With ``parts`` a map for each partition, of equal keys the
    last value."""
    if parts:
        return [{r.key: r.value for r in rows} for _, rows in _numbered(df.select("key", "value"))]
    return {r.key: r.value for r in df.groupBy("key").agg(F.max("value").alias("value")).collect()}


def collect_as_set(df: DataFrame, key: Key = None) -> set:
    return {r[0] for r in df.select(as_column(df, key).alias("v")).distinct().collect()}


def execute(df: DataFrame) -> None:
    """Runs the plan for its side effects."""
    df.write.format("noop").mode("overwrite").save()


def _numbered(df: DataFrame) -> Iterator[tuple[int, list[Row]]]:
    """Partition by partition: one is on the driver at a time."""
    n = df.rdd.getNumPartitions()
    for i in range(n):
        yield i, df.sparkSession.sparkContext.runJob(df.rdd, list, [i])


def _write(path: Path, data: bytes, compression: str | None) -> None:
    if compression not in (None, "gzip"):
        raise ValueError(f"unknown compression {compression!r}")
    path = path.with_name(path.name + (".gz" if compression else ""))
    path.write_bytes(gzip.compress(data) if compression else data)


def collect_as_files(df: DataFrame, directory: str, column: str = "value", ext: str = "", sep: str = "\n", compression: str | None = None) -> None:
    """One file per partition, ``<number><ext>``, in a folder of the driver: strings or bytes, each followed by ``sep``."""
    Path(directory).mkdir(parents=True, exist_ok=True)
    for i, rows in _numbered(df.select(column)):
        data = b"".join((r[0] if isinstance(r[0], bytes | bytearray) else str(r[0]).encode()) + sep.encode() for r in rows)
        _write(Path(directory) / f"{i}{ext}", data, compression)


def collect_as_json(df: DataFrame, directory: str, compression: str | None = None) -> None:
    collect_as_files(df.select(F.to_json(F.struct(*df.columns)).alias("value")), directory, ext=".json", compression=compression)


def collect_as_pickles(df: DataFrame, directory: str, compression: str | None = None) -> None:
    Path(directory).mkdir(parents=True, exist_ok=True)
    for i, rows in _numbered(df):
        _write(Path(directory) / f"{i}.p", pickle.dumps([tuple(r) for r in rows], 4), compression)


def save_as_files(df: DataFrame, path: str, column: str = "value", compression: str | None = None, sep: str = "\n") -> None:
    """One file per partition, written on the executors: strings, each followed by ``sep``."""
    if compression not in (None, "gzip", "lz4"):
        raise ValueError(f"unknown compression {compression!r}")
    df.select(F.col(column).cast("string").alias("value")).write.text(path, compression=compression, lineSep=sep)


def save_as_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.json(path, compression=compression)


def save_as_pickles(df: DataFrame, path: str) -> None:
    df.rdd.map(tuple).saveAsPickleFile(path)


def load_pickles(spark, path: str, schema: str) -> DataFrame:
    return spark.sparkContext.pickleFile(path).toDF(schema)


def save_as_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.partitionBy(*(partition_by or [])).parquet(path)


def to_pandas(df: DataFrame, n: int | None = None):
    """A pandas frame of all rows, or of n of them."""
    return (df if n is None else df.limit(n)).toPandas()


def read_json_lines(directory: str) -> list[Any]:
    """Rows that collect_as_json wrote, by file number."""
    found = sorted(Path(directory).iterdir(), key=lambda p: int(p.name.partition(".")[0]))
    texts = (gzip.decompress(p.read_bytes()) if p.suffix == ".gz" else p.read_bytes() for p in found)
    return [json.loads(x) for t in texts for x in t.decode().splitlines()]
