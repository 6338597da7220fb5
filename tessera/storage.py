"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a Parquet row group of an intermediate table: a writing task holds one in memory.
ROW_GROUP_BYTES = 16 << 20

_written: list[str] = []
#: Names of the tables that are registered, by path.
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local master may leave it unset and gets a temporary one; elsewhere executors could not read it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """``stored`` in buckets of ``keys``, as many as a shuffle has partitions: what groups by the keys reads them where they lie. Spark knows buckets of
    registered tables only, so the table has a name until ``release``."""
    spark, unique = df.sparkSession, uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/{name}-{unique}", f"tessera_{unique}"
    _written.append(path)
    _tables[path] = table
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("path", path)
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).saveAsTable(table, format="parquet")
    return spark.table(table)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: Spark deletes them when the write ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written() -> int:
    """How many tables ``stored`` has written and ``release`` has left."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, but: int = 0) -> int:
    """Deletes what ``stored`` has written in this driver after the first ``since`` tables, except the last ``but`` ones, and returns the number of folders;
    for when no result that reads them is used any more."""
    n, jvm = 0, spark.sparkContext._jvm
    last = _written[len(_written) - but :]
    del _written[len(_written) - but :]
    while len(_written) > since:
        name = _written.pop()
        if name in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(name)}")
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _written.extend(last)
    return n
