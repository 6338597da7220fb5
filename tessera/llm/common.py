"""What the operators share: tables, the shared folder, Arrow batches and bit tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import bucketed, freed_shuffles, release, shared_dir, stored, written  # noqa: F401 -- for the operators and their callers

#: Cells of a bit table: at least one 4 KB bucket, at most 2^30 (128 MB, the proven bound of its broadcast).
MIN_CELLS, MAX_CELLS = 1 << 15, 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_batches(df: DataFrame, f: Callable, schema, keep: str = "") -> DataFrame:
    """``df.mapInArrow`` in small Arrow batches, after which the worker keeps no cache but ``keep``."""
    _bound_batches(df.sparkSession)
    return df.mapInArrow(tidied(f, keep), schema)


#: A table of fewer bytes of files may be one row group, which one task would read: it is dealt out to all cores before costly Python.
SMALL_BYTES = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


#: Bytes of an Arrow batch between the JVM and Python: it exists on both sides, once for each task.
ARROW_BYTES = 4 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Lowers Spark's default bound on Arrow batches (64 MB) to ARROW_BYTES for the session, as every operator does; a bound that was set is left. Whole texts
    would else take an executor's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(ARROW_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """A text column as Python strings, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def small_batches(batches: Iterable[pa.RecordBatch], max_bytes: int = 4 << 20, max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``max_bytes`` at most (one row may be larger), so that memory does not follow the text length."""
    for batch in batches:
        start, rows = 0, batch.num_rows
        step = max(1, min(max_rows, int(rows * max_bytes / max(1, batch.nbytes))))
        while start < rows:
            yield batch.slice(start, step)
            start += step


def bit_cells(hashed: Column, cells: int) -> tuple[Column, Column]:
    """Two cell numbers from the low and the high half of a 64-bit hash."""
    return hashed.bitwiseAND(F.lit(cells - 1)), F.shiftrightunsigned(hashed, 33).bitwiseAND(F.lit(cells - 1))


def cell_count(rows: int) -> int:
    """A power of two, 16 cells a row, within MIN_CELLS and MAX_CELLS. Beyond that the table fills up: more rows test positive, none is lost."""
    return min(MAX_CELLS, max(MIN_CELLS, 1 << max(0, 16 * rows - 1).bit_length()))


def bit_table(cells: DataFrame) -> DataFrame:
    """A Bloom filter as rows (bucket, bits of 32,768 cells), built by buckets on the executors. cells: column ``cell``."""
    bucket = F.floor(F.col("cell") / 32768).cast("long").alias("bucket")
    return cells.select(bucket, (F.col("cell") % 32768).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def probe(df: DataFrame, bits: DataFrame, cells: tuple[Column, ...], into: str) -> DataFrame:
    """``df`` with the boolean ``into``: whether all cells are set. The table is broadcast: MAX_CELLS / 8 bytes at most."""
    columns = df.columns
    hit = F.lit(True)
    for i, cell in enumerate(cells):
        bucket, byte, bit = f"__bucket{i}", f"__bits{i}", (cell % 8).cast("int")
        at = (F.floor((cell % 32768) / 8) + 1).cast("int")
        df = df.withColumn(bucket, F.floor(cell / 32768).cast("long"))
        df = df.join(F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(byte))), bucket, "left")
        value = F.conv(F.hex(F.substring(F.col(byte), at, F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(F.call_function("getbit", value, bit) == 1, F.lit(False))
    return df.select(*columns, hit.alias(into))


#: Python workers serve one operator after another; what one keeps from batch to batch is let go when another begins.
_caches: dict[str, Callable[[], object]] = {}


def keeps(name: str, clear: Callable[[], object]) -> None:
    """Registers the cache of an operator's module, by what empties it."""
    _caches[name] = clear


def begin(name: str = "") -> None:
    """Called first in a task of an operator: empties the caches of the others."""
    for other, clear in _caches.items():
        if other != name:
            clear()
    trim()


#: Of libc's mallopt: allocations from LARGE_BYTES on are mappings of their own, which go back at once when they are freed.
M_MMAP_THRESHOLD, LARGE_BYTES = -3, 1 << 20


def trim() -> None:
    """Gives free memory back to the machine, which a worker would else hold until it ends."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(M_MMAP_THRESHOLD, LARGE_BYTES)
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass


def tidy(f: Callable) -> Callable:
    """``f`` of a group, after which the worker holds no more than the result."""

    def run(*tables):
        begin()
        out = f(*tables)
        begin()
        return out

    # Spark tells functions of one and of two tables apart by their parameters.
    if f.__code__.co_argcount == 1:
        return lambda table: run(table)
    return lambda left, right: run(left, right)


def tidied(f: Callable, keep: str = "") -> Callable:
    """``f`` of a partition's batches, after which the worker holds the cache ``keep`` at most."""

    def run(batches):
        yield from f(batches)
        begin(keep)

    return run


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (one column, stored): only rows that a bit table lets pass are joined, the others stay where they are."""
    ids = ids.toDF("id").filter("id IS NOT NULL").distinct()
    cells = cell_count(ids.count())
    hashed = F.xxhash64("id")
    bits = bit_table(ids.select(F.explode(F.array(*bit_cells(hashed, cells))).alias("cell")))
    rows = docs.select(quoted(id_col).alias("id"), F.struct(*(quoted(c) for c in docs.columns)).alias("row"))
    probed = probe(rows, bits, bit_cells(hashed, cells), "maybe")
    sure = probed.filter("id IS NULL OR NOT maybe").select("row.*")
    return sure.unionByName(probed.filter("id IS NOT NULL AND maybe").join(ids, "id", "left_anti").select("row.*"))


#: A group counts as hot beyond this share of all rows. Fewer than 1 / HOT_SHARE groups can be: that bounds the broadcast.
HOT_SHARE = 0.001


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group (one row a key, ``size`` its rows, of ``total``): hot groups are broadcast, the rest joins by shuffle, so
    that no key brings more than a thousandth of all rows to a task. Both frames should be stored: they are read twice."""
    limit = max(1000, int(total * HOT_SHARE))
    hot = F.broadcast(groups.filter(F.col(size) > limit))
    cold = groups.filter(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
