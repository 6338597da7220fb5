"""Sources: ranges, driver collections, files by name, lines, CSV, Parquet."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a folder; filters and columns are pushed into its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_(spark: SparkSession, start: int, stop: int | None = None, step: int = 1, pcount: int | None = None) -> DataFrame:
    """Integers as ``id``; one argument is the stop. Partition i holds positions i*n/p up to (i+1)*n/p."""
    if stop is None:
        start, stop = 0, start
    return spark.range(start, stop, step, pcount)


def collection(spark: SparkSession, items: Iterable[Any], schema=None, pcount: int | None = None, psize: int | None = None) -> DataFrame:
    """Driver data as a frame: a mapping gives its items, a range stays lazy. ``pcount`` partitions or ``psize`` rows in each, not both."""
    if pcount is not None and psize is not None:
        raise ValueError("give pcount or psize, not both")
    if (pcount is not None and pcount <= 0) or (psize is not None and psize <= 0):
        raise ValueError("pcount and psize must be positive")
    if isinstance(items, range):
        return range_(spark, items.start, items.stop, items.step, pcount or (math.ceil(len(items) / psize) if psize and len(items) else None))
    rows = list(items.items() if isinstance(items, Mapping) else items)
    slices = pcount or (max(1, math.ceil(len(rows) / psize)) if psize else None)
    if isinstance(items, Mapping) and schema is None:
        schema = ["key", "value"]
    rows = [x if isinstance(x, tuple | list | dict) or hasattr(x, "asDict") else (x,) for x in rows]
    if schema is None and rows and isinstance(rows[0], tuple) and len(rows[0]) == 1:
        schema = ["value"]
    if slices is None:
        return spark.createDataFrame(rows, schema)
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, slices), schema)


def files(
    spark: SparkSession,
    root: str | list[str],
    recursive: bool = True,
    name_glob: str | None = None,
    keep: Callable[[Column], Column] | None = None,
    psize_files: int | None = None,
    psize_bytes: int | None = None,
    keep_folder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """path, modificationTime, length, content of each file. ``name_glob`` prunes the listing, ``keep`` is a condition on the path, ``keep_folder`` one on the
    path of its folder. With ``psize_files`` partitions hold about so many files, with ``psize_bytes`` about so many bytes; otherwise they are packed by size."""
    if psize_files and psize_bytes:
        raise ValueError("give psize_files or psize_bytes, not both")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    found = reader.load(root)
    if keep:
        found = found.where(keep(F.col("path")))
    if keep_folder:
        found = found.where(keep_folder(F.regexp_replace("path", "/[^/]*$", "")))
    if psize_files:
        return found.repartition(max(1, math.ceil(found.select("path").count() / psize_files)), "path")
    if psize_bytes:  # length comes from the listing: no file is opened for it
        return found.repartition(max(1, math.ceil(total_size(found) / psize_bytes)), "path")
    return found


def chunks(content: DataFrame, size: int) -> DataFrame:
    """Each file's content in pieces of ``size`` bytes: path, part, content."""
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / size).cast("int"))
    parts = content.select("path", "content", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return parts.select("path", "part", F.substring("content", F.col("part") * size + 1, F.lit(size)).alias("content"))


def decode(content: DataFrame, encoding: str = "utf-8", errors: str | None = None) -> DataFrame:
    """``content`` as a string. ``errors`` takes Python's codecs and their error handlers ("strict", "ignore", "replace", ...)."""
    if errors is None:
        return content.withColumn("content", F.decode("content", encoding.upper()))
    return _mapped(content, "content", lambda x: x.decode(encoding, errors), T.StringType())


def _mapped(df: DataFrame, name: str, f: Callable[[bytes], Any], kind: T.DataType) -> DataFrame:
    """``df`` with ``f`` of each value of one column, nulls left, in Arrow batches."""
    at = df.columns.index(name)
    schema = T.StructType([T.StructField(name, kind) if i == at else x for i, x in enumerate(df.schema.fields)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = pa.array([None if x is None else f(x) for x in batch.column(at).to_pylist()], pa.string() if isinstance(kind, T.StringType) else pa.binary())
            yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return df.mapInArrow(run, schema)


def split_content(content: DataFrame, separator: str) -> DataFrame:
    """Decoded contents cut at ``separator``: path, value."""
    return content.select("path", F.explode(F.split("content", _literal(separator))).alias("value"))


def _literal(text: str) -> str:
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def lines(spark: SparkSession, root: str | list[str], keepends: bool = False, separator: str | None = None, recursive: bool = True, encoding: str = "utf-8", errors: str | None = None) -> DataFrame:
    """``value``: lines of text files. UTF-8 files without their terminators are read in splits, compressed ones opened by their suffix.

    ``keepends`` (terminators as they are in the file), other encodings and error handlers read each file whole, in one task.
    """
    if not keepends and encoding.lower().replace("_", "-") in ("utf-8", "utf8") and errors is None:
        reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
        return (reader.option("lineSep", separator) if separator else reader).text(root)

    def run(batches):
        import re

        import pyarrow as pa

        cut = re.compile(re.escape(separator) if separator else "\r\n|\r|\n")
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                text, at = x.decode(encoding, errors or "strict"), 0
                for m in cut.finditer(text):
                    out.append(text[at : m.end() if keepends else m.start()])
                    at = m.end()
                if at < len(text):
                    out.append(text[at:])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    return files(spark, root, recursive).select("content").mapInArrow(run, "value string")


def decompress(content: DataFrame, codec: str | None = "gzip") -> DataFrame:
    """``content`` unpacked: gzip or lz4 (frame); None leaves it."""
    if codec is None:
        return content
    if codec not in ("gzip", "lz4"):
        raise ValueError(f"unknown codec {codec!r}")
    def plain(x: bytes) -> bytes:
        import pyarrow as pa

        return pa.CompressedInputStream(pa.BufferReader(x), codec).read()

    return _mapped(content, "content", plain, T.BinaryType())


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, header: bool = True, **options: Any) -> DataFrame:
    """CSV files, each with its own header; give a schema to avoid the inference pass."""
    reader = spark.read.options(header=header, **options)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


#: A CSV record: quoted parts, which may hold line ends, and plain ones. Possessive, so that it never goes back.
_RECORD = r'(?:"(?:[^"\\]++|\\.)*+"|[^"\r\n]++|")++'


def parse_csv(df: DataFrame, schema: str, column: str = "value", **options: Any) -> DataFrame:
    """Each value is CSV text of one or more lines without header: its rows by ``schema``. Quoted fields may hold line ends."""
    records = F.regexp_extract_all(column, F.lit(_RECORD), F.lit(0))
    return df.select(F.explode(records).alias("line")).select(F.from_csv("line", schema, options).alias("row")).select("row.*")


def filenames(df: DataFrame) -> list[str]:
    return df.inputFiles()


def file_count(content: DataFrame) -> int:
    return content.select("path").distinct().count()


def total_size(content: DataFrame) -> int:
    return content.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
