"""Moments of numbers and vectors in one pass, and histograms with closed last bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moment_columns(x: Column) -> list[Column]:
    """Count, mean, extremes, population and sample variance and deviation, population skewness and excess kurtosis."""
    x = x.cast("double")
    made = {
        "count": F.count(x), "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "variance": F.var_pop(x), "stdev": F.stddev_pop(x),
        "sample_variance": F.var_samp(x), "sample_stdev": F.stddev_samp(x), "skew": F.skewness(x), "kurtosis": F.kurtosis(x),
    }
    return [v.alias(k) for k, v in made.items()]


def stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """The moments of a column, of each group where ``by`` is given."""
    return df.groupBy(*(by or [])).agg(*moment_columns(F.col(column)))


def mvstats(df: DataFrame, column: str, width: int | None = None) -> DataFrame:
    """The moments of each component of a vector column, by ``pos`` from 0. With ``width`` a vector of another length fails the job; else it counts where it
    has components."""
    if width is not None:
        wrong = F.concat(F.lit(f"a vector has not {width} components but "), F.size(column).cast("string"))
        df = df.select(F.when(F.size(column) != width, F.raise_error(wrong).cast(df.schema[column].dataType)).otherwise(F.col(column)).alias(column))
    return df.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(*moment_columns(F.col("x")))


def histogram(df: DataFrame, column: str, bins: int | list[float] = 10) -> DataFrame:
    """bin, low, high, count of each bin, empty ones too. A number of bins spans the extremes (one job more); a list gives the edges. Bins are half-open
    but for the last, which holds its upper edge; values outside given edges are left out."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    spark = df.sparkSession
    if isinstance(bins, int):
        low, high = rows.agg(F.min("x"), F.max("x")).first()
        if low is None:
            raise ValueError("dataset is empty")
        n = 1 if low == high else bins
        step = (high - low) / n
        edges = [low + i * step for i in range(n)] + [high]
        number = F.least(F.floor((F.col("x") - low) / F.lit(step)).cast("int"), F.lit(n - 1)) if n > 1 else F.lit(0)
        counted = rows.select(number.alias("bin")).groupBy("bin").count()
    else:
        edges = sorted(set(map(float, bins)))
        inside = rows.where((F.col("x") >= edges[0]) & (F.col("x") <= edges[-1]))
        number = F.least(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("x"))) - 1, F.lit(len(edges) - 2))
        counted = inside.select(number.alias("bin")).groupBy("bin").count()
    every = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))], "bin int, low double, high double")
    return every.join(counted, "bin", "left").select("bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count"))
