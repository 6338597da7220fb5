"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: its weight's share of the target size over its own rows. A row's number of copies is a Poisson
variable of that mean, inverted from uniform numbers that a hash of the seed, the id and the text gives: the same row always gets the same
count, whatever the partitioning and however often a task is repeated. Rows are exploded by their count and shuffled globally by a hash of
(seed, id, text, copy) that leaves no trace of source or input order.

A rate above CHUNK is split into equal parts whose Poisson counts add up, so that the inversion stays short and exact for any rate.

The rates are one row a source. They are broadcast when there are at most BROADCAST_SOURCES of them (counted first); beyond that the join is
salted, so that a source with a third of all rows is spread over SALTS tasks.

Defined results: a null source is a source of its own; a source of weight zero or without a weight (where weights are given) yields no row;
repeated rows get the same counts each; an empty table gives an empty result; other columns are carried and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, quoted

CHUNK = 8.0
#: Terms of the inverted distribution: beyond 60 at a mean of 8 lies less than 1e-27, below the 2^-52 step of the uniforms.
TERMS = 60
BROADCAST_SOURCES, SALTS = 10_000, 32
SEED = "mix-1"


def rates(docs: DataFrame, source_col: str = "source", weights: dict[str | None, float] | None = None, target_rows: float | None = None, power: float = 0.5) -> DataFrame:
    """One row a source: source, n, rate. Without ``weights`` a source of n rows weighs n ** power; without ``target_rows`` the size stays."""
    sizes = docs.groupBy(quoted(source_col).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(power))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name).cast("string")), F.lit(float(w))).otherwise(weight)
    sizes = sizes.select("source", "n", weight.alias("weight"))
    total = sizes.agg(F.sum("weight").alias("weights"), F.sum("n").alias("rows")).first()
    target = float(total.rows or 0) if target_rows is None else float(target_rows)
    rate = F.when(F.col("weight") > 0, F.col("weight") / F.lit(total.weights) * F.lit(target) / F.col("n")).otherwise(F.lit(0.0))
    return sizes.select("source", "n", rate.alias("rate"))


def _cdf(mean):
    """The first TERMS values of the Poisson distribution function, as an array."""
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("all"))

    def step(acc, j):
        p = acc["p"] * mean / j
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS - 1)), start, step, lambda acc: acc["all"])


def _uniform(key):
    """A number in [0, 1) of 52 bits from the hash of ``key``."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def counted(docs: DataFrame, by_source: DataFrame, id_col: str, text_col: str, source_col: str, seed: str = SEED) -> DataFrame:
    """(row: all columns as a struct, key: its hash key, copies)."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK).cast("int"))
    table = by_source.select("source", parts.alias("parts"), _cdf(F.col("rate") / parts).alias("cdf"))
    key = F.concat_ws("|", F.lit(seed), F.coalesce(quoted(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(quoted(text_col), F.lit(""))))
    rows = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), quoted(source_col).alias("own"), key.alias("key"))
    if table.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), F.col("own").eqNullSafe(F.col("source")))
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("own_salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, F.col("own").eqNullSafe(F.col("source")) & (F.col("own_salt") == F.col("salt")))
    # The uniform number is bound by a one-element array, else it is hashed again for every term.
    drawn = lambda c: F.array(_uniform(F.concat_ws("|", F.col("key"), c.cast("string"))))
    one = lambda c: F.transform(drawn(c), lambda u: F.size(F.filter(F.col("cdf"), lambda x: x <= u)))[0]
    copies = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda acc, c: acc + one(c))
    return joined.select("row", "key", copies.alias("copies"))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(row, copy from 1, shuffle_key), globally shuffled: partitions follow ranges of the key and are sorted by it."""
    by_source = rates(docs, source_col, weights, **options)
    rows = counted(docs, by_source, id_col, text_col, source_col).filter("copies > 0")
    each = rows.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    each = each.select("row", "copy", F.md5(F.concat_ws("|", "key", F.lit("copy"), F.col("copy").cast("string"))).alias("shuffle_key"))
    # A hash partition of a uniform key is as global a shuffle as ranges of it, and needs no sampling pass over the texts.
    return each.repartition(partitions(docs.sparkSession), "shuffle_key").sortWithinPartitions("shuffle_key")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """The mixed rows with the columns of ``docs``."""
    return replicate(docs, weights, **options).select("row.*")


def report(docs: DataFrame, weights: dict[str | None, float] | None = None, **options) -> DataFrame:
    """The mixed rows as doc_id, source, text_sha256, copy, shuffle_key."""
    own = docs.select("doc_id", "source", "text")
    return replicate(own, weights, **options).select("row.doc_id", "row.source", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("text_sha256"), "copy", "shuffle_key")


SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, count(*) AS n, pow(count(*), 0.5) AS weight FROM documents GROUP BY source),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate FROM sizes),
parts AS (SELECT source, rate / greatest(1, ceil(rate / {CHUNK})) AS mean, CAST(greatest(1, ceil(rate / {CHUNK})) AS INT) AS parts FROM rates),
cdf AS (
  SELECT source, mean, 0 AS j, exp(-mean) AS p, exp(-mean) AS total FROM parts
  UNION ALL
  SELECT source, mean, j + 1, p * mean / (j + 1), total + p * mean / (j + 1) FROM cdf WHERE j < {TERMS - 1}),
keyed AS (
  SELECT doc_id, d.source, text, concat('{SEED}|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, ''))) AS key, parts
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
drawn AS (
  SELECT doc_id, source, text, key, CAST(('0x' || substr(md5(key || '|' || c), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM (SELECT *, unnest(range(1, parts + 1)) AS c FROM keyed)),
copies AS (
  SELECT doc_id, d.source, text, key, count(t.total) AS n
  FROM drawn d LEFT JOIN cdf t ON d.source IS NOT DISTINCT FROM t.source AND t.total <= d.u
  GROUP BY doc_id, d.source, text, key)
SELECT doc_id, source, sha256(coalesce(text, '')) AS text_sha256, CAST(copy AS INT) AS copy, md5(key || '|copy|' || copy) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM copies)
"""
