"""Registered queries of the dataset algebra, each beside its SQL oracle."""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import combine, elements, keyed, moments, ordering, reduce, shared, sinks
from tessera.sources import collection, range_, table
from tessera.storage import shared_dir

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def query(sql: str | None = None):
    """Register the function under its own name, with the SQL that must give the same rows."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return keep


def _exact(column: Column) -> Column:
    """Decimal, so that sums do not depend on their order."""
    return column.cast("decimal(18,4)")


def _one(spark: SparkSession, **values) -> DataFrame:
    """One row of driver values."""
    return spark.createDataFrame([tuple(values.values())], list(values))


def _kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("value"), "o_orderkey")


@query(
    """
    WITH rev AS (
      SELECT c_nationkey, c_custkey, CAST(SUM(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
      FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
      GROUP BY c_nationkey, c_custkey),
    best AS (
      SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY revenue DESC, c_custkey) AS rn FROM rev)
    SELECT n_name, c_custkey, revenue, CAST(rn AS BIGINT) AS rn
    FROM best JOIN nation ON c_nationkey = n_nationkey WHERE rn <= 3
    """
)
def flagship_top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("amount")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    revenue = line.join(orders, "o_orderkey").join(customer, "c_custkey").groupBy("c_nationkey", "c_custkey").agg(F.sum("amount").cast("double").alias("value"))
    top = keyed.nlargest_by_key(revenue.withColumnRenamed("c_nationkey", "key"), 3, ties=["c_custkey"])
    named = combine.lookup_join(top, nation.withColumnRenamed("c_nationkey", "key"), "key")
    return named.select("n_name", "c_custkey", F.col("value").alias("revenue"), F.col("rank").alias("rn"))


# Elements


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS DOUBLE) AS revenue FROM lineitem")
def map_project(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return elements.map_(line, "l_orderkey", "l_linenumber", _exact(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("revenue"))


@query("SELECT round(l_quantity * l_tax, 4) AS value FROM lineitem")
def starmap_columns(spark, sf_dir):
    return elements.starmap(table(spark, sf_dir, "lineitem").select("l_quantity", "l_tax"), lambda q, t: F.round(q * t, 4))


@query("SELECT o_orderkey * 2 + 1 AS value FROM orders")
def map_python(spark, sf_dir):
    return elements.map_(table(spark, sf_dir, "orders").select("o_orderkey"), lambda x: 2 * x + 1, schema="value long")


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e0, CAST(embedding[6] AS DOUBLE) AS e5 FROM embeddings")
def pluck_fields(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    both = elements.pluck_values(v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("value")), 0).withColumnRenamed("value", "e0")
    more = elements.pluck_values(v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("value")), 5).withColumnRenamed("value", "e5")
    return combine.join(both, more).select(F.col("key").alias("vec_id"), F.col("e0").cast("double"), F.col("e5").cast("double"))


@query("SELECT CAST(coalesce(embedding[100], -1) AS DOUBLE) AS value FROM embeddings")
def pluck_default(spark, sf_dir):
    return elements.pluck(table(spark, sf_dir, "embeddings"), 99, "embedding", default=-1.0).select(F.col("value").cast("double"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word")
def flatmap_words(spark, sf_dir):
    words = elements.flatmap(table(spark, sf_dir, "documents").select("text"), lambda t: F.split(t, " "), name="word")
    return words.groupBy("word").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' AND l_quantity > 30")
def filter_predicate(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return elements.filter_(line, (F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")) & (F.col("l_quantity") > 30)).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM labels WHERE toxic <> 0")
def filter_truthy(spark, sf_dir):
    return elements.filter_(table(spark, sf_dir, "labels"), column="toxic").select("doc_id")


@query("SELECT l_discount, l_tax FROM lineitem WHERE l_discount > l_tax")
def starfilter_two_cols(spark, sf_dir):
    return elements.starfilter(table(spark, sf_dir, "lineitem").select("l_discount", "l_tax"), lambda d, t: d > t)


@query("SELECT CAST(o_orderkey % 7 AS BIGINT) AS key, o_orderkey AS value FROM orders")
def key_by_mod(spark, sf_dir):
    return elements.key_by(table(spark, sf_dir, "orders").select("o_orderkey"), lambda x: x % 7)


@query("SELECT c_custkey AS key, 'x' AS value FROM customer")
def with_value_const(spark, sf_dir):
    return elements.with_value(table(spark, sf_dir, "customer").select("c_custkey"), "x")


@query("SELECT o_totalprice AS key, o_custkey AS value FROM orders")
def keys_values_swap(spark, sf_dir):
    return elements.map_(_kv(spark, sf_dir), F.col("value").alias("key"), F.col("key").alias("value"))


@query("SELECT DISTINCT o_custkey AS key FROM orders")
def keys_distinct(spark, sf_dir):
    return elements.keys(_kv(spark, sf_dir)).distinct()


@query("SELECT upper(c_mktsegment) AS key, c_acctbal AS value FROM customer")
def map_keys_upper(spark, sf_dir):
    pairs = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_acctbal").alias("value"))
    return elements.map_keys(pairs, F.upper)


@query("SELECT doc_id AS key, CAST(length(text) AS BIGINT) AS value FROM documents")
def map_values_len(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    return elements.map_values(pairs, lambda v: F.length(v).cast("long"))


@query("SELECT vec_id AS key, CAST(embedding[2] AS DOUBLE) AS value FROM embeddings")
def pluck_values(spark, sf_dir):
    pairs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("value"))
    return elements.pluck_values(pairs, 1).select("key", F.col("value").cast("double"))


@query("SELECT o_custkey AS key, o_totalprice AS value FROM orders WHERE o_custkey % 10 = 3")
def filter_bykey(spark, sf_dir):
    return elements.filter_bykey(_kv(spark, sf_dir), lambda k: k % 10 == 3).select("key", "value")


@query("SELECT o_custkey AS key, o_totalprice AS value FROM orders WHERE o_totalprice > 200000")
def filter_byvalue(spark, sf_dir):
    return elements.filter_byvalue(_kv(spark, sf_dir), lambda v: v > 200000).select("key", "value")


@query("SELECT CAST(x AS DOUBLE) AS value FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def flatmap_values(spark, sf_dir):
    pairs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("value"))
    return elements.flatmap_values(pairs).select(F.col("value").cast("double"))


@query("SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS key, o_orderkey AS value FROM orders")
def key_by_idx_ordered(spark, sf_dir):
    return elements.key_by_idx(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT count(*) AS ids, count(*) AS rows FROM orders")
def key_by_id_unique(spark, sf_dir):
    return elements.key_by_id(table(spark, sf_dir, "orders").select("o_orderkey")).agg(F.count_distinct("key").alias("ids"), F.count("*").alias("rows"))


@query("SELECT r_name, r_regionkey, CAST(r_regionkey * 10 AS BIGINT) AS a, upper(r_name) AS b FROM region")
def assign_columns(spark, sf_dir):
    return elements.assign(table(spark, sf_dir, "region"), b=F.upper("r_name"), a=(F.col("r_regionkey") * 10).cast("long"))


@query("SELECT count(*) AS n FROM events")
def glom_sizes(spark, sf_dir):
    return elements.glom(table(spark, sf_dir, "events").select("event_id")).agg(F.sum(F.size("values")).alias("n"))


@query("SELECT CAST(sum(length(n_name) + 1) AS BIGINT) AS n FROM nation")
def concat_lengths(spark, sf_dir):
    return elements.concat(table(spark, sf_dir, "nation"), "n_name", "|").agg(F.sum(F.length("value")).alias("n"))


@query("SELECT count(*) AS n, CAST(sum(value) AS DOUBLE) AS total FROM (SELECT CAST(value AS DECIMAL(18,4)) AS value FROM events WHERE event_id % 2 = 0)")
def map_partitions_pandas(spark, sf_dir):
    def even(frames):
        for f in frames:
            yield f[f["event_id"] % 2 == 0][["value"]]

    return elements.map_partitions(table(spark, sf_dir, "events").select("event_id", "value"), even, "value double").agg(
        F.count("*").alias("n"), F.sum(_exact(F.col("value"))).cast("double").alias("total")
    )


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def parse_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT CAST(id AS BIGINT) AS id FROM range(5, 1000, 3) t(id)")
def range_source(spark, sf_dir):
    return range_(spark, 5, 1000, 3, 7)


@query("SELECT CAST(i AS BIGINT) AS key, chr(CAST(97 + i AS INT)) AS value FROM range(26) t(i)")
def collection_source(spark, sf_dir):
    return collection(spark, {i: chr(97 + i) for i in range(26)}, "key long, value string", pcount=4)


# Reductions


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, sf_dir):
    return _one(spark, n=reduce.count(table(spark, sf_dir, "lineitem")))


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM lineitem")
def sum_all(spark, sf_dir):
    return _one(spark, total=float(reduce.sum_(table(spark, sf_dir, "lineitem"), _exact(F.col("l_extendedprice")))))


@query("SELECT round(CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) / count(value), 6) AS mean FROM events")
def mean_all(spark, sf_dir):
    return _one(spark, mean=round(reduce.mean(table(spark, sf_dir, "events"), "value"), 6))


@query("SELECT min(l_shipdate) AS lo, max(l_shipdate) AS hi, min(l_quantity) AS qlo, max(l_quantity) AS qhi FROM lineitem")
def min_max_all(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    days = {"lo": reduce.min_(line, "l_shipdate"), "hi": reduce.max_(line, "l_shipdate")}
    kind = line.schema["l_shipdate"].dataType.simpleString()
    return spark.createDataFrame([(*days.values(), reduce.min_(line, "l_quantity"), reduce.max_(line, "l_quantity"))], f"lo {kind}, hi {kind}, qlo double, qhi double")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def max_by_key(spark, sf_dir):
    best = reduce.max_(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), by=["o_totalprice", "o_orderkey"])
    return _one(spark, **best.asDict())


_MOMENTS = """
SELECT {by} count(x) AS count, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, round(var_pop(x), 4) AS variance, round(stddev_pop(x), 5) AS stdev,
  round(var_samp(x), 4) AS sample_variance, round(stddev_samp(x), 5) AS sample_stdev,
  round((avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*avg(x)*avg(x)*avg(x)) / pow(var_pop(x), 1.5), 4) AS skew, round(kurtosis_pop(x), 4) AS kurtosis
FROM {rows} {group}
"""


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    digits = {"mean": 6, "variance": 4, "stdev": 5, "sample_variance": 4, "sample_stdev": 5, "skew": 4, "kurtosis": 4}
    return df.select(*keys, "count", "min", "max", *(F.round(c, d).alias(c) for c, d in digits.items()))


@query(_MOMENTS.format(by="", rows="(SELECT value AS x FROM events)", group=""))
def stats_moments(spark, sf_dir):
    return _rounded(moments.stats(table(spark, sf_dir, "events"), "value"))


@query(_MOMENTS.format(by="event_type,", rows="(SELECT event_type, value AS x FROM events)", group="GROUP BY event_type"))
def stats_by_group(spark, sf_dir):
    return _rounded(moments.stats(table(spark, sf_dir, "events"), "value", ["event_type"]), "event_type")


@query(
    """
    SELECT CAST(pos - 1 AS INT) AS pos, count(*) AS count, round(avg(x), 6) AS mean, min(x) AS min, max(x) AS max, round(var_pop(x), 6) AS variance
    FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY pos
    """
)
def mvstats_embeddings(spark, sf_dir):
    made = moments.mvstats(table(spark, sf_dir, "embeddings"), "embedding")
    return made.select("pos", "count", F.round("mean", 6).alias("mean"), "min", "max", F.round("variance", 6).alias("variance"))


@query(
    """
    WITH e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INT) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1)
    SELECT CAST(i AS INT) AS bin, coalesce(n, 0) AS count FROM range(20) t(i) LEFT JOIN c ON c.bin = i
    """
)
def histogram_auto(spark, sf_dir):
    return moments.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20).select("bin", "count")


@query(
    """
    SELECT CAST(CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 26 THEN 2 ELSE 3 END AS INT) AS bin, count(*) AS count
    FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1
    """
)
def histogram_edges(spark, sf_dir):
    return moments.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", [1, 10, 25, 26, 50]).select("bin", "count")


@query("SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
def count_distinct_exact(spark, sf_dir):
    return _one(spark, n=reduce.count_distinct(table(spark, sf_dir, "lineitem"), "l_partkey"))


@query("SELECT count(DISTINCT l_partkey) AS n, true AS within FROM lineitem")
def count_distinct_approx(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    n = reduce.count_distinct(line, "l_partkey")
    return _one(spark, n=n, within=all(abs(reduce.count_distinct_approx(line, "l_partkey", rate) - n) <= 4 * rate * n for rate in (0.01, 0.05, 0.2)))


@query("SELECT l_returnflag AS value, count(*) AS count FROM lineitem GROUP BY 1")
def count_by_value(spark, sf_dir):
    return reduce.count_by_value(table(spark, sf_dir, "lineitem"), "l_returnflag")


@query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM lineitem")
def tree_reduce_sum(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return reduce.tree_sum(line, _exact(F.col("l_extendedprice"))).select(F.col("total").cast("double"))


# Keyed


@query("SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1")
def group_by_sizes(spark, sf_dir):
    return keyed.group_by(table(spark, sf_dir, "orders"), "o_custkey").select("key", F.size("values").cast("long").alias("n"))


@query("SELECT n_regionkey AS key, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def group_by_key_sorted(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("value"))
    return keyed.group_by_key(pairs, order=True).select("key", F.array_join("values", ",").alias("names"))


@query("SELECT o_custkey AS key, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS value FROM orders GROUP BY 1")
def aggregate_by_key_sum(spark, sf_dir):
    return keyed.aggregate_by_key(_kv(spark, sf_dir), F.sum(_exact(F.col("value"))).cast("double"))


@query("SELECT event_type AS key, count(*) AS n, max(event_id) AS top FROM events GROUP BY 1")
def aggregate_by_key_pandas(spark, sf_dir):
    def local(f):
        return f.groupby("key", as_index=False).agg(n=("n", "sum"), top=("top", "max"))

    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.lit(1).cast("long").alias("n"), F.col("event_id").alias("top"))
    return keyed.aggregate_by_key(rows, local, schema="key string, n long, top long")


@query("SELECT o_custkey AS key, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS value FROM orders GROUP BY 1")
def combine_by_key_avg(spark, sf_dir):
    pairs = _kv(spark, sf_dir).select("key", F.col("value").cast("decimal(28,4)").alias("value"))
    return keyed.combine_by_key(
        pairs,
        lambda v: F.struct(v.alias("s"), F.lit(1).cast("long").alias("n")),
        lambda a, v: F.struct((a["s"] + v).cast("decimal(28,4)").alias("s"), (a["n"] + 1).alias("n")),
        lambda a, b: F.struct((a["s"] + b["s"]).cast("decimal(28,4)").alias("s"), (a["n"] + b["n"]).alias("n")),
        lambda a: a["s"].cast("double") / a["n"],
    )


@query("SELECT lower(word) AS key, count(*) AS value FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1")
def reduce_by_key_count(spark, sf_dir):
    words = elements.flatmap(table(spark, sf_dir, "documents").select("text"), lambda t: F.split(t, " "))
    return keyed.reduce_by_key(words.select(F.lower("value").alias("key"), F.lit(1).alias("value")), "sum")


_TOP = """
SELECT event_type AS key, value, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value {way}, event_id) AS BIGINT) AS rank
FROM events QUALIFY rank <= 5
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), "value", "event_id")


@query(_TOP.format(way="DESC"))
def nlargest_by_key(spark, sf_dir):
    return keyed.nlargest_by_key(_events(spark, sf_dir), 5, ties=["event_id"])


@query(_TOP.format(way="ASC"))
def nsmallest_by_key(spark, sf_dir):
    return keyed.nsmallest_by_key(_events(spark, sf_dir), 5, ties=["event_id"])


# Combining


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_bag(spark, sf_dir):
    return combine.union(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return combine.distinct(union_bag(spark, sf_dir))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def product_small(spark, sf_dir):
    return combine.product(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"))


def _customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment", "c_acctbal")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey", "o_totalprice")


@query("SELECT c_custkey AS key, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner_flat(spark, sf_dir):
    return combine.join(_customer(spark, sf_dir), _orders(spark, sf_dir)).select("key", "c_name", "o_orderkey")


@query("SELECT o_custkey AS key, count(*) AS pairs FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def join_pair_counts(spark, sf_dir):
    return combine.join(_customer(spark, sf_dir), _orders(spark, sf_dir), nested=True).select("key", F.size("pairs").cast("long").alias("pairs"))


@query(
    """
    SELECT coalesce(a.k, b.k) AS key, coalesce(a.n, 0) AS n0, coalesce(b.n, 0) AS n1
    FROM (SELECT c_custkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) b ON a.k = b.k
    """
)
def cogroup_sizes(spark, sf_dir):
    made = combine.cogroup(_customer(spark, sf_dir).withColumn("value", F.col("key")), _orders(spark, sf_dir).withColumn("value", F.col("o_orderkey")))
    return made.select("key", F.size("values_0").cast("long").alias("n0"), F.size("values_1").cast("long").alias("n1"))


@query("SELECT c_custkey AS key, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left_outer(spark, sf_dir):
    return combine.join(_customer(spark, sf_dir), _orders(spark, sf_dir), how="left").select("key", "o_orderkey")


@query("SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_semi(spark, sf_dir):
    return combine.join(_customer(spark, sf_dir), _orders(spark, sf_dir), how="left_semi").select("key")


@query("SELECT c_custkey AS key FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return combine.join(_customer(spark, sf_dir), _orders(spark, sf_dir), how="left_anti").select("key")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey")
def join_theta(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    pairs = combine.product(n.toDF("a", "ra"), n.toDF("b", "rb"))
    return elements.starfilter(pairs, F.col("ra") < F.col("rb")).select("a", "b")


@query("SELECT x, y FROM (VALUES (1, 1), (NULL, 3)) l(k, x) JOIN (VALUES (1, 2), (NULL, 4)) r(k2, y) ON k IS NOT DISTINCT FROM k2")
def join_null_safe(spark, sf_dir):
    left = spark.createDataFrame([(1, 1), (None, 3)], "key int, x int")
    return combine.join(left, spark.createDataFrame([(1, 2), (None, 4)], "key int, y int"), null_safe=True).select("x", "y")


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
def join_self(spark, sf_dir):
    o = _orders(spark, sf_dir).select("key", "o_orderkey")
    return combine.join(o.withColumnRenamed("o_orderkey", "a"), o.withColumnRenamed("o_orderkey", "b")).filter("a < b").select("a", "b")


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def broadcast_lookup(spark, sf_dir):
    dim = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return combine.lookup_join(table(spark, sf_dir, "supplier"), dim, "s_nationkey").select("s_suppkey", "n_name")


@query(
    """
    SELECT c, s FROM (SELECT c_custkey AS c, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer)
    JOIN (SELECT s_suppkey AS s, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS r FROM supplier) USING (r)
    """
)
def zip_by_rank(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey")
    right = table(spark, sf_dir, "supplier").select("s_acctbal", "s_suppkey")
    made = combine.zip_(left, right, ["c_acctbal", "c_custkey"], ["s_acctbal", "s_suppkey"])
    return made.select(F.col("left.c_custkey").alias("c"), F.col("right.s_suppkey").alias("s"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_cols(spark, sf_dir):
    return combine.distinct(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def distinct_by_key_first(spark, sf_dir):
    return combine.distinct(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", F.col("o_orderkey").asc())


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_distinct(spark, sf_dir):
    return combine.subtract(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_distinct(spark, sf_dir):
    return combine.intersect(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select("o_custkey"))


# Order, samples, partitions, shared state


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def nlargest(spark, sf_dir):
    return ordering.nlargest(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 20, "o_totalprice", ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def nsmallest(spark, sf_dir):
    return ordering.nsmallest(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 20, "o_totalprice", ["o_orderkey"])


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY value, event_id) - 1 AS BIGINT) AS pos FROM events")
def sort_range(spark, sf_dir):
    made = elements.key_by_idx(table(spark, sf_dir, "events").select("value", "event_id"), ["value", "event_id"])
    return made.select("value.event_id", F.col("key").alias("pos"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) - 1 AS BIGINT) AS pos FROM customer")
def sort_desc(spark, sf_dir):
    ordered = ordering.sort(table(spark, sf_dir, "customer").select("c_acctbal", "c_custkey"), ["c_acctbal", "c_custkey"], reverse=True)
    return elements.key_by_idx(ordered).select("value.c_custkey", F.col("key").alias("pos"))


@query(
    """
    SELECT event_id FROM events
    WHERE CAST(('0x' || substr(md5('s|' || event_id), 1, 13)) AS BIGINT) < CAST(floor(0.1 * 4503599627370496) AS BIGINT)
    """
)
def sample_fraction(spark, sf_dir):
    return ordering.sample_by_hash(table(spark, sf_dir, "events").select("event_id"), 0.1, "s")


@query("SELECT CAST(least(100, count(*)) AS BIGINT) AS n, CAST(least(100, count(*)) AS BIGINT) AS members FROM orders")
def take_sample_n(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    drawn = spark.createDataFrame(ordering.take_sample(orders, 100, seed=3), "o_orderkey long")
    members = combine.join(orders, drawn, "o_orderkey", how="left_semi")
    return drawn.agg(F.count_distinct("o_orderkey").alias("n")).crossJoin(members.agg(F.count("*").alias("members")))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders")
def repartition_counts(spark, sf_dir):
    dealt = ordering.shuffle(table(spark, sf_dir, "orders").select("o_orderkey"), 8, "o_orderkey", partitioner=lambda k: k % 5)
    return dealt.agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT count(*) AS n FROM lineitem")
def coalesce_counts(spark, sf_dir):
    return ordering.coalesce_parts(table(spark, sf_dir, "lineitem"), 2).agg(F.count("*").alias("n"))


@query("SELECT p_brand AS brand, count(*) AS n, (SELECT count(*) FROM part WHERE p_size > 25) AS all_n FROM part WHERE p_size > 25 GROUP BY 1")
def cache_reuse(spark, sf_dir):
    kept = shared.cache(table(spark, sf_dir, "part").filter("p_size > 25").select("p_brand"))
    total = kept.agg(F.count("*").alias("all_n"))
    return kept.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")).crossJoin(total)


@query("SELECT CAST(sum(event_id) AS BIGINT) AS total, CAST(bit_or(event_id) AS BIGINT) AS bits FROM events")
def observe_metrics(spark, sf_dir):
    df, seen = shared.observe(table(spark, sf_dir, "events").select("event_id"), "m", total=F.sum("event_id"), bits=F.bit_or("event_id"))
    df.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["total"], seen.get["bits"])], "total long, bits long")


@query("SELECT CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events")
def partitioned_value_sum(spark, sf_dir):
    parts = shared.partitioned_values(table(spark, sf_dir, "events"), F.sum(_exact(F.col("value"))))
    return parts.agg(F.sum("value").cast("double").alias("total"))


@query("SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY 1) ORDER BY n DESC, word LIMIT 25")
def word_count_top(spark, sf_dir):
    return ordering.nlargest(flatmap_words(spark, sf_dir), 25, "n", ["word"])


# Files and sinks: rows are written to the shared folder and read back


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _text_files(spark: SparkSession, sf_dir: str, compression: str | None = None) -> str:
    """The names of the nations, a file for each region."""
    nation = ordering.shuffle(table(spark, sf_dir, "nation"), 5, "n_regionkey", partitioner=lambda k: k)
    path = _folder(spark)
    sinks.save_as_files(nation, path, "n_name", compression)
    return path


@query("SELECT CAST(count(DISTINCT n_regionkey) AS BIGINT) AS files, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation")
def files_sizes(spark, sf_dir):
    found = sources.files(spark, _text_files(spark, sf_dir), name_glob="*.txt")
    return _one(spark, files=sources.file_count(found), bytes=sources.total_size(found))


@query("SELECT CAST(count(DISTINCT n_regionkey) AS BIGINT) AS names FROM nation")
def files_names(spark, sf_dir):
    return _one(spark, names=len({*sources.filenames(sources.files(spark, _text_files(spark, sf_dir), psize_bytes=64))}))


@query("SELECT n_name AS value FROM nation")
def files_lines(spark, sf_dir):
    return sources.lines(spark, _text_files(spark, sf_dir))


@query("SELECT n_name || chr(10) AS value FROM nation")
def files_lines_with_ends(spark, sf_dir):
    return sources.lines(spark, _text_files(spark, sf_dir), keepends=True)


@query("SELECT n_name AS value FROM nation")
def files_decoded_split(spark, sf_dir):
    content = sources.decode(sources.files(spark, _text_files(spark, sf_dir), name_glob="*.txt"))
    return elements.filter_(sources.split_content(content, "\n").select("value"))


@query("SELECT n_name AS value FROM nation")
def files_decompressed(spark, sf_dir):
    content = sources.decompress(sources.files(spark, _text_files(spark, sf_dir, "gzip"), name_glob="*.gz"))
    return elements.filter_(sources.split_content(sources.decode(content), "\n").select("value"))


@query("SELECT CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes, CAST(7 AS BIGINT) AS longest FROM nation")
def files_chunks(spark, sf_dir):
    pieces = sources.chunks(sources.files(spark, _text_files(spark, sf_dir), name_glob="*.txt"), 7)
    size = F.length("content").cast("long")
    return pieces.agg(F.sum(size).alias("bytes"), F.max(size).alias("longest"))


_CSV = "SELECT c_custkey, c_name, c_acctbal FROM customer"


@query(_CSV)
def csv_files(spark, sf_dir):
    path = _folder(spark)
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True)
    return sources.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("SELECT c_custkey, c_name || chr(10) || 'x' AS c_name FROM customer")
def csv_values(spark, sf_dir):
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit('\nx"\n'))
    return sources.parse_csv(table(spark, sf_dir, "customer").select(line.alias("value")), "c_custkey long, c_name string")


@query(_CSV)
def json_files(spark, sf_dir):
    path = _folder(spark)
    sinks.save_as_json(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "gzip")
    return spark.read.schema("c_custkey long, c_name string, c_acctbal double").json(path)


@query(_CSV)
def pickle_files(spark, sf_dir):
    path = _folder(spark)
    sinks.save_as_pickles(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return sinks.load_pickles(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query(_CSV)
def parquet_folders(spark, sf_dir):
    path = _folder(spark)
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", (F.col("c_custkey") % 3).alias("m"))
    sinks.save_as_parquet(rows, path, ["m"])
    return spark.read.parquet(path).drop("m")


@query("SELECT n_nationkey, n_name FROM nation")
def json_collected(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:  # collect_* write where the driver is
        sinks.collect_as_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(3), folder, "gzip")
        rows = sinks.read_json_lines(folder)
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


@query("SELECT n_name AS value FROM nation")
def files_collected(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        sinks.collect_as_files(table(spark, sf_dir, "nation").repartition(3), folder, "n_name", ext=".txt")
        lines = [x for p in Path(folder).iterdir() for x in p.read_text().splitlines()]
    return spark.createDataFrame([(x,) for x in lines], "value string")


@query("SELECT n_nationkey, n_name FROM nation")
def pickles_collected(spark, sf_dir):
    with tempfile.TemporaryDirectory() as folder:
        sinks.collect_as_pickles(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(3), folder)
        rows = [r for p in Path(folder).iterdir() for r in pickle.loads(p.read_bytes())]
    return spark.createDataFrame(rows, "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def rows_collected(spark, sf_dir):
    parts = sinks.collect(table(spark, sf_dir, "nation").select("n_nationkey", "n_name").repartition(3), parts=True)
    return spark.createDataFrame([r for part in parts for r in part], "n_nationkey int, n_name string")


@query("SELECT n_nationkey, n_name FROM nation ORDER BY n_name")
def rows_iterated(spark, sf_dir):
    ordered = ordering.sort(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name")
    rows = [*sinks.icollect(ordered)]
    if [r.n_name for r in rows] != sorted(r.n_name for r in rows):
        raise ValueError("the rows came out of order")
    return spark.createDataFrame(rows, "n_nationkey int, n_name string")


@query("SELECT n_name AS key, n_regionkey AS value FROM nation")
def map_collected(spark, sf_dir):
    got = sinks.collect_as_map(table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value")))
    return collection(spark, got, "key string, value int")


@query("SELECT DISTINCT n_regionkey AS value FROM nation")
def set_collected(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in sinks.collect_as_set(table(spark, sf_dir, "nation"), "n_regionkey")], "value int")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 5")
def rows_taken(spark, sf_dir):
    ordered = ordering.sort(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"])
    rows = ordering.take(ordered, 5)
    if rows != [*ordering.itake(ordered, 5)] or rows[0] != ordering.first(ordered):
        raise ValueError("take, itake and first differ")
    return spark.createDataFrame(rows, "o_totalprice double, o_orderkey long")


@query("SELECT n_nationkey, n_name FROM nation")
def pandas_frame(spark, sf_dir):
    return spark.createDataFrame(sinks.to_pandas(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")))


@query("SELECT count(*) AS n FROM orders")
def executed_count(spark, sf_dir):
    df, seen = shared.observe(table(spark, sf_dir, "orders"), "executed", n=F.count("*"))
    sinks.execute(df)
    return _one(spark, n=seen.get["n"])


# Partitions and Python functions


@query("SELECT CAST(2 * sum(event_id) AS BIGINT) AS total, true AS numbered FROM events")
def map_partitions_numbered(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id").repartition(4)
    made = elements.map_partitions_with_index(events, lambda i, it: (f.assign(event_id=2 * f["event_id"], p=i) for f in it), "event_id long, p long")
    return made.agg(F.sum("event_id").alias("total"), (F.count_distinct("p") == 4).alias("numbered"))


@query("SELECT lower(n_name) AS value FROM nation")
def piped_lines(spark, sf_dir):
    return elements.pipe(table(spark, sf_dir, "nation").repartition(3), "tr A-Z a-z", "n_name")


@query("SELECT CAST(i AS BIGINT) AS id FROM range(100, 300) t(i)")
def masked_partitions(spark, sf_dir):
    return elements.mask_partitions(range_(spark, 0, 1000, 1, 10), lambda p: p.isin(1, 2))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def struct_as_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.struct("n_nationkey", "n_name").alias("value"))
    return elements.as_dataframe(rows, ["id", "name"])


@query("SELECT n_name FROM nation")
def column_picked(spark, sf_dir):
    return elements.column(table(spark, sf_dir, "nation"), "n_name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS k, CAST(n_regionkey AS DOUBLE) AS r FROM nation")
def typed_from_sample(spark, sf_dir):
    import pandas as pd

    return elements.from_sample(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), pd.DataFrame({"k": ["x"], "r": [0.5]}))


@query("SELECT CAST(i AS BIGINT) AS a, CAST(i + 100 AS BIGINT) AS b FROM range(100) t(i)")
def zip_partition_frames(spark, sf_dir):
    left, right = range_(spark, 0, 100, 1, 4).toDF("a"), range_(spark, 100, 200, 1, 4).toDF("b")
    return combine.zip_partitions(left, right, lambda x, y: x.assign(b=y["b"].to_numpy()), "a long, b long")


@query("SELECT CAST(i AS BIGINT) AS a, CAST(i + 100 AS BIGINT) AS b FROM range(100) t(i)")
def zip_by_position(spark, sf_dir):
    made = combine.zip_(range_(spark, 0, 100, 1, 4), range_(spark, 100, 200, 1, 4))
    return made.select(F.col("left").alias("a"), F.col("right").alias("b"))


@query("SELECT CAST(sum(event_id) AS BIGINT) AS total FROM events")
def aggregate_python(spark, sf_dir):
    return _one(spark, total=reduce.aggregate(table(spark, sf_dir, "events").repartition(4), sum, key="event_id"))


@query("SELECT CAST(min(event_id) AS BIGINT) AS least, CAST(max(event_id) AS BIGINT) AS most FROM events")
def combine_python(spark, sf_dir):
    got = reduce.combine(
        table(spark, sf_dir, "events").repartition(4), (1 << 62, -1), lambda a, x: (min(a[0], x), max(a[1], x)), lambda a, b: (min(a[0], b[0]), max(a[1], b[1])), "event_id"
    )
    return _one(spark, least=got[0], most=got[1])


@query("SELECT CAST(bit_xor(event_id) AS BIGINT) AS bits FROM events")
def reduce_python(spark, sf_dir):
    return _one(spark, bits=reduce.reduce_(table(spark, sf_dir, "events").repartition(4), lambda a, b: a ^ b, "event_id"))


@query("SELECT CAST(sum(event_id) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS n FROM events")
def tree_aggregate_python(spark, sf_dir):
    got = reduce.tree_aggregate(table(spark, sf_dir, "events").repartition(9), (0, 0), lambda a, x: (a[0] + x, a[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), 3, "event_id")
    return _one(spark, total=got[0], n=got[1])


@query("SELECT CAST(max(event_id) AS BIGINT) AS most FROM events")
def tree_reduce_python(spark, sf_dir):
    return _one(spark, most=reduce.tree_reduce(table(spark, sf_dir, "events").repartition(9), max, 3, "event_id"))


@query("SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)")
def sample_by_stratum(spark, sf_dir):
    return ordering.sample_by(table(spark, sf_dir, "nation"), "n_regionkey", {1: 1.0, 3: 1.0}).select("n_nationkey")


@query("SELECT count(*) AS n, true AS let_go FROM region")
def cache_let_go(spark, sf_dir):
    kept = shared.cache(table(spark, sf_dir, "region").select("r_name", F.lit("let go").alias("mark")))
    n = kept.count()
    return _one(spark, n=n, let_go=not shared.is_cached(shared.uncache(kept)))


@query("SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS parity FROM orders")
def broadcast_value(spark, sf_dir):
    names = shared.broadcast(spark, {0: "even", 1: "odd"})
    return elements.map_(table(spark, sf_dir, "orders").select("o_orderkey"), lambda x: (x, names.value[x % 2]), schema="o_orderkey long, parity string")


@query("SELECT CAST(sum(n_nationkey) AS BIGINT) AS total, CAST(bit_or(n_nationkey) AS BIGINT) AS bits FROM nation")
def accumulated(spark, sf_dir):
    total, bits = shared.accumulator(spark), shared.accumulator(spark, 0, "or")
    table(spark, sf_dir, "nation").foreach(lambda r: (total.add(r.n_nationkey), bits.add(r.n_nationkey)))
    return _one(spark, total=total.value, bits=bits.value)


# Null values, and keyed forms that fold in blocks


_SPARSE = "(SELECT n_regionkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS value FROM nation)"


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("value"))


def _shown(column: str) -> Column:
    return F.array_join(F.transform(F.sort_array(column), lambda x: F.coalesce(x.cast("string"), F.lit("null"))), ",")


@query(f"SELECT key, string_agg(coalesce(CAST(value AS VARCHAR), 'null'), ',' ORDER BY value NULLS FIRST) AS shown FROM {_SPARSE} GROUP BY key")
def group_by_key_nulls(spark, sf_dir):
    return keyed.group_by_key(_sparse(spark, sf_dir)).select("key", _shown("values").alias("shown"))


@query(f"SELECT key, string_agg(coalesce(CAST(value AS VARCHAR), 'null'), ',' ORDER BY value NULLS FIRST) AS shown, CAST(0 AS BIGINT) AS others FROM {_SPARSE} GROUP BY key")
def cogroup_nulls(spark, sf_dir):
    pairs = _sparse(spark, sf_dir)
    return combine.cogroup(pairs, pairs.limit(0)).select("key", _shown("values_0").alias("shown"), F.size("values_1").cast("long").alias("others"))


@query(f"SELECT key, count(*) AS n, count(*) - count(value) AS nulls FROM {_SPARSE} GROUP BY key")
def combine_by_key_nulls(spark, sf_dir):
    one = lambda v: F.struct(F.lit(1).cast("long").alias("n"), v.isNull().cast("long").alias("nulls"))
    plus = lambda a, b: F.struct((a["n"] + b["n"]).alias("n"), (a["nulls"] + b["nulls"]).alias("nulls"))
    return keyed.combine_by_key(_sparse(spark, sf_dir), one, lambda a, v: plus(a, one(v)), plus).select("key", "value.*")


@query("SELECT o_custkey AS key, CAST(max(o_orderkey) AS BIGINT) AS value FROM orders GROUP BY 1")
def reduce_by_key_python(spark, sf_dir):
    return keyed.reduce_by_key(_kv(spark, sf_dir).select("key", F.col("o_orderkey").alias("value")), max)


@query("SELECT n_regionkey AS key, count(*) AS n FROM nation GROUP BY 1")
def cogroup_frames(spark, sf_dir):
    pairs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("key"), "n_name")
    return combine.cogroup_apply(pairs, pairs, lambda x, y: x.head(1).assign(n=len(y))[["key", "n"]], "key int, n long")


@query("SELECT n_nationkey, n_name, r AS other FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation)")
def assign_by_position(spark, sf_dir):
    nation = ordering.sort(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey", pcount=3)
    return elements.assign(nation, range_(spark, 0, nation.count(), 1, 2).toDF("other"))
