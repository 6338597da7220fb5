"""Forms that take Python callables or act eagerly, against plain Python."""

import heapq
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import combine, elements, keyed, moments, ordering, reduce, shared


@pytest.fixture(params=[1, 3, 7])
def ints(spark, request):
    return spark.range(0, 1000, 1, request.param)


def test_elements_with_python_functions(ints):
    assert sorted(r.v for r in elements.map_(ints, lambda x: x * x, schema="v long").collect()) == [x * x for x in range(1000)]
    pairs = ints.select("id", (F.col("id") % 3).alias("m"))
    assert elements.starmap(pairs, lambda a, b: a + b, schema="v long").agg(F.sum("v")).first()[0] == sum(x + x % 3 for x in range(1000))
    assert elements.flatmap(ints, lambda x: [x] * (x % 3), schema="v long").count() == sum(x % 3 for x in range(1000))
    seen = elements.map_partitions_with_index(ints, lambda i, it: (f.assign(p=i) for f in it), "id long, p int")
    assert seen.select("p").distinct().count() == ints.rdd.getNumPartitions()


def test_truthiness_and_keys(spark, ints):
    df = spark.createDataFrame([(0, "", [], None), (1, "a", [1], True), (None, None, None, False)], "i int, s string, a array<int>, b boolean")
    assert [elements.filter_(df, column=c).count() for c in df.columns] == [1, 1, 1, 1]
    pairs = elements.key_by(ints, lambda x: x % 5)
    assert elements.filter_bykey(pairs).count() == 800 and elements.filter_byvalue(pairs).count() == 999
    assert elements.values(elements.map_values(pairs, lambda v: v + 1)).agg(F.sum("value")).first()[0] == sum(range(1001))
    assert elements.pluck_each_value(spark.createDataFrame([(1, [[1, 2], [3, 4]])], "key int, value array<array<int>>"), 1).first().value == [2, 4]
    assert elements.flatmap_values(spark.createDataFrame([(1, [5, 6])], "key int, value array<int>"), keep_keys=True).count() == 2
    assert elements.pluck(spark.createDataFrame([([1, 2, 3],)], "a array<int>"), [2, 0], "a").first().value == [3, 1]
    with pytest.raises(KeyError):
        elements.column(df, "nope")
    with pytest.raises(ValueError):
        elements.concat(df, "i")


def test_numbering(ints):
    assert sorted(tuple(r) for r in elements.key_by_idx(ints).collect()) == [(i, i) for i in range(1000)]
    down = elements.key_by_idx(ints.select((-F.col("id")).alias("x")), "x")
    assert sorted(tuple(r) for r in down.collect()) == [(i, i - 999) for i in range(1000)]
    assert elements.key_by_id(ints).select("key").distinct().count() == 1000


def test_partitions(spark):
    letters = spark.createDataFrame([(c,) for c in "abcdef"], "c string").coalesce(1)
    assert elements.concat(letters, "c", "-", "c").first().value == "a-b-c-d-e-f-"
    assert elements.glom(letters, "c").first()["values"] == list("abcdef")
    assert [r.value for r in elements.pipe(letters, "cat", "c").collect()] == list("abcdef")
    four = spark.range(0, 40, 1, 4)
    assert elements.mask_partitions(four, lambda p: p.isin(1, 3)).count() == 20
    frame = elements.as_dataframe(letters.select(F.struct("c").alias("s")), ["letter"])
    assert frame.columns == ["letter"]
    sample = frame.limit(1).toPandas()
    assert elements.from_sample(letters, sample).columns == ["letter"]


def test_keyed_forms(spark, ints):
    pairs = ints.select(F.floor(F.col("id") / 100).alias("key"), F.col("id").alias("value"))
    groups = {k: list(range(100 * k, 100 * k + 100)) for k in range(10)}
    assert {r.key: sorted(r["values"]) for r in keyed.group_by_key(pairs).collect()} == groups
    assert {r.key: r["values"] for r in keyed.nlargest_by_key(pairs, 7, nested=True).collect()} == {k: heapq.nlargest(7, v) for k, v in groups.items()}
    assert {r.key: r["values"] for r in keyed.nsmallest_by_key(pairs, 200, nested=True).collect()} == groups
    assert dict(map(tuple, keyed.reduce_by_key(pairs, lambda a, b: a + b).collect())) == {k: sum(v) for k, v in groups.items()}
    rdd = keyed.combine_by_key_rdd(pairs, lambda v: [v, 1], lambda a, v: [a[0] + v, a[1] + 1], lambda a, b: [a[0] + b[0], a[1] + b[1]], "key long, value array<long>")
    assert {r.key: r.value for r in rdd.collect()} == {k: [sum(v), 100] for k, v in groups.items()}
    fold = keyed.combine_by_key(pairs, lambda v: v, lambda a, v: F.greatest(a, v), lambda a, b: F.greatest(a, b))
    assert dict(map(tuple, fold.collect())) == {k: max(v) for k, v in groups.items()}


def test_reductions(ints, spark):
    assert reduce.count(ints) == 1000 and reduce.sum_(ints) == sum(range(1000)) and reduce.mean(ints) == 499.5
    assert reduce.max_(ints) == 999 and reduce.min_(ints, by=-F.col("id")) == 999
    assert reduce.aggregate(ints, sum) == sum(range(1000)) and reduce.aggregate(ints, F.max("id")) == 999
    assert reduce.combine(ints, [0], lambda a, x: [a[0] + x], lambda a, b: [a[0] + b[0]]) == [sum(range(1000))]
    assert reduce.reduce_(ints, max) == 999
    for depth in (1, 2, 4):
        assert reduce.tree_reduce(ints, lambda a, b: a + b, depth) == sum(range(1000))
        assert reduce.tree_aggregate(ints, 0, lambda a, x: a + x, lambda a, b: a + b, depth) == sum(range(1000))
    assert dict(map(tuple, reduce.count_by_value(ints, lambda x: x % 10).collect())) == Counter(x % 10 for x in range(1000))
    assert reduce.count_distinct(ints, lambda x: x % 7) == 7
    for rate in (0.005, 0.05, 0.2):
        assert abs(reduce.count_distinct_approx(ints, error_rate=rate) - 1000) <= 4 * rate * 1000
    empty = spark.range(0)
    assert reduce.sum_(empty) == 0
    for f in (reduce.max_, reduce.mean):
        with pytest.raises(ValueError):
            f(empty)
    with pytest.raises(ValueError):
        reduce.aggregate(empty, sum)


@pytest.mark.parametrize("bins", [1, 10, 20, 100, [0, 10, 25, 50, 100], [0, 2, 3, 4, 5]])
def test_histogram_equals_numpy(spark, bins):
    rng = random.Random(4)
    data = [rng.randint(0, 99) for _ in range(1000)]
    got = sorted(map(tuple, moments.histogram(spark.createDataFrame([(x,) for x in data], "x int"), "x", bins).collect()))
    counts, edges = np.histogram(data, bins)
    assert [r[3] for r in got] == counts.tolist()
    assert np.allclose([r[1] for r in got] + [got[-1][2]], edges)


def test_histogram_of_equal_values_and_moments(spark):
    same = spark.createDataFrame([(5.0,)] * 4, "x double")
    assert [tuple(r) for r in moments.histogram(same, "x").collect()] == [(0, 5.0, 5.0, 4)]
    row = moments.stats(same, "x").first()
    assert row.variance == 0 and row["skew"] is None
    x = np.log(np.arange(1, 1000))
    row = moments.stats(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    m = x - x.mean()
    assert row["count"] == 999 and np.isclose(row.mean, x.mean()) and np.isclose(row.sample_variance, x.var(ddof=1))
    assert np.isclose(row.skew, (m**3).mean() / x.var() ** 1.5) and np.isclose(row.kurtosis, (m**4).mean() / x.var() ** 2 - 3)


def test_combining(spark):
    a = spark.createDataFrame([(i % 4, i) for i in range(10)], "key int, value int")
    b = spark.createDataFrame([(i % 4, i) for i in range(10, 20)], "key int, value int")
    c = spark.createDataFrame([(9, 1)], "key int, value int")
    got = {r.key: (sorted(r.values_0), sorted(r.values_1), r.values_2) for r in combine.cogroup(a, b, c).collect()}
    assert got == {k: ([i for i in range(10) if i % 4 == k], [i for i in range(10, 20) if i % 4 == k], []) for k in range(4)} | {9: ([], [], [1])}
    nested = {r.key: sorted((x.left.value, x.right.value) for x in r.pairs) for r in combine.join(a, b, nested=True).collect()}
    assert nested == {k: sorted(product(*v[:2])) for k, v in got.items() if k != 9}
    x, y = spark.range(0, 30, 1, 3), spark.range(100, 130, 1, 3)
    assert [tuple(r) for r in combine.zip_(x, y).collect()] == list(zip(range(30), range(100, 130)))
    sums = combine.zip_partitions(x, y, lambda p, q: p.assign(s=p["id"] + q["id"].to_numpy())[["s"]], "s long")
    assert sorted(r.s for r in sums.collect()) == [100 + 2 * i for i in range(30)]
    pairs = combine.product_partitions(x, y, lambda p, q: [len(p) * len(q)], "n int")
    assert sorted(r.n for r in pairs.collect()) == [100] * 9
    assert combine.product(x, y).count() == 900
    assert combine.distinct(a, "key").count() == 4 and combine.distinct(a, lambda k, v: v % 2).count() == 2
    merged = combine.cogroup_apply(a, b, lambda p, q: p.assign(n=len(q))[["key", "n"]].head(1), "key int, n int")
    assert merged.count() == 4


def test_order_samples_and_partitions(spark, ints):
    up = [r.id for r in ordering.sort(ints, pcount=5).collect()]
    assert up == list(range(1000)) and [r.id for r in ordering.sort(ints, reverse=True).collect()] == up[::-1]
    assert ordering.sort(spark.range(0)).count() == 0
    assert ordering.sample(ints, 0).count() == 0 and ordering.sample(ints, 1).count() == 1000
    big = spark.range(0, 200_000, 1, 10)
    for fraction in (0.1, 0.5, 0.9):
        assert abs(ordering.sample(big, fraction, seed=1).count() / 200_000 - fraction) < 0.01
        assert abs(ordering.sample(big, fraction, True, seed=1).count() / 200_000 - fraction) < 0.01
    with pytest.raises(ValueError):
        ordering.sample(ints, 1.5)
    assert len(ordering.take_sample(ints, 50, seed=2)) == 50 and len(ordering.take_sample(ints, 2000)) == 1000
    assert ordering.sample_by(ints.select((F.col("id") % 2).alias("m")), "m", {0: 1.0}).count() == 500
    dealt = ordering.shuffle(ints, 3, partitioner=lambda k: k % 2).rdd.glom().collect()
    assert [set(r.id % 2 for r in part) for part in dealt if part] == [{0}, {1}]
    assert all([r.id for r in part] == sorted(r.id for r in part) for part in dealt)
    assert ordering.coalesce_parts(big, 4).rdd.getNumPartitions() == 4
    with pytest.raises(ValueError):
        ordering.coalesce_parts(ints, 0)
    assert len(ordering.take(ints, 5)) == 5
    with pytest.raises(ValueError):
        ordering.first(spark.range(0))


def test_shared_state(spark, ints):
    kept = shared.cache(ints.filter("id > 10"))
    assert shared.is_cached(kept) and kept.count() == 989
    assert not shared.is_cached(shared.cache(kept, None))
    with pytest.raises(ValueError):
        shared.cache(ints, "moon")
    total, flags, found = shared.accumulator(spark), shared.accumulator(spark, 0, "or"), shared.accumulator(spark, frozenset(), "set")
    ints.foreach(lambda r: (total.add(r.id), flags.add(r.id), found.add(frozenset([r.id % 3]))))
    assert (total.value, flags.value, found.value) == (sum(range(1000)), 1023, {0, 1, 2})
    table = shared.broadcast(spark, {0: "even", 1: "odd"})
    assert elements.map_(ints, lambda x: table.value[x % 2], schema="v string").filter("v = 'odd'").count() == 500
    df, seen = shared.observe(ints, "o", n=F.count("*"))
    df.count()
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["n"] == 1000
    assert shared.partitioned_values(ints, F.count("*")).agg(F.sum("value")).first()[0] == 1000
    with shared.described(spark, "named"), shared.profiled(spark, "perf"):
        assert ints.count() == 1000


def test_small_functions_and_session(spark, ints):
    from tessera import functions as fn
    from tessera.session import default_pcount, executor_count, get_session, share_package

    x = F.col("id")
    row = ints.agg(F.sum(fn.inc(x)), F.sum(fn.double(x)), F.sum(fn.neg(x)), F.sum(fn.is_even(x).cast("int")), F.sum(fn.is_odd(x).cast("int")), F.max(fn.identity(x))).first()
    total = sum(range(1000))
    assert tuple(row) == (total + 1000, 2 * total, -total, 500, 500, 999)
    assert [r[0] for r in spark.sql("SELECT array(1, 1) a UNION ALL SELECT array(1, 2)").select(fn.all_equal(F.col("a"))).collect()] == [True, False]
    assert [r.id for r in ordering.itake(ints, 3)] == [0, 1, 2]
    assert default_pcount(spark) == 4 and executor_count(spark) >= 1 and get_session() is spark
    share_package(spark)
    assert "PYTHONPATH" in spark.sparkContext.environment


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_are_dense_over_many_files(spark, tmp_path, adaptive):
    """More rows than the sample that range bounds come from, in files of their own."""
    n = 200_000
    spark.range(0, n, 1, 8).select(F.pmod(F.xxhash64("id"), F.lit(n // 2)).alias("x"), "id").write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = spark.read.parquet(str(tmp_path / "t"))
        for order in (None, ["x", "id"]):
            made = elements.key_by_idx(rows, order)
            row = made.agg(F.count_distinct("key").alias("d"), F.min("key").alias("lo"), F.max("key").alias("hi")).first()
            assert tuple(row) == (n, 0, n - 1)
        got = np.array(made.orderBy("key").select("value.x", "value.id").collect())
        assert (np.lexsort((got[:, 1], got[:, 0])) == np.arange(n)).all()
        pairs = combine.zip_(rows, rows, ["x", "id"], ["x", "id"])
        assert pairs.count() == n and pairs.filter("left.id <> right.id").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_null_values_stay(spark):
    pairs = spark.createDataFrame([("a", 2), ("a", None), ("b", None), (None, 3)], "key string, value int")
    assert {r.key: r["values"] for r in keyed.group_by_key(pairs, order=True).collect()} == {"a": [None, 2], "b": [None], None: [3]}
    got = {r.key: (sorted(r.values_0, key=str), r.values_1) for r in combine.cogroup(pairs, pairs.filter("key = 'b'")).collect()}
    assert got == {"a": ([2, None], []), "b": ([None], [None]), None: ([3], [])}
    sizes = keyed.combine_by_key(pairs, lambda v: F.lit(1), lambda a, v: a + 1, lambda a, b: a + b)
    assert dict(map(tuple, sizes.collect())) == {"a": 2, "b": 1, None: 1}
    assert sorted(map(str, elements.glom(pairs.select("value").coalesce(1)).first()["values"])) == ["2", "3", "None", "None"]
    assert sorted(map(str, keyed.group_by(pairs.select("value"), F.lit(1)).first()["values"])) == ["2", "3", "None", "None"]


def test_folds_meet_in_blocks(spark):
    rows = spark.range(0, 20_000, 1, 3).select(F.lit(1).alias("key"), F.col("id").alias("value"))
    assert keyed.combine_by_key(rows, lambda v: v, lambda a, v: a + v, lambda a, b: a + b, lambda a: a * 2).first().value == 2 * sum(range(20_000))


def test_partition_functions_read_a_stream(spark):
    assert reduce.aggregate(spark.range(0, 100, 1, 3), lambda it: sum(1 for _ in it), sum) == 100


def test_assign_by_position_and_pipes(spark):
    left = spark.range(0, 10, 1, 3).toDF("a")
    right = spark.range(10, 20, 1, 2).toDF("b")
    assert sorted(map(tuple, elements.assign(left, right, c=lambda a, b: a + b).collect())) == [(i, i + 10, 2 * i + 10) for i in range(10)]
    assert elements.assign(left, right.toDF("a")).columns == ["a"]
    with pytest.raises(ValueError):
        elements.assign(left, right.filter("b > 12"))
    back = elements.pipe(left, "cat", "a", writer=lambda x: f"<{x}>", reader=lambda s: (int(s[1:-1]),), schema="a long")
    assert sorted(r.a for r in back.collect()) == list(range(10))


def test_shared_folder(spark):
    from tessera.storage import release, shared_dir, stored, written

    release(spark)
    kept = stored(spark.range(3), "three")
    more, last = stored(spark.range(4), "four"), stored(spark.range(5), "five")
    assert written() == 3 and release(spark, since=1, but=1) == 1 and kept.count() == 3 and last.count() == 5
    with pytest.raises(Exception, match="(?i)not.*exist|not_found|FileNotFound"):
        more.count()
    assert release(spark) == 2 and written() == 0 and shared_dir(spark)


def test_parts_widths_monoids_and_executors(spark, ints):
    from tessera.session import await_executors, executors

    made = elements.map_partitions_with_part(ints, lambda part, it: (f.assign(p=part.idx) for f in it), "id long, p int")
    assert made.select("p").distinct().count() == ints.rdd.getNumPartitions()
    vectors = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.mean for r in moments.mvstats(vectors, "v", 2).orderBy("pos").collect()] == [2.0, 3.0]
    with pytest.raises(Exception, match="components"):
        moments.mvstats(vectors, "v", 3).collect()
    longest = shared.accumulator(spark, "", ("", lambda a, b: max(a, b, key=lambda x: (len(x), x))))
    ints.foreach(lambda r: longest.add("x" * (r.id % 7)))
    assert longest.value == "xxxxxx"
    assert len(executors(spark)) == await_executors(spark, 1, 1) >= 1 and await_executors(spark, 10**6, 0.2) >= 1
