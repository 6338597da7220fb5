import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import mixing


def uniform(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52


def brute(rows, weights=None, power=0.5):
    sizes = Counter(s for _, _, s in rows)
    w = {s: (n**power if weights is None else weights.get(s, 0.0)) for s, n in sizes.items()}
    out = Counter()
    for i, text, s in rows:
        rate = w[s] / sum(w.values()) * len(rows) / sizes[s]
        parts = max(1, math.ceil(rate / mixing.CHUNK))
        key = f"{mixing.SEED}|{'' if i is None else i}|{hashlib.md5((text or '').encode()).hexdigest()}"
        for c in range(1, parts + 1):
            u, k, p = uniform(f"{key}|{c}"), 0, math.exp(-rate / parts)
            total = p
            while total <= u:
                k += 1
                p *= rate / parts / k
                total += p
            out[i, text, s] += k
    return +out


def rows():
    return [(i, f"t{i}" if i % 7 else None, ("hot" if i % 3 else f"s{i % 5}") if i % 11 else None) for i in range(900)] + [(1, "t1", "hot")]


def test_counts_equal_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string").withColumn("copy", F.lit(1)).repartition(6)
    for weights in (None, {"hot": 1.0, "s0": 40.0, None: 3.0}):
        got = Counter(tuple(r)[:3] for r in mixing.mix(df, weights).collect())
        assert got == brute(rows(), weights)
    assert mixing.mix(df).columns == df.columns
    assert mixing.mix(df.limit(0)).count() == 0


def test_very_long_texts_and_columns_named_as_the_result(spark):
    own = [(1, "x" * 300_000, "a", 5, "k"), (2, "y", "a", 6, None), (2, "y", "a", 6, None)]
    df = spark.createDataFrame(own, "doc_id long, text string, source string, copies int, shuffle_key string").withColumn("row", F.lit(1)).withColumn("own", F.lit(2))
    got = Counter(tuple(r)[:3] for r in mixing.mix(df).collect())
    assert got == brute([r[:3] for r in own]) and mixing.mix(df).columns == df.columns


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    one = Counter(map(tuple, mixing.report(df).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter(map(tuple, mixing.report(df.repartition(3)).collect())) == one


def test_shares_meet_the_weights(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    got = Counter(r.source for r in mixing.mix(df, {"a": 0.8, "b": 0.2}, target_rows=20_000).select("source").collect())
    assert abs(got["a"] - 16_000) < 600 and abs(got["b"] - 4_000) < 300
