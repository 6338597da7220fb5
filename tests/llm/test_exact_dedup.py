import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tessera.llm.common import bit_cells, bit_table, cell_count, probe

SCHEMA = "doc_id long, text string, keep_id string, cell int"


def brute(rows):
    best, size = {}, {}
    for i, text, *_ in rows:
        t = text or ""
        size[t] = size.get(t, 0) + 1
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    return best, size


def test_report_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "", "a", "b", "é" * 50_000, f"u{i}", f"u{i // 2}"]), "x", 1) for i in range(400)]
    best, size = brute(rows)
    out = {r.doc_id: r for r in exact_dedup.report(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert len(out) == len(rows)
    for i, text, *_ in rows:
        t, r = text or "", out[i]
        assert (r.keep_id, r.group_size, r.kept) == (best[t], size[t], best[t] == i)
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "a", "x", 1)] * 3 + [(None, "a", "y", 2), (None, "z", "y", 2), (None, "z", "y", 2), (7, "q", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.report(df).collect()
    assert len(got) == 7
    assert sum(r.kept for r in got) == 3
    assert {r.group_size for r in got if r.doc_id == 5} == {4}
    kept = exact_dedup.dedup(df).collect()
    assert sorted(r.text for r in kept) == ["a", "q", "z"]
    assert [r.doc_id for r in kept if r.text == "a"] == [5]
    assert exact_dedup.dedup(df).columns == df.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.report(empty).count() == 0
    assert exact_dedup.dedup(empty).count() == 0


def test_columns_named_as_those_inside(spark):
    rows = [(1, "a", 1, 2, "x"), (2, "a", 3, 4, "y"), (3, "b", 5, 6, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __hash int, repeated int, __bits0 string").withColumn("row", F.lit(0)).withColumn("digest", F.lit(1))
    kept = exact_dedup.dedup(df)
    assert kept.columns == df.columns and sorted((r.doc_id, r["__hash"]) for r in kept.collect()) == [(2, 3), (3, 5)]
    assert exact_dedup.report(df).filter("kept").count() == 2


def test_hot_text_beside_the_rest(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    kept = exact_dedup.report(df).filter("kept")
    assert kept.count() == 4001
    assert kept.filter("group_size > 1").first().keep_id == 5997


def test_probe_has_no_false_negative(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("h"), "id")
    cells = cell_count(2000)
    some = df.filter("id % 10 = 0").select(F.explode(F.array(*bit_cells(F.col("h"), cells))).alias("cell"))
    hit = probe(df, bit_table(some), bit_cells(F.col("h"), cells), "hit")
    assert hit.filter("id % 10 = 0 AND NOT hit").count() == 0
    assert hit.filter("id % 10 <> 0 AND hit").count() < 200
