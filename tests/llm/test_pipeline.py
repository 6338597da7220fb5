import random
from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import quality
from test_jaccard_join import brute as near_groups
from test_mixing import brute as mixed


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    vocab = ["".join(rng.choice(("ter", "an", "lo", "si", "en", "du", "the", "ra", "mi")) for _ in range(rng.randint(1, 3))) for _ in range(300)]
    rows = []
    for i in range(260):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        rows.append([i, " ".join(words), rng.choice(("en", "fr")), "hot" if i % 3 else f"s{i % 5}"])
    rows += [[300 + i, rows[i][1], "en", "s1"] for i in range(20)]  # exact copies
    rows += [[400 + i, rows[30 + i][1] + " tail", rows[30 + i][2], "s2"] for i in range(20)]  # near copies
    rows += [[500 + i, "".join(rng.choice("QXZ!#%&") for _ in range(300)), "en", "s3"] for i in range(12)]  # junk
    rows += [[600, None, "en", "s4"], [601, "the " * 20_000, "fr", "s4"]]
    out = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(r[0], 0 if r[0] >= 500 else 1, 0) for r in rows[::2]], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_equal_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    kept = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{folder}/labels.parquet")).filter("kept").collect()}
    assert len({i for i in range(260)} - kept) <= 2 and len(kept & set(range(500, 512))) <= 1
    rows = [r for r in rows if r[0] in kept]
    best = {}
    for r in rows:
        best[r[1] or ""] = max(best.get(r[1] or "", r), r, key=lambda x: x[0])
    rows = sorted(best.values(), key=lambda r: r[0])
    names = {i: least for i, _, least in near_groups([(r[0], r[1]) for r in rows], 5, 80)}
    rows = [r for r in rows if names[r[0]] == r[0]]
    count = mixed([(r[0], r[1], r[3]) for r in rows])
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline._tokenizer())
    expected = Counter()
    for (i, text, source), n in count.items():
        expected[i, source, tuple(library.encode(text or "", add_bos=True, add_eos=True))] += n
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.source, tuple(r.piece_ids)) for r in out) == expected
    assert all(r.round_trip and r.n_tokens == len(r.piece_ids) for r in out)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_stages_take_nulls_repeats_and_further_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("row", F.lit(1)).withColumn("key", F.lit("k")).withColumn("piece_ids", F.lit("p")).limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "null id", "en", "a", 7), (7000, "again and again", None, None, None), (7000, "again and again", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        if name == "sentencepiece":
            assert len(ids) == docs.count()
            continue
        assert out.columns == docs.columns, name
        if name != "source_mix":
            assert ids.count(None) == 2 and ids.count(7000) == (1 if name == "exact_dedup" else 2), name


def test_each_stage_begins_with_collected_heaps(spark, folder):
    def collections() -> int:
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES:
        before = collections()
        stage(spark, docs, folder)
        assert collections() > before, name
