"""Sources, sinks and streams on temporary folders."""

import gzip
import pickle

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import sources, streaming
from tessera.operators import sinks


def test_collections_and_ranges(spark):
    assert [r.id for r in sources.range_(spark, 5).collect()] == list(range(5))
    assert [r.id for r in sources.range_(spark, 10, 0, -3, 2).collect()] == [10, 7, 4, 1]
    assert sources.collection(spark, range(10), pcount=4).rdd.glom().map(len).collect() == [2, 3, 2, 3]
    assert sources.collection(spark, iter("abc"), psize=2).rdd.getNumPartitions() == 2
    assert sources.collection(spark, {1: "a"}).columns == ["key", "value"]
    for bad in ({"pcount": 0}, {"psize": -1}, {"pcount": 1, "psize": 1}):
        with pytest.raises(ValueError):
            sources.collection(spark, [1], **bad)


@pytest.fixture
def folder(tmp_path):
    for i in range(6):
        (tmp_path / f"f{i}.txt").write_text("".join(f"line {i} {j} é\n" for j in range(8)))
    (tmp_path / "decoy.bin").write_bytes(b"\x00\x01")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "deep.txt").write_text("no newline at end")
    return tmp_path


def test_files(spark, folder):
    found = sources.files(spark, str(folder), name_glob="*.txt")
    assert sources.file_count(found) == 7 and len(sources.filenames(found)) == 7
    assert sources.total_size(found) == sum(p.stat().st_size for p in folder.rglob("*.txt"))
    assert sources.files(spark, str(folder), recursive=False, name_glob="*.txt").count() == 6
    assert sources.files(spark, str(folder), keep=lambda p: p.endswith("f3.txt")).count() == 1
    assert sources.files(spark, str(folder), name_glob="*.txt", psize_files=3).rdd.getNumPartitions() == 3
    text = "".join(r.content for r in sources.decode(found).orderBy("path").collect())
    assert "line 5 7 é" in text
    pieces = sources.chunks(found, 10).orderBy("path", "part").collect()
    whole = {}
    for r in pieces:
        whole[r.path] = whole.get(r.path, b"") + bytes(r.content)
    assert whole == {r.path: bytes(r.content) for r in found.collect()}
    assert sources.split_content(sources.decode(found), "é\n").count() == 6 * 9 + 1
    assert sources.lines(spark, str(folder / "f1.txt")).count() == 8
    assert sources.lines(spark, str(folder / "f1.txt"), keepends=True).first().value.endswith("é\n")


def test_compressed(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(b"1\n2\n"))
    with pa.CompressedOutputStream(str(tmp_path / "b.lz4"), "lz4") as out:
        out.write(b"3\n")
    zipped = sources.files(spark, str(tmp_path), name_glob="*.gz")
    assert bytes(sources.decompress(zipped).first().content) == b"1\n2\n"
    assert bytes(sources.decompress(sources.files(spark, str(tmp_path), name_glob="*.lz4"), "lz4").first().content) == b"3\n"
    assert sources.decompress(zipped, None) is zipped
    with pytest.raises(ValueError):
        sources.decompress(zipped, "zip")
    assert sources.lines(spark, str(tmp_path / "a.gz")).count() == 2


def test_csv(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("a,b\n" + "".join(f"{j},{j * j}\n" for j in range(10)))
    assert sources.read_csv(spark, str(tmp_path), "a long, b long").agg(F.sum("b")).first()[0] == 3 * 285
    assert sources.read_csv(spark, str(tmp_path)).schema["a"].dataType.typeName() == "integer"
    text = spark.createDataFrame([("1,x\n2,y\n",)], "value string")
    assert [tuple(r) for r in sources.parse_csv(text, "a int, b string").collect()] == [(1, "x"), (2, "y")]


def test_sinks(spark, tmp_path):
    df = spark.range(0, 100, 1, 3).select("id", F.col("id").cast("string").alias("value"))
    assert [len(p) for p in sinks.collect(df, parts=True)] == [33, 33, 34] and len(sinks.collect(df)) == 100
    assert [r.id for r in sinks.icollect(df)] == list(range(100))
    assert sinks.collect_as_set(df, "id") == set(range(100))
    assert sinks.collect_as_map(df.select((F.col("id") % 3).alias("key"), F.col("id").alias("value"))) == {0: 99, 1: 97, 2: 98}
    by_part = sinks.collect_as_map(df.select((F.col("id") % 3).alias("key"), F.col("id").alias("value")), parts=True)
    assert by_part == [{0: 30, 1: 31, 2: 32}, {0: 63, 1: 64, 2: 65}, {0: 99, 1: 97, 2: 98}]
    sinks.save_as_files(df, str(tmp_path / "sep"), sep=";")
    assert sum(p.read_text().count(";") for p in (tmp_path / "sep").glob("part-*")) == 100
    sinks.execute(df)
    for compression in (None, "gzip"):
        out = tmp_path / f"json-{compression}"
        sinks.collect_as_json(df, str(out), compression)
        assert [r["id"] for r in sinks.read_json_lines(str(out))] == list(range(100)) and len(list(out.iterdir())) == 3
        sinks.save_as_files(df, str(tmp_path / f"text-{compression}"), compression=compression)
        assert spark.read.text(str(tmp_path / f"text-{compression}")).count() == 100
        sinks.save_as_json(df, str(tmp_path / f"sj-{compression}"), compression)
        assert spark.read.json(str(tmp_path / f"sj-{compression}")).count() == 100
    sinks.collect_as_pickles(df, str(tmp_path / "p"))
    assert sum(len(pickle.loads(p.read_bytes())) for p in (tmp_path / "p").iterdir()) == 100
    sinks.save_as_pickles(df, str(tmp_path / "sp"))
    assert sinks.load_pickles(spark, str(tmp_path / "sp"), "id long, value string").count() == 100
    sinks.collect_as_files(df, str(tmp_path / "f"), ext=".txt")
    assert (tmp_path / "f" / "0.txt").read_text().startswith("0\n1\n")
    sinks.save_as_parquet(df.withColumn("m", F.col("id") % 2), str(tmp_path / "pq"), ["m"])
    assert spark.read.parquet(str(tmp_path / "pq")).filter("m = 1").count() == 50
    assert len(sinks.to_pandas(df, 7)) == 7
    with pytest.raises(ValueError):
        sinks.save_as_files(df, str(tmp_path / "x"), compression="zip")
    with pytest.raises(ValueError):
        sinks.collect_as_files(df, str(tmp_path / "x"), compression="zip")


def test_stream_counts_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = streaming.read_folder(spark, str(tmp_path / "in"), events.schema)
    counts = streaming.windowed(stream, "ts", "1 day", ["event_type"], n=F.count("*"))
    streaming.run_available(counts, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    closed = got.agg(F.max("end")).first()[0]
    expected = batch.filter(F.col("start") < F.lit(closed))
    assert got.select("start", "event_type", "n").exceptAll(expected).count() == 0 and got.count() == expected.count() > 0


def test_line_ends(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"1\r\n2\n3\r4")
    assert [r.value for r in sources.lines(spark, str(tmp_path), keepends=True).collect()] == ["1\r\n", "2\n", "3\r", "4"]
    assert [r.value for r in sources.lines(spark, str(tmp_path)).collect()] == ["1", "2", "3", "4"]
    (tmp_path / "a.txt").write_bytes("é;ü;".encode("latin-1"))
    assert [r.value for r in sources.lines(spark, str(tmp_path), separator=";", encoding="latin-1").collect()] == ["é", "ü"]
    assert [r.value for r in sources.lines(spark, str(tmp_path), separator=";", errors="ignore").collect()] == ["", ""]
    assert sources.decode(sources.files(spark, str(tmp_path)), errors="replace").first().content == "�;�;"


def test_file_partitions_and_folders(spark, folder):
    found = sources.files(spark, str(folder), name_glob="*.txt", psize_bytes=300)
    assert found.rdd.getNumPartitions() == -(-sources.total_size(found) // 300)
    assert sources.files(spark, str(folder), keep_folder=lambda p: p.endswith("sub")).count() == 1
    with pytest.raises(ValueError):
        sources.files(spark, str(folder), psize_files=1, psize_bytes=1)


def test_csv_with_quoted_line_ends(spark):
    text = spark.createDataFrame([('1,"x\ny"\r\n\n2,"a""b, c"\n3,z',), (None,), ("",)], "value string")
    assert [tuple(r) for r in sources.parse_csv(text, "a int, b string", escape='"').collect()] == [(1, "x\ny"), (2, 'a"b, c'), (3, "z")]
    long = spark.createDataFrame([('1,"' + "x\n" * 50_000 + '"\n',)], "value string")
    assert [r.a for r in sources.parse_csv(long, "a int, b string").collect()] == [1]
