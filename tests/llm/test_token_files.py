import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_files
from tessera.llm.common import shared_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    fixed = ["", "  a  b ", "a's'tx 'll", "<|endoftext|>x", "x\x1cy", "½ ²", "__a__b", "a b", "\r\n\r\n x", "the " * 9000]
    for alphabet in (" etaoinshr.\n\té▁中", "'stmdlvre abc '", " the_=-*#12½", "\n\t \r a", "ªºßñ¿¡·µ a1"):
        fixed += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 100))) for _ in range(200)]
    return fixed


def test_ids_equal_the_library(library):
    some = texts()
    got = token_files.Encoder(PATH)(some)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def test_planes_round_trip():
    x = np.array([0, 1, 255, 256, 2**32 - 1], "<u4")
    assert token_files.unplaned(token_files.planes(x)).tolist() == x.tolist()


def test_files_read_back(spark, library, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_BYTES", 4000)
    some = texts()
    rows = [(i * 3 % 2003, t, "x") for i, t in enumerate(some)] + [(5000, None, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(5)
    out = f"{shared_dir(spark)}/files-test"
    token_files.write(df, PATH, out)
    got = {r.doc_id: r for r in token_files.read(spark, out).collect()}
    seen = 0
    for i, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (seen, len(ids), zlib.crc32(ids.tobytes()))
        seen += len(ids)
    one = rows[17]
    assert [x.tolist() for x in token_files.lookup(spark, out, one[0])] == [[*library.encode(one[1], add_special_tokens=False).ids, 0]]
    assert token_files.lookup(spark, out, -5) == []
    with pytest.raises(ValueError):
        token_files.Reader("other", b"").check(1, "this")


def test_repeated_ids_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    got = token_files.round_trip(df, PATH)
    assert got.count() == 4
    assert got.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == got.agg(F.sum("n_tokens")).first()[0]
    assert token_files.round_trip(df.limit(0), PATH).count() == 0
