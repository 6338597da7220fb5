import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import sentencepiece_codec as codec_

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    rng = random.Random(7)
    fixed = ["", " ", "  a  b ", "\ta\n\n", "▁x ▁", "a" * 3000, " " * 2000, "ab" * 2000, "\x00", "<s></s><0x09>", "日本語", "😀é", "--" * 500, "thethethe " * 90]
    for alphabet in (" etaoinshr.\n\té▁中", "ab", " the_=-*#", "aàáâ 😀"):
        fixed += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    return fixed


def test_ids_equal_the_library(library):
    some = texts()
    ids, starts = codec_.Codec(PATH).encode(some)
    expected = library.encode(some, add_bos=True, add_eos=True)
    for i, x in enumerate(expected):
        assert ids[starts[i] : starts[i + 1]].tolist() == x, some[i]


def test_heap_and_rounds_agree(library, monkeypatch):
    monkeypatch.setattr(codec_, "HELD_ROUNDS", 1)
    some = texts()
    ids, starts = codec_.Codec(PATH).encode(some)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == library.encode(some, add_bos=True, add_eos=True)


def test_long_words_equal_the_library(library, monkeypatch):
    rng = random.Random(9)
    some = ["".join(rng.choice(a) for _ in range(n)) for a in ("etaoinshrdlu", "ab", "é中a_", "thein") for n in (2500, 20_000)] + ["x " + "ing" * 30_000 + " y\n"]
    ids, starts = codec_.Codec(PATH).encode(some)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == library.encode(some, add_bos=True, add_eos=True)
    monkeypatch.setattr(codec_, "LONG_WORD", 1)
    some = texts()[:600]
    ids, starts = codec_.Codec(PATH).encode(some)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == library.encode(some, add_bos=True, add_eos=True)


def test_cache_overflow_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(codec_, "CACHE_WORDS", 50)
    c = codec_.Codec(PATH)
    some = texts()[:200]
    for i in range(0, 200, 20):
        ids, starts = c.encode(some[i : i + 20])
        assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == library.encode(some[i : i + 20], add_bos=True, add_eos=True)


def test_frames(spark, library):
    rows = [(1, "so it is", "x", "a"), (1, "so it is", "x", "a"), (None, None, None, None), (3, "", "y", "b"), (4, "é" * 40_000, "z", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, decoded_sha256 string")
    got = codec_.digests(df, PATH).collect()
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, *_ in rows if i == r.doc_id)
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    back = codec_.decode(codec_.encode(df, PATH), PATH).collect()
    assert sorted(r.decoded for r in back) == sorted(t or "" for _, t, *_ in rows)
    assert codec_.digests(df.limit(0), PATH).count() == 0
    clash = codec_.encode(df.withColumnRenamed("n_tokens", "piece_ids"), PATH)
    assert clash.columns == ["doc_id", "text", "decoded_sha256", "piece_ids"] and clash.count() == 5
