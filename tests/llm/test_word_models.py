import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_quality import brute_model, corpus
from test_quality import symbol as symbol_of
from tessera.llm import quality, word_models


def kind(c):
    if c.isspace():
        return "blank"
    if ord(c) > 0xFFFF or (c.isalnum() and 0x2E80 <= ord(c) < 0xA000):
        return "alone"
    return "word" if c.isalnum() else "mark"


def split(text):
    out, i = [], 0
    text = text.replace("\x00", "")
    while i < len(text):
        j = i
        while j < len(text) and kind(text[j]) == "blank":
            j += 1
        if j < len(text):
            of, j = kind(text[j]), j + 1
            while of != "alone" and j < len(text) and kind(text[j]) == of:
                j += 1
        out.append(text[i:j])
        i = j
    return [*out, None]


def brute_words(texts, spell):
    """The same smoothing with dictionaries over tokens; ``spell``: the probability of a token's symbols in their text."""
    raw, ones = Counter(), Counter()
    for t in texts:
        s = ["<s>", "<s>", *split(t)]
        raw.update(tuple(s[i - 2 : i + 1]) for i in range(2, len(s)))
        ones.update(s[2:])
    counts = {3: raw, 2: Counter(g[1:] for g in raw), 1: Counter({(w,): c for w, c in ones.items()})}
    disc, ctx = {}, {}
    for k, cs in counts.items():
        n = Counter(cs.values())
        disc[k] = quality.discounts([n[1], n[2], n[3], n[4]])
        ctx[k] = defaultdict(lambda: [0, 0.0])
        for g, c in cs.items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][1] += disc[k][min(c, 3) - 1]

    def p(g, spelled):
        if not g:
            return spelled
        if g[:-1] not in ctx[len(g)]:
            return p(g[1:], spelled)
        total, left = ctx[len(g)][g[:-1]]
        c = counts[len(g)].get(g, 0)
        return (c - disc[len(g)][min(c, 3) - 1] if c else 0) / total + left / total * p(g[1:], spelled)

    def nll(text):
        s, out, at = ["<s>", "<s>", *split(text)], 0.0, 0
        for i in range(2, len(s)):
            size = 1 if s[i] is None else len(s[i])
            out -= math.log(p(tuple(s[i - 2 : i + 1]), spell(text, at, at + size)))
            at += size
        return out

    return nll


def spelling(p):
    def spell(text, a, b):
        s = [quality.BOS] * 3 + [symbol_of(ord(c)) for c in text] + [quality.EOS]
        return math.prod(p(tuple(s[i : i + 4])) for i in range(a, b))

    return spell


@pytest.mark.parametrize("chunk_chars,bucket_chars", [(10**9, 10**9), (9_000, 3_000)])
def test_word_scores_equal_brute_force(spark, monkeypatch, chunk_chars, bucket_chars):
    monkeypatch.setattr(quality, "CHUNK_CHARS", chunk_chars)
    monkeypatch.setattr(word_models, "BUCKET_CHARS", bucket_chars)
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    half = {r.doc_id: r.h for r in docs.select("doc_id", F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(2)).alias("h")).collect()}
    got = {r.doc_id: r for r in quality.score(docs.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    good = {i for i, q, _ in labels if q == 1}
    models = {}
    for lang in ("en", "fr", None):
        for h in (0, 1):
            texts = [t or "" for i, t, g, _ in rows if i in good and g == lang and half[i] != h]
            models[lang, h] = brute_words(texts, spelling(brute_model(texts)))
    for i, text, lang, _ in rows:
        if len(text or "") < 1000:
            expected = models[lang, half[i]](text or "") / (len(text or "") + 1)
            assert abs(math.log(got[i].word_perplexity) - expected) < 2**-15, (i, text, lang)


def test_tokens():
    texts = ["", " ", "ab, cd  e\n", "a\x00b 漢字x 😀", "ab"]
    words, at, sizes = word_models.tokens(texts)
    assert sizes.tolist() == [len(split(t)) for t in texts]
    spans, begin = [], 0
    for t in texts:
        for w in split(t):
            spans.append(begin)
            begin += len(w) if w else 1
    assert at.tolist() == spans
    names = [w for t in texts for w in split(t)]
    assert len(set(words.tolist())) == len(set(names)) and len(dict(zip(names, words.tolist()))) == len(set(names))


def test_what_is_gathered_grows_with_the_text():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    kinds = []
    for n in (100, 1000):
        words, _, sizes = word_models.tokens([" ".join(rng.choices(vocabulary, k=100)) for _ in range(n)])
        kinds.append(len(word_models.Distinct(words, sizes).counts))
    assert kinds[1] > 9 * kinds[0]


def test_packets():
    rng = np.random.default_rng(1)
    words, sizes = rng.integers(0, 2**40, 50, np.uint64, endpoint=False)[rng.integers(0, 50, 300)], np.array([100, 1, 199])
    marked = rng.random(300) < 0.5
    d = word_models.Distinct(words, sizes, marked.astype(float))
    padded = [np.r_[[word_models.BOS] * 2, x] for x in np.split(words, [100, 101])]
    grams = [np.concatenate([x[i : len(x) - 2 + i] for x in padded]) for i in range(3)]
    assert all((x[d.number] == y).all() for x, y in zip(d.grams, grams, strict=True)) and (d.words[d.word] == words).all()
    assert (np.bincount(d.number, marked) == d.counts).all() and len({*zip(*d.grams, strict=True)}) == len(d.counts)
    back = word_models.grams_of(word_models.pack_grams(d.vocabulary, *d.numbers, d.counts))
    assert all((back[0][x] == y).all() for x, y in zip(back[1:4], d.grams, strict=True)) and (back[4] == d.counts).all()
    x = rng.random(7).astype(np.float32)
    assert (word_models.unpacked(word_models.packed(x, x[:1]))[0] == x).all()


@pytest.mark.parametrize("words", [60, 2**21 + 5])
def test_a_shard_comes_back_from_its_pack(words):
    rng = np.random.default_rng(2)
    vocabulary = np.unique(rng.integers(0, 2**40, words, np.uint64))
    texts = rng.choice(vocabulary[:60], 3000) if words == 60 else np.concatenate([rng.permutation(vocabulary), rng.choice(vocabulary[:60], 3000)])
    sizes = np.array([len(texts) - 1000, 1000])
    counted = word_models.Distinct(texts, sizes, places=False)
    packs = [word_models.pack_grams(counted.vocabulary, *counted.numbers, counted.counts)]
    shard = word_models.Shard(packs)
    back = word_models.Shard.of(shard.pack())
    assert (3 * int(shard.bits) <= 64) == (words == 60)
    for x in ("vocabulary", "keys3", "c3", "contexts3", "of3", "keys2", "c2", "contexts2", "of2"):
        assert (getattr(back, x) == getattr(shard, x)).all(), x
    asked = word_models.Distinct(rng.choice(np.r_[vocabulary[:60], np.arange(9, dtype=np.uint64)], 500), np.array([500]), places=False)
    ask = word_models.grams_of(word_models.pack_grams(asked.vocabulary, *asked.numbers))
    d = np.array([0.5, 1.0, 1.5])
    one, two = shard.weigh(d, d).answer(*ask), back.weigh(d, d).answer(*ask)
    assert all((x == y).all() for x, y in zip(one, two, strict=True)) and (one[0] > 0).any()


def test_counting_alone_gives_the_same_grams():
    rng = np.random.default_rng(3)
    for words in (rng.integers(0, 50, 400, np.uint64), rng.integers(0, 2**40, 2**21 + 400, np.uint64)):
        sizes = np.array([100, len(words) - 100])
        a, b = word_models.Distinct(words, sizes), word_models.Distinct(words, sizes, places=False)
        assert (a.counts == b.counts).all() and all((x == y).all() for x, y in zip(a.numbers, b.numbers, strict=True))
