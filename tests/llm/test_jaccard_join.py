import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard_join as jj

SCHEMA = "doc_id long, text string, digest string"


def brute_set(text, k):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent):
    sets = [(i, brute_set(t, k)) for i, t, *_ in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "été", "The"]
    rows = []
    while len(rows) < n:
        size = rng.choice([0, 1, 2, 3, 5, 8, 11, 12, 15, 20, 30, 60, 150, 400])
        base = [rng.choice(vocab) for _ in range(size)]
        for _ in range(rng.choice([1, 1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, size // 60), max(1, size // 25)])):
                at = rng.randint(0, len(w))
                edit = rng.random()
                if edit < 0.4 and w:
                    w[at - 1] = rng.choice(vocab)
                elif edit < 0.7:
                    w.insert(at, rng.choice(vocab))
                elif w:
                    del w[at - 1]
            rows.append((len(rows) * 7 % 1009, rng.choice([" ", "  ", "\n"]).join(w), "x"))
    return rows


@pytest.mark.parametrize(("k", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_components_equal_brute_force(spark, k, percent, seed, monkeypatch):
    monkeypatch.setattr(jj, "FLUSH", 3000)
    monkeypatch.setattr(jj, "RANGE", 2000)
    monkeypatch.setattr(jj, "BLOCK_MEMBERS", 4)
    rows = [*corpus(seed, 500), (2000, None, "x"), (2001, " \t", "x"), (2002, "The THE the" * 4000, "x"), (2003, "the the the" * 4000, "x")]
    got = jj.links(spark.createDataFrame(rows, SCHEMA).repartition(5), k, percent)
    assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


@pytest.mark.parametrize(("percent", "slack"), [(90, None), (80, None), (80, 1), (90, 0)])
def test_linked_pairs_always_share_a_usable_key(percent, slack, monkeypatch):
    rng = np.random.default_rng(4)
    plan = jj.Plan(percent, {b: 1000 for b in range(100)})
    if slack is not None:  # so little that many sets keep their empty segments
        monkeypatch.setattr(jj.Plan, "allocation", lambda self, b: (self.bound(b) + 1 + slack, 0, slack) if self.bound(b) else (0, 0, 0))
    modes = set()
    for _ in range(1500):
        n = int(rng.choice([9, 10, 11, 14, 19, 25, 40, 80, 200, 700, 3000]) + rng.integers(0, 4))
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        worst = (100 - percent) * len(a) // 100
        drop = int(rng.integers(0, worst + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - drop]], rng.integers(0, 2**64, int(rng.integers(0, worst + 1)), dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared < percent * (len(a) + len(b) - shared) or len(a) == len(b) == shared:
            continue
        small, large = sorted((a, b), key=len)
        (ka, ba, na), (kb, bb, nb) = plan.signatures(small), plan.signatures(large)
        x, y = dict(zip(ka.tolist(), ba.tolist())), dict(zip(kb.tolist(), bb.tolist()))
        same = plan.band(len(small)) == plan.band(len(large))
        both = {k for k in x.keys() & y.keys() if x[k] & jj.LOW and (y[k] & jj.LOW) == (jj.LOW if same else 0)}
        assert len(both) >= max(na[0], nb[0] if same else nb[1], 1)
        assert any((x[k] | y[k]) & jj.LOW and (x[k] | y[k]) & jj.FULL for k in x.keys() & y.keys()), (len(a), len(b), shared)
        modes.add(plan.allocation(plan.band(min(len(a), len(b))))[1] > 0)
    assert modes == ({True, False} if slack is None else {False})


def test_chain_and_keep_one(spark):
    words = [f"t{i}" for i in range(60)]
    rows = []
    for i in range(8):  # each differs from the next by one word, the ends by eight
        w = list(words)
        for j in range(i):
            w[7 * j] = f"new{j}"
        rows.append((50 - i, " ".join(w), "x"))
    rows += [(99, "alone " * 3, "x"), (43, rows[-1][1], "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.component_id for r in jj.links(df, 1, 90).collect()} == {43, 99}
    kept = jj.keep_one(df, 1, 90)
    assert sorted(r.doc_id for r in kept.collect()) == [43, 43, 99]
    assert kept.columns == df.columns
    assert jj.links(df.limit(0)).count() == 0
    assert jj.keep_one(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (None, "x y"), (None, None)], "doc_id long, text string")
    assert jj.links(nulls).filter("component_id = 4").count() == 2


def test_keep_one_judges_rows(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(3, words, 1), (7, words + " more", 2), (7, "a clean text of its own id twin", 3), (None, words + " less", 4), (None, "no id but clean", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row int")
    assert sorted(r.row for r in jj.keep_one(df, 5, 80).collect()) == [1, 3, 5]
    only = spark.createDataFrame([r for r in rows if r[0] is None] + [(None, words, 6)], "doc_id long, text string, row int")
    assert len({r.row for r in jj.keep_one(only, 5, 80).collect()} & {4, 6}) == 1


def test_sketches_bound_the_difference_and_fold():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, 80, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(rng.integers(0, 80))], rng.integers(0, 2**64, 20, dtype=np.uint64)]))
        apart = len(np.setxor1d(a, b))
        x, y = jj._folded(jj.sketch(a, 1024), 64), jj._folded(jj.sketch(b, 512), 64)
        assert np.bitwise_count(x ^ y).sum() <= apart
        assert (jj._folded(jj.sketch(a, 1024), 32) == jj._folded(jj.sketch(a, 256), 32)).all()


def test_group_whose_members_link_in_parts_only(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(250):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5])):
            w[at] = f"e{i}_{at}"
        rows.append((i, " ".join(w), "x"))
    got = jj.links(spark.createDataFrame(rows, SCHEMA), 3, 90)
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 90)
