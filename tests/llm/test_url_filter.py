import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import url_filter as uf


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for r in uf.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best and best.verdict


def urls():
    rng = random.Random(1)
    out = [None, "", "x", "://", "http://", "http://a.com", "HTTP://WWW.Example.COM/en/?a", "https://com/", "http://É.com/ü", "a://b://c.com/x", "http://notcom/", "http://wwwexample.com/en/x", "http://a.net/es", "http://a.net/es/#é", "http://x.org/" + "y" * 20_000, "http://x.com/\x00z", "http://x.com/a\nb?c"]
    for _ in range(600):
        out.append(f"http{rng.choice(('', 's'))}://{rng.choice(('', 'www.', 'blog.'))}{rng.choice(('good', 'spam-farm', 'Example'))}.{rng.choice(('example.', ''))}{rng.choice(('com', 'net', 'org'))}/{rng.choice(('en', 'es', 'fr', 'de'))}/{rng.randint(1, 999)}{rng.choice(('', '?q=1', '#t'))}")
    return out


def test_rules_and_fields_equal_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(urls())]
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    assert len(got) == len(rows)
    for i, u, _ in rows:
        host, path, rule, verdict = brute(u)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")


def test_models_tell_classes_apart(spark):
    rng = random.Random(2)
    word = lambda a: "".join(rng.choice(a) for _ in range(12))
    rows = [(i, f"http://x.com/{word('abcde')}") for i in range(400)] + [(1000 + i, f"http://x.net/es/{word('vwxyz')}") for i in range(400)]
    new = [(5000 + i, f"http://x.org/{word('abcde')}") for i in range(200)] + [(6000 + i, f"http://x.org/{word('vwxyz')}") for i in range(200)]
    got = {r.page_id: r.verdict for r in uf.judge(spark.createDataFrame(rows + new, "page_id long, url string")).collect()}
    right = sum(got[i] == ("allow" if i < 6000 else "block") for i, _ in new)
    assert right >= 380


def test_one_class_only_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (2, "http://b.org/y")], "page_id long, url string")
    assert sorted((r.page_id, r.verdict) for r in uf.judge(df).collect()) == [(1, "allow"), (1, "allow"), (2, "allow")]
    assert uf.judge(df.limit(0)).count() == 0


def test_models_are_distributions_and_windows_stay_in_their_url():
    key, starts = uf.grams(["http://a.b/c", "", "zz"])
    keys, c = np.unique(key, return_counts=True)
    alone = uf.single(np.bincount((key & np.uint64(255)).astype(int), minlength=256))
    assert np.isclose(alone.sum(), 1)
    for context in (0x2F2F3A70, 0x7A7A, 0x1234567890):
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.isclose(uf.mixed(every, alone, keys, c).sum(), 1)
    own, _ = uf.grams(["zz"])
    assert key[starts[2] :].tolist() == own.tolist() and starts[2] - starts[1] == 1


@pytest.mark.parametrize("chunk_bytes", [10**9, 3000])
def test_chunks_give_the_same(spark, monkeypatch, chunk_bytes):
    monkeypatch.setattr(uf, "CHUNK_BYTES", chunk_bytes)
    rows = [(i, u, "x") for i, u in enumerate(urls())] + [(5, urls()[5], "x")] * 3 + [(None, None, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, chunk string")
    got = uf.judge(df).collect()
    assert len(got) == len(rows)
    scores = {r.page_id: round(r.score, 6) for r in got if r.score is not None}
    _CHUNKED.append(scores)
    assert all(x == _CHUNKED[0] for x in _CHUNKED)


_CHUNKED = []


def brute_log(texts, gram):
    """Witten-Bell mixing with dictionaries: the log probability of the last symbol of ``gram``."""
    p = 1 / 256
    for order in range(1, uf.ORDER + 1):
        own = [t[i - order + 1 : i + 1] for t in texts for i in range(uf.ORDER - 1, len(t))]
        context = [g for g in own if g[:-1] == gram[len(gram) - order : -1]]
        if context:
            kinds = len({g[-1] for g in context})
            p = (sum(g[-1] == gram[-1] for g in context) + kinds * p) / (len(context) + kinds)
    return np.log(p)


def coded(url):
    return (*[0] * (uf.ORDER - 1), *url.encode(), 0)


def test_scores_and_threshold_equal_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(5))
    rows = [(i, rng.choice((f"http://{word()}.com/{word()}", f"http://{word()}.net/es/{word()}", f"http://{word()}.org/{word()}"))) for i in range(60)]
    half = {r.u: r.h for r in spark.createDataFrame(rows, "i long, u string").select("u", F.pmod(F.xxhash64("u"), F.lit(2)).alias("h")).collect()}
    texts = {(h, v): [coded(u) for _, u in rows if half[u] == h and brute(u)[3] == v] for h in (0, 1) for v in ("allow", "block")}

    def score(url, allow, block):
        t = coded(url)
        grams = [t[i - uf.ORDER + 1 : i + 1] for i in range(uf.ORDER - 1, len(t))]
        return sum(brute_log(allow, g) - brute_log(block, g) for g in grams) / len(grams)

    bins = {"allow": [], "block": []}
    for _, u in rows:
        if verdict := brute(u)[3]:
            bins[verdict].append(int(np.floor(score(u, texts[1 - half[u], "allow"], texts[1 - half[u], "block"]) * 1000)))
    best = max(((np.mean([b >= t for b in bins["allow"]]) + np.mean([b < t for b in bins["block"]]), -t) for t in range(-9000, 9000)))
    both = [texts[0, v] + texts[1, v] for v in ("allow", "block")]
    for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string")).collect():
        if r.rule is None:
            own = score(dict(rows)[r.page_id], *both)
            assert abs(own - r.score) < 1e-4
            at = uf.calibrate([(v, b, 1) for v in bins for b in bins[v]])
            assert r.verdict == ("allow" if r.score >= at else "block")
            gained = np.mean([b / 1000 >= at for b in bins["allow"]]) + np.mean([(b + 0.5) / 1000 < at for b in bins["block"]])
            assert gained >= best[0] - 1e-9
