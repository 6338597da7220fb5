"""URL filter: listed rules first, then the ratio of two character language models.

Rules name a host (and all its subdomains) and the start of a path; the longest that fits decides. URLs that a rule accepts or rejects train
two variable-order Markov models over bytes (contexts of 0 to 5 bytes, each mixed with the next shorter one by Witten-Bell smoothing, so that longer
contexts enter where counts support them). All other URLs are judged by the mean log-likelihood difference a byte against a threshold. The threshold is
calibrated on the judged URLs' scores by the models of the other half (halves by the hash of the URL, so equal URLs share a half): no score it sees is
of text that its model counted.

Sharding: rows are dealt into chunks of bounded size. A chunk sends its distinct 6-grams in packets, each with its counts by half and verdict, so that one
packet counts and asks; packets meet by the byte before the last, which all contexts of one byte or more end in. Only the counts of single bytes are
summed over all shards: 1,024 numbers on the driver. What the models gather grows with the judged URLs, and no table is broadcast.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule; where no URL is accepted or none rejected by
a rule, the models say nothing and the verdict is allow; repeated rows are judged alike; an empty table gives an empty result. Only the id and the URL
are read: further columns may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, quoted, small_batches, stored, tidy
from .word_models import pack_words, packed, unpack_words, unpacked

#: Bytes of an n-gram, and shards.
ORDER, BUCKETS = 6, 64
#: Bytes of URLs a chunk.
CHUNK_BYTES = 16_000_000
#: Scores are counted in bins of a thousandth between -LIMIT and LIMIT for the calibration.
LIMIT = 20.0


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules in production.
RULES = (Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block"), Rule("net/fr/", "block"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return text, verdict


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end in each byte and in the end of each URL, as 64-bit keys of a byte a symbol (0 stands for begin and end), and where each URL begins
    among them."""
    coded = [u.encode("utf-8", "surrogatepass").replace(b"\x00", b"\x01") for u in urls]
    gap = bytes(ORDER - 1)
    raw = np.frombuffer(gap + gap.join(coded) + gap, np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) + 1
    starts = np.r_[0, np.cumsum(sizes)]
    at = np.arange(starts[-1]) + np.repeat(np.arange(len(coded)) * (ORDER - 2), sizes) + ORDER - 1
    key = raw[at]
    for k in range(1, ORDER):
        key |= raw[at - k] << np.uint64(8 * k)
    return key, starts


def single(counts: np.ndarray) -> np.ndarray:
    """Probabilities of the 256 symbols alone."""
    kinds, total = int((counts > 0).sum()), int(counts.sum())
    return (counts + kinds / 256) / max(1, total + kinds) if total else np.full(256, 1 / 256)


def mixed(asked: np.ndarray, p: np.ndarray, keys: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Probabilities of the asked n-grams' last symbols from a shard's sorted n-grams; p: those of the symbols alone."""
    for k in range(2, ORDER + 1):
        mask = np.uint64((1 << 8 * k) - 1)
        own, of = np.unique(keys & mask, return_inverse=True)
        count = np.bincount(of, c, len(own))
        contexts, of = np.unique(own >> np.uint64(8), return_inverse=True)
        total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
        want = asked & mask
        context = want >> np.uint64(8)
        at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
        gram = np.minimum(np.searchsorted(own, want), len(own) - 1)
        n = np.where(own[gram] == want, count[gram], 0.0)
        p = np.where(contexts[at] == context, (n + kinds[at] * p) / (total[at] + kinds[at]), p)
    return p


def _singles(judged: DataFrame) -> np.ndarray:
    """Counts of the symbols by half and verdict (allow, block): at most 1,024 rows come back."""

    def run(batches):
        own = np.zeros((4, 256), np.int64)
        for batch in small_batches(batches):
            key, starts = grams(batch.column(0).to_pylist())
            np.add.at(own, (np.repeat(batch.column(1).to_numpy(), np.diff(starts)), (key & np.uint64(255)).astype(np.int64)), 1)
        group, symbol = np.nonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(symbol.astype(np.int32)), pa.array(own[group, symbol])], ["group", "symbol", "n"])

    out = np.zeros((4, 256), np.int64)
    found = in_batches(judged.select("url", "group"), run, "group int, symbol int, n long").groupBy("group", "symbol").agg(F.sum("n").alias("n")).toArrow()
    out[found["group"].to_numpy(), found["symbol"].to_numpy()] = found["n"].to_numpy()
    return out


#: The halves whose counts make each model: those that score half 0, half 1 and the URLs without a rule.
MODELS = ((1,), (0,), (0, 1))


def _asked(rows: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        key, starts = grams([u or "" for u in table.column("url").to_pylist()])
        group = np.repeat(table.column("group").fill_null(4).to_numpy(), np.diff(starts))
        keys, number = np.unique(key, return_inverse=True)
        counts = np.bincount(5 * number + group, minlength=5 * len(keys)).reshape(-1, 5)[:, :4]
        of = ((keys >> np.uint64(8)) & np.uint64(255)) % np.uint64(BUCKETS)
        places = np.unique(of).tolist()
        packs = [pack_words(keys[of == b], *counts[of == b].T) for b in places]
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(packs), pa.int32()), "bucket": pa.array(places, pa.int32()), "pack": pa.array(packs, pa.binary())})

    return rows.select("chunk", "url", "group").groupBy("chunk").applyInArrow(tidy(run), "chunk int, bucket int, pack binary")


def _answers(asked: DataFrame, singles: np.ndarray) -> DataFrame:
    """Every packet with its n-grams' log probability ratios by the three models; zero where a model has no text of one verdict."""

    def run(table: pa.Table) -> pa.Table:
        packs = [unpack_words(p.as_py()) for p in table.column("pack")]
        keys, of = np.unique(np.concatenate([p[0] for p in packs]), return_inverse=True)
        counts = [np.bincount(of, np.concatenate([p[1 + g] for p in packs]), len(keys)) for g in range(4)]
        last = (keys & np.uint64(255)).astype(np.int64)
        ratios = []
        for halves in MODELS:
            alone = [sum(singles[2 * h + v] for h in halves) for v in (0, 1)]
            logs = []
            for v in (0, 1):
                c = sum(counts[2 * h + v] for h in halves)
                p, counted = single(alone[v])[last], c > 0
                logs.append(np.log(mixed(keys, p, keys[counted], c[counted]) if counted.any() else p))
            ratios.append((logs[0] - logs[1]).astype(np.float32) if alone[0].any() and alone[1].any() else np.zeros(len(keys), np.float32))
        made, at = [], 0
        for own, *_ in packs:
            part = of[at : at + len(own)]
            made.append(packed(own, *(r[part] for r in ratios)))
            at += len(own)
        return table.set_column(2, "pack", pa.array(made, pa.binary()))

    return asked.groupBy("bucket").applyInArrow(tidy(run), "chunk int, bucket int, pack binary")


def _scored(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """``rows`` without url, chunk and group, and ``score``: the mean log-likelihood difference a byte by the row's model."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    gone = ("url", "chunk", "group")
    schema = StructType([*(f for f in rows.schema.fields if f.name not in gone), StructField("score", DoubleType())])

    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        parts = [unpacked(p.as_py()) for p in answered.column("pack")]
        keys = np.concatenate([*(p[0] for p in parts), np.empty(0, np.uint64)])
        order = np.argsort(keys)
        ratios = [np.concatenate([*(p[1 + m] for p in parts), np.empty(0, np.float32)])[order] for m in range(3)]
        key, starts = grams([u or "" for u in table.column("url").to_pylist()])
        at = np.searchsorted(keys[order], key)
        model = np.where(table.column("verdict").is_null().to_numpy(), 2, table.column("half").to_numpy())
        sums = np.stack([np.add.reduceat(r[at].astype(np.float64), starts[:-1]) for r in ratios]) if len(starts) > 1 else np.zeros((3, 0))
        score = sums[model, np.arange(len(model))] / np.diff(starts)
        return table.drop_columns(list(gone)).append_column("score", pa.array(score))

    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(run), schema)


def calibrate(bins: list[tuple[str, int, int]]) -> float:
    """The threshold of the best balanced accuracy, midway in its gap. bins: (verdict, thousandths, rows)."""
    levels = sorted({b for _, b, _ in bins})
    n = {v: sum(c for w, _, c in bins if w == v) for v in ("allow", "block")}
    count = {}
    for v, b, c in bins:
        count[v, b] = count.get((v, b), 0) + c
    best, at, below, allow_below, block_below = -1.0, 0.0, None, 0, 0
    for b in [*levels, None]:
        score = (1 - allow_below / n["allow"]) + block_below / n["block"]
        if score > best + 1e-12:
            low, high = (below if below is not None else b - 1), (b if b is not None else below + 1)
            best, at = score, (low + high + 1) / 2000
        if b is not None:
            allow_below += count.get(("allow", b), 0)
            block_below += count.get(("block", b), 0)
            below = b
    return at


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict and score (null where a rule decided)."""
    host, path = split_url(F.col("url"))
    rows = pages.select(quoted(id_col).alias("page_id"), quoted(url_col).alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("verdict"))
    group = F.when(F.col("verdict").isNotNull(), 2 * F.col("half") + (F.col("verdict") == "block").cast("int")).cast("int")
    total = rows.agg(F.sum(F.octet_length("url"))).first()[0] or 0
    chunks = max(1, math.ceil(total / CHUNK_BYTES))
    rows = rows.withColumn("half", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(2)).cast("int")).withColumn("group", group)
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("page_id", "url"), F.lit(chunks)).cast("int"))
    singles = _singles(rows.filter("group IS NOT NULL"))
    scored = stored(_scored(rows, _answers(_asked(rows), singles)), "url-scores")
    limit = threshold(scored.filter("verdict IS NOT NULL"), singles)
    ruled = F.col("verdict").isNotNull()
    verdict = F.coalesce("verdict", F.when(F.col("score") >= limit, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(~ruled, F.col("score")).alias("score"))


def threshold(judged: DataFrame, singles: np.ndarray) -> float:
    """From the scores of each half by the models of the other; 0 where a verdict has no URL."""
    if not (singles[0] + singles[2]).any() or not (singles[1] + singles[3]).any():
        return 0.0
    level = F.floor(F.least(F.greatest(F.col("score"), F.lit(-LIMIT)), F.lit(LIMIT)) * 1000).cast("int")
    return calibrate([tuple(r) for r in judged.groupBy("verdict", level.alias("level")).count().collect()])
