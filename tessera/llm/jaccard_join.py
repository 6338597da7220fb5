"""Exact Jaccard self-join of word shingle sets by universe partition and pigeonhole.

Sets are grouped into size bands so that only equal or neighbouring bands can join. For the pairs of a band there is a bound H on the symmetric
difference. Tokens are dealt by their hash into segments that every set of the pair of bands shares. An exact segment matches when both sets
have the same tokens in it, which rules out no difference; a one-deletion segment matches up to one token more or less, which is found by indexing
the segment and its subsets with one token left out. When the weights (1 and 2) of the segments sum to W > H, a linked pair matches segments of
weight W - H at least. A cost model chooses the allocation for each band from the number of sets in it: exact segments with some slack, or
one-deletion segments where sets are so small that exact segments would often be empty. With slack W - H - 1 a set leaves out its empty exact
segments as long as they do not outweigh the slack, so no bucket of all "empty" sets arises. What the slack leaves over is the number of keys that
any two linked sets must share; a set that shares fewer with all others together has no link in that band and is dropped before anything else.

Equal sets are one class from the start. Signatures travel as sorted, compressed blocks and meet by key range; only keys that two classes share
come out. Candidates are verified exactly on the whole sets, in two rounds: first each class against its most popular neighbour, then the
candidate pairs across the components found so far. Pairs inside one component need no check, and no link between components is lost. Before a
pair of the second round is even a row, parity sketches are compared inside the key: every token flips one bit of its set's sketch, so bits that
differ are at most the symmetric difference, and a pair with too many cannot link. Keys with many members are compared in blocks.

Words and sets: A-Z lower-cased, words are runs of characters other than blank and U+0009 to U+000D; a text of fewer words than a shingle is one
shingle of its whole sequence. Shingles are compared by 64-bit hashes, sets by 128-bit hashes, of which candidates carry 64 bits (``node``).

Defined results: a null or blank text has an empty set and links with nothing; a null id takes part in links but never names a component; an empty table gives an empty result. ``links`` reads the id and the text only and ``keep_one`` gives
all columns back: further columns may have any name. Only components are produced: a component's links are verified as far as it takes to join
its members, for all links of a group of g near copies are of the order of g^2.
"""

from __future__ import annotations

import math
import uuid
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, bit_cells, bit_table, cell_count, in_batches, join_groups, keeps, partitions, probe, quoted, small_batches, spread, stored, strings, tidy, without

LOW, FULL = 1, 2
#: Signatures gathered before blocks are written, and signatures a key range is sized for.
FLUSH, RANGE = 2_500_000, 3_000_000
#: Members of a key that are compared in one block, and rows of open keys a task is sized for.
BLOCK_MEMBERS, OPEN_ROWS = 2048, 50_000
#: Pairs of 16 bytes that are broadcast to their sets; more are joined by shuffle.
BROADCAST_PAIRS = 200_000
WORD_CACHE = 200_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Hashes()
keeps("words", _words.clear)


def shingles(text: str, k: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    if n < k:
        h, width = w[:1].copy(), n
    else:
        h, width = w[: n - k + 1].copy(), k
    for i in range(1, width):
        h = mix(h * _GOLD + np.uint64(i)) + w[i : i + len(h)]
    return np.unique(mix(h * _GOLD + np.uint64(width << 8)))


def sketch(tokens: np.ndarray, bits: int) -> bytes:
    """Parities of the tokens by bit; a sketch of twice as many bits folds to this one by XOR of its halves."""
    at = (tokens & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def digest(tokens: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def node(digest_: bytes) -> int:
    return int.from_bytes(digest_[:8], "little", signed=True)


class Plan:
    """Bands, bounds and allocations for a threshold of ``percent`` over 100. ``sets``: about how many sets lie in each band."""

    def __init__(self, percent: int, sets: dict[int, int]):
        self.percent, self.sets = percent, sets
        self.lows = [1]

    def low(self, band: int) -> int:
        while len(self.lows) <= band + 1:
            self.lows.append(100 * self.lows[-1] // self.percent + 1)
        return self.lows[band]

    def band(self, n: int) -> int:
        while self.lows[-1] <= n:
            self.low(len(self.lows))
        return bisect_right(self.lows, n) - 1

    def bound(self, band: int) -> int:
        """The largest symmetric difference of a linked pair whose smaller set is in ``band``."""
        largest = self.low(band + 1) - 1
        return (100 - self.percent) * (largest + 100 * largest // self.percent) // (100 + self.percent)

    @lru_cache(None)  # noqa: B019  (one plan lives as long as its job)
    def allocation(self, band: int) -> tuple[int, int, int]:
        """(exact segments, one-deletion segments, slack); all zero where only equal sets can link."""
        h, n = self.bound(band), self.low(band)
        if h == 0:
            return 0, 0, 0
        count = max(1, self.sets.get(band, 1))
        deletions = h // 2 + 1
        best = deletions + n, (0, deletions, 2 * deletions - h - 1)
        # Slack so large that hardly one set of the band has more empty segments (normal tail of their number).
        sigmas, slack = math.sqrt(2 * math.log(count + 1)), 1
        for _ in range(60):
            m = h + 1 + slack
            if m > n:
                break
            empty = m * math.exp(-n / m)
            need = math.ceil(empty + sigmas * math.sqrt(empty) + 1)
            if need <= slack:
                if m < best[0]:
                    best = m, (m, 0, slack)
                break
            slack = need
        return best[1]

    def sketch_bits(self, n: int) -> int:
        """Eight bits for each token two linked sets may differ in, 256 at least, as a power of two."""
        return max(256, 1 << (8 * self.bound(self.band(n)) - 1).bit_length())

    def signatures(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
        """(keys, LOW and FULL bits) of one set: as the smaller one in its own band, as the larger one for the band below; and for the two roles how many
        keys it must share with others to have a link."""
        band = self.band(len(tokens))
        keys, bits, needs = [], [], []
        mixed = mix(tokens + _GOLD)
        for b, low in ((band, LOW), (band - 1, 0)):
            exact, deleting, slack = self.allocation(b) if b >= 0 else (0, 0, 0)
            m = exact + deleting
            needs.append(1)
            if m == 0:
                continue
            seg = ((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            own, sums = seg[starts], np.add.reduceat(mixed, starts)
            base = np.uint64((b + 1) * int(_M1) & (1 << 64) - 1)
            if deleting:
                sizes = np.diff(np.r_[starts, len(tokens)])
                whole = np.zeros(m, np.uint64)
                whole[own.astype(np.int64)] = sums
                places = np.arange(m, dtype=np.uint64)
                keys += [_key(base, places, whole), _key(base, seg, np.repeat(sums, sizes) - mixed)]
                bits += [np.full(m, low | FULL, np.uint8), np.full(len(tokens), low, np.uint8)]
            else:
                keys.append(_key(base, own, sums))
                if m - len(own) > slack:
                    none = np.setdiff1d(np.arange(m, dtype=np.uint64), own)
                    keys.append(_key(base, none, np.zeros(len(none), np.uint64)))
                else:  # a set with its empty segments can meet one without them, so only here is more than one key certain
                    needs[-1] = slack + 1 - (m - len(own))
                bits += [np.full(len(k), low | FULL, np.uint8) for k in keys[len(bits) :]]
        if not keys:
            return np.empty(0, np.uint64), np.empty(0, np.uint8), (1, 1)
        return np.concatenate(keys), np.concatenate(bits), (needs[0], needs[1])


def _key(base: np.uint64, seg: np.ndarray, content: np.ndarray) -> np.ndarray:
    return mix(mix(content + base) + (seg + np.uint64(1)) * _GOLD)


# Blocks: sorted keys with the local number of their document and its bits


def _squeezed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _widened(data: bytes, kind: str) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


class _Blocks:
    def __init__(self, ranges: int):
        self.ranges = ranges
        self.clear()

    def clear(self) -> None:
        self.known: set[int] = set()
        self.nodes, self.sizes, self.keys, self.docs, self.bits, self.n = [], [], [], [], [], 0

    def add(self, node: int, size: int, keys: np.ndarray, bits: np.ndarray, needs: tuple[int, int]) -> None:
        self.known.add(node)
        self.docs.append(np.full(len(keys), len(self.nodes), np.uint32))
        self.nodes.append(node), self.sizes.append((size, *(min(x, 65535) for x in needs))), self.keys.append(keys), self.bits.append(bits)
        self.n += len(keys)

    def rows(self):
        """(range, keys, docs, bits, nodes, sizes and needs of the documents in it), the first three compressed."""
        if not self.n:
            return
        keys, docs, bits = np.concatenate(self.keys), np.concatenate(self.docs), np.concatenate(self.bits)
        order = np.argsort(keys)
        keys, docs, bits = keys[order], docs[order], bits[order]
        nodes, sizes = np.array(self.nodes, np.int64), np.array(self.sizes, _SIZES)
        place = ((keys >> np.uint64(32)) * np.uint64(self.ranges)) >> np.uint64(32)
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            used, local = np.unique(docs[a:b], return_inverse=True)
            yield int(place[a]), _squeezed(keys[a:b]), _squeezed(local.astype(np.uint32)), _squeezed(bits[a:b]), nodes[used].tobytes(), sizes[used].tobytes()
        self.clear()


_BLOCK = ("keys", "docs", "bits", "nodes", "sizes")
_SIZES = np.dtype([("n", "<u4"), ("low", "<u2"), ("high", "<u2")])


def _signed(docs: DataFrame, id_col: str, text_col: str, words: int, plan: Plan, ranges: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, digest, node) of every document, where the digest of an empty set is null; and the signatures of all sets as blocks by key range. Every
    text is shingled once for both, and equal sets of one block are signed once."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n int, digest binary, node long, place int, " + ", ".join(f"{c} binary" for c in _BLOCK)

    def run(batches):
        begin("words")
        blocks, id_type = _Blocks(ranges), None

        def flushed():
            out = list(blocks.rows())
            for i in range(0, len(out), 16):
                part = list(zip(*out[i : i + 16], strict=True))
                none = [pa.nulls(len(part[0]), t) for t in (id_type, pa.int32(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(part[0], pa.int32()), *(pa.array(c, pa.binary()) for c in part[1:])], names)

        for batch in small_batches(batches):
            id_type, digests, sizes = batch.schema.field(0).type, [], []
            for text in strings(batch.column(1)):
                tokens = shingles(text, words)
                digests.append(digest(tokens) if len(tokens) else None)
                sizes.append(len(tokens))
                if len(tokens) and (d := node(digests[-1])) not in blocks.known:
                    blocks.add(d, len(tokens), *plan.signatures(tokens))
                    if blocks.n >= FLUSH:
                        yield from flushed()
            own = [batch.column(0), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array([d and node(d) for d in digests], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *(pa.nulls(len(sizes), t) for t in [pa.int32()] + [pa.binary()] * len(_BLOCK))], names)
        if blocks.n:
            yield from flushed()

    names = ["doc_id", "n", "digest", "node", "place", *_BLOCK]
    both = stored(in_batches(spread(rows), run, schema), "classes-and-blocks")
    return both.filter("place IS NULL").select("doc_id", "n", "digest", "node"), both.filter("place IS NOT NULL").select("place", *_BLOCK)


def _shared_keys(blocks: DataFrame, ranges: int) -> DataFrame:
    """(key, node, n, need, low, full): the members of every key that two classes share."""

    def run(table: pa.Table) -> pa.Table:
        keys, docs, bits, nodes, sizes, base = [], [], [], [], [], 0
        for row in table.to_batches():
            for k, d, b, g, s in zip(*(row.column(c) for c in _BLOCK), strict=True):
                keys.append(_widened(k.as_py(), "<u8"))
                docs.append(_widened(d.as_py(), "<u4").astype(np.int64) + base)
                bits.append(_widened(b.as_py(), "u1"))
                nodes.append(np.frombuffer(g.as_py(), "<i8")), sizes.append(np.frombuffer(s.as_py(), _SIZES))
                base += len(sizes[-1])
        keys, docs, bits, nodes, sizes = map(np.concatenate, (keys, docs, bits, nodes, sizes))
        order = np.argsort(keys, kind="stable")
        keys, docs, bits = keys[order], docs[order], bits[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        of = nodes[docs]
        live = (np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)) & (np.bitwise_or.reduceat(bits, starts) == LOW | FULL)
        keep = np.repeat(live, np.diff(np.r_[starts, len(keys)]))
        keys, docs, bits, of = keys[keep], docs[keep], bits[keep], of[keep]
        order = np.lexsort((bits, of, keys))
        keys, docs, bits, of = keys[order], docs[order], bits[order], of[order]
        first = np.r_[True, (keys[1:] != keys[:-1]) | (of[1:] != of[:-1]) | (bits[1:] != bits[:-1])] if len(keys) else np.zeros(0, bool)
        keys, docs, bits, of = keys[first], docs[first], bits[first], of[first]
        size = sizes[docs]
        return pa.table({
            "key": pa.array(keys.view(np.int64)), "node": pa.array(of), "n": pa.array(size["n"].astype(np.int32)),
            "need": pa.array(np.where(bits & LOW, size["low"], size["high"]).astype(np.int32)), "low": pa.array((bits & LOW) > 0), "full": pa.array((bits & FULL) > 0),
        })

    dealt = blocks.repartition(max(ranges, partitions(blocks.sparkSession)), "place")
    return dealt.groupBy("place").applyInArrow(tidy(run), "key long, node long, n int, need int, low boolean, full boolean")


def _sharing_enough(members: DataFrame) -> DataFrame:
    """Without most classes that share fewer keys than a link needs, and keys that then have one class only; twice, as each makes more of the other.

    The members themselves do not shuffle: bit tables of what stays are probed, and what they let pass by mistake does no harm.
    """

    def passing(kept: DataFrame, by: list[str]) -> DataFrame:
        cells = cell_count(kept.count())
        bits = bit_table(kept.select(F.explode(F.array(*bit_cells(F.xxhash64(*by), cells))).alias("cell")))
        return probe(members, bits, bit_cells(F.xxhash64(*by), cells), "stays").filter("stays").drop("stays")

    for _ in range(2):
        # (key, node, low) repeats only where one shared key is enough, so rows count as keys.
        enough = members.groupBy("node", "low").agg(F.count("*").alias("keys"), F.max("need").alias("need")).filter("keys >= need")
        members = passing(stored(enough.select("node", "low"), "enough"), ["node", "low"])
        live = members.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.max("low").alias("low"), F.max("full").alias("full"))
        members = stored(passing(stored(live.filter("x <> y AND low AND full").select("key"), "live-keys"), ["key"]), "enough-keys")
    return members


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, by minimum labels with pointer jumping. ``edges``: a, b."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(step.join(jump, "label").select("node", "old", F.least("label", "further").alias("label")), "labels")
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int, plan: Plan) -> DataFrame:
    """(node, tokens, sketch) of the wanted classes, from the text of one document each; the other texts do not shuffle."""
    ids = stored(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct(), "ids")
    texts = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    hashed = F.xxhash64("id")
    count = wanted.count()
    cells = cell_count(count)
    bits = bit_table(ids.select(F.explode(F.array(*bit_cells(hashed, cells))).alias("cell")))
    maybe = probe(texts, bits, bit_cells(hashed, cells), "maybe").filter("maybe").select("id", "text")
    found = maybe.join(ids.withColumnRenamed("id", "own"), F.col("id").eqNullSafe(F.col("own")), "left_semi")

    def run(batches):
        begin("words")
        for batch in small_batches(batches):
            sets = [shingles(t, words) for t in strings(batch.column(1))]
            sets = [s for s in sets if len(s)]
            sketches = [sketch(s, plan.sketch_bits(len(s))) for s in sets]
            columns = [pa.array([node(digest(s)) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "tokens", "sketch"])

    # A repeated id can bring a set twice or one that nobody asked for; the pairs found with them are made distinct, so neither needs a shuffle.
    return in_batches(found, run, "node long, tokens array<long>, sketch binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by the intersection of the whole sets. Each side meets its pairs first, so that only sets of pairs move, and they
    meet each other by pair: a centre of many pairs is no hot key."""
    pairs = stored(pairs.distinct(), "pairs")
    of = F.broadcast(pairs) if pairs.count() <= BROADCAST_PAIRS else pairs
    x = sets.join(of, F.col("node") == F.col("a")).select("a", "b", F.col("tokens").alias("x"))
    y = sets.join(of, F.col("node") == F.col("b")).select("a", "b", F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    both = x.join(y, ["a", "b"])
    return both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def links(docs: DataFrame, words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links, itself included)."""
    plan, ranges = make_plan(docs, percent, text_col)
    rows, blocks = _signed(docs, id_col, text_col, words, plan, ranges)
    members = _sharing_enough(stored(_shared_keys(blocks, ranges), "shared-keys"))
    labels = _linked(docs, rows, members, id_col, text_col, words, plan)
    # Copies collapse to their class before any join, and hot classes and components are broadcast: no group meets in one task.
    of = rows.filter("digest IS NOT NULL")
    classes = of.groupBy("digest", "node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    label = F.col("node") if labels is None else F.coalesce("label", "node")
    classes = stored((classes if labels is None else classes.join(labels, "node", "left")).select("digest", "least", "copies", label.alias("label")), "classes")
    named = stored(classes.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("size"), F.sum("copies").alias("rows")), "components")
    total = named.agg(F.sum("size"), F.sum("rows")).first()
    placed = stored(join_groups(classes, named, "label", "size", total[0] or 0).select("digest", "copies", "component_id"), "placed")
    out = join_groups(of, placed, "digest", "copies", total[1] or 0).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    alone = rows.filter("digest IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def make_plan(docs: DataFrame, percent: int, text_col: str) -> tuple[Plan, int]:
    """Numbers of sets by band from the lengths of all texts (about six characters a word); they decide costs only."""
    length = F.greatest(F.lit(1.0), F.length(quoted(text_col)) / 6.0)
    step = math.log(100 / percent)
    found = docs.groupBy(F.floor(F.log(length) / step).alias("level")).agg(F.count("*").alias("n"), F.sum(length).alias("words")).collect()
    plan, sets = Plan(percent, {}), {}
    for r in found:
        if r.level is not None:
            band = plan.band(max(1, round(math.exp((r.level + 0.5) * step))))
            sets[band] = sets.get(band, 0) + r.n
    total = sum(r.words or 0 for r in found) * 2.5 * (100 - percent) / 100
    return Plan(percent, sets), max(1, math.ceil(total / RANGE))


def _linked(docs, rows, members, id_col, text_col, words, plan):
    """(node, label) of the classes that link with another; None where no key is shared."""
    if members.isEmpty():
        return None
    percent = plan.percent
    sets = stored(_sets(docs, rows, members.select("node").distinct(), id_col, text_col, words, plan), "sets")
    # Popularity: how many keys a class shares. Near copies share most with their common original.
    popular = members.groupBy("node").agg(F.count("*").alias("popularity"))
    ranked = stored(members.select("key", "node", "n").join(popular, "node"), "ranked")
    centre = ranked.groupBy("key").agg(F.max(F.struct("popularity", "node", "n")).alias("centre"))
    first = ranked.join(centre, "key").filter(F.col("node") != F.col("centre.node")).filter(_compatible(F.col("n"), F.col("centre.n"), percent))
    first = first.groupBy(F.col("node").alias("a")).agg(F.max("centre").alias("centre")).select("a", F.col("centre.node").alias("b"))
    found = stored(_verified(first, sets, percent), "links")
    labels = components(found)
    # Keys whose members are all of one component have nothing left to find.
    placed = members.join(labels, "node", "left").select("key", "node", "n", "low", "full", F.coalesce("label", "node").alias("label"))
    placed = stored(placed, "placed-keys")
    split = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("g")).filter("x <> y").select("key", "g")
    open_ = stored(placed.join(split, "key"), "open-keys")
    sketches = sets.select("node", "sketch").dropDuplicates(["node"])
    more = stored(_verified(_near_pairs(open_.join(sketches, "node"), open_.count(), percent), sets, percent), "links")
    if more.isEmpty():
        return labels
    return components(found.unionByName(more))


def _near_pairs(open_: DataFrame, count: int, percent: int) -> DataFrame:
    """(a, b): pairs of different components in one key whose sketches allow a link. A key of g members is compared in blocks of BLOCK_MEMBERS."""
    sides = F.ceil(F.col("g") / BLOCK_MEMBERS).cast("int")
    rows = open_.withColumn("sides", sides).withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    rows = rows.select("key", F.least("side", "other").alias("s"), F.greatest("side", "other").alias("t"), "side", "node", "n", "low", "full", "label", "sketch")
    tasks = max(partitions(open_.sparkSession), math.ceil(count / OPEN_ROWS))
    place = F.pmod(F.xxhash64("key", "s", "t"), F.lit(tasks)).cast("int").alias("place")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("s", "ascending"), ("t", "ascending")])
        key, s, t, side, n = (table.column(c).to_numpy() for c in ("key", "s", "t", "side", "n"))
        low, full = (table.column(c).to_numpy(zero_copy_only=False) for c in ("low", "full"))
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        names, sketches = table.column("node").to_pylist(), table.column("sketch").to_pylist()
        cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1]), True])
        out = set()
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = np.arange(a, b)
            if (label[own] == label[a]).all():
                continue
            width = min(len(sketches[i]) for i in own)
            words = np.stack([_folded(sketches[i], width) for i in own])
            # Rows of the key's largest component meet the others only: pairs inside it need no check.
            main = np.bincount(label[own]).argmax()
            left = own[label[own] != main]
            for at in range(0, len(left), 16):
                i = left[at : at + 16]
                apart = np.bitwise_count(words[i - a][:, None, :] ^ words[None, :, :]).sum(-1, dtype=np.int64)
                total = n[i][:, None] + n[own][None, :]
                ok = (apart * (100 + percent) <= (100 - percent) * total) & (label[i][:, None] != label[own][None, :])
                ok &= (low[i][:, None] | low[own][None, :]) & (full[i][:, None] | full[own][None, :])
                if s[a] != t[a]:
                    ok &= side[i][:, None] != side[own][None, :]
                for x, y in zip(*np.nonzero(ok), strict=True):
                    out.add(tuple(sorted((names[i[x]], names[own[y]]))))
        pairs = sorted(out)
        return pa.table({"a": pa.array([x for x, _ in pairs], pa.int64()), "b": pa.array([y for _, y in pairs], pa.int64())})

    return rows.withColumn("place", place).groupBy("place").applyInArrow(tidy(run), "a long, b long")


def _folded(sketch_: bytes, width: int) -> np.ndarray:
    x = np.frombuffer(sketch_, np.uint64)
    while len(x) * 8 > width:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _compatible(n, m, percent: int):
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, with all columns: the one of the smallest id, null ids last. Rows are judged one by one, for a row goes by its id and the
    hash of its text; rows that repeat both are one document."""
    own = next(n for n in iter(lambda: f"row{uuid.uuid4().hex}", None) if n not in docs.columns)
    named = docs.withColumn(own, F.struct(quoted(id_col).isNull().alias("none"), quoted(id_col).alias("id"), F.xxhash64(F.coalesce(quoted(text_col), F.lit(""))).alias("text")))
    dropped = links(named, words, percent, own, text_col).filter("doc_id <> component_id").select("doc_id")
    return without(named, own, stored(dropped, "near-copies")).drop(own)
