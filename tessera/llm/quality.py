"""Quality classifier: word n-gram models of trusted text over character n-gram models, with interpolated modified Kneser-Ney smoothing.

What the word models (see ``word_models``) gather grows with the trusted text. The character models spell the words that those do not know, and score too.

Trusted text is every document labelled good. Two models a language are trained, one from each half of the trusted documents (halves by text
hash, so equal texts share a half), and every document is scored by the model of the other half: all trusted text is counted and no score is
of text the model has seen. Thresholds are quantiles of the trusted documents' own scores, by language.

Sharding: documents are packed into chunks of bounded size. First the chunks of trusted documents send their distinct n-grams in packets with counts; these
meet by shards, and what each shard holds for a model is written once. Then the chunks of all documents are scored in rounds of some chunks each: a chunk
sends its distinct n-grams without counts, each shard answers in the order of the packet, and the chunk sums the answers per document. What a round moved
is deleted before the next, so that the disk holds the models and a round's share of the rest. Whatever the probability of a character n-gram needs, its
own count, its shorter forms and all their contexts, ends in the symbol before the last or in it and one more, so a shard of such symbols holds it whole;
only the probabilities of single symbols and the discounts are summed over all shards.

A symbol is a code point of the Basic Multilingual Plane; others fold into the private use area. An n-gram of up to four symbols is one
64-bit number, 16 bits a symbol, so prefix and suffix are bit operations.

The score of a document is its mean negative log probability a symbol, half by each model, shrunk to the mean of its language with the weight of SHRINK symbols,
so that very short texts are judged mildly.

Defined results: a null or empty text has its end symbol only; a language without trusted documents has no threshold and all its documents
stay; a null language is a language of its own; repeated rows are judged alike; a very long text is one pack; an empty table gives an empty result. ``score``
reads the id, the text and the language only, once a round, so ``docs`` must give the same rows each time, and ``keep_good`` gives all columns back: further columns may have any name.
"""

import io
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from . import word_models
from .common import bit_cells, bit_table, bucketed, cell_count, freed_shuffles, in_batches, partitions, probe, quoted, release, small_batches, spread, stored, tidy, without, written

ORDER = 4
#: Characters a chunk: its packs, its distinct n-grams and their probabilities fit a small worker.
CHUNK_CHARS = 16_000_000
#: Characters from which a small table is dealt into more chunks, one a core.
LEAST_CHARS = 1_000_000
#: Rounds in which the documents are scored, at most, and the characters of one, at least. Each round reads the documents and the models again.
MAX_ROUNDS, ROUND_CHARS = 4, 16_000_000
SHRINK = 200.0
#: The share of trusted documents below the threshold.
QUANTILE = 0.9995
BOS, EOS, NUL = 0xEFFE, 0xEFFD, 0xEFFF
#: Shards of the character n-grams of a language.
CHAR_BUCKETS = 64
#: Languages whose means and thresholds are broadcast.
MAX_BROADCAST = 10_000
#: Slots of the small tables of recent keys, two to this power: they stay in the processor's cache.
_SEEN_BITS = 17


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams that end in each symbol of each text and in its end, as 64-bit keys, and where each text begins among them."""
    pad = "\x00" * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(t.replace("\x00", chr(NUL)) for t in texts) + pad).encode("utf-32-le", "surrogatepass"), "<u4")
    s = raw.astype(np.uint64)
    if len(wide := np.flatnonzero(raw > 0xFFFF)):
        s[wide] = np.uint64(0xE000) | (s[wide] & np.uint64(0xFFF))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.r_[0, np.cumsum(sizes)]
    # Between texts lie ORDER - 1 pads: the first ends the text before, and all stand for the begin of the next.
    kept = np.ones(max(0, len(raw) - (ORDER - 1)), bool)
    for k in range(1, ORDER - 1):
        kept[starts[1:] + np.arange(len(texts)) * (ORDER - 2) + k - 1] = False
    pads = np.flatnonzero(raw == 0)
    before = s.copy()
    before[pads], s[pads] = BOS, EOS
    key = s[ORDER - 1 :]
    for k in range(1, ORDER):
        key |= before[ORDER - 1 - k : len(raw) - k] << np.uint64(16 * k)
    key = key[kept]
    return key, starts


class _Seen:
    """Passes on the keys it has not just met; what it forgets comes again, so the caller makes the keys distinct."""

    def __init__(self):
        self.slots = np.zeros(1 << _SEEN_BITS, np.uint64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)
        new = self.slots[at] != keys
        keys, at = keys[new], at[new]
        self.slots[at] = keys
        return keys


def _pack(columns: list[pa.Array], names: list[str]) -> bytes:
    sink = io.BytesIO()
    batch = pa.RecordBatch.from_arrays(columns, names)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as w:
        w.write_batch(batch)
    return sink.getvalue()


def _unpacked(packs: pa.ChunkedArray):
    """(ids, models, texts) of each pack, one at a time."""
    for p in packs:
        with pa.ipc.open_stream(p.as_buffer()) as r:
            for b in r:
                yield b.column(0), np.array(b.column(1).to_pylist()), b.column(2).to_pylist()


def _rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, chunks: int) -> DataFrame:
    """(chunk, id, model, text)."""
    text = F.coalesce(quoted(text_col), F.lit(""))
    model = F.concat(F.coalesce(quoted(lang_col).cast("string"), F.lit("\x00")), F.pmod(F.xxhash64(text), F.lit(2)).cast("string"))
    chunk = F.pmod(F.coalesce(F.when(quoted(id_col).isNotNull(), F.xxhash64(quoted(id_col))), F.xxhash64(text)), F.lit(chunks)).cast("int")
    return docs.select(chunk.alias("chunk"), quoted(id_col).alias("id"), model.alias("model"), text.alias("text"))


def _packed(rows: DataFrame, chunks: int) -> DataFrame:
    """(chunk, pack) dealt out by chunk."""

    def run(batches):
        for batch in small_batches(batches):
            own = batch.column(0).to_numpy()
            order = np.argsort(own, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0, True])
            sorted_ = batch.take(pa.array(order))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = sorted_.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array([own[order[a]]], pa.int32()), pa.array([_pack(part.columns[1:], ["id", "model", "text"])], pa.binary())], ["chunk", "pack"])

    return in_batches(spread(rows), run, "chunk int, pack binary").repartition(max(chunks, partitions(rows.sparkSession)), "chunk")


def _by_model(models: np.ndarray, texts: list[str]):
    for m in np.unique(models):
        at = np.flatnonzero(models == m)
        yield str(m), at, [texts[i] for i in at]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams counted once to four times; fixed ones where those are too few."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [max(min(i - (i + 1) * y * n[i] / n[i - 1], i), 0.05 * i) if n[0] and n[1] and n[i - 1] else 0.5 * i for i in (1, 2, 3)]


def _level(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-grams that end these (k + 1)-grams, and how many of them each ends."""
    return np.unique(keys & np.uint64((1 << 16 * k) - 1), return_counts=True)


class _Grams:
    """The distinct 4-grams of the texts given so far, with their counts if they count."""

    def __init__(self, counting: bool):
        self.seen, self.keys, self.counted = None if counting else _Seen(), [], []

    def add(self, texts: list[str]) -> None:
        keys, _ = symbols(texts)
        if not self.seen:
            self.counted.append(np.unique(keys, return_counts=True))
        elif len(new := self.seen(keys)):
            self.keys.append(word_models.distinct(new))
        if len(self.keys) > 64:
            self.keys = [word_models.distinct(np.concatenate(self.keys))]
        if len(self.counted) > 64:
            self.counted = [_summed(self.counted)]

    def packets(self, buckets: int):
        """(bucket, pack): by the symbol before the last."""
        keys, *c = (word_models.distinct(np.concatenate(self.keys)),) if self.seen else _summed(self.counted)
        of = ((keys >> np.uint64(16)) & np.uint64(0xFFFF)) % np.uint64(buckets)
        for k in np.unique(of).tolist():
            yield k, word_models.pack_words(keys[of == k], *(x[of == k] for x in c))


#: What a packet holds: character 4-grams, words, or word trigrams.
CHARS, WORDS, TRIGRAMS = 0, 1, 3
_PACKET = "chunk int, lang string, half int, kind int, bucket int, pack binary"
_KEYS = ("lang", "kind", "bucket")


def _packets(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ((),) * 6
    types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    names = ("chunk", "lang", "half", "kind", "bucket", "pack")
    return pa.table({n: pa.array(x, t) for n, x, t in zip(names, columns, types, strict=True)})


def _sent(packed: pa.Table, buckets: int, char_buckets: int, good: set | None = None) -> pa.Table:
    """The packets of a chunk: all its texts ask the model of their half; with ``good`` the texts of these ids count for the model of the other half."""
    counting, grams, texts_of, rows = good is not None, {}, {}, []
    for own, models, texts in _unpacked(packed.column("pack")):
        if counting:
            trust = np.flatnonzero(np.fromiter((i in good for i in own.to_pylist()), bool, len(own)))
            models, texts = models[trust], [texts[i] for i in trust]
        for m, _, part in _by_model(models, texts):
            grams.setdefault(m, _Grams(counting)).add(part)
            words, _, sizes = word_models.tokens(part)
            texts_of.setdefault(m, []).append((words, sizes))
    chunk = packed.column("chunk")[0].as_py() if packed.num_rows else 0
    for m in sorted(grams):
        place = (chunk, m[:-1], 1 - int(m[-1]) if counting else int(m[-1]))
        rows += [(*place, CHARS, k, pack) for k, pack in grams.pop(m).packets(char_buckets)]
        d = word_models.Distinct(*(np.concatenate(x) for x in zip(*texts_of.pop(m), strict=True)), places=False)
        three, one = ((d.counts,), (np.bincount(d.word),)) if counting else ((), ())
        middle = d.vocabulary[d.numbers[1]]
        rows += [(*place, TRIGRAMS, k, word_models.pack_grams(d.vocabulary, *(x[a:b] for x in (*d.numbers, *three)))) for k, a, b in word_models.cuts(middle, buckets)]
        rows += [(*place, WORDS, k, word_models.pack_words(*(x[a:b] for x in (d.words, *one)))) for k, a, b in word_models.cuts(d.words, buckets)]
    return _packets(rows)


def _counted(packs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """The packets that count, of the trusted texts of each chunk; ``half`` is that of the model they are for."""
    char_buckets = CHAR_BUCKETS

    def run(packed: pa.Table, ids: pa.Table) -> pa.Table:
        return _sent(packed, buckets, char_buckets, set(ids.column("id").to_pylist()))

    return packs.groupBy("chunk").cogroup(trusted.groupBy("chunk")).applyInArrow(tidy(run), _PACKET)


def _asked(packs: DataFrame, buckets: int) -> DataFrame:
    """The packets that ask, of all texts of each chunk."""
    char_buckets = CHAR_BUCKETS

    def run(packed: pa.Table) -> pa.Table:
        return _sent(packed, buckets, char_buckets)

    return packs.groupBy("chunk").applyInArrow(tidy(run), _PACKET)


#: Rows of ``_built``: a shard's pack for a model, or (k not null) its share in what the model needs of all its shards: numbers of n-grams by count, of word
#: n-grams (1 to 3) and of character n-grams (10 + 2 to 10 + ORDER), and symbols with the number of symbols before them.
_SYMBOL = 11
_NUMBERS = ("n1", "n2", "n3", "n4", "total", "kinds")
_BUILT = "lang string, half int, kind int, bucket int, pack binary, k int, symbol int, " + ", ".join(f"{x} long" for x in _NUMBERS)


def _built(counted: DataFrame) -> DataFrame:
    """What the packets that count give to each shard of each model."""

    def shard_of(kind: int, packs: list[bytes]) -> tuple[bytes, list[tuple]]:
        if kind == TRIGRAMS:
            shard = word_models.Shard(packs)
            return shard.pack(), [(3, 0, *word_models.counts_of_counts(shard.c3)), (2, 0, *word_models.counts_of_counts(shard.c2))]
        keys, c = word_models.words_of(packs)
        pack, rows = word_models.pack_words(keys, c), []
        if kind == WORDS:
            return pack, [(1, 0, *word_models.counts_of_counts(c))]
        for k in range(ORDER, 1, -1):
            rows.append((10 + k, 0, *word_models.counts_of_counts(c)))
            keys, c = _level(keys, c, k - 1)
        return pack, rows + [(_SYMBOL, x, 0, 0, 0, 0, n, 0) for x, n in zip(keys.tolist(), c.tolist(), strict=True)]

    def run(table: pa.Table) -> pa.Table:
        lang, kind, bucket = (table.column(x)[0].as_py() for x in _KEYS)
        rows = []
        for half in (0, 1):
            if packs := table.column("pack").filter(pa.array(table.column("half").to_numpy() == half)).to_pylist():
                pack, shares = shard_of(kind, packs)
                rows += [(lang, half, kind, bucket, pack, *[None] * 8), *((lang, half, kind, bucket, None, *x) for x in shares)]
        types = [pa.string(), *[pa.int32()] * 3, pa.binary(), *[pa.int32()] * 2, *[pa.int64()] * 6]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["lang", "half", "kind", "bucket", "pack", "k", "symbol", *_NUMBERS])

    return counted.groupBy(*_KEYS).applyInArrow(tidy(run), _BUILT)


def _models(parts: DataFrame) -> DataFrame:
    """(lang, words, chars): a pack of both models' discounts (words) and of their discounts and symbol probabilities (characters)."""

    def run(table: pa.Table) -> pa.Table:
        half, k = table.column("half").to_numpy(), table.column("k").to_numpy()
        n = np.stack([table.column(f"n{i}").to_numpy() for i in (1, 2, 3, 4)], 1)
        total, kinds = table.column("total").to_numpy(), table.column("kinds").to_numpy()
        symbol = table.column("symbol").to_numpy()
        words, chars = [], []
        for m in (0, 1):

            def summed(order: int) -> np.ndarray:
                return n[(half == m) & (k == order)].sum(0)  # noqa: B023 -- called at once

            d = [discounts(summed(order).tolist()) for order in (1, 2, 3)]
            at = (half == m) & (k == 1)
            one, of = int(total[at].sum()), summed(1)
            left = d[0][0] * of[0] + d[0][1] * of[1] + d[0][2] * (int(kinds[at].sum()) - of[0] - of[1])
            words.append(np.array([*d[0], *d[1], *d[2], one, left] if one else [0.0] * 9 + [1.0, 1.0]))
            at = np.flatnonzero((half == m) & (k == _SYMBOL))
            at = at[np.argsort(symbol[at])]
            c = total[at]
            p, unknown = np.empty(0), 1e-6
            if len(c):
                first = np.array(discounts([int((c == i).sum()) for i in (1, 2, 3, 4)]))[np.minimum(c, 3) - 1]
                unknown = first.sum() / c.sum() / (len(c) + 1)
                p = (c - first) / c.sum() + unknown
            chars += [np.array([x for order in range(2, ORDER + 1) for x in discounts(summed(10 + order).tolist())]), symbol[at].astype(np.uint32), p, np.array([unknown])]
        packs = [pa.array([word_models.packed(*x)], pa.binary()) for x in (words, chars)]
        return pa.table([table.column("lang")[:1].combine_chunks(), *packs], ["lang", "words", "chars"])

    return parts.groupBy("lang").applyInArrow(tidy(run), "lang string, words binary, chars binary")


def levels(keys: np.ndarray, c: np.ndarray, d: list[float]) -> list[tuple[np.ndarray, ...]]:
    """Of a shard's counts, for the orders 2 to ORDER: n-grams, the own probability of each, contexts, and the share that each leaves; d: discounts."""
    out, grams, count = [], keys, c
    for k in range(ORDER, 1, -1):
        off = np.array(d[3 * (k - 2) : 3 * (k - 1)])[np.minimum(count, 3) - 1]
        contexts, of = word_models.runs(grams >> np.uint64(16))
        total = np.bincount(of, count)
        out.append((grams, (count - off) / total[of], contexts, np.bincount(of, off) / total))
        grams, count = _level(grams, count, k - 1)
    return out[::-1]


def interpolated(asked: np.ndarray, p: np.ndarray, of: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """Probabilities of the asked 4-grams' last symbols from a shard's ``levels``; p: those of the symbols alone."""
    for k, (grams, first, contexts, left) in enumerate(of, 2):
        own = asked & np.uint64((1 << 16 * k) - 1)
        at, known = word_models._found(contexts, own >> np.uint64(16))
        gram, seen = word_models._found(grams, own)
        p = np.where(known, np.where(seen, first[gram], 0.0) + left[at] * p, p)
    return p


#: In place of a chunk and a half: the parameters of both models.
_BOTH = -1


def _parameters(built: DataFrame, buckets: int) -> DataFrame:
    """Packets with both models' parameters for each shard."""
    parts = built.filter("k IS NOT NULL").groupBy("lang", "half", "k", "symbol").agg(*(F.sum(x).alias(x) for x in _NUMBERS))
    models = stored(_models(parts), "quality-parameters")
    kind = F.explode(F.array(*map(F.lit, (CHARS, WORDS, TRIGRAMS)))).alias("kind")
    each = models.select("lang", kind, "words", "chars").select("lang", "kind", F.when(F.col("kind") == CHARS, F.col("chars")).otherwise(F.col("words")).alias("pack"))
    last = F.when(F.col("kind") == CHARS, F.lit(CHAR_BUCKETS - 1)).otherwise(F.lit(buckets - 1))
    return each.select(F.lit(_BOTH).alias("chunk"), "lang", F.lit(_BOTH).alias("half"), "kind", F.explode(F.sequence(F.lit(0), last)).alias("bucket"), "pack")


def _unknown(kind: int) -> list[np.ndarray]:
    """The parameters of both models of a language without trusted text."""
    if kind == CHARS:
        return [np.array(discounts([0] * 4) * (ORDER - 1)), np.empty(0, np.uint32), np.empty(0), np.array([1e-6])] * 2
    return [np.array([0.0] * 9 + [1.0, 1.0])] * 2


def _answers(asked: DataFrame, parameters: DataFrame, built: DataFrame) -> DataFrame:
    """Every packet with the numbers of its n-grams instead, in its order; those of characters with their keys."""

    def run(table: pa.Table, model: pa.Table) -> pa.Table:
        asks = table.column("half").to_numpy() != _BOTH
        both, table = table.column("pack").filter(pa.array(~asks)).to_pylist(), table.filter(pa.array(asks))
        if not table.num_rows:
            return _packets([])
        kind, made = table.column("kind")[0].as_py(), np.empty(table.num_rows, object)
        of, half = dict(zip(model.column("half").to_pylist(), model.column("pack").to_pylist(), strict=True)), table.column("half").to_numpy()
        parameters = word_models.unpacked(both[0]) if both else _unknown(kind)
        for m in (0, 1):
            at = np.flatnonzero(half == m)
            if not len(at):
                continue
            if kind == TRIGRAMS:
                shard = (word_models.Shard.of(of[m]) if m in of else word_models.Shard([])).weigh(parameters[m][3:6], parameters[m][6:9])
            else:
                keys, c = word_models.unpack_words(of[m]) if m in of else (np.empty(0, np.uint64), np.empty(0, np.int64))
                c = c.astype(np.int64)
            if kind == CHARS:
                d, symbol, alone, (unknown,) = parameters[4 * m : 4 * m + 4]
                shard = levels(keys, c, d.tolist()) if len(keys) else []
            for i in at.tolist():
                pack = table.column("pack")[i].as_py()
                if kind == TRIGRAMS:
                    own = shard.answer(*word_models.grams_of(pack))
                    made[i] = word_models.packed(*map(word_models.rounded, own))
                    continue
                own = word_models.unpack_words(pack)[0]
                if kind == WORDS:
                    d = parameters[m]
                    found, known = word_models._found(keys, own)
                    p = np.where(known, c[found] - d[np.minimum(c[found], 3) - 1], 0.0) / d[9] if len(c) else np.zeros(len(own))
                    made[i] = word_models.packed(word_models.rounded(p), np.array([d[10] / d[9]], np.float32))
                    continue
                found, known = word_models._found(symbol, (own & np.uint64(0xFFFF)).astype(np.uint32))
                p = np.where(known, alone[found], unknown) if len(alone) else np.full(len(own), unknown)
                p = interpolated(own, p, shard)
                made[i] = word_models.packed(word_models.steps(own), np.log(p).astype(np.float32))
        return table.drop_columns(["pack"]).append_column("pack", pa.array(made.tolist(), pa.binary()))

    shards = built.filter("k IS NULL").select(*_KEYS, "half", "pack")
    return asked.unionByName(parameters).groupBy(*_KEYS).cogroup(shards.groupBy(*_KEYS)).applyInArrow(tidy(run), _PACKET)


class _Answered:
    """The log probabilities that a chunk got for one model, behind a table of recent ones."""

    def __init__(self, gram: np.ndarray, logp: np.ndarray):
        order = np.argsort(gram)
        self.gram, self.logp = gram[order], logp[order]
        self.slots = np.zeros(1 << _SEEN_BITS, np.uint64)
        self.values = np.zeros(1 << _SEEN_BITS)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SEEN_BITS)).astype(np.int64)
        out, new = self.values[at], np.flatnonzero(self.slots[at] != keys)
        if len(new):
            found = np.searchsorted(self.gram, keys[new])
            if not (found < len(self.gram)).all() or not (self.gram[found] == keys[new]).all():
                raise ValueError("an n-gram of the chunk was not answered")
            out[new] = self.logp[found]
            # Of two keys in one slot the last is written to both tables.
            self.slots[at[new]], self.values[at[new]] = keys[new], out[new]
        return out


def _word_log(words: np.ndarray, sizes: np.ndarray, spelled: np.ndarray, answers3: list, answers1: list) -> np.ndarray:
    """The log probability of each text; ``spelled``: those of its tokens by the character model; answers: (bucket, arrays)."""
    d = word_models.Distinct(words, sizes)
    a, b = (np.concatenate(x) for x in zip(*(p for _, p in sorted(answers3, key=lambda x: x[0])), strict=True))
    alone = sorted(answers1, key=lambda x: x[0])
    p1, left = np.concatenate([p[0] for _, p in alone]), float(alone[0][1][1][0])
    if len(a) != len(d.counts) or len(p1) != len(d.words):
        raise ValueError("an n-gram of the chunk was not answered")
    b = b[d.number].astype(float)
    p = a[d.number] + b * (p1[d.word] + left * np.exp(spelled.astype(float)))
    # A word whose spelling is too improbable for floating point keeps its sum of logarithms.
    log = np.where(p > 1e-300, np.log(np.maximum(p, 1e-300)), np.log(np.maximum(b * left, 1e-30)) + spelled)
    return np.add.reduceat(log, np.r_[0, np.cumsum(sizes)[:-1]])


def _scores(packs: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """(doc_id, model, n, nll, word_nll): symbols and summed negative log probabilities of each document by the character and by the word model."""

    def run(packed: pa.Table, answered: pa.Table) -> pa.Table:
        models, packets, got, rows = {}, {}, {}, []
        for row in answered.select(["lang", "half", "kind", "bucket", "pack"]).to_batches(64):
            for x in row.to_pylist():
                packets.setdefault((f"{x['lang']}{x['half']}", x["kind"]), []).append((x["bucket"], word_models.unpacked(x["pack"])))
        for m in {m for m, _ in packets}:
            keys, logp = (np.concatenate(x) for x in zip(*((np.cumsum(k, dtype=np.uint64), p) for _, (k, p) in packets.pop((m, CHARS))), strict=True))
            models[m] = _Answered(keys, logp)
        for ids, of, texts in _unpacked(packed.column("pack")):
            n, nll, word_nll = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts))
            for m, at, part in _by_model(of, texts):
                keys, starts = symbols(part)
                logs = models[m](keys)
                n[at], nll[at] = np.diff(starts), -np.add.reduceat(logs, starts[:-1])
                words, begins, sizes = word_models.tokens(part)
                got.setdefault(m, []).append((words, sizes, np.add.reduceat(logs, begins).astype(np.float32), word_nll, at))
            rows.append((ids, of, n, nll, word_nll))
        for m in sorted(got):
            parts = got.pop(m)
            log = _word_log(*(np.concatenate([p[i] for p in parts]) for i in range(3)), packets.pop((m, TRIGRAMS)), packets.pop((m, WORDS)))
            for (*_, into, at), own in zip(parts, np.split(log, np.cumsum([len(p[1]) for p in parts])[:-1]), strict=True):
                into[at] = -own
        names_ = ["doc_id", "model", "n", "nll", "word_nll"]
        out = [pa.table([ids, pa.array(of, pa.string()), *map(pa.array, more)], names_) for ids, of, *more in rows]
        empty = [pa.array([], t) for t in (id_type, pa.string(), pa.int64(), pa.float64(), pa.float64())]
        return pa.concat_tables(out) if out else pa.table(empty, names_)

    id_type = to_arrow_type(_parse_datatype_string(kind))
    return packs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(run), f"doc_id {kind}, model string, n long, nll double, word_nll double")


def _maybe_in(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` with the boolean ``maybe``: true for all whose id is in ``ids`` (stored) and a few others."""
    cells = cell_count(ids.count())
    hashed = F.xxhash64("id")
    bits = bit_table(ids.select(F.explode(F.array(*bit_cells(hashed, cells))).alias("cell")))
    return probe(rows, bits, bit_cells(hashed, cells), "hit").withColumn("maybe", F.expr("id IS NOT NULL AND hit")).drop("hit")


def _chunks(spark: SparkSession, characters: float) -> int:
    return max(1, math.ceil(characters / CHUNK_CHARS), min(spark.sparkContext.defaultParallelism, math.ceil(characters / LEAST_CHARS)))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, lang, n_symbols, perplexity, word_perplexity (both a symbol), score, threshold, kept. ``labels``: doc_id, quality (1: trusted)."""
    spark = docs.sparkSession
    kind = docs.select(quoted(id_col).alias("x")).schema["x"].dataType.simpleString()
    with freed_shuffles(spark):
        trusted = stored(labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast(kind).alias("id")).distinct(), "trusted")
        maybe, size = _maybe_in(docs.select(quoted(id_col).alias("id"), F.length(quoted(text_col)).alias("n")), trusted), F.sum("n")
        total, good_total = (x or 0 for x in maybe.agg(size, F.sum(F.when(F.col("maybe"), F.col("n")))).first())
        rounds = max(1, min(MAX_ROUNDS, total // ROUND_CHARS))
        per_round, n = _chunks(spark, total / rounds), _chunks(spark, good_total)
        buckets = max(1, math.ceil(total / word_models.BUCKET_CHARS))
        before = written()
        own = _maybe_in(_rows(docs, id_col, text_col, lang_col, n), trusted).filter("maybe").drop("maybe")
        counted = _counted(_packed(own, n), trusted.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("chunk"), "id"), buckets)
        built = bucketed(_built(counted), "quality-models", *_KEYS)
        parameters = _parameters(built, buckets)
        rows, scored = _rows(docs, id_col, text_col, lang_col, rounds * per_round), []
        for i in range(rounds):
            packs = _packed(rows.filter(F.pmod("chunk", F.lit(rounds)) == i), per_round)
            scored.append(stored(_scores(packs, _answers(_asked(packs, buckets), parameters, built), kind), "quality-scores"))
    release(spark, since=before, but=rounds)
    scored = reduce(DataFrame.unionByName, scored)
    both = ((F.col("nll") + F.col("word_nll")) / 2).alias("both")
    rows = scored.select("doc_id", F.expr("nullif(substring(model, 1, length(model) - 1), '\\u0000')").alias("lang"), F.col("n").alias("n_symbols"), "nll", "word_nll", both)
    good = rows.join(trusted.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    mean = stored(good.groupBy("lang").agg((F.sum("both") / F.sum("n_symbols")).alias("mean")), "means")
    shrunk = (F.col("both") + SHRINK * F.coalesce("mean", F.lit(0.0))) / (F.col("n_symbols") + SHRINK)
    at = _joined(good, mean).select("lang", shrunk.alias("score"))
    limit = stored(at.groupBy("lang").agg(F.percentile_approx("score", F.lit(QUANTILE), F.lit(20_000)).alias("threshold")), "thresholds")
    kept = F.coalesce(shrunk <= F.col("threshold"), F.lit(True))
    perplexity = F.exp(F.col("nll") / F.col("n_symbols"))
    out = _joined(_joined(rows, mean), limit)
    return out.select("doc_id", "lang", "n_symbols", perplexity.alias("perplexity"), F.exp(F.col("word_nll") / F.col("n_symbols")).alias("word_perplexity"), shrunk.alias("score"), "threshold", kept.alias("kept"))


def _joined(rows: DataFrame, by_lang: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``by_lang`` (stored, one row a language), nulls equal: broadcast up to MAX_BROADCAST languages, else as Spark decides."""
    other = by_lang.withColumnRenamed("lang", "__lang")
    if other.count() <= MAX_BROADCAST:
        other = F.broadcast(other)
    return rows.join(other, rows["lang"].eqNullSafe(F.col("__lang")), "left").drop("__lang")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns. An id goes when all its rows are rejected; rows without id stay."""
    judged = score(docs, labels, id_col, text_col, lang_col).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return without(docs, id_col, stored(judged.filter("NOT kept").select("doc_id"), "rejected"))
