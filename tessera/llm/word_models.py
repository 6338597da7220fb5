"""Word n-gram models of trusted text, orders 1 to 3, over the character models of ``quality`` for words they do not know.

A token is a run of letters and digits, of marks, or one ideograph, with the blanks before it; a text ends with a token of its own. A token is a
40-bit hash. The probability of a token interpolates modified Kneser-Ney trigrams and bigrams (continuation counts), discounted raw unigrams, and
last the probability that the character model gives the token's symbols: what the models gather grows with the trusted text, and no word is
unknown.

Sharding: a packet holds distinct n-grams of a chunk's texts; those that count have their counts, those that ask have none. It is of one bucket, by the
word before the last (orders 2 and 3) or by the word itself (order 1). A bucket holds all that its n-grams need but the discounts. A packet's n-grams
are in the order of their hashes, so that an answer is an array of numbers in the same order and carries no keys.
"""

from functools import lru_cache

import numpy as np
import pyarrow as pa

from .common import keeps

#: Characters of all texts a bucket.
BUCKET_CHARS = 1 << 25
#: Bits of a word's hash: with 10^8 words one in ten thousand shares its hash.
WORD_BITS = 40
BOS = np.uint64(0xF4914F6CDD)
_BLANK, _WORD, _ALONE, _MARK, _END = range(5)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_CODEC = pa.Codec("zstd", 3)


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x10000, _MARK, np.uint8)
    for i in range(0x10000):
        c = chr(i)
        if c.isspace():
            out[i] = _BLANK
        elif c.isalnum():
            out[i] = _ALONE if 0x2E80 <= i < 0xA000 else _WORD
    return out


@lru_cache(1)
def _begins() -> np.ndarray:
    """Whether a token begins between a symbol of one class (times eight) and the next one's."""
    before, after = np.divmod(np.arange(64, dtype=np.uint8), 8)
    return ((after != before) | (after == _ALONE)) & ((before != _BLANK) | (after == _END))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K[1]
    x = (x ^ (x >> np.uint64(27))) * _K[2]
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _codes() -> np.ndarray:
    return _mixed((np.arange(0x10000, dtype=np.uint64) + np.uint64(1)) * _K[0])


_kept: list[tuple[np.ndarray, np.ndarray]] = []
keeps("powers", _kept.clear)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number modulo 2^64, and of its inverse."""
    if not _kept or len(_kept[0][0]) < n:
        base, size = int(_K[0]), 1 << max(16, n.bit_length())
        _kept[:] = [tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))]
    return _kept[0]


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * _K[0] + _mixed(b + _K[3]))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each token, where it begins among the symbols of the texts and their ends, and the number of tokens of each text."""
    raw = np.frombuffer("".join(t.replace("\x00", "\uefff") + "\x00" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    ends = np.cumsum(sizes)
    wide = np.flatnonzero(raw > 0xFFFF)
    low = np.minimum(raw, 0xFFFF) if len(wide) else raw
    kind = _classes()[low]
    kind[wide] = _ALONE
    kind[ends - 1] = _END
    first = np.ones(len(raw), bool)
    first[1:] = _begins()[kind[:-1] * np.uint8(8) + kind[1:]]
    first[ends[:-1]] = True
    at = np.flatnonzero(first)
    # A token's hash is the sum of its symbols' numbers times powers of an odd base: powers of the place in the batch, taken back by the token's begin.
    codes = _codes()[low]
    if len(wide):
        codes[wide] = _mixed((raw[wide].astype(np.uint64) + np.uint64(1)) * _K[0])
    up, down = _powers(len(raw))
    codes *= up[: len(raw)]
    hashed = np.add.reduceat(codes, at) * down[at]
    last = np.searchsorted(at, ends)
    return _mixed(hashed) >> np.uint64(64 - WORD_BITS), at, np.diff(np.r_[0, last])


def distinct(x: np.ndarray) -> np.ndarray:
    """As np.unique, by sorting: numpy's table of hashes takes several times as long."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


#: Slots of the table that numbers words, two to this power.
_SLOT_BITS = 17


def numbered(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words, which ascend, and the number of each place: by a table of one word a slot, and by search where another word took the slot."""
    found = distinct(words)
    slot = found >> np.uint64(WORD_BITS - _SLOT_BITS)
    table = np.zeros(1 << _SLOT_BITS, np.int32)
    table[slot] = np.arange(len(found), dtype=np.int32)
    number = table[words >> np.uint64(WORD_BITS - _SLOT_BITS)].astype(np.int64)
    other = np.flatnonzero(found[number] != words) if len(found) else np.empty(0, np.int64)
    number[other] = np.searchsorted(found, words[other])
    return found, number


class Distinct:
    """Distinct trigrams of texts (which begin with BOS twice) in the order of (middle, first, last), with counts (of the marked places) and, unless they are
    only counted, the number of each place. ``numbers`` are their words' places in ``vocabulary``, which ascends; ``words`` and ``word`` are the distinct words and their numbers."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, marked: np.ndarray | None = None, places: bool = True):
        n, begins = len(words), np.r_[0, np.cumsum(sizes)[:-1]]
        self.words, self.word = numbered(words)
        bos = int(np.searchsorted(self.words, BOS))
        there = bos < len(self.words) and self.words[bos] == BOS
        self.vocabulary = self.words if there else np.insert(self.words, bos, BOS)
        three = self.word.astype(np.uint64)
        if not there:
            three += (self.word >= bos).astype(np.uint64)
        two = np.r_[np.uint64(bos), three[:-1]]
        two[begins] = bos
        one = np.r_[np.uint64(bos), two[:-1]]
        one[begins] = bos
        bits = np.uint64(max(1, len(self.vocabulary).bit_length()))
        if 3 * int(bits) <= 64:
            key, of = np.unique((two << (bits + bits)) | (one << bits) | three, return_inverse=places, return_counts=not places)
            mask = (np.uint64(1) << bits) - np.uint64(1)
            self.numbers = (key >> bits) & mask, key >> (bits + bits), key & mask
        else:
            order = np.lexsort((three, one, two))
            a, b, c = one[order], two[order], three[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]
            of = np.empty(n, np.int64)
            of[order] = np.cumsum(new) - 1
            self.numbers = a[new], b[new], c[new]
            of = of if places else np.bincount(of)
        if places:
            self.number, of = of, np.bincount(of, marked, len(self.numbers[0]))
        self.counts = of.astype(np.int64)

    @property
    def grams(self) -> tuple[np.ndarray, ...]:
        return tuple(self.vocabulary[x] for x in self.numbers)


def cuts(words: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, begin, end) of sorted words; buckets are ranges of hashes."""
    of = (words * np.uint64(buckets)) >> np.uint64(WORD_BITS)
    edges = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, int)
    return [(int(of[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _plain(x: np.ndarray) -> bytes:
    """Byte planes, which compress better than numbers."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _back(data: memoryview, kind: str, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, n).T).view(kind).ravel()


def packed(*arrays: np.ndarray) -> bytes:
    parts, head = [], [len(arrays)]
    for x in arrays:
        data = _plain(x) if len(x) else b""
        parts.append(data)
        head += [len(x), x.dtype.itemsize + 16 * (x.dtype.kind == "f")]
    whole = np.array(head, np.int64).tobytes() + b"".join(parts)
    return len(whole).to_bytes(8, "little") + _CODEC.compress(whole, asbytes=True)


def unpacked(pack: bytes) -> list[np.ndarray]:
    whole = memoryview(_CODEC.decompress(pack[8:], int.from_bytes(pack[:8], "little"), asbytes=True))
    n = int(np.frombuffer(whole[:8], np.int64)[0])
    head, at, out = np.frombuffer(whole[8 : 8 + 16 * n], np.int64), 8 + 16 * n, []
    for size, kind in head.reshape(-1, 2).tolist():
        width = kind % 16
        out.append(_back(whole[at : at + size * width], f"<{'f' if kind >= 16 else 'u'}{width}", size) if size else np.empty(0, f"<{'f' if kind >= 16 else 'u'}{width}"))
        at += size * width
    return out


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pack_grams(vocabulary: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray, *more: np.ndarray) -> bytes:
    """Words by number in a list of the packet's own words; the middle ones ascend, as ``Distinct`` has them."""
    if 8 * len(one) > len(vocabulary):
        there = np.zeros(len(vocabulary), bool)
        there[one] = there[two] = there[three] = True
        used, number = np.flatnonzero(there), (np.cumsum(there) - 1).astype(np.uint64)
        one, two, three = number[one], number[two], number[three]
    else:
        used, number = np.unique(np.concatenate([one, two, three]), return_inverse=True)
        one, two, three = np.split(number, 3)
    return packed(steps(vocabulary[used]), _small(one), _small(steps(two)), _small(three), *(_small(x) for x in more))


def grams_of(pack: bytes) -> list[np.ndarray]:
    """The packet's words, which ascend, the numbers of each trigram's words among them, and what else it holds."""
    ascending, one, two, three, *rest = unpacked(pack)
    return [np.cumsum(ascending, dtype=np.uint64), one, np.cumsum(two, dtype=np.int64), three, *rest]


def pack_words(words: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending words."""
    return packed(steps(words), *(_small(x) for x in more))


def unpack_words(pack: bytes) -> list[np.ndarray]:
    ascending, *rest = unpacked(pack)
    return [np.cumsum(ascending, dtype=np.uint64), *rest]


def steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def rounded(x: np.ndarray) -> np.ndarray:
    """32-bit numbers with 15 bits of fraction, whose last byte packs to nothing; the relative error is at most 2^-16."""
    bits = x.astype(np.float32).view(np.uint32)
    return ((bits + np.uint32(0x80)) & np.uint32(0xFFFFFF00)).view(np.float32)


def _found(sorted_: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(sorted_, asked), len(sorted_) - 1)
    return at, sorted_[at] == asked


class Shard:
    """What the packets of one bucket counted, by the word before the last: trigrams raw, bigrams by the number of words before them.

    Words go by their number in the shard. A trigram of three numbers fits 64 bits in the order of the packets, so that asked and counted ones meet in
    order; beyond 2^21 words it is hashed.
    """

    def __init__(self, packs: list[bytes]):
        parts = []
        for p in packs:
            vocabulary, one, two, three, c, *_ = grams_of(p)
            if (counted := c > 0).any():
                parts.append((vocabulary, *(x[counted] for x in (one, two, three, c))))
        self._words(np.unique(np.concatenate([*(p[0] for p in parts), np.empty(0, np.uint64)])))
        numbers = [self.numbers(*p[:4]) for p in parts]
        n1, n2, n3 = (np.concatenate([*(x[i] for x in numbers), np.empty(0, np.uint64)]) for i in range(3))
        c = np.concatenate([*(p[4] for p in parts), np.empty(0, np.uint64)])
        self.keys3, first, inverse = np.unique(self.joined(self.joined(n2, n1), n3), return_index=True, return_inverse=True)
        self.c3 = np.bincount(inverse, c, len(first)).astype(np.int64)
        n1, n2, n3 = self.grams3 = n1[first], n2[first], n3[first]
        self.contexts3, self.of3 = np.unique(self.joined(n2, n1), return_inverse=True)
        self.keys2, first, self.c2 = np.unique(self.joined(n2, n3), return_index=True, return_counts=True)
        self.grams2 = n2[first], n3[first]
        self.contexts2, self.of2 = np.unique(n2[first], return_inverse=True)

    def _words(self, vocabulary: np.ndarray) -> None:
        self.vocabulary, self.bits = vocabulary, np.uint64((len(vocabulary) + 1).bit_length())

    def pack(self) -> bytes:
        """All that the shard holds, in order."""
        (n1, n2, n3), (m2, m3), c3, c2 = self.grams3, self.grams2, self.c3, self.c2
        if 3 * int(self.bits) > 64:
            three, two = np.lexsort((n3, n1, n2)), np.lexsort((m3, m2))
            n1, n2, n3, c3, m2, m3, c2 = n1[three], n2[three], n3[three], c3[three], m2[two], m3[two], c2[two]
        return packed(steps(self.vocabulary), *map(_small, (n1, steps(n2), n3, c3, steps(m2), m3, c2)))

    @classmethod
    def of(cls, pack: bytes) -> "Shard":
        """The shard that was packed; its n-grams have their order, so that nothing is sorted."""
        vocabulary, n1, n2, n3, c3, m2, m3, c2 = grams_of(pack)
        self = cls.__new__(cls)
        self._words(vocabulary)
        if 3 * int(self.bits) > 64:
            return cls([pack])
        n1, n2, n3, m3 = (x.astype(np.uint64) for x in (n1, n2, n3, m3))
        m2 = np.cumsum(m2, dtype=np.uint64)
        pair = self.joined(n2, n1)
        self.keys3, self.c3, self.keys2, self.c2 = self.joined(pair, n3), c3.astype(np.int64), self.joined(m2, m3), c2.astype(np.int64)
        (self.contexts3, self.of3), (self.contexts2, self.of2) = runs(pair), runs(m2)
        return self

    def numbers(self, vocabulary: np.ndarray, *of: np.ndarray) -> list[np.ndarray]:
        """Numbers of a packet as numbers of the shard; words that it did not count have one that no word has."""
        at, known = _found(self.vocabulary, vocabulary)
        own = np.where(known, at, len(self.vocabulary)).astype(np.uint64)
        return [own[x] for x in of]

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a << self.bits) | b if 3 * int(self.bits) <= 64 else _pair(a, b)

    def weigh(self, d2: np.ndarray, d3: np.ndarray) -> "Shard":
        """With these discounts: the own probability of each n-gram and the share that each context leaves."""
        self.levels = []
        for keys, c, contexts, of, d in ((self.keys2, self.c2, self.contexts2, self.of2, d2), (self.keys3, self.c3, self.contexts3, self.of3, d3)):
            off = d[np.minimum(c, 3) - 1]
            total = np.bincount(of, c, len(contexts))
            self.levels.append((keys, (c - off) / total[of], contexts, np.bincount(of, off, len(contexts)) / total))
        return self

    def answer(self, vocabulary: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(a, b): the probability of each trigram is a + b times that of its last word alone."""
        n1, n2, n3 = self.numbers(vocabulary, one, two, three)
        a, b = np.zeros(len(n1)), np.ones(len(n1))
        pair = self.joined(n2, n1)
        for (keys, p, contexts, left), context, key in zip(self.levels, (n2, pair), (self.joined(n2, n3), self.joined(pair, n3)), strict=True):
            # Equal contexts are neighbours: each run is looked up once.
            first = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])[: len(context)]
            sizes = np.diff(np.r_[first, len(context)])
            at, known = (np.repeat(x, sizes) for x in _found(contexts, context[first]))
            if not known.any():
                continue
            # An n-gram is there only if its context is.
            asked = np.flatnonzero(known)
            gram, seen = _found(keys, key[asked])
            share = left[at[asked]]
            a[asked] = np.where(seen, p[gram], 0.0) + share * a[asked]
            b[asked] *= share
        return a, b


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of ascending numbers, and the number of each place."""
    new = np.r_[True, x[1:] != x[:-1]][: len(x)]
    return x[new], np.cumsum(new) - 1


def words_of(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a bucket that were counted, and their counts."""
    parts = [(w[c > 0], c[c > 0]) for w, c in map(unpack_words, packs)]
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return words, np.bincount(inverse, np.concatenate([p[1] for p in parts])).astype(np.int64)


def counts_of_counts(c: np.ndarray) -> list[int]:
    return [*(int((c == i).sum()) for i in (1, 2, 3, 4)), int(c.sum()), len(c)]
