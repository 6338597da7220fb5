"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts is cut into words (no piece of the vocabulary crosses the cut), and each distinct word is encoded once. All words not met
before form one flat array of symbols. A round looks up the rank of every adjacent pair, takes the minimum per word, merges all leftmost
occurrences of that pair in every word at once, and compacts the array; words without a pair left drop out.

The library merges one pair at a time. Merging all occurrences at once gives the same result unless a merge makes a neighbouring pair that is
at least as good as the pair merged; such a word merges only its first occurrence in that round. A word for which this happens often, and one of
LONG_WORD characters or more, goes to an exact heap instead, so that no text costs quadratic time.

Defined results: a null or empty text has no pieces, so its ids are begin and end only; lone surrogates are encoded as U+FFFD; every row gives a row,
repeated rows and null ids included; an empty table gives an empty result. ``digests`` names its columns itself; in ``encode`` and ``decode`` columns
of the result's names give way.
"""

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .common import begin, in_batches, keeps, quoted, small_batches, spread, strings

NONE = np.iinfo(np.int64).max
#: Rounds in which a word may be held back to one merge before it goes to the heap.
HELD_ROUNDS = 16
#: Characters from which a word goes to the heap at once: a round costs the whole word, and a long one has a round for each of its ranks.
LONG_WORD = 2000
#: Distinct words kept from batch to batch.
CACHE_WORDS = 100_000
#: Text of a batch: its words are Python strings for a while, about twenty times its size.
BATCH_BYTES = 1 << 20


class Codec:
    """Encoder and decoder for one model file; its normaliser must be the identity (checked on loading)."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not supported")
        if any("▁" in pieces[i].lstrip("▁") for i in normal) or any(re.search("[ \n]", pieces[i]) for i in normal):
            raise ValueError("pieces that cross words are not supported")
        probe = "  Aéﬁ 　b\t́ "
        if sp.normalize(probe) != "▁" + probe.replace(" ", "▁"):
            raise ValueError("only models without normalisation are supported")
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        # Equal scores share a rank; a smaller rank merges first.
        scores = np.array([sp.get_score(i) for i in normal], np.float64)
        _, rank = np.unique(-scores, return_inverse=True)
        self.pieces = pieces
        self.id_of = {pieces[i]: i for i in normal}
        self.rank_of = {pieces[i]: int(r) for i, r in zip(normal, rank, strict=True)}
        self._pair_table(normal, pieces)
        self.reset()

    def _pair_table(self, normal: list[int], pieces: list[str]) -> None:
        """Sorted keys (left id, right id) of every way to make a piece of two others, with rank and id of the result."""
        keys, ranks, ids = [], [], []
        for i in normal:
            p = pieces[i]
            for k in range(1, len(p)):
                left, right = self.id_of.get(p[:k], -1), self.id_of.get(p[k:], -1)
                # A single character outside the vocabulary is a symbol too, but no piece can be looked up by it here.
                if left < 0 and k == 1 or right < 0 and k == len(p) - 1:
                    raise ValueError("a piece holds a character that is no piece")
                if left >= 0 and right >= 0:
                    keys.append(left << 32 | right), ranks.append(self.rank_of[p]), ids.append(i)
        order = np.argsort(np.array(keys, np.int64))
        keys_, ranks_, ids_ = (np.array(x, np.int64)[order] for x in (keys, ranks, ids))
        # Open addressing: one gather finds most pairs, and absent ones end at an empty slot.
        size = 1 << (4 * len(keys_)).bit_length()
        self.mask, self.slot_key = size - 1, np.full(size, -1, np.int64)
        self.slot_rank, self.slot_id = np.full(size, NONE, np.int64), np.full(size, -1, np.int64)
        left, at = np.arange(len(keys_)), self._slot(keys_)
        while len(left):
            free = self.slot_key[at] == -1
            first = np.zeros(len(at), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.slot_key[at[put]], self.slot_rank[at[put]], self.slot_id[at[put]] = keys_[left[put]], ranks_[left[put]], ids_[left[put]]
            left, at = left[~put], (at[~put] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(29)).astype(np.int64) & self.mask

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of each pair's piece; NONE and -1 where there is none. Negative symbols never pair."""
        keys = left << 32 | right
        at = self._slot(keys)
        found = self.slot_key[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.slot_key[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        ok = (self.slot_key[at] == keys) & (left >= 0) & (right >= 0)
        return np.where(ok, self.slot_rank[at], NONE), np.where(ok, self.slot_id[at], -1)

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.ids = np.empty(0, np.int64)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Encodes words not met before and appends their ids to the cache."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        known = {int(c): self.id_of.get(chr(c), -1) for c in np.unique(flat)}
        chars = np.array(sorted(known), np.int64)
        symbols = np.array([known[c] for c in chars.tolist()], np.int64)[np.searchsorted(chars, flat)] if len(chars) else flat
        symbols = np.where(symbols >= 0, symbols, -1 - flat)  # characters outside the vocabulary: negative, never merged
        symbols, owner = self._rounds(symbols, np.repeat(np.arange(len(words)), lengths))
        ids, owner = self._bytes(symbols, owner)
        for w, x in zip(words, range(len(self.index), len(self.index) + len(words)), strict=True):
            self.index[w] = x
        counts = np.bincount(owner, minlength=len(words))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])

    def _rounds(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_s, done_o = [], []
        if len(symbols) >= LONG_WORD:
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(symbols)])
            for a, n in zip(first[sizes >= LONG_WORD].tolist(), sizes[sizes >= LONG_WORD].tolist(), strict=True):
                out = self._heap(symbols[a : a + n])
                done_s.append(out), done_o.append(np.full(len(out), owner[a]))
            short = np.repeat(sizes < LONG_WORD, sizes)
            symbols, owner = symbols[short], owner[short]
        held = np.zeros(int(owner.max()) + 1 if len(owner) else 0, np.int64)
        while len(symbols):
            rank, made = self._pairs(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = NONE
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, NONE], first)
            sizes = np.diff(np.r_[first, len(symbols)])
            finished = np.repeat(best == NONE, sizes)
            best = np.repeat(best, sizes)[:-1]
            at = np.flatnonzero((rank == best) & (rank != NONE))
            at = self._leftmost(at, made, rank)
            if len(at):
                at, stuck = self._held_back(symbols, owner, at, made[at], rank[at])
                held[stuck] += 1
                for w in stuck[held[stuck] == HELD_ROUNDS]:
                    mine = np.flatnonzero(owner == w)
                    out = self._heap(symbols[mine])
                    done_s.append(out), done_o.append(np.full(len(out), w))
                    finished[mine] = True
                    at = at[owner[at] != w]
                heaped = np.isin(owner, stuck[held[stuck] == HELD_ROUNDS])
            else:
                heaped = np.zeros(len(symbols), bool)
            symbols = symbols.copy()
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            end = finished & ~heaped
            done_s.append(symbols[end]), done_o.append(owner[end])
            keep &= ~finished
            symbols, owner = symbols[keep], owner[keep]
        if not done_s:
            return symbols, owner
        symbols, owner = np.concatenate(done_s), np.concatenate(done_o)
        order = np.argsort(owner, kind="stable")
        return symbols[order], owner[order]

    @staticmethod
    def _leftmost(at: np.ndarray, made: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Of overlapping pairs (runs of neighbours) every other one, from the left."""
        if not len(at):
            return at
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        return at[place % 2 == 0]

    def _held_back(self, symbols, owner, at, made, rank) -> tuple[np.ndarray, np.ndarray]:
        """Drops all but the first merge of words in which a merge makes a pair as good as its own."""
        n, word = len(symbols), owner[at]
        multiple = np.flatnonzero(np.bincount(word, minlength=int(owner[-1]) + 1)[word] > 1)
        if not len(multiple):
            return at, at[:0]
        a, m, r, w = at[multiple], made[multiple], rank[multiple], word[multiple]
        absent = np.int64(-1)
        prev = np.where((a > 0) & (owner[np.maximum(a - 1, 0)] == w), symbols[np.maximum(a - 1, 0)], absent)
        next_ = np.where((a + 2 < n) & (owner[np.minimum(a + 2, n - 1)] == w), symbols[np.minimum(a + 2, n - 1)], absent)
        after = np.r_[np.where((np.diff(a) == 2) & (w[1:] == w[:-1]), m[1:], absent), absent]
        before = np.r_[absent, np.where((np.diff(a) == 2) & (w[1:] == w[:-1]), m[:-1], absent)]
        # Different pieces of equal rank in one word are rare; their order is then left to single merges.
        mixed = np.r_[False, (w[1:] == w[:-1]) & (m[1:] != m[:-1])]
        bad = mixed.copy()
        for left, right in ((prev, m), (m, next_), (m, after), (before, m)):
            bad |= self._pairs(left, right)[0] <= r
        stuck = np.unique(w[bad])
        drop = np.isin(word, stuck)
        drop[np.unique(word, return_index=True)[1]] = False
        return at[~drop], stuck

    def _heap(self, symbols: np.ndarray) -> np.ndarray:
        """One word, one merge at a time: best rank first, leftmost among equals."""
        n = len(symbols)
        rank, made = self._pairs(symbols[:-1], symbols[1:])
        at = np.flatnonzero(rank != NONE)
        # A pair is rank and place in one number, so that the heap orders plain integers.
        heap = ((rank[at] << 32) | at).tolist()
        heapq.heapify(heap)
        s, before, after = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        wanted = np.where(rank != NONE, made, -1).tolist() + [-1]  # what the pair that begins at a place makes; -1: none
        ranks, pieces, id_of, rank_of = rank.tolist() + [NONE], self.pieces, self.id_of, self.rank_of

        def pair(i: int) -> None:
            j = after[i]
            if j < n and s[i] >= 0 and s[j] >= 0:
                piece = pieces[s[i]] + pieces[s[j]]
                id_ = id_of.get(piece, -1)
                wanted[i] = id_
                if id_ >= 0:
                    ranks[i] = rank_of[piece]
                    heapq.heappush(heap, ranks[i] << 32 | i)
            else:
                wanted[i] = -1

        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if wanted[i] < 0 or ranks[i] != top >> 32:
                continue
            j = after[i]
            s[i], wanted[i], wanted[j], after[i] = wanted[i], -1, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                pair(before[i])
            pair(i)
            s[j] = None
        return np.array([x for x in s if x is not None], np.int64)

    def _bytes(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero(symbols < 0)
        if not len(odd):
            return symbols, owner
        coded = [np.frombuffer(chr(-1 - c).encode(), np.uint8) for c in symbols[odd].tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = [len(x) for x in coded]
        out, owner = np.repeat(symbols, width), np.repeat(owner, width)
        out[out < 0] = self.byte_ids[np.concatenate(coded)]
        return out, owner

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, begin and end included, as one array, and the start of each text in it (one more at the end)."""
        words = [_words(t) for t in texts]
        new = {w for ws in words for w in ws}.difference(self.index)
        if len(self.index) + len(new) > CACHE_WORDS and self.index:
            self.reset()
            new = {w for ws in words for w in ws}
        if new:
            self._learn(sorted(new))
        per_text = np.fromiter(map(len, words), np.int64, len(words))
        get = self.index.__getitem__
        at = np.fromiter((get(w) for ws in words for w in ws), np.int64, int(per_text.sum()))
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        total = np.r_[0, np.cumsum(size)]
        flat = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
        bounds = total[np.r_[0, np.cumsum(per_text)]]
        out = np.empty(len(flat) + 2 * len(texts), np.int64)
        starts = bounds + 2 * np.arange(len(texts) + 1)
        inner = np.ones(len(out), bool)
        inner[starts[:-1]], inner[starts[1:] - 1] = False, False
        out[inner], out[starts[:-1]], out[starts[1:] - 1] = flat, self.bos, self.eos
        return out, starts

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_WORD = re.compile("\n| *[^ \n]+| +")


def _words(text: str) -> list[str]:
    """Words with their leading blanks as U+2581; the first gets one more. Line ends are words of their own."""
    if not text:
        return []
    try:
        text.encode()
    except UnicodeEncodeError:
        text = re.sub("[\ud800-\udfff]", "\ufffd", text)
    return [w.replace(" ", "▁") for w in _WORD.findall(" " + text.replace("▁", " "))]


@lru_cache(2)
def codec(path: str) -> Codec:
    """One a worker process; it keeps its word cache from batch to batch."""
    return Codec(path)


keeps("pieces", codec.cache_clear)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256, from the ids of its whole text."""

    def run(batches):
        begin("pieces")
        c = codec(path)
        for batch in small_batches(batches, BATCH_BYTES):
            texts = strings(batch.column(1))
            ids, starts = c.encode(texts)
            n, sha, back = [], [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = ids[a:b]
                n.append(b - a)
                sha.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                back.append(hashlib.sha256(c.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(spread(rows), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", "pieces")


def encode(docs: DataFrame, path: str, text_col: str = "text", into: str = "piece_ids", round_trip: str | None = None) -> DataFrame:
    """``docs`` with the array column ``into`` of ids, begin and end included; ``round_trip`` names a column that says whether they decode to the text.
    Columns that have these names already give way."""
    added = [StructField(into, ArrayType(IntegerType()))] + ([StructField(round_trip, BooleanType())] if round_trip else [])
    docs = docs.drop(*(f.name for f in added))
    at = docs.columns.index(text_col)

    def run(batches):
        begin("pieces")
        c = codec(path)
        for batch in small_batches(batches, BATCH_BYTES):
            texts = strings(batch.column(at))
            ids, starts = c.encode(texts)
            made = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))]
            if round_trip:
                bounds = zip(texts, starts[:-1].tolist(), starts[1:].tolist(), strict=True)
                made.append(pa.array([c.decode(ids[a:b]) == t.replace("▁", " ") for t, a, b in bounds], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *(f.name for f in added)])

    return in_batches(spread(docs), run, StructType([*docs.schema.fields, *added]), "pieces")


def decode(docs: DataFrame, path: str, ids_col: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the string column ``into`` (instead of one of that name), read back from the ids; null ids give an empty text."""
    docs = docs.drop(into)
    at = docs.columns.index(ids_col)

    def run(batches):
        begin("pieces")
        c = codec(path)
        for batch in small_batches(batches, BATCH_BYTES):
            lists = batch.column(at)
            texts = [c.decode(lists[i].values.to_numpy()) if lists[i].is_valid else "" for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, into])

    return in_batches(docs, run, StructType([*docs.schema.fields, StructField(into, StringType())]), "pieces")
