"""Token ids in compressed binary segments, one zstandard frame a document under a shared dictionary.

Rows are range-partitioned and sorted by id, so the segments follow ascending document order. A segment is one row of a Parquet dataset
(Spark's commit protocol: a lost or repeated task leaves no half-written file) with the format version, the SHA-256 of the dictionary, the
range of document ids, the offset index and the frames. The dictionary itself is a row of the dataset ``dictionary`` beside the segments.
A single short document is read by pruning on the id range, then slicing its frame out by the index.

Format (version 1): ids as little-endian unsigned 32-bit integers, split into four byte planes before compression; index: little-endian
64-bit offsets of the frames and one more for the end.

Defined results: a null or empty text has the end id only; a null document id sorts first; rows that repeat an id keep the order of their
texts' hashes; an empty table gives an empty dataset. Only the id and the text are read: further columns may have any name.
"""

import hashlib
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import begin, in_batches, keeps, partitions, quoted, shared_dir, small_batches, strings

VERSION = 1
#: The dictionary is fitted on so many whole documents and bytes of text at most, those of the smallest hash and of a sixteenth of the bytes or less each:
#: it affects the size of the files only.
TRAINING_DOCS, TRAINING_BYTES, DICTIONARY_BYTES = 500, 8 << 20, 64 << 10
SEGMENT_BYTES = 4 << 20
CACHE_WORDS = 400_000
#: New words encoded in one call.
JOINED = 100
SCHEMA = "version int, dictionary string, doc_ids array<{kind}>, counts array<long>, index binary, frames binary, first_id {kind}, last_id {kind}, part int, seq int, seen long"

#: The byte-level pre-tokenizer's pattern, for texts of SAFE characters only, in which Python's classes equal those of the tokenizer.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+| ?_+(?:[^\s\w]|_)*|\s+(?!\S)|\s+")
SAFE = re.compile("[\t\n\r\x20-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ɏ]*")


class _Words(dict):
    """Numbers for words, given on first sight; ``new`` gathers the words that still lack ids."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        return at


class Encoder:
    """Ids by the tokenizers library. In plain texts each distinct pre-token is encoded once; other texts go to the library whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # Tokens that begin with a blank: of words that begin with one and hold no other, each starts with such a token.
        self.blank = np.zeros(self.library.get_vocab_size(), bool)
        self.blank[[i for t, i in self.library.get_vocab().items() if t.startswith("Ġ")]] = True
        self._reset()

    def _reset(self) -> None:
        self.words, self.ids, self.starts = _Words(), np.empty(0, "<u4"), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and their numbers. Blank-led words are encoded JOINED at a time and told apart by their first tokens."""
        joined = np.fromiter((w[0] == " " and w[1:].isalpha() for w in words), bool, len(words))
        led = [w for w, j in zip(words, joined, strict=True) if j]
        flat = np.concatenate([*self._whole(["".join(led[i : i + JOINED]) for i in range(0, len(led), JOINED)]), np.empty(0, "<u4")])
        first = np.flatnonzero(self.blank[flat])
        if len(first) != len(led):
            raise ValueError("a word of letters does not start with one blank-led token")
        rest = self._whole([w for w, j in zip(words, joined, strict=True) if not j])
        sizes = np.empty(len(words), np.int64)
        sizes[joined], sizes[~joined] = np.diff(np.r_[first, len(flat)]), [len(x) for x in rest]
        out = np.empty(int(sizes.sum()), "<u4")
        of_led = np.repeat(joined, sizes)
        out[of_led], out[~of_led] = flat, np.concatenate([*rest, np.empty(0, "<u4")])
        return out, sizes

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > CACHE_WORDS:
            self._reset()
        plain = [SAFE.fullmatch(t) is not None and "_" not in t and not any(s in t for s in self.special) for t in texts]
        get = self.words.__getitem__
        found = [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in (WORD.findall(t) for t, p in zip(texts, plain, strict=True) if p)]
        if self.words.new:
            ids, sizes = self._each(self.words.new)
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
            self.words.new.clear()
        at = np.concatenate([*found, np.empty(0, np.int64)])
        size = self.starts[at + 1] - self.starts[at]
        total = np.r_[0, np.cumsum(size)]
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], size)]
        bounds = total[np.cumsum([len(x) for x in found], dtype=np.int64)] if found else total[:0]
        quick, rest = iter(np.split(flat, bounds[:-1])), iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [next(quick) if p else next(rest) for p in plain]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


keeps("tokens", encoder.cache_clear)


def planes(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def train_dictionary(rows: DataFrame, path: str, end_id: int) -> bytes:
    """A shared dictionary from a bounded sample of documents; empty where there is too little to learn from."""
    import zstandard

    # The choice first, from hashes and lengths alone: no task sends texts that are not used, and longer texts than the bound are passed over.
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)))
    first = keyed.filter(F.col("size") <= TRAINING_BYTES // 16).select("key", "size").orderBy("key", "size").limit(TRAINING_DOCS).collect()
    chosen, total = set(), 0
    for r in first:
        total += r["size"]
        if total > TRAINING_BYTES:
            break
        chosen.add(r.key)

    def run(batches):
        encode = encoder(path)
        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([planes(np.append(x, np.uint32(end_id))) for x in encode(strings(batch.column(0)))], pa.binary())], ["ids"])

    sample = keyed.filter((F.col("size") <= TRAINING_BYTES // 16) & F.col("key").isin(*chosen)).select("text").distinct() if chosen else None
    ids = sorted(bytes(r.ids) for r in in_batches(sample, run, "ids binary", "tokens").collect()) if chosen else []
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [x for x in ids if len(x) > 32]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(docs: DataFrame, path: str, out: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id`` and writes the segments below ``out``."""
    import zstandard

    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dictionary = train_dictionary(rows, path, end_id)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dictionary)], "dictionary string, content binary").coalesce(1).write.parquet(f"{out}/dictionary")
    n = max(partitions(spark), 1)

    def run(batches):
        from pyspark import TaskContext

        begin("tokens")
        part, seq = TaskContext.get().partitionId(), 0
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True) if shared else zstandard.ZstdCompressor(level=3)
        encode = encoder(path)
        doc_ids, counts, frames, size, seen = [], [], [], 0, 0

        def segment():
            index = np.cumsum([0, *map(len, frames)]).astype("<i8").tobytes()
            known = [x for x in doc_ids if x is not None]
            row = (VERSION, digest, doc_ids, counts, index, b"".join(frames), min(known, default=None), max(known, default=None), part, seq, seen)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        id_type = None
        for batch in small_batches(batches):
            id_type = batch.schema.field(0).type
            names = ["version", "dictionary", "doc_ids", "counts", "index", "frames", "first_id", "last_id", "part", "seq", "seen"]
            types = [pa.int32(), pa.string(), pa.list_(id_type), pa.list_(pa.int64()), pa.binary(), pa.binary(), id_type, id_type, pa.int32(), pa.int32(), pa.int64()]
            for doc, ids in zip(batch.column(0).to_pylist(), encode(strings(batch.column(1))), strict=True):
                frame = packer.compress(planes(np.append(ids, np.uint32(end_id))))
                doc_ids.append(doc), counts.append(len(ids) + 1), frames.append(frame)
                size += len(frame)
                if size >= SEGMENT_BYTES:
                    yield segment()
                    doc_ids, counts, frames, size, seq, seen = [], [], [], 0, seq + 1, seen + sum(counts)
        if doc_ids:
            yield segment()

    ordered = rows.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"))
    in_batches(ordered, run, SCHEMA.format(kind=kind), "tokens").write.parquet(f"{out}/segments")


class Reader:
    """Unpacks documents; refuses segments written under another dictionary or version."""

    def __init__(self, digest: str, dictionary: bytes):
        import zstandard

        self.digest = digest
        self.plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def check(self, version: int, digest: str) -> None:
        if version != VERSION or digest != self.digest:
            raise ValueError("segment of another version or dictionary")

    def ids(self, frames: bytes, index: np.ndarray, k: int) -> np.ndarray:
        return unplaned(self.plain.decompress(frames[index[k] : index[k + 1]]))


def _dictionary(spark: SparkSession, out: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{out}/dictionary").first()
    if hashlib.sha256(row.content).hexdigest() != row.dictionary:
        raise ValueError("the dictionary does not have its hash")
    return row.dictionary, bytes(row.content)


def read(spark: SparkSession, out: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    digest, dictionary = _dictionary(spark, out)
    segments = spark.read.parquet(f"{out}/segments")
    kind = segments.schema["first_id"].dataType.simpleString()
    # One number a partition of the writer: as many rows as it had tasks.
    sums = segments.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    before, seen = {}, 0
    for r in sorted(sums):
        before[r.part], seen = seen, seen + r.n

    def run(batches):
        reader = Reader(digest, dictionary)
        for batch in small_batches(batches, 64 << 20, 16):
            for row in batch.to_pylist():
                reader.check(row["version"], row["dictionary"])
                seen = before[row["part"]] + row["seen"]
                index, starts, crcs = np.frombuffer(row["index"], "<i8"), [], []
                for k, n in enumerate(row["counts"]):
                    ids = reader.ids(row["frames"], index, k)
                    if len(ids) != n:
                        raise ValueError("a frame does not have its length")
                    starts.append(seen)
                    crcs.append(zlib.crc32(ids.tobytes()))
                    seen += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], batch.schema.field("first_id").type), pa.array(starts, pa.int64()), pa.array(row["counts"], pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return in_batches(segments, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, out: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row, if its id repeats): only segments whose range holds it are read."""
    reader = Reader(*_dictionary(spark, out))
    found = []
    for row in spark.read.parquet(f"{out}/segments").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "seq").toLocalIterator():
        reader.check(row.version, row.dictionary)
        index = np.frombuffer(row["index"], "<i8")
        found += [reader.ids(bytes(row.frames), index, k) for k, x in enumerate(row.doc_ids) if x == doc_id]
    return found


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Writes to the shared folder and reads the files back."""
    import uuid

    out = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, out)
    return read(docs.sparkSession, out)
