"""Token ids as binary files with Elias-Fano document boundaries.

A data set is a folder of files in document order and a manifest. A file is the ids of its documents one behind the
other, in two or four bytes each, and two Elias-Fano sequences: where its documents end, and their ids as numbers above
the file's least. Such a sequence of n values below u takes about 2 + log2(u / n) bits a value: the low bits are packed
side by side, and the high ones are a bit vector in which value i sets bit (high part + i). Every STRIDE-th set bit's
place is kept in 32 bits, so value i is found by counting the set bits of a few bytes; no table of 64-bit offsets is
written or made. The manifest has one row for each file; its starts are sums over files in two levels.

Writing: texts are sorted by ranges of document id, and each task encodes its range and writes it as files of about FILE_IDS ids. Files that a lost task left are in no manifest and are never read. Reading: the
manifest's rows are dealt to tasks, which open the files that they name.

A text's ids are those of its words: the tokenizer drops white space, and neither its normal form nor its pattern joins
what ASCII white space divides. Words of plain texts are cut into pieces as the tokenizer's pattern cuts them, and its model encodes
the pieces; other words go through the whole tokenizer. A worker remembers words and pieces over its tasks.

Defined results: a null or empty text has the end id alone; documents without an id come first and read back as null;
of several with one id the order is by a hash of their texts; an empty table gives no file and no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from tokenizers import Tokenizer

from gazetta.llm.common import SLICE, _cuts, materialize, once_per_worker
from gazetta.scratch import scratch_path

#: Ids of a file, about; the id that ends a document.
FILE_IDS, END = 1 << 24, 1
#: Values between two kept places of set bits.
STRIDE = 256
#: Words and pieces that a worker remembers, and the longest; characters of texts that are encoded together.
CACHED, LONGEST, TOGETHER = 1_000_000, 48, 2_000_000
#: What a file begins with: name, version, bytes of an id, documents without an id, documents, ids, least document id,
#: and how many bytes the two sequences take.
HEAD = struct.Struct("<4sHHIIQqQQ")
NAME, VERSION = b"GTOK", 1
_EF = struct.Struct("<QBxxxxxxxQQ")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def default_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


class EliasFano:
    """A sequence of values that never fall, read from its bytes."""

    def __init__(self, data: bytes | memoryview):
        self.n, self.low_bits, n_low, n_high = _EF.unpack_from(data)
        at = _EF.size
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        self.marks = np.frombuffer(data, "<u4", -(-self.n // STRIDE), at + n_low + n_high)

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        """The bytes of ascending unsigned values."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // n).bit_length() - 1) if n else 0
        low = b""
        if bits and n:
            planes = ((values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
            low = np.packbits(planes.ravel(), bitorder="little").tobytes()
        set_bits = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros((int(set_bits[-1]) // 8 + 1) * 8 if n else 0, np.uint8)
        vector[set_bits] = 1
        high = np.packbits(vector, bitorder="little").tobytes()
        return _EF.pack(n, bits, len(low), len(high)) + low + high + set_bits[::STRIDE].astype("<u4").tobytes()

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The place of set bit i, from the kept place before it."""
        at, left = int(self.marks[i // STRIDE]), i % STRIDE
        byte = at >> 3
        # set bits of the first byte that lie before the kept place do not count
        left += int(_ONES[int(self.high[byte]) & ((1 << (at & 7)) - 1)])
        while True:
            counts = np.cumsum(_ONES[self.high[byte : byte + 64]], dtype=np.int64)
            if counts[-1] > left:
                step = int(np.searchsorted(counts, left, "right"))
                left -= int(counts[step - 1]) if step else 0
                ones = np.flatnonzero(np.unpackbits(self.high[byte + step : byte + step + 1], bitorder="little"))
                return (byte + step) * 8 + int(ones[left])
            left -= int(counts[-1])
            byte += 64

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        b = self.low_bits
        low = 0
        if b:
            first, last = i * b, i * b + b
            low = int.from_bytes(self.low[first >> 3 : (last + 7) >> 3].tobytes(), "little") >> (first & 7) & ((1 << b) - 1)
        return (self.select(i) - i) << b | low

    def all(self) -> np.ndarray:
        """All values, as unsigned numbers."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        if not self.low_bits:
            return high
        planes = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        low = np.zeros(self.n, np.uint64)
        for k in range(self.low_bits):
            low |= planes[:, k].astype(np.uint64) << np.uint64(k)
        return high << np.uint64(self.low_bits) | low

    def up_to(self, x: int) -> int:
        """How many values are at most x."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            a, b = (m + 1, b) if self[m] <= x else (a, m)
        return a


class TokenFile:
    """One file: any document's ids by one look-up, and one reading of their bytes."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        name, version, self.width, self.nulls, self.n, self.n_ids, self.least, n_ends, n_keys = HEAD.unpack(file.read_at(HEAD.size, 0))
        if name != NAME or version != VERSION:
            raise ValueError("not a token file of this version")
        self.ends = EliasFano(file.read_at(n_ends, HEAD.size))
        self.keys = EliasFano(file.read_at(n_keys, HEAD.size + n_ends))
        self.begin = HEAD.size + n_ends + n_keys

    def __len__(self) -> int:
        return self.n

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends[i - 1] if i else 0, self.ends[i]

    def ids(self, i: int) -> np.ndarray:
        return self.between(*self.bounds(i))

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids from place a up to b, whatever documents they belong to."""
        return np.frombuffer(self.file.read_at((b - a) * self.width, self.begin + a * self.width), f"<u{self.width}")

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.keys[i - self.nulls]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + [self.least + x for x in self.keys.all().tolist()]

    def doc_at(self, place: int) -> int:
        """The document that holds the id at a place."""
        return self.ends.up_to(place)


def file_bytes(keys: list[int | None], sizes: list[int], width: int) -> bytes:
    """What stands before the ids of a file. sizes: ids of each document."""
    known = [k for k in keys if k is not None]
    least = known[0] if known else 0
    ends = EliasFano.pack(np.cumsum(np.array(sizes, np.uint64)))
    above = EliasFano.pack(np.array([k - least for k in known], np.uint64))
    return HEAD.pack(NAME, VERSION, width, len(keys) - len(known), len(keys), sum(sizes), least, len(ends), len(above)) + ends + above


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder that Spark names, and the path in it."""
    for spark_name in ("s3a://", "s3n://"):
        uri = uri.replace(spark_name, "s3://", 1) if uri.startswith(spark_name) else uri
    return pafs.FileSystem.from_uri(uri)


@cache
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


#: Texts of these characters only are cut by PIECES in lower case, as the tokenizer's own pattern cuts them: ASCII and the
#: letters of Latin-1, which its normal form leaves as they are.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The letters of Latin-1 as the tokenizer sees them: a character for each byte of UTF-8, its own if that is printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    seen = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(seen[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


class WordIds:
    """The ids of words as bytes: words of plain texts in lower case, and words of others as they are (behind a space).

    Up to about CACHED words and pieces of them are remembered; they leave in two generations.
    """

    def __init__(self, path: str, width: int):
        self.library, self.width = _library(path), width
        self.model, self.letters = self.library.model, byte_letters()
        self.special = [t.content for _, t in sorted(self.library.get_added_tokens_decoder().items())]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text) and not any(t in text for t in self.special):
            return text.lower().split()
        return [w.lower() if PLAIN.fullmatch(w) and not any(t in w for t in self.special) else f" {w}" for w in ascii_words(text)]

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.known.get(piece) or self.older.get(piece)
        if ids is None:
            ids = self._bytes([t.id for t in self.model.tokenize(piece.translate(self.letters))])
        if len(piece) <= LONGEST:
            self.known[piece] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Plain words by their pieces, which the model encodes; others by the library."""
        if word[0] == " ":
            return self._bytes(self.library.encode(word[1:], add_special_tokens=False).ids)
        return b"".join(map(self._piece, PIECES.findall(word)))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, known = [], self.known
        for text in texts:
            words = self.words(text)
            found = list(map(known.get, words))
            if None in found:
                for i, x in enumerate(found):
                    if x is None:
                        w = words[i]
                        x = known.get(w) or self.older.get(w) or self._word(w)
                        if len(w) <= LONGEST:
                            known[w] = x
                        found[i] = x
            out.append(b"".join(found))
        if len(known) > CACHED // 2:
            self.older, self.known = known, {}
        return out


_WHITE = dict.fromkeys((9, 10, 11, 12, 13), " ")


def ascii_words(text: str) -> list[str]:
    """What ASCII white space divides; other white space is left to the tokenizer."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in text.translate(_WHITE).split(" ") if w]


def write_dataset(docs: DataFrame, folder: str, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all texts under folder, by ascending document id. The manifest: part, file, first, path, n_docs, n_ids."""
    tokenizer = tokenizer or default_tokenizer()
    width = 2 if max(_library(tokenizer).get_vocab_size(), end + 1) <= 1 << 16 else 4
    key, last = uuid.uuid4().hex, np.array([end], f"<u{width}").tobytes()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    # by the hash too, so that a frequent id is divided; texts move before they are encoded, as finding the ranges computes all rows once more
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), 0
        words = once_per_worker(key, lambda: WordIds(tokenizer, width))
        system, top = file_system(folder)
        keys: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def put() -> pa.RecordBatch:
            nonlocal files, size
            path = f"part-{part:06d}-{files:04d}-{uuid.uuid4().hex}.tok"
            sizes = [len(x) // width for x in held]
            with system.open_output_stream(f"{top}/{path}") as out:
                out.write(file_bytes(keys, sizes, width))
                for x in held:
                    out.write(x)
            row = pa.RecordBatch.from_pydict({"part": [part], "file": [files], "path": [path], "n_docs": [len(keys)], "n_ids": [sum(sizes)]}, schema=_MANIFEST)
            keys.clear()
            held.clear()
            files, size = files + 1, 0
            return row

        system.create_dir(top, recursive=True)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                whole = batch.slice(at, SLICE)
                names, texts = whole.column(0).to_pylist(), whole.column(1).to_pylist()
                for a, b in _cuts(texts, TOGETHER):
                    for name, x in zip(names[a:b], words.ids(texts[a:b]), strict=True):
                        if held and size + len(x) + width > file_ids * width:
                            yield put()
                        keys.append(name)
                        held.append(x + last)
                        size += len(held[-1])
        if held:
            yield put()

    listed = materialize(rows.mapInArrow(write, "part long, file long, path string, n_docs long, n_ids long"))
    # sums of whole tasks first (one row for each), then within them
    tasks = listed.groupBy("part").agg(F.sum("n_ids").alias("n"))
    tasks = tasks.select(F.col("part").alias("__p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("__base"))
    within = F.sum("n_ids").over(Window.partitionBy("part").orderBy("file")) - F.col("n_ids")
    manifest = listed.join(tasks, F.col("part") == F.col("__p")).select("part", "file", (F.col("__base") + within).alias("first"), "path", "n_docs", "n_ids")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


_MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def map_documents(spark: SparkSession, folder: str, one: Callable[[np.ndarray], tuple], schema: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and what one returns for each document's ids, read from the files under folder."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("first", "path", "n_ids")
    out = _parse_datatype_string(f"doc_id long, start long, {schema}")
    arrow = to_arrow_schema(out)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{top}/{row['path']}") as opened:
                    file = TokenFile(opened)
                    keys, ends = file.doc_ids(), [0, *file.ends.all().tolist()]
                    at = 0
                    while at < file.n:
                        # documents are read together up to a bound, or one longer document
                        to = at + 1
                        while to < file.n and to - at < 1024 and ends[to + 1] - ends[at] <= READ_IDS:
                            to += 1
                        ids = file.between(ends[at], ends[to])
                        rows = [one(ids[ends[i] - ends[at] : ends[i + 1] - ends[at]]) for i in range(at, to)]
                        columns = [keys[at:to], [row["first"] + x for x in ends[at:to]], *zip(*rows, strict=True)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, arrow.types, strict=True)], schema=arrow)
                        at = to

    tasks = max(1, manifest.count())
    return manifest.repartition(tasks, "path").mapInArrow(read, out)


#: Ids that are read at once.
READ_IDS = 1 << 20


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start and ids of each document."""
    return map_documents(spark, folder, lambda ids: (ids.tolist(),), "ids array<int>")


def token_digest(docs: DataFrame) -> DataFrame:
    """Written to a new folder and read back: doc_id, start, n_tokens, ids_crc32 (of the ids in four bytes each)."""
    spark = docs.sparkSession
    folder = f"{scratch_path(spark)}-tokens"
    write_dataset(docs, folder)
    return map_documents(spark, folder, lambda ids: (len(ids), zlib.crc32(ids.astype("<u4").tobytes())), "n_tokens long, ids_crc32 long")
