"""Token-ID output: documents are encoded and written as wavelet matrices, one compressed file for each shard.

A shard holds consecutive documents in ascending id order. Its token ids are stored as bit-planes, from the highest
bit down; after each plane the ids are dealt stably by that bit, zeros first. A directory of ranks (ones before each
block of bits) answers access, count and occurrence lookup from the packed planes alone. Shards are rows of a
Parquet table in the shared folder, whose committer makes them survive lost executors.
"""

from __future__ import annotations

import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curato.llm.common import materialise

END = 2
#: Tokens at which a shard is closed; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
#: Pieces of text whose ids a worker remembers.
CACHE = 1_000_000
MAGIC = b"WMX2"
#: Bits of a plane for which the directory holds a rank.
BLOCK = 2048
#: Bytes of text in a range of ids, about; characters of the longest piece that is remembered.
RANGE_BYTES, LONGEST = 1 << 27, 200

SHARDS = "part:int,before:long,first_id:long,last_id:long,n_docs:long,n_tokens:long,content:binary"


class WaveletMatrix:
    """A sequence of ids below ``2 ** bits`` as packed bit-planes with rank directories."""

    def __init__(self, n: int, planes: list[np.ndarray], ranks: list[np.ndarray] | None = None):
        self.n, self.planes, self.bits = n, planes, len(planes)
        self.ranks = [self._directory(plane) for plane in planes] if ranks is None else ranks
        self.zeros = [n - int(r[-1]) for r in self.ranks]

    def _directory(self, plane: np.ndarray) -> np.ndarray:
        """Ones before each block, and in all."""
        if not self.n:
            return np.zeros(1, np.int64)
        per = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), BLOCK // 8), dtype=np.int64)
        return np.concatenate(([0], np.cumsum(per)))

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, now = [], ids
        for level in range(bits - 1, -1, -1):
            on = (now & now.dtype.type(1 << level)) != 0
            planes.append(np.packbits(on))
            now = now[np.concatenate((np.flatnonzero(~on), np.flatnonzero(on)))]
        return cls(len(ids), planes)

    def _rank1(self, level: int, at: int) -> int:
        """Ones before position ``at``."""
        plane, block = self.planes[level], at // BLOCK
        first, last = block * BLOCK // 8, at // 8
        count = int(self.ranks[level][block]) + int(np.bitwise_count(plane[first:last]).sum())
        return count + (int(plane[last]) >> (8 - at % 8)).bit_count() if at % 8 else count

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the ``k``-th (from 0) such bit: a binary search over ranks."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._rank1(level, mid + 1)
            if (ones if bit else mid + 1 - ones) <= k:
                low = mid + 1
            else:
                high = mid
        return low

    def access(self, at: int) -> int:
        """The id at a position."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level in range(self.bits):
            ones = self._rank1(level, at)
            bit = int(self.planes[level][at // 8]) >> (7 - at % 8) & 1
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self._rank1(level, low), self._rank1(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """Occurrences of an id within positions [low, high)."""
        if not 0 <= token < 1 << self.bits:
            return 0
        a, b = self._range(token, low, self.n if high is None else high)
        return b - a

    def occurrence(self, token: int, k: int) -> int:
        """Position of the ``k``-th (from 0) occurrence of an id; -1 if there are fewer."""
        if k < 0 or k >= self.count(token):
            return -1
        at = self._range(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order: the planes undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            on = np.unpackbits(self.planes[level], count=self.n).view(bool)
            back = np.empty_like(now)
            now[self.zeros[level] :] |= kind(1 << (self.bits - 1 - level))
            back[np.concatenate((np.flatnonzero(~on), np.flatnonzero(on)))] = now
            now = back
        return now


class Shard:
    """One file: document ids, of which the first ``without`` are null, their token counts and the wavelet matrix of their ids."""

    def __init__(self, doc_ids: np.ndarray, lengths: np.ndarray, matrix: WaveletMatrix, without: int = 0):
        self.doc_ids, self.lengths, self.matrix, self.without = doc_ids, lengths, matrix, without
        self.starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))

    def to_bytes(self) -> bytes:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        columns = (self.doc_ids.astype("<i8"), self.lengths.astype("<u4"), *self.matrix.planes, *(r.astype("<i8") for r in self.matrix.ranks))
        parts = [squeeze(x.tobytes()) for x in columns]
        head = struct.pack("<4sIQQQ", MAGIC, self.matrix.bits, len(self.doc_ids), self.matrix.n, self.without)
        return head + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, content: bytes) -> Shard:
        magic, bits, docs, n, without = struct.unpack_from("<4sIQQQ", content)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        sizes = struct.unpack_from(f"<{2 * bits + 2}Q", content, 32)
        at, parts, expand = 32 + 8 * (2 * bits + 2), [], zstandard.ZstdDecompressor().decompress
        for size in sizes:
            parts.append(expand(content[at : at + size]))
            at += size
        planes, ranks = [np.frombuffer(p, np.uint8) for p in parts[2 : 2 + bits]], [np.frombuffer(p, "<i8") for p in parts[2 + bits :]]
        return cls(np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], "<u4"), WaveletMatrix(n, planes, ranks), without)

    def tokens(self, index: int) -> list[int]:
        """The ids of the document at ``index``, by access to the planes."""
        return [self.matrix.access(at) for at in range(int(self.starts[index]), int(self.starts[index + 1]))]


def tokenizer_path() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if visible, else the next from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)}


_BYTES = _byte_letters()


class _Pieces(dict):
    """The ids of pieces, encoded when first asked for.

    A piece follows a blank, or stands as it is if it starts with a line feed; NUL marks one that follows nothing.
    """

    _tail = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)

    def __init__(self, inner, kind: str):
        super().__init__()
        self.inner, self.kind = inner, kind

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            # Letters alone are one word to the pre-tokenizer: its model takes them as they are, byte by byte.
            word = "\u0120" + piece if piece.isascii() else (b" " + piece.encode()).decode("latin-1").translate(_BYTES)
            made = array(self.kind, [t.id for t in self.inner.model.tokenize(word)]).tobytes()
        else:
            found = self._tail.fullmatch(piece) if piece[:1] not in "\0\n" else None
            if found:
                made = self[found[1]] + self["\0" + found[2]]
            else:
                whole = piece[1:] if piece[:1] == "\0" else piece if piece[:1] == "\n" else " " + piece
                made = array(self.kind, self.inner.encode(whole, add_special_tokens=False).ids).tobytes()
        if len(piece) <= LONGEST:
            self[piece] = made
        return made


class Encoder:
    """Encodes texts with the tokenizers library, remembering the ids of pieces.

    The vocabulary's pre-tokenizer always starts a new word at a single blank between two other characters, makes a
    single line feed between two others a word of its own, and parts letters from the marks after them. So a text may
    be cut there and its pieces encoded apart.
    """

    _cut = re.compile(r"(?<=\S) (?=\S)")
    #: Blanks that stand together or at an end, and those other than the space and the line feed.
    _odd = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        added = sorted({t.content for t in self.inner.get_added_tokens_decoder().values()})
        #: The library takes added tokens out of a text before the pre-tokenizer cuts it.
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.bits = max(1, (max(self.inner.get_vocab_size() - 1, END)).bit_length())
        self.kind = np.dtype("=u2" if self.bits <= 16 else "=u4")
        self.seen = _Pieces(self.inner, "H" if self.bits <= 16 else "I")

    def _pieces(self, text: str) -> list[str]:
        """Pieces that follow a blank or a line feed; the first has neither, which is marked by NUL."""
        if "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[0] == " " or text[-1] == " " or self._odd.search(text):
            parts = self._cut.split(text)
        else:
            parts = text.replace("\n", " \n").split(" ")
        parts[0] = "\0" + parts[0]
        return parts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        if len(self.seen) > CACHE:
            # The first half stays: words met early are mostly frequent ones.
            for piece in list(islice(self.seen, CACHE // 2, None)):
                del self.seen[piece]
        out, end, ids = [], np.array([END], self.kind).tobytes(), self.seen.__getitem__
        for text in texts:
            if text and self.added and self.added.search(text):
                out.append(np.array([*self.inner.encode(text, add_special_tokens=False).ids, END], self.kind))
                continue
            pieces = self._pieces(text) if text and "\0" not in text else ["\0" + text] if text else []
            out.append(np.frombuffer(b"".join([*map(ids, pieces), end]), self.kind))
        return out


def _encoder(path: str) -> Encoder:
    """The worker's encoder: kept from task to task."""
    kept = sys.modules[__name__].__dict__.setdefault("_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def write_shards(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes every text (null: empty) and returns the shards, as read back from the shared folder.

    Documents are dealt by ranges of their id, as many as their bytes ask for, and sorted within. Ids are whole numbers;
    rows without one come first, dealt and ordered by a hash of their text, and rows with one id are ordered by their
    text. An empty table gives no shards.
    """
    path = path or tokenizer_path()
    t = F.col(text).cast("string")
    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.when(F.col(doc_id).isNull(), F.xxhash64(t)).alias("h"), t.alias("t"))
    size = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    order = [F.col("i").asc_nulls_first(), F.col("h").asc_nulls_first()]
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "t")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ids, lengths, parts, total, before = _encoder(path), [], [], [], 0, 0
        task = TaskContext.get().partitionId()

        def close():
            without = ids.count(None)
            matrix = WaveletMatrix.build(np.concatenate(parts), encoder.bits)
            content = Shard(np.array([0] * without + ids[without:], np.int64), np.array(lengths), matrix, without).to_bytes()
            ends = pa.array([ids[0]], pa.int64()), pa.array([ids[-1]], pa.int64())
            return pa.RecordBatch.from_pydict({"part": pa.array([task], pa.int32()), "before": [before], "first_id": ends[0], "last_id": ends[1], "n_docs": [len(ids)], "n_tokens": [total], "content": [content]})

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for i, found in zip(part.column(0).to_pylist(), encoder.encode(part.column(2).to_pylist())):
                    if total and total + len(found) > shard_tokens:
                        yield close()
                        before += total
                        ids, lengths, parts, total = [], [], [], 0
                    ids.append(i)
                    lengths.append(len(found))
                    parts.append(found)
                    total += len(found)
        if ids:
            yield close()

    return materialise(ordered.mapInArrow(pack, SHARDS), "shards")


def placed(shards: DataFrame) -> DataFrame:
    """The shards with ``start``, the number of tokens in all shards before.

    Each shard knows the tokens before it in the task that wrote it; a running sum over one row for each of those
    tasks, as many as ranges, gives the rest and is broadcast.
    """
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return shards.join(F.broadcast(tasks), "part").withColumn("start", F.col("earlier") + F.col("before"))


def read_documents(shards: DataFrame) -> DataFrame:
    """A row for each document of the shards: doc_id, start, n_tokens and the crc32 of its ids, from the decoded planes."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard.from_bytes(content.as_py())
                tokens = memoryview(shard.matrix.decode().astype("<u4")).cast("B")
                at, ends = shard.starts, (4 * shard.starts).tolist()
                crcs = [zlib.crc32(tokens[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                ids = pa.array(shard.doc_ids, pa.int64(), mask=np.arange(len(shard.doc_ids)) < shard.without)
                yield pa.RecordBatch.from_arrays([ids, pa.array(at[:-1] + start, pa.int64()), pa.array(shard.lengths.astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(shards).select("start", "content").mapInArrow(unpack, "doc_id:long,start:long,n_tokens:long,ids_crc32:long")


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    """Encodes all documents, writes their shards and reads them back."""
    return read_documents(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
