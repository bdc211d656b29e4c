"""What the corpus operators share: words, shared tables and joins which survive hot keys."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curato.operators.graph import components, materialise, shared_dir

__all__ = ["components", "hash_words", "is_hot", "join_counted", "materialise", "mix", "node_of", "pieces", "raw", "real_id", "shared_dir", "tokens_of", "words_of"]

#: Lower-cases A-Z and blanks every other ASCII byte but digits and a-z; bytes of longer code points stay.
_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text with A-Z lower-cased; none for null."""
    return text.translate(_FOLD).split() if text else []


def tokens_of(text: bytes | None) -> list[bytes]:
    """The runs of non-space of a UTF-8 text with A-Z lower-cased; none for null."""
    return text.lower().split() if text else []


def raw(column: str = "text") -> Column:
    """The text as UTF-8 bytes, empty for null: workers then decode nothing that they don't need."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


#: Numbers from here on stand for rows whose id is null; no id may be one of them.
MADE_UP = (1 << 63) - (1 << 50)


def node_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The id, a whole number, or for a null one a number from the text, greater than any id."""
    return F.coalesce(F.col(doc_id).cast("long"), F.pmod(F.xxhash64(raw(text)), F.lit(1 << 50)) + F.lit(MADE_UP))


def real_id(node: str) -> Column:
    """The id that a node stands for; null if the row had none."""
    return F.when(F.col(node) < F.lit(MADE_UP), F.col(node))


def is_hot(count: Column, total: int) -> Column:
    """Whether a key holds a thousandth of ``total`` rows: at most a thousand keys do."""
    return count * 1000 >= F.lit(total)


def join_counted(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has a row for each ``key`` and its number ``n_key`` of rows in ``left``.

    Keys with a thousandth of the ``total`` rows of ``left``, a thousand keys at most, are broadcast, so that no
    task gets all rows of such a key; the others are shuffled. Both sides should be cheap to read twice.
    """
    hot = right.where(is_hot(F.col("n_key"), total)).drop("n_key")
    cold = right.where(~is_hot(F.col("n_key"), total)).drop("n_key")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return left.join(F.broadcast(hot), key).unionByName(rest)



#: Bytes of text hashed at a time, and bytes of text in a piece of a batch.
WINDOW, PIECE = 1 << 18, 1 << 22

_LOOKUP = np.frombuffer(_FOLD.replace(b" ", b"\0"), np.uint8)
_M = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64; a worker keeps those it has made."""
    kept = sys.modules[__name__].__dict__
    if len(kept.get("_kept_powers", ((),))[0]) < n:
        base = 0x2545F4914F6CDD1D
        both = [np.full(n, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
        for x in both:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        kept["_kept_powers"] = tuple(both)
    return kept["_kept_powers"]


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (see ``words_of``) of UTF-8 texts in a row, and where each text's begin and the last one's end.

    A word's hash is its polynomial in an odd number, taken from running sums over a window of bytes; a word longer than
    a window makes the window longer.
    """
    wide = pa.types.is_large_binary(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    hashes, places, at = [], [], 0
    while at < len(data):
        end = min(at + WINDOW, len(data))
        while end < len(data):
            # A window ends where a text begins or no word is cut.
            begun = bounds[np.searchsorted(bounds, end, "right") - 1]
            blanks = np.flatnonzero(_LOOKUP[data[at:end]] == 0)
            cut = max(int(begun), at + int(blanks[-1]) + 1 if len(blanks) else 0)
            if cut > at:
                end = cut
                break
            end = min(at + 2 * (end - at), len(data))
        part = _LOOKUP[data[at:end]]
        inside = part != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        marks = bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, end)] - at
        first[marks] = inside[marks]
        last[marks - 1] = inside[marks - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        up, down = _powers(max(WINDOW, len(part) + 1))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        hashes.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _M))
        places.append(starts + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)


def pieces(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a binary column holds about as many bytes as ``PIECE`` in each, but one row at least."""
    for batch in batches:
        texts = batch.column(column)
        kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end
