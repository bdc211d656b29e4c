"""Filter interaction audit: what each filter removes after the others, in every order of them.

One pass of a table-driven byte transducer over the UTF-8 text counts words, capitals, code points and symbols, while
the spans of words go into a hash table whose entries are compared byte for byte. The rest is aggregation: a document
is a set of five failures, and how many documents of a part have each set is all that the orders need.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curato.llm.common import pieces, raw

#: The filters; bit i of a set of failures is the i-th of them.
FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
SPACES = b" \t\n\v\f\r"

PROFILE = "struct<words:long,distinct:long,capitals:long,code_points:long,symbols:long>"
_ARROW = pa.struct([(name, pa.int64()) for name in ("words", "distinct", "capitals", "code_points", "symbols")])

#: What the transducer does at a byte: it ends in a word or not, a word begins, a capital, a symbol, a code point begins.
INSIDE, BEGINS, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8, 16


def _transitions() -> np.ndarray:
    """Actions by state (0 outside of a word, 1 inside) and byte; the state after a byte is its ``INSIDE``."""
    table = np.zeros((2, 256), np.uint8)
    for state in (0, 1):
        for byte in range(256):
            inside = byte not in SPACES
            table[state, byte] = (
                INSIDE * inside | BEGINS * (inside and not state) | CAPITAL * (65 <= byte <= 90) | SYMBOL * (byte in SYMBOLS) | POINT * (byte & 0xC0 != 0x80)
            )
    return table


_TABLE = _transitions()
#: Bytes that the transducer takes at a time, so that the words' table stays in the cache; a word is never cut.
WINDOW = 1 << 18
#: Up to so many bytes, a word is hashed and compared eight bytes at a time, all words at once.
SHORT = 64
_K = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Words:
    """A hash table of words, told apart by their document and their bytes.

    Open addressing with linear probing, for many words at once: of those that reach a free slot one takes it, and the
    others are compared with it, document, length and bytes; the unlike ones go on to the next slot.
    """

    def __init__(self, data: np.ndarray):
        # Bytes beyond the end are zeros.
        self.plain = data.tobytes() + bytes(SHORT + 8)
        # Eight bytes from any place on.
        self.eights = np.ndarray((len(self.plain) - 7,), "<u8", self.plain, strides=(1,))
        self.clear()

    def clear(self) -> None:
        self.starts, self.lengths, self.docs, self.hashes = (np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, np.uint64))
        self.slots = np.full(1 << 10, -1, np.int32)

    def _hash(self, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
        found = self.eights[starts] & _MASKS[np.minimum(lengths, 8)]
        longer = np.flatnonzero(lengths > 8)
        last = self.eights[starts[longer] + lengths[longer] - 8]
        found[longer] = (found[longer] * _K) ^ (last >> np.uint64(7)) ^ (last << np.uint64(57))
        for i in np.flatnonzero(lengths > 16):
            found[i] = xxhash.xxh3_64_intdigest(self.plain[starts[i] : starts[i] + lengths[i]])
        found = (found ^ (docs.astype(np.uint64) << np.uint64(40)) ^ lengths.astype(np.uint64)) * _K
        return (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def _equal(self, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the bytes from ``a`` on equal those from ``b`` on."""
        same = ((self.eights[a] ^ self.eights[b]) & _MASKS[np.minimum(lengths, 8)]) == 0
        for at in range(8, SHORT, 8):
            on = np.flatnonzero(same & (lengths > at))
            if not len(on):
                return same
            same[on] = ((self.eights[a[on] + at] ^ self.eights[b[on] + at]) & _MASKS[np.minimum(lengths[on] - at, 8)]) == 0
        for i in np.flatnonzero(same & (lengths > SHORT)):
            same[i] = self.plain[a[i] : a[i] + lengths[i]] == self.plain[b[i] : b[i] + lengths[i]]
        return same

    def _grow(self, more: int) -> None:
        n = len(self.slots)
        while n < 2 * (len(self.starts) + more):
            n *= 2
        if n > len(self.slots):
            self.slots = np.full(n, -1, np.int32)
            left, at = np.arange(len(self.starts), dtype=np.int32), self._slot(self.hashes)
            while len(left):
                free = self.slots[at] < 0
                self.slots[at[free]] = left[free]
                missed = self.slots[at] != left
                left, at = left[missed], (at[missed] + 1) & (n - 1)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(20)).astype(np.int64) & (len(self.slots) - 1)

    def insert(self, starts: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> None:
        """Inserts words; those that are there already change nothing."""
        self._grow(len(starts))
        before, hashes = len(self.starts), self._hash(starts, lengths, docs)
        starts, lengths, docs, hashes = (np.concatenate(x) for x in ((self.starts, starts), (self.lengths, lengths), (self.docs, docs), (self.hashes, hashes)))
        left = np.arange(before, len(starts), dtype=np.int32)
        at = self._slot(hashes[left])
        taken = []
        while len(left):
            free = self.slots[at] < 0
            # The last one written to a slot has it.
            self.slots[at[free]] = left[free]
            holder = self.slots[at]
            own = holder == left
            taken.append(left[own])
            left, at, holder = left[~own], at[~own], holder[~own]
            like = (docs[left] == docs[holder]) & (lengths[left] == lengths[holder])
            check = np.flatnonzero(like)
            like[check] = self._equal(starts[left[check]], starts[holder[check]], lengths[left[check]])
            left, at = left[~like], (at[~like] + 1) & (len(self.slots) - 1)
        # The table keeps its entries only; slots get their new places.
        kept = np.concatenate((np.arange(before), np.sort(np.concatenate(taken)))) if taken else np.arange(before)
        place = np.zeros(len(starts), np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        full = np.flatnonzero(self.slots >= before)
        self.slots[full] = place[self.slots[full]]
        self.starts, self.lengths, self.docs, self.hashes = starts[kept], lengths[kept], docs[kept], hashes[kept]


def _ends(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts bytes into windows that end where a text begins or after a space."""
    at, spaces = 0, np.isin(np.arange(256), list(SPACES))
    while at < len(data):
        width = WINDOW
        while True:
            end = min(at + width, len(data))
            cut = end if end == len(data) else int(bounds[np.searchsorted(bounds, end, "right") - 1])
            if cut <= at:
                blank = np.flatnonzero(spaces[data[at:end]])
                cut = at + int(blank[-1]) + 1 if len(blank) else 0
            if cut > at:
                break
            width *= 2
        yield at, cut
        at = cut


def profile(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each UTF-8 text of an Arrow array of binaries."""
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    bounds = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    found = {name: np.zeros(len(texts), np.int64) for name in _ARROW.names}
    table = Words(data)
    for at, end in _ends(data, bounds):
        part = data[at:end]
        low, high = np.searchsorted(bounds, at, "right") - 1, np.searchsorted(bounds, end)
        edges = np.clip(bounds[low : high + 1], at, end) - at
        # The state before a byte is what the byte before it left; a text begins outside of a word, and so does a window.
        state = np.zeros(len(part), np.uint8)
        state[1:] = _TABLE[0, part[:-1]] & INSIDE
        first = edges[:-1][edges[:-1] < len(part)]
        state[first] = 0
        actions = _TABLE[state, part]
        begun = np.flatnonzero(actions & BEGINS)
        # A word ends before a byte outside, or where another one begins with the next text.
        inside = actions & INSIDE != 0
        inside[:-1] &= actions[1:] & (INSIDE | BEGINS) != INSIDE
        ends = np.flatnonzero(inside) + 1
        counts = np.diff(np.searchsorted(begun, edges))
        if bounds[low] == at:
            # No text goes on from the window before.
            found["distinct"] += np.bincount(table.docs, minlength=len(texts))
            table.clear()
        table.insert(begun + at, ends - begun, np.repeat(np.arange(low, high), counts))
        for name, bit in (("words", BEGINS), ("capitals", CAPITAL), ("symbols", SYMBOL), ("code_points", POINT)):
            places = begun if bit == BEGINS else np.flatnonzero(actions & bit)
            found[name][low:high] += np.diff(np.searchsorted(places, edges))
    found["distinct"] += np.bincount(table.docs, minlength=len(texts))
    return found


def _profiles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        parts = [profile(piece.column(0)) for piece in pieces(iter([pa.record_batch([batch], ["t"])]), 0)]
        columns = [np.concatenate([p[name] for p in parts]) if parts else np.zeros(0, np.int64) for name in _ARROW.names]
        yield pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_ARROW))


def profile_of(text: str = "text") -> Column:
    """words, distinct, capitals, code_points and symbols of a text; all zero for null or empty ones."""
    return F.arrow_udf(_profiles, PROFILE)(raw(text))


def failures(counts: Column) -> Column:
    """Bits of the filters A to D that a profile fails (see ``profile_of``)."""
    fails = {
        "A": counts["words"] < 100,
        "B": 100 * counts["distinct"] < 80 * counts["words"],
        "C": 100 * counts["capitals"] > 10 * counts["code_points"],
        "D": counts["symbols"] > 0,
    }
    found = F.lit(0)
    for name, fail in fails.items():
        found = found + F.when(fail, 1 << FILTERS.index(name)).otherwise(0)
    return found


def failure_counts(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, failed, n, good, toxic): documents of a part by the set of filters that they fail, and those labelled so.

    A null or empty text is the empty one; a null part is the empty string. E, a copy of a smaller id's text, is decided
    over all rows: rows without an id, and rows that repeat an id with its text, are no copies of one another. A
    document is good or toxic if any row of ``labels`` of its id says so; rows without an id have no labels. Empty
    tables give no rows; other columns are ignored.

    The texts are read once and stay where they are. What is shuffled is a digest and a few numbers for each row,
    merged before and after; a group of copies is a few rows, one for each part and label, when its smallest id is found.
    """
    rows = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(raw(), 256)).alias("digest"),
        failures(profile_of()).alias("failed"),
    )
    rows = rows.groupBy("id", "part", "digest", "failed").agg(F.count("*").alias("c"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(name) for c, name in (("quality", "is_good"), ("toxic", "is_toxic"))))
    named = rows.where("id is not null").join(said, "id", "left")
    nameless = rows.where("id is null").withColumns({"is_good": F.lit(False), "is_toxic": F.lit(False)})
    both = named.unionByName(nameless).withColumns({name: F.coalesce(name, F.lit(False)) for name in ("is_good", "is_toxic")})
    groups = both.groupBy("digest", "part", "failed", "is_good", "is_toxic").agg(
        F.sum("c").alias("n"), F.min(F.when(F.col("id").isNotNull(), F.struct("id", "c"))).alias("least"), F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).alias("nameless")
    )
    lowest = F.min("least.id").over(Window.partitionBy("digest"))
    first = F.col("nameless") + F.when(F.col("least.id") == F.col("lowest"), F.col("least.c")).otherwise(0)
    groups = groups.withColumn("lowest", lowest).withColumn("first", first)
    each = F.array(
        F.struct(F.col("failed"), F.col("first").alias("n")),
        F.struct((F.col("failed") + (1 << FILTERS.index("E"))).alias("failed"), (F.col("n") - F.col("first")).alias("n")),
    )
    sets = groups.select("part", "is_good", "is_toxic", F.inline(each))
    counted = lambda name: F.coalesce(F.sum(F.when(F.col(name), F.col("n"))), F.lit(0))
    return sets.groupBy("part", "failed").agg(F.sum("n").alias("n"), counted("is_good").alias("good"), counted("is_toxic").alias("toxic")).where("n > 0")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part, order of the filters and step, from ``failure_counts``.

    ``kept`` documents pass this step too, ``removed`` ones are lost at it, ``redundant`` ones fail its filter but were
    lost before, ``unique_fails`` fail its filter alone; ``good_lost`` and ``toxic_lost`` are those removed with a label.
    ``shapley`` is what the filter removes at any step, summed over all orders: a document that fails k filters is
    removed by each of them in a k-th of the orders.
    """
    bit = {name: 1 << i for i, name in enumerate(filters)}
    orders = ["".join(p) for p in permutations(filters)]
    steps = [{"filter_order": order, "step": i + 1, "own": bit[order[i]], "before": sum(bit[x] for x in order[:i])} for order in orders for i in range(len(order))]
    # A part has at most 2 ** 5 sets.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    schema = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    rows = parts.select("part", "sets", F.inline(F.from_json(F.lit(json.dumps(steps)), schema)))
    own, before = F.col("own"), F.col("before")

    def total(of: str, chosen, weight=lambda s: F.lit(1)) -> Column:
        return F.aggregate("sets", F.lit(0).cast("long"), lambda sum_, s: sum_ + F.when(chosen(s["failed"]), s[of] * weight(s["failed"])).otherwise(0))

    removed = lambda failed: (failed.bitwiseAND(own) != 0) & (failed.bitwiseAND(before) == 0)
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda f: f.bitwiseAND(own + before) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda f: (f.bitwiseAND(own) != 0) & (f.bitwiseAND(before) != 0)).alias("redundant"),
        total("n", lambda f: f == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("n", lambda f: f.bitwiseAND(own) != 0, lambda f: (F.lit(len(orders)) / F.greatest(F.bit_count(f), F.lit(1))).cast("long")).alias("shapley"),
    )


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return interactions(failure_counts(docs, labels))


OP13_SQL = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS lowest FROM d),
f AS (SELECT doc_id, part,
  CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > lowest THEN 16 ELSE 0 END AS failed FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND len(list_distinct([a.b, b.b, c.b, d.b, e.b])) = 5),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT *, (failed & own) <> 0 AS fails, (failed & before::BIGINT) <> 0 AS gone FROM c, s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fails AND NOT gone), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (fails AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (failed = own), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (fails AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (fails AND NOT gone), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * (120 // greatest(bit_count(failed), 1))) FILTER (fails), 0) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step
"""
