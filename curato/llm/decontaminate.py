"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The benchmark is cut into windows of ten consecutive words (an item of fewer words is one window). For each
window length there is one Wu-Manber table: a shift table over blocks of two words tells how far the search may
skip, the block at a window's end selects a bucket of test windows by the hash of its words, and a direct
comparison confirms each occurrence.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.llm.common import raw, words_of

#: Bytes of benchmark text in one search table; a larger benchmark is searched in as many passes as it has such blocks.
BLOCK_BYTES = 16 << 20

SPANS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    + [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")]
)
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


class WuManber:
    """Finds all occurrences of word windows in a list of words."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.tables = []
        by_length = defaultdict(list)
        for window, items in windows.items():
            by_length[len(window)].append((window, items))
        for m, group in sorted(by_length.items()):
            b = min(2, m)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], dict[bytes, list]] = {}
            for window, items in group:
                for end in range(b, m + 1):
                    block = window[end - b : end]
                    shift[block] = min(shift.get(block, m), m - end)
                buckets.setdefault(window[m - b :], {}).setdefault(window[0], []).append((list(window), items))
            self.tables.append((m, b, shift, m - b + 1, buckets))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """Yields (first word, end, items) for each window that occurs."""
        n = len(words)
        for m, b, shift, furthest, buckets in self.tables:
            at = m
            step = shift.get
            while at <= n:
                block = (words[at - 2], words[at - 1]) if b == 2 else (words[at - 1],)
                skip = step(block, furthest)
                if skip:
                    at += skip
                    continue
                for window, items in buckets[block].get(words[at - m], ()):
                    if words[at - m : at] == window:
                        yield at - m, at, items
                at += 1


def windows_of(rows, size: int) -> dict[tuple[bytes, ...], set[str]]:
    """The windows of (item id, UTF-8 text) rows, with the items they belong to."""
    found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    for item, text in rows:
        words = words_of(text)
        if words:
            m = min(size, len(words))
            for at in range(len(words) - m + 1):
                found[tuple(words[at : at + m])].add(str(item))
    return dict(found)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def _finder(shared):
    """An Arrow UDF which searches texts for the windows in a broadcast."""

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = WuManber(shared.value)
        for batch in batches:
            out = []
            for text in batch:
                words = words_of(text.as_py())
                items: set[str] = set()
                spans = []
                for start, end, of in table.search(words):
                    spans.append((start, end))
                    items |= of
                merged = _merge(spans)
                out.append({"n_words": len(words), "n_hit": sum(e - s for s, e in merged), "items": sorted(items), "starts": [s for s, _ in merged], "ends": [e for _, e in merged]})
            yield pa.array(out, _ARROW)

    return F.arrow_udf(find, SPANS).asNondeterministic()


def _blocks(benchmark: DataFrame, item: str, text: str, size: int, block_bytes: int) -> Iterator[dict]:
    """The benchmark's windows in blocks of about ``block_bytes`` of text, one at a time on the driver."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), raw(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for block in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == block)
        yield windows_of(part.toLocalIterator(), size)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds ``hit`` (n_words, n_hit, items, starts, ends; spans are in words) to every row of ``docs``.

    Only the text goes to Python; the other columns stay as they are, and a column named ``hit`` is replaced. A null
    or empty text has no words and no hits; repeated rows each get their own result; an empty benchmark hits nothing.
    Benchmarks beyond ``block_bytes`` are searched block by block and the spans joined within the row.
    """
    blocks = list(
        docs.sparkSession.sparkContext.broadcast(windows)
        for windows in _blocks(benchmark, item, item_text, size, block_bytes)
    )
    if len(blocks) == 1:
        return docs.withColumn("hit", _finder(blocks[0])(raw(text)))
    columns = [c for c in docs.columns if c != "hit"]
    rows = docs.select(*columns, F.array(*(_finder(b)(raw(text)) for b in blocks)).alias("hit"))
    return rows.withColumn("hit", F.arrow_udf(_joined, SPANS)(F.col("hit")))


def _joined(rows: pa.Array) -> pa.Array:
    out = []
    for parts in rows.to_pylist():
        merged = _merge([(s, e) for p in parts for s, e in zip(p["starts"], p["ends"])])
        out.append({"n_words": parts[0]["n_words"], "n_hit": sum(e - s for s, e in merged), "items": sorted({i for p in parts for i in p["items"]}), "starts": [s for s, _ in merged], "ends": [e for _, e in merged]})
    return pa.array(out, _ARROW)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their own columns."""
    found = find_contamination(docs.select(F.struct("*").alias("row"), F.col(options.get("text", "text"))), benchmark, **options)
    return found.where(F.col("hit.n_hit") == 0).select("row.*")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contamination report over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        F.col("hit.n_words").alias("n_words"),
        F.col("hit.n_hit").alias("n_hit"),
        F.size("hit.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hit.n_hit") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, benchmark: list[tuple], size: int = 10) -> tuple[int, int, int, str]:
    """(n_words, n_hit, n_items, items_sha256) by comparing every window at every position."""
    words = words_of((text or "").encode())
    hit, items = set(), set()
    for item, other in benchmark:
        own = words_of((other or "").encode())
        m = min(size, len(own))
        if own:
            windows = [own[i : i + m] for i in range(len(own) - m + 1)]
            for at in range(len(words) - m + 1):
                if words[at : at + m] in windows:
                    items.add(str(item))
                    hit.update(range(at, at + m))
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
bm AS (SELECT item_id, w, least(10, len(w)) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS win FROM bm),
ms AS (SELECT DISTINCT m FROM bw),
dl AS (SELECT doc_id, m, [array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)] AS wins FROM d, ms WHERE len(w) >= m),
dw AS (SELECT doc_id, m, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS i FROM dl),
h AS (SELECT doc_id, item_id, i, m FROM dw JOIN bw USING (m, win)),
p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
