"""Embedding review: similarity to the centroid, robust outliers and nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curato.functions.columns import clamp, dot, unit
from curato.operators.duplicates import rows_of
from curato.operators.graph import materialise
from curato.operators.statistics import median_of

#: Limits of the robust outlier threshold.
MOST, LEAST_GAP, SPREADS = 0.75, 0.10, 3.5
#: Rows that are held against each other at a time, those of a block, and blocks of a side at least.
CHUNK, BLOCK, LEAST_BLOCKS = 2048, 65_536, 8
#: Cosines of equal vectors differ by less in products of other shapes.
TIE = 1e-12


def centroid(vectors: DataFrame, vector: str) -> DataFrame:
    """One row: ``centroid``, the mean of the vectors' directions, of unit length."""
    parts = vectors.select(F.posexplode(unit(F.col(vector))).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    # As many rows as the vectors have dimensions.
    whole = parts.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))
    return whole.select(unit(F.col("c")).alias("centroid"))


def centroid_similarity(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, similarity): each vector's cosine with the centroid, clipped to 0..1."""
    rows = vectors.crossJoin(F.broadcast(centroid(vectors, vector)))
    return rows.select(key, clamp(dot(unit(F.col(vector)), F.col("centroid"))).alias("similarity"))


def outlier_threshold(similarities: DataFrame, most: float = MOST, least_gap: float = LEAST_GAP, spreads: float = SPREADS) -> DataFrame:
    """One row: median, median absolute deviation and the threshold below which a similarity is an outlier; null without similarities."""
    return _threshold(materialise(similarities.select("similarity"), "similarities"), most, least_gap, spreads)


def _threshold(written: DataFrame, most: float = MOST, least_gap: float = LEAST_GAP, spreads: float = SPREADS) -> DataFrame:
    median = median_of(written, F.col("similarity"))
    mad = None if median is None else median_of(written, F.abs(F.col("similarity") - F.lit(median)))
    limit = None if median is None else min(most, max(0.0, median - max(least_gap, spreads * mad)))
    return written.sparkSession.createDataFrame([(median, mad, limit)], "median double, mad double, threshold double")


def outliers(vectors: DataFrame, key: str, vector: str, **limits) -> DataFrame:
    """(key, similarity, threshold) of the outliers. Advice only: nothing is rejected."""
    rows = materialise(centroid_similarity(vectors, key, vector), "similarities")
    limit = F.lit(_threshold(rows, **limits).first().threshold).cast("double")
    return rows.where(F.col("similarity") < limit).select(key, "similarity", limit.alias("threshold"))


def packed(rows: DataFrame, key: str, vector: str, blocks: int, most: int = CHUNK) -> DataFrame:
    """(at, k, v): chunks of at most ``most`` rows as bytes of their keys and of their directions, dealt evenly to blocks 0 to ``blocks`` - 1."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        for batch in batches:
            for start in range(0, len(batch), most):
                part = batch.slice(start, most)
                keys, own = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), rows_of(part.column(1))
                yield pa.record_batch([pa.array([at % blocks], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([own.tobytes()], pa.binary())], ["at", "k", "v"])
                at += 1

    return rows.select(F.col(key).cast("long").alias("k"), unit(F.col(vector)).alias("v")).mapInArrow(pack, "at int, k binary, v binary")


def nearest(queries: DataFrame, references: DataFrame, key: str, vector: str, block: int = BLOCK, skip_self: bool = True) -> DataFrame:
    """(key, other, cosine): the nearest reference of each query, ties to the smallest key; with ``skip_self`` none has its own key.

    Queries and references go in blocks of about ``block`` rows, and in a few smaller ones where that makes too few tasks: each pair of
    blocks is one task's, which holds a chunk of queries against a chunk of references at a time, and the best of the blocks is taken.
    So every row is sent as often as the other side has blocks. Cosines that differ by no more than the sum's last places are ties.
    A vector of zeros is an error.
    """
    n_q, n_r = (max(LEAST_BLOCKS, -(-rows.count() // block)) for rows in (queries, references))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed(queries, key, vector, n_q, min(CHUNK, block)).select(F.col("at").alias("q"), each(n_r).alias("r"), "k", "v")
    right = packed(references, key, vector, n_r, min(CHUNK, block)).select(each(n_q).alias("q"), F.col("at").alias("r"), "k", "v")

    def chunks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for k, v in zip(table.column("k").to_pylist(), table.column("v").to_pylist()):
            keys = np.frombuffer(k, np.int64)
            yield keys, np.frombuffer(v, float).reshape(len(keys), -1)

    def best(some: pa.Table, others: pa.Table) -> pa.Table:
        held = []
        for k2, v2 in chunks(others):
            order = np.argsort(k2, kind="stable")
            held.append((k2[order], np.ascontiguousarray(v2[order].T)))
        out = []
        for k1, v1 in chunks(some):
            top, other, rows = np.full(len(k1), -2.0), np.zeros(len(k1), np.int64), np.arange(len(k1))
            for k2, v2 in held:
                found = v1 @ v2
                if skip_self:
                    low, high = np.searchsorted(k2, k1), np.searchsorted(k2, k1, "right")
                    for i in np.flatnonzero(high > low):
                        found[i, low[i] : high[i]] = -2
                most = found.max(axis=1)
                # Keys ascend: the first of those as near as the nearest has the smallest.
                at = k2[(found >= (most - TIE)[:, None]).argmax(axis=1)]
                better = (most > -2) & ((most > top + TIE) | ((most >= top - TIE) & (at < other)))
                top, other = np.maximum(top, most), np.where(better, at, other)
            if held:
                out.append((k1, other, top))
        columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, float))]
        return pa.table(dict(zip(("k", "other", "cosine"), columns)))

    compared = left.groupBy("q", "r").cogroup(right.groupBy("q", "r")).applyInArrow(best, "k long, other long, cosine double").where("cosine > -2")
    top = compared.groupBy("k").agg(F.max(F.struct(F.round("cosine", 11).alias("c"), (-F.col("other")).alias("o"), "cosine")).alias("t"))
    return top.select(F.col("k").alias(key), (-F.col("t.o")).alias("other"), F.col("t.cosine").alias("cosine"))
