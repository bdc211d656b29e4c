"""Toxicity by cumulative-link (proportional-odds) ordinal regression on sparse text features.

One vector of weights is shared by ordered thresholds: P(grade > k) = sigmoid(w.x - theta_k). Features are hashed words
with the logarithm of their count, and the expected severity is the sum of the probabilities above each threshold.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.llm.common import raw, words_of

BUCKETS = 1 << 16
#: Labelled documents which the model is fitted on, at most: a bounded sample, drawn by a hash of the id.
SAMPLE = 6000
GRADES = 4
#: Features of the documents that the fit takes at a time, about.
PART = 1 << 16
#: Probability of any toxicity from which a document is toxic.
REJECT = 0.3


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text: the bucket of each distinct word and stem, and 1 + log of its count.

    A stem is a word's first four bytes: invented and inflected words share it.
    """
    columns, counts = counted(text)
    return columns, 1 + np.log(counts.astype(float))


def counted(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(columns, counts) of a text's words, followed by those of its stems in the order of ``stems``."""
    words = words_of(text)
    counts = Counter(words)
    counts.update([w[:4] + b"-" for w in words])
    return np.fromiter((zlib.crc32(w) % BUCKETS for w in counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))


def sampled(docs: DataFrame, labels: DataFrame, label: str, size: int, training=None) -> DataFrame:
    """At most about ``size`` labelled documents (text as bytes, label), the same ones for the same ids.

    The labels are counted first, so the sample's share follows from ``size`` alone; text is read for those only.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if training is not None:
        known = known.where(training)
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    share = min(1.0, size / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # At most about ``size`` rows of two numbers: small by construction.
    return docs.select("doc_id", raw().alias("text")).join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])


class Ordinal:
    """Weights and thresholds of the fitted model."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def above(self, text: bytes | None) -> np.ndarray:
        """P(grade > k) for each threshold k."""
        columns, values = features(text)
        return 1 / (1 + np.exp(self.thresholds - np.clip(self.weights[columns] @ values, -30, 30)))


def stems(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of a text's stems, each as the number that its four bytes make."""
    counts = Counter(w[:4].ljust(4, b"\0") for w in words_of(text))
    return np.fromiter((int.from_bytes(w, "big") for w in counts), np.int64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))


def grade_of(toxic: list[int], held: list[tuple[np.ndarray, np.ndarray]], grades: int = GRADES) -> tuple[np.ndarray, dict[int, float]]:
    """Severity grades of a sample, by its rows' stems, whose labels are 0 or 1 only.

    Grade 0 is not toxic. Toxic ones are graded 1 to ``grades`` - 1 by how many words they hold whose stem marks toxic
    documents: its smoothed odds of being in a toxic document are at least twenty times those in another.
    Labels that are graded already, with a value over 1, are kept.
    """
    if max(toxic, default=0) > 1:
        return np.minimum(np.array(toxic), grades - 1), {}
    inside: tuple[Counter, Counter] = (Counter(), Counter())
    for label, (numbers, _) in zip(toxic, held):
        inside[label].update(numbers.tolist())
    n1, n0 = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    marks = {w: r for w, c in inside[1].items() if c >= 3 and (r := (c + 0.1) / n1 / ((inside[0][w] + 0.1) / n0)) >= 20}
    out = np.zeros(len(held), int)
    for i, label in enumerate(toxic):
        if label:
            hits = sum(c for w, c in zip(held[i][0].tolist(), held[i][1].tolist()) if w in marks)
            out[i] = 1 + min(grades - 2, int(np.log2(max(1, hits))))
    return out, marks


def fit(y: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], grades: int = GRADES, rounds: int = 200, ridge: float = 4e-4) -> Ordinal:
    """Maximum likelihood of the cumulative-link model by full-batch Adam, on the grades and features of a bounded sample.

    Rows are taken some at a time, in order: sums are the same as of all at once, and little memory is needed besides the features.
    """
    bounds = np.concatenate(([0], np.cumsum([len(c) for c, _ in rows]))).astype(np.int64)
    cuts = np.unique(np.append(np.searchsorted(bounds, np.arange(0, bounds[-1], PART)), len(rows)))
    parts = []
    for low, high in zip(cuts[:-1], cuts[1:]):
        column, value = (np.concatenate([r[i] for r in rows[low:high]]) for i in range(2))
        parts.append((low, high, np.diff(bounds[low : high + 1]), column, value))
    n, w = max(1, len(rows)), np.zeros(BUCKETS)
    theta = np.array([np.log((np.sum(y <= k) + 1) / (np.sum(y > k) + 1)) for k in range(grades - 1)])
    # The first threshold and the logarithms of the gaps keep the thresholds in order.
    p = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 0.05))))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(p), np.zeros_like(p)]
    # A word in few documents tells little; one in most of them has a large sum of gradients: rates are per column.
    for t in range(1, rounds + 1):
        theta = np.concatenate((p[:1], p[0] + np.cumsum(np.exp(p[1:]))))
        z = np.zeros(len(rows))
        for low, high, sizes, column, value in parts:
            z[low:high] = np.bincount(np.repeat(np.arange(high - low), sizes), w[column] * value, high - low)
        s = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -30, 30)))
        cum = np.concatenate((np.ones((len(z), 1)), s, np.zeros((len(z), 1))), 1)
        own = np.maximum(cum[np.arange(len(z)), y] - cum[np.arange(len(z)), y + 1], 1e-9)
        slope = s * (1 - s)
        d = np.zeros_like(s)
        at = np.arange(len(z))
        low, high = y > 0, y < grades - 1
        d[at[low], y[low] - 1] += slope[at[low], y[low] - 1] / own[low]
        d[at[high], y[high]] -= slope[at[high], y[high]] / own[high]
        pull, gw = d.sum(1), np.zeros(BUCKETS)
        for low, high, sizes, column, value in parts:
            np.add.at(gw, column, value * np.repeat(pull[low:high], sizes))
        gw = -gw / n + ridge * w
        gt = d.sum(0) / n
        gp = np.concatenate(([gt.sum()], [gt[k + 1 :].sum() * np.exp(p[k + 1]) for k in range(grades - 2)]))
        for g, x, a, b in ((gw, w, 0, 1), (gp, p, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.999 * moments[b] + 0.001 * g * g
            x -= 0.05 * (moments[a] / (1 - 0.9**t)) / (np.sqrt(moments[b] / (1 - 0.999**t)) + 1e-8)
    theta = np.concatenate((p[:1], p[0] + np.cumsum(np.exp(p[1:]))))
    return Ordinal(w, theta)


#: What a sampled text becomes: arrays as their bytes. The last counts are those of the stems.
_KINDS = {"columns": np.uint16, "counts": np.int32, "stems": np.uint32}
_ROW = T.StructType([T.StructField(name, T.BinaryType()) for name in _KINDS])


def _features(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        rows = [(*counted(t.as_py()), stems(t.as_py())[0]) for t in batch]
        yield pa.StructArray.from_arrays([pa.array([r[i].astype(kind).tobytes() for r in rows], pa.binary()) for i, kind in enumerate(_KINDS.values())], list(_KINDS))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the model's weights and thresholds, of all rows (label, columns, counts, stems); none of no rows."""
    toxic, held, rows = [], [], []
    for batch in batches:
        toxic += [int(label) for label in batch.column(0).to_pylist()]
        for row in zip(*(batch.column(i + 1) for i in range(len(_KINDS)))):
            columns, counts, numbers = (np.frombuffer(x.as_py(), kind) for x, kind in zip(row, _KINDS.values()))
            held.append((numbers, counts[len(counts) - len(numbers) :]))
            rows.append((columns, 1 + np.log(counts.astype(float))))
    if not toxic:
        return
    y, _ = grade_of(toxic, held)
    held.clear()
    model = fit(y, rows)
    yield pa.RecordBatch.from_arrays([pa.array([x.astype(float).tobytes()], pa.binary()) for x in (model.weights, model.thresholds)], ["weights", "thresholds"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, training=None) -> Ordinal:
    """Fits the model on a bounded sample of labelled documents; without labels every text gets a severity near 0.

    Features are made in tasks, and a task fits the model on the sample's: the driver gets the model, no texts and no features.
    """
    rows = sampled(docs, labels, "toxic", sample, training).select("doc_id", "label", F.arrow_udf(_features, _ROW).asNondeterministic()("text").alias("f"))
    # As many rows as ``sample``, about, however large the tables are.
    one = rows.repartition(1).sortWithinPartitions("doc_id").select("label", *(f"f.{name}" for name in _KINDS))
    found = one.mapInArrow(_fitted, "weights:binary,thresholds:binary").collect()
    if not found:
        return Ordinal(np.zeros(BUCKETS), np.full(GRADES - 1, 10.0) + np.arange(GRADES - 1))
    return Ordinal(np.frombuffer(found[0].weights), np.frombuffer(found[0].thresholds))


_TYPE = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("toxicity", T.DoubleType()), T.StructField("grade", T.IntegerType())])


def score(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """Adds ``tox`` (severity, toxicity, grade) to every row; the model's size is fixed by its buckets.

    Null and empty texts have no words and get the model's base rate, which is grade 0; repeated rows get equal
    scores; other columns stay, but one named ``tox`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Ordinal(*shared.value)
        for batch in batches:
            above = np.array([own.above(t.as_py()) if len(t.as_py()) else np.zeros(len(own.thresholds)) for t in batch]).reshape(len(batch), len(own.thresholds))
            yield pa.StructArray.from_arrays([pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array((above >= 0.5).sum(1), pa.int32())], ["severity", "toxicity", "grade"])

    return docs.withColumn("tox", F.arrow_udf(apply, _TYPE).asNondeterministic()(raw(text)))


def drop_toxic(docs: DataFrame, model: Ordinal, threshold: float = REJECT) -> DataFrame:
    """The rows whose probability of any toxicity is under ``threshold``, with their own columns."""
    found = score(docs.select(F.struct("*").alias("row"), "text"), model)
    return found.where(F.col("tox.toxicity") < threshold).select("row.*")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Severity of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    found = score(docs, model).select("doc_id", "tox")
    return found.select("doc_id", "tox.severity", "tox.toxicity", "tox.grade", (F.col("tox.toxicity") >= REJECT).cast("int").alias("toxic"))


def evaluate(scored: pd.DataFrame) -> dict[str, float]:
    """Precision and recall of ``toxic`` against ``label``."""
    hit = ((scored.toxic == 1) & (scored.label == 1)).sum()
    return {"precision": hit / max(1, (scored.toxic == 1).sum()), "recall": hit / max(1, (scored.label == 1).sum())}
