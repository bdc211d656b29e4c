"""Quality by nearest neighbours in a latent-semantic space.

Texts become sparse vectors of stems and of token shapes (capitals, runs of marks, repeats). A truncated singular value
decomposition of a bounded labelled sample gives the latent axes; the sample's vectors are broadcast, every document's
cosines with all of them are computed in blocks, and the nearest labels vote with their similarity as weight.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curato.llm.common import raw
from curato.llm.toxicity import sampled

TERMS, SHAPES = 1 << 11, 64
#: Labelled documents that vote, at most: their vectors are all that is broadcast.
SAMPLE = 4000
AXES, NEIGHBOURS, BLOCK = 64, 25, 512
#: From which score a document counts as good.
GOOD = 0.3

_MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]{2,}|^[^0-9A-Za-z\x80-\xff]$")


def _terms(token: bytes) -> tuple[int, ...]:
    """The columns of a token: its stem, and its shapes."""
    low = token.lower()
    found = [SHAPES + zlib.crc32(low[:5]) % (TERMS - SHAPES)]
    for run in _MARKS.findall(token):
        found.append(2 + zlib.crc32(bytes(run[:1])) % (SHAPES - 6))
    if len(token) > 3 and token != low and token == token.upper():
        found.append(SHAPES - 1)
    if any(48 <= c < 58 for c in token):
        found.append(SHAPES - 2)
    if len(token) > 20:
        found.append(SHAPES - 3)
    return tuple(found)


def vector(text: bytes, seen: dict[bytes, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(columns, values) of a text, of unit length: square roots of counts, which for stems are damped by a logarithm."""
    tokens = text.split()
    counts: Counter = Counter()
    for token, n in Counter(tokens).items():
        found = seen.get(token)
        if found is None:
            if len(seen) > 300_000:
                seen.clear()
            found = seen[token] = _terms(token)
        for column in found:
            counts[column] += n
    repeats = sum(map(eq, tokens, tokens[1:]))
    lines = [line for line in text.split(b"\n") if len(line) > 20]
    again = sum(len(line.split()) * (n - 1) for line, n in Counter(lines).items() if n > 1)
    counts.update({0: repeats, 1: again})
    columns = np.fromiter(counts, np.int64, len(counts))
    values = np.fromiter(counts.values(), float, len(counts))
    values = np.sqrt(np.where(columns < SHAPES, values, np.log1p(values)))
    length = np.linalg.norm(values)
    return columns, values / length if length else values


class Voters:
    """The latent axes and the labelled vectors."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, prior: float):
        self.weights, self.axes, self.vectors, self.labels, self.prior = weights, axes, vectors, labels, prior
        self.seen: dict[bytes, tuple[int, ...]] = {}

    def project(self, texts: list[bytes]) -> np.ndarray:
        """Unit vectors in the latent space; zero for a text without terms."""
        return self.place([vector(text, self.seen) for text in texts])

    def place(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The unit vectors of (columns, values)."""
        out = np.zeros((len(rows), self.axes.shape[1]))
        for i, (columns, values) in enumerate(rows):
            if len(columns):
                out[i] = (values * self.weights[columns]) @ self.axes[columns]
        return _unit(out).astype(np.float32)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The similarity-weighted share of label 1 among each text's nearest neighbours; the prior without any."""
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        out = np.empty(len(texts))
        k = min(NEIGHBOURS, len(self.vectors))
        for at in range(0, len(texts), BLOCK):
            cosines = self.project(texts[at : at + BLOCK]) @ self.vectors.T
            best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            near = np.clip(np.take_along_axis(cosines, best, 1), 0, None).astype(float) ** 4
            total = near.sum(1)
            share = (near * self.labels[best]).sum(1) / np.where(total > 0, total, 1)
            out[at : at + BLOCK] = np.clip(np.where(total > 0, share, self.prior), 0, 1)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], axes: int = AXES) -> Voters:
    """The latent space of a bounded sample's (columns, values): the Gram matrix of its terms has a fixed size."""
    if not rows:
        return Voters(np.ones(TERMS), np.zeros((TERMS, axes)), np.zeros((0, axes), np.float32), np.zeros(0), 0.5)
    spread = np.bincount(np.concatenate([c for c, _ in rows]), minlength=TERMS)
    weights = np.log((1 + len(rows)) / (1 + spread)) + 0.3
    dense = np.zeros((len(rows), TERMS), np.float32)
    for i, (columns, values) in enumerate(rows):
        dense[i, columns] = values * weights[columns]
    dense = _unit(dense)
    _, vectors = np.linalg.eigh(dense.T @ dense)
    found = vectors[:, ::-1][:, :axes].astype(float)
    made = Voters(weights, found, np.zeros((0, axes), np.float32), np.array(labels, float), float(np.mean(labels)))
    made.vectors = made.place(rows)
    return made


#: What a sampled text becomes: arrays as their bytes, so that the driver holds no number as an object.
_ROW = T.StructType([T.StructField("columns", T.BinaryType()), T.StructField("values", T.BinaryType())])


def _vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    seen: dict[bytes, tuple[int, ...]] = {}
    for batch in texts:
        rows = [vector(t.as_py(), seen) for t in batch]
        yield pa.StructArray.from_arrays([pa.array([c.astype(np.int32).tobytes() for c, _ in rows], pa.binary()), pa.array([v.astype(np.float64).tobytes() for _, v in rows], pa.binary())], ["columns", "values"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, training=None) -> Voters:
    """Fits on a bounded sample of labelled rows, drawn by a hash of the id; equal inputs give equal voters.

    The driver gets as many numbers of a row as there are terms, at most, and no texts.
    """
    rows = sampled(docs, labels, "quality", sample, training).select("doc_id", "label", F.arrow_udf(_vectors, _ROW).asNondeterministic()("text").alias("f")).orderBy("doc_id").select("label", "f.*").collect()
    return fit([(np.frombuffer(r.columns, np.int32).astype(np.int64), np.frombuffer(r["values"], float)) for r in rows], [int(r.label) for r in rows])


def score(docs: DataFrame, voters: Voters, text: str = "text") -> DataFrame:
    """Adds ``quality_score`` to every row, 0 to 1: higher means that label 1 is likelier.

    Null and empty texts have no terms and get the labels' mean; repeated rows get equal scores; other columns stay,
    but one named ``quality_score`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((voters.weights, voters.axes, voters.vectors, voters.labels, voters.prior))

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Voters(*shared.value)
        for batch in batches:
            out = [own.score([t.as_py() for t in batch.slice(at, BLOCK)]) for at in range(0, len(batch), BLOCK)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("quality_score", F.arrow_udf(apply, T.DoubleType()).asNondeterministic()(raw(text)))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labelled rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    voters = train(docs, labels, training=~held_out)
    found = score(docs, voters).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
