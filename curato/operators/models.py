"""Models as table functions over pictures: taggers and embedders behind one protocol each.

A model is a small description that tasks carry; each worker loads it once. Pictures go to it in batches, which are
halved when memory runs out and go on from there in the same task. What comes back has to fit what was asked, picture
by picture, or the task fails.
"""

from __future__ import annotations

import hashlib
import os
import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

from curato.functions import pixels

# Pictures of a first batch, scores over which tags of a category are selected, and how errors tell that memory ran out.
FIRST_BATCH = 8
THRESHOLDS = {"general": 0.35, "character": 0.85, "rating": 0.0}
NO_MEMORY = ("out of memory", "cuda_error_out_of_memory", "cuda failure 2", "failed to allocate memory")

#: Takes upright pictures (height, width, channels) and returns an array with a row for each.
Runner = Callable[[Sequence[np.ndarray]], np.ndarray]


@runtime_checkable
class Tagger(Protocol):
    """Scores every tag of its vocabulary, (tag, category) each, for every picture."""

    model_id: str
    revision: str

    def vocabulary(self) -> Sequence[tuple[str, str]]: ...

    def load(self) -> Runner: ...


@runtime_checkable
class Embedder(Protocol):
    """Gives a vector of ``dimension`` numbers for every picture."""

    model_id: str
    revision: str
    dimension: int

    def load(self) -> Runner: ...


def _kept(name: str) -> dict:
    """A dictionary that a worker keeps between tasks."""
    return sys.modules[__name__].__dict__.setdefault(f"_kept_{name}", {})


def loaded(model: Any) -> Runner:
    """The model's runner, which a worker loads once for each model and revision."""
    runners, key = _kept("runners"), (type(model).__name__, repr(model))
    if key not in runners:
        runners[key] = model.load()
    return runners[key]


def ran_out_of_memory(error: Exception) -> bool:
    """Whether an error tells that a smaller batch may do."""
    return isinstance(error, MemoryError) or any(sign in str(error).casefold() for sign in NO_MEMORY)


def run_in_batches(run: Runner, items: Sequence, width: int, first: int = FIRST_BATCH, sizes: dict | None = None, key: object = None) -> Iterator[np.ndarray]:
    """Yields a row of ``width`` numbers for each item. A batch that runs out of memory is tried again at half its size.

    ``sizes`` remembers under ``key`` the size that did, with which the next call begins. One item that runs out of memory, and
    any other error, is an error; so are results that aren't a row for each item.
    """
    sizes = {} if sizes is None else sizes
    at, size = 0, min(len(items), sizes.get(key, first))
    while at < len(items):
        batch = items[at : at + size]
        try:
            found = np.asarray(run(batch), np.float64)
        except Exception as error:
            if size <= 1 or not ran_out_of_memory(error):
                raise
            size //= 2
            continue
        if found.ndim == 1 and len(batch) == 1:
            found = found[None, :]
        if found.shape != (len(batch), width):
            raise ValueError(f"the model gave {found.shape} for {len(batch)} pictures of {width} numbers each")
        if not np.isfinite(found).all():
            raise ValueError("the model gave numbers that aren't finite")
        yield from found
        at += len(batch)
        sizes[key] = size


_COLUMNS = ("width", "height", "channels", "data", "orientation")


def _over_pictures(pictures: DataFrame, key: str, model: Any, width: int, first: int, result: pa.Schema, rows_of: Callable[[Any, np.ndarray | None], pa.RecordBatch]) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, sizes, name = loaded(model), _kept("sizes"), (type(model).__name__, repr(model))
        for batch in batches:
            keys = batch.column(key).to_pylist()
            own, places = [], []
            for place, (w, h, c, d, o) in enumerate(zip(*(batch.column(n).to_pylist() for n in _COLUMNS))):
                if d is not None and w and h and c:
                    own.append(pixels.upright(np.frombuffer(d, np.uint8).reshape(h, w, c), o or 1))
                    places.append(place)
                else:
                    yield rows_of(keys[place], None)
            for place, found in zip(places, run_in_batches(run, own, width, first, sizes, name), strict=True):
                yield rows_of(keys[place], found)

    return pictures.select(key, *_COLUMNS).mapInArrow(apply, from_arrow_schema(result))


def _key_type(pictures: DataFrame, key: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(dict(pictures.dtypes)[key], pa.string())


def tag_pictures(pictures: DataFrame, key: str, model: Tagger, thresholds: Mapping[str, float] = THRESHOLDS, first: int = FIRST_BATCH) -> DataFrame:
    """(key, model_id, revision, place, tag, score, model_category, selected, error): a row for each picture and tag.

    ``pictures`` has width, height, channels, data and orientation (see ``read_pictures``); one without data has a single
    row, with the error no_pixels. Scores are clipped to 0..1; a tag is selected if its score is over its category's threshold.
    """
    if not isinstance(model, Tagger):
        raise TypeError("not a tagger")
    words = list(model.vocabulary())
    if not words or len({w for w, _ in words}) != len(words) or not all(w for w, _ in words):
        raise ValueError("a vocabulary has tags, none of them empty or twice")
    limits = np.array([thresholds.get(category, thresholds["general"]) for _, category in words])
    kind = _key_type(pictures, key)
    result = pa.schema(
        [(key, kind), ("model_id", pa.string()), ("revision", pa.string()), ("place", pa.int32()), ("tag", pa.string()), ("score", pa.float64()), ("model_category", pa.string()), ("selected", pa.bool_()), ("error", pa.string())]
    )
    names, categories = pa.array([w for w, _ in words]), pa.array([c for _, c in words])
    model_id, revision = model.model_id, model.revision

    def rows(of: Any, scores: np.ndarray | None) -> pa.RecordBatch:
        if scores is None:
            return pa.RecordBatch.from_pylist([{key: of, "model_id": model_id, "revision": revision, "error": "no_pixels"}], result)
        n, scores = len(words), np.clip(scores, 0, 1)
        same = lambda value, kind: pa.array([value] * n, kind)
        columns = [same(of, kind), same(model_id, pa.string()), same(revision, pa.string()), pa.array(np.arange(n, dtype=np.int32)), names, pa.array(scores), categories, pa.array(scores > limits), same(None, pa.string())]
        return pa.record_batch(columns, schema=result)

    return _over_pictures(pictures, key, model, len(words), first, result, rows)


def embed_pictures(pictures: DataFrame, key: str, model: Embedder, first: int = FIRST_BATCH) -> DataFrame:
    """(key, model_id, revision, dimension, vector, error): a row for each picture; one without data has the error no_pixels."""
    if not isinstance(model, Embedder):
        raise TypeError("not an embedder")
    result = pa.schema([(key, _key_type(pictures, key)), ("model_id", pa.string()), ("revision", pa.string()), ("dimension", pa.int32()), ("vector", pa.list_(pa.float64())), ("error", pa.string())])
    model_id, revision, dimension = model.model_id, model.revision, model.dimension

    def rows(of: Any, found: np.ndarray | None) -> pa.RecordBatch:
        row = {key: of, "model_id": model_id, "revision": revision, "dimension": dimension, "vector": None if found is None else found.tolist(), "error": "no_pixels" if found is None else None}
        return pa.RecordBatch.from_pylist([row], result)

    return _over_pictures(pictures, key, model, dimension, first, result, rows)


def square(picture: np.ndarray, side: int, blue_first: bool = True) -> np.ndarray:
    """A picture in the middle of a white square, resized to ``side``, as floats of 0 to 255."""
    colours = pixels.over_background(picture, (255, 255, 255))
    height, width = colours.shape[:2]
    most = max(height, width)
    padded = np.full((most, most, 3), 255, np.uint8)
    top, left = (most - height) // 2, (most - width) // 2
    padded[top : top + height, left : left + width] = colours
    made = pixels.resize(padded, side, side, "lanczos").astype(np.float32)
    return made[:, :, ::-1] if blue_first else made


@dataclass(frozen=True)
class ColourTagger:
    """Tags by the means of the channels and of the brightness: a model that needs no weights."""

    model_id: str = "curato/colour"
    revision: str = "1"

    def vocabulary(self) -> Sequence[tuple[str, str]]:
        return [("red", "general"), ("green", "general"), ("blue", "general"), ("bright", "rating"), ("contrast", "character")]

    def load(self) -> Runner:
        def run(pictures: Sequence[np.ndarray]) -> np.ndarray:
            out = []
            for picture in pictures:
                light = pixels.brightness(pixels.rgb_of(picture)) / 255
                out.append([*(pixels.rgb_of(picture).mean(axis=(0, 1)) / 255), light.mean(), light.max() - light.min()])
            return np.array(out)

        return run


@dataclass(frozen=True)
class TinyEmbedder:
    """The stand-in embedding of 8 by 8 pixels."""

    model_id: str = "curato/tiny"
    revision: str = "1"
    dimension: int = 192

    def load(self) -> Runner:
        return lambda pictures: pixels.tiny_embeddings(np.stack([pixels.resize(pixels.rgb_of(p), 8, 8) for p in pictures]))


@dataclass(frozen=True)
class OnnxTagger:
    """A model file with a picture input of (batch, side, side, 3) or (batch, 3, side, side) and a score for each tag.

    ``path`` is a file that all workers have, ``sha256`` what it has to be; ``side`` counts where the file leaves it open.
    """

    path: str
    tags: tuple[tuple[str, str], ...]
    model_id: str
    revision: str
    sha256: str | None = None
    side: int = 448
    blue_first: bool = True
    providers: tuple[str, ...] = field(default=("CUDAExecutionProvider", "CPUExecutionProvider"))

    def __post_init__(self) -> None:
        if not self.revision.strip():
            raise ValueError("a model needs a fixed revision")

    def vocabulary(self) -> Sequence[tuple[str, str]]:
        return self.tags

    def load(self) -> Runner:
        import onnxruntime

        with open(self.path, "rb") as file:
            content = file.read()
        if self.sha256 and hashlib.sha256(content).hexdigest() != self.sha256:
            raise ValueError(f"another file than the one meant: {os.path.basename(self.path)}")
        wanted = [p for p in self.providers if p in onnxruntime.get_available_providers()]
        if not wanted:
            raise RuntimeError(f"none of {self.providers} is there")
        session = onnxruntime.InferenceSession(content, providers=wanted)
        asked = session.get_inputs()[0]
        channels_first = len(asked.shape) == 4 and asked.shape[1] == 3 and asked.shape[3] != 3
        sides = asked.shape[2:] if channels_first else asked.shape[1:3]
        sides = [s if isinstance(s, int) else self.side for s in sides] if len(asked.shape) == 4 else [self.side] * 2
        if sides[0] != sides[1]:
            raise RuntimeError(f"the model takes {sides[0]} by {sides[1]}, which is no square")

        def run(pictures: Sequence[np.ndarray]) -> np.ndarray:
            batch = np.stack([square(p, sides[0], self.blue_first) for p in pictures])
            batch = np.ascontiguousarray(batch.transpose(0, 3, 1, 2) if channels_first else batch)
            return session.run(None, {asked.name: batch})[0]

        return run
