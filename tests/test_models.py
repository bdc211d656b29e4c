import hashlib
import sys
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from curato.operators import models

# Workers don't know this module: its models travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
RNG = np.random.default_rng(9)
SCHEMA = "id string, width int, height int, channels int, data binary, orientation int, extra string"


def _table(spark, pictures):
    rows = [(f"p{i}", p.shape[1], p.shape[0], p.shape[2], bytearray(p.tobytes()), 1, "clash") for i, p in enumerate(pictures)]
    return spark.createDataFrame([*rows, ("none", None, None, None, None, None, "x")], SCHEMA).repartition(3)


@dataclass(frozen=True)
class Greedy:
    """Runs out of memory beyond a number of pictures."""

    most: int
    message: str = "CUDA out of memory"
    model_id: str = "test/greedy"
    revision: str = "1"

    def vocabulary(self):
        return [("mean", "general"), ("rated", "rating"), ("who", "character")]

    def load(self):
        def run(pictures):
            if len(pictures) > self.most:
                raise RuntimeError(self.message)
            return np.array([[p.mean() / 255, 2.0, -1.0] for p in pictures])

        return run


@dataclass(frozen=True)
class Misaligned(Greedy):
    def load(self):
        return lambda pictures: np.zeros((max(1, len(pictures) - 1), 3)) if len(pictures) > 1 else np.zeros((1, 2))


def test_no_row_is_left_out_when_memory_runs_out(spark):
    pictures = [RNG.integers(0, 256, (3 + i % 4, 5, 3), np.uint8) for i in range(41)]
    for most in (1, 3, 100):
        found = models.tag_pictures(_table(spark, pictures), "id", Greedy(most)).collect()
        mean = {r.id: r.score for r in found if r.tag == "mean"}
        assert mean == pytest.approx({f"p{i}": p.mean() / 255 for i, p in enumerate(pictures)})
        assert len(found) == 3 * 41 + 1 and [r.id for r in found if r.error] == ["none"]
        assert {(r.tag, r.score, r.selected) for r in found if r.tag in ("rated", "who")} == {("rated", 1.0, True), ("who", 0.0, False)}


def test_batches_are_halved_and_remembered():
    seen, sizes = [], {}

    def run(items):
        seen.append(len(items))
        if len(items) > 3:
            raise MemoryError
        return np.array([[i] for i in items])

    assert [int(x[0]) for x in models.run_in_batches(run, range(10), 1, 16, sizes, "k")] == list(range(10))
    assert seen == [10, 5, 2, 2, 2, 2, 2] and sizes == {"k": 2}
    seen.clear()
    list(models.run_in_batches(run, range(5), 1, 16, sizes, "k"))
    assert seen == [2, 2, 1]
    assert list(models.run_in_batches(run, [], 1)) == []


def test_other_errors_are_errors(spark):
    pictures = [np.zeros((2, 2, 3), np.uint8)] * 3
    with pytest.raises(Exception, match="broken"):
        models.tag_pictures(_table(spark, pictures), "id", Greedy(0, "broken")).collect()
    with pytest.raises(Exception, match="out of memory"):
        models.tag_pictures(_table(spark, pictures), "id", Greedy(0)).collect()
    with pytest.raises(Exception, match="pictures of 3 numbers"):
        models.tag_pictures(_table(spark, pictures), "id", Misaligned(9)).collect()
    with pytest.raises(TypeError, match="tagger"):
        models.tag_pictures(_table(spark, pictures), "id", models.TinyEmbedder())
    with pytest.raises(TypeError, match="embedder"):
        models.embed_pictures(_table(spark, pictures), "id", Greedy(1))
    with pytest.raises(ValueError, match="finite"):
        list(models.run_in_batches(lambda items: np.array([[np.nan]]), [1], 1))


def test_a_model_is_loaded_once_by_a_worker():
    loads = []

    @dataclass(frozen=True)
    class Counted(Greedy):
        def load(self):
            loads.append(1)
            return super().load()

    one, again, other = Counted(5, revision="7"), Counted(5, revision="7"), Counted(5, revision="8")
    assert models.loaded(one) is models.loaded(again) and models.loaded(other) is not models.loaded(one)
    assert len(loads) == 2


def test_embeddings_by_the_other_protocol(spark):
    pictures = [RNG.integers(0, 256, (8, 8, 3), np.uint8) for _ in range(9)]
    found = {r.id: r for r in models.embed_pictures(_table(spark, pictures), "id", models.TinyEmbedder()).collect()}
    assert len(found) == 10 and found["none"].vector is None and found["none"].error == "no_pixels"
    for i, p in enumerate(pictures):
        want = p.reshape(-1) / 255 - p.mean() / 255
        assert np.abs(np.array(found[f"p{i}"].vector) - want / np.linalg.norm(want)).max() < 1e-12


def _field(number, value):
    """One field of a protocol buffer: a number, or bytes with their length."""

    def varint(n):
        out = bytearray()
        while True:
            out.append(n & 127 | (128 if n > 127 else 0))
            n >>= 7
            if not n:
                return bytes(out)

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def _mean_model(shape, axes):
    """A model file: the mean of each channel over 255."""
    dims = b"".join(_field(1, _field(2, d) if isinstance(d, str) else _field(1, d)) for d in shape)
    tensor = lambda name, dims: _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, dims)))
    node = lambda op, ins, out, extra=b"": _field(1, b"".join(_field(1, i) for i in ins) + _field(2, out) + _field(4, op) + extra)
    ints = _field(5, _field(1, "axes") + b"".join(_field(8, a) for a in axes) + _field(20, 7))
    keep = _field(5, _field(1, "keepdims") + _field(3, 0) + _field(20, 2))
    constant = _field(5, _field(1, 1) + _field(2, 1) + _field(4, np.float32(255).tobytes()) + _field(8, "full"))
    out_dims = _field(1, _field(2, "n")) + _field(1, _field(1, 3))
    graph = node("ReduceMean", ["in"], "m", ints + keep) + node("Div", ["m", "full"], "out") + _field(2, "g") + constant + _field(11, tensor("in", dims)) + _field(12, tensor("out", out_dims))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, "") + _field(2, 13))


@pytest.mark.parametrize("shape,axes", [(("n", 6, 6, 3), (1, 2)), (("n", 3, 6, 6), (2, 3)), (("n", "h", "w", 3), (1, 2))])
def test_a_model_file_runs_through_the_same_protocol(spark, tmp_path, shape, axes):
    pytest.importorskip("onnxruntime")
    path = tmp_path / "model.onnx"
    path.write_bytes(_mean_model(shape, axes))
    tags = (("blue", "general"), ("green", "general"), ("red", "character"))
    model = models.OnnxTagger(str(path), tags, "test/mean", "1", hashlib.sha256(path.read_bytes()).hexdigest(), side=6)
    pictures = [np.full((12, 12, 3), (250, 100, 5), np.uint8), np.full((4, 8, 3), (0, 0, 0), np.uint8), np.concatenate((np.full((8, 8, 3), 90, np.uint8), np.zeros((8, 8, 1), np.uint8)), axis=2)]
    found = {(r.id, r.tag): (round(r.score, 3), r.selected) for r in models.tag_pictures(_table(spark, pictures), "id", model).collect() if r.tag}
    assert found["p0", "red"] == (0.98, True) and found["p0", "green"] == (0.392, True) and found["p0", "blue"] == (0.02, False)
    # Half of the square is white, about; a transparent picture lies on white.
    assert found["p1", "red"][0] == pytest.approx(0.5, abs=0.02) and found["p2", "blue"] == (1.0, True)
    with pytest.raises(ValueError, match="another file"):
        models.OnnxTagger(str(path), tags, "test/mean", "1", "0" * 64).load()
    with pytest.raises(ValueError, match="revision"):
        models.OnnxTagger(str(path), tags, "test/mean", " ")


def test_two_taggers_run_alike(spark):
    pictures = [RNG.integers(0, 256, (6, 7, 3), np.uint8) for _ in range(5)]
    table = _table(spark, pictures).where(F.col("data").isNotNull())
    both = models.tag_pictures(table, "id", models.ColourTagger()).unionByName(models.tag_pictures(table, "id", Greedy(2)))
    assert {(r.model_id, r.n) for r in both.groupBy("model_id").agg(F.countDistinct("id").alias("n")).collect()} == {("curato/colour", 5), ("test/greedy", 5)}
