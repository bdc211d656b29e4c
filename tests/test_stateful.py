import random
import re

import pytest
from pyspark.sql import functions as F

from curato.operators import logs, state
from curato.streaming import stateful


def _run(query):
    query.awaitTermination()
    assert query.exception() is None


def whole_lines(data):
    """All lines of bytes at once."""
    lines = re.split(rb"\r\n|\r|\n", data)
    return lines if lines[-1] else lines[:-1]


def test_lines_cut_anywhere_are_those_of_the_whole():
    rng = random.Random(3)
    for _ in range(3000):
        data = b"".join(rng.choice([b"a", b"bc", b"\r", b"\n", b"\r\n", b"\xc3\xa9", b""]) for _ in range(rng.randrange(12)))
        out, pending, after_cr, at = [], b"", False, 0
        while at < len(data):
            size = rng.randrange(4)
            lines, pending, after_cr = stateful.cut_lines(pending, after_cr, data[at : at + size])
            out += lines
            at += size
        assert out + ([pending] if pending else []) == whole_lines(data)


def test_a_stream_of_chunks_gives_lines(spark, tmp_path):
    rng = random.Random(4)
    text = {
        ("r1", "out"): "epoch 1 step 3/9 loss=0.5\rstep 4/9\r\nüber\n\n\nend without a mark".encode(),
        ("r1", "err"): b"\r\n\r\n\xffodd bytes\r",
        ("r2", "out"): b"".join(b"line %d%s" % (i, rng.choice([b"\r", b"\n", b"\r\n"])) for i in range(50)),
        ("r3", "out"): b"",
    }
    rows = []
    for (run, channel), data in text.items():
        cuts = [0, *sorted(rng.sample(range(len(data)), min(len(data), 9)) if data else []), len(data)]
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        rows += [(run, channel, i, bytearray(p) if p else None, i == len(parts) - 1, "more") for i, p in enumerate(parts)]
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "run_id string, channel string, seq int, data binary, last boolean, extra string"
    rng.shuffle(rows)
    for i in range(3):
        # Chunks come in any order, and some of them twice.
        part = rows[i::3] + (rows[:4] if i == 2 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        chunks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        # Each round is a restart from the checkpoint.
        _run(stateful.start_append(stateful.lines_of(chunks, ["run_id", "channel"]), out, check))
    found = spark.read.parquet(out).orderBy("run_id", "channel", "line_no").collect()
    got = {}
    for r in found:
        got.setdefault((r.run_id, r.channel), []).append((r.line_no, r.line))
    want = {k: [(i, x.decode("utf-8", "replace")) for i, x in enumerate(whole_lines(d))] for k, d in text.items() if d}
    assert got == want
    parsed = logs.parse_progress(spark.read.parquet(out), "line", 9).orderBy("line_no").collect()
    assert [(r.epoch, r.step, r.train_loss) for r in parsed] == [(1, 3, 0.5), (0, 4, None)]


def test_throttling_equals_the_batch_operator_across_restarts(spark, tmp_path):
    rng = random.Random(5)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "state"))
    now, everything = 0.0, []
    for _ in range(4):
        rows = []
        for _ in range(60):
            now += rng.choice([0.0, 0.5, 1.0, 4.0])
            rows.append((rng.choice(["a", "b", "c", None]), now))
        rows.append(("a", None))
        everything += rows
        spark.createDataFrame(rows, "k string, t double").repartition(3).write.mode("append").parquet(source)
        stream = spark.readStream.schema("k string, t double").parquet(source)
        _run(stateful.start_append(stateful.throttled(stream, "k", "t", 5.0), out, check))
    want = state.throttled(spark.createDataFrame(everything, "k string, t double"), "k", F.col("t"), 5.0)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture
def sink(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "CREATED"), ("r2", None), ("r3", "CREATED")], "run_id string, current_stage string")
    return stateful.RunSink(spark, str(tmp_path / "sink"), runs)


EVENTS = "run_id string, event_id long, event_type string, stage string, message string"


def test_a_repeated_batch_changes_nothing(spark, sink):
    batches = [
        [("r1", 1, "stage_started", "IMPORTING", "a"), ("r1", 2, "progress", None, "b"), ("gone", 3, "stage_started", "TAGGING", "c")],
        [("r1", 5, "stage_started", "TAGGING", "d"), ("r1", 4, "stage_started", "NORMALIZING", "e"), ("r2", 6, "note", "", "f")],
        [("r2", 7, "stage_started", "IMPORTING", "g"), ("r1", 7, "note", "", "h")],
    ]
    frames = [spark.createDataFrame(b, EVENTS) for b in batches]
    want = [{"r1": "IMPORTING", "r2": None, "r3": "CREATED"}, {"r1": "TAGGING", "r2": None, "r3": "CREATED"}, {"r1": "TAGGING", "r2": "IMPORTING", "r3": "CREATED"}]
    for number, frame in enumerate(frames):
        for _ in range(2):
            sink.write(frame, number)
            assert {r.run_id: r.current_stage for r in sink.current().collect()} == want[number]
            assert sink.events().count() == sum(len(b) for b in batches[: number + 1])


def test_the_sink_of_a_stream(spark, sink, tmp_path):
    source = str(tmp_path / "in")
    rows = [("r1", i, "stage_started", f"S{i}", "x") for i in range(5)] + [("r2", 9, "progress", None, "y")]
    for i in range(3):
        spark.createDataFrame(rows[i::3], EVENTS).coalesce(1).write.mode("append").parquet(source)
        _run(sink.start(spark.readStream.schema(EVENTS).parquet(source)))
    assert sorted(r.event_id for r in sink.events().collect()) == [0, 1, 2, 3, 4, 9]
    assert {r.run_id: r.current_stage for r in sink.current().collect()} == {"r1": "S4", "r2": None, "r3": "CREATED"}


def test_lines_are_handed_over_by_channel(spark, tmp_path):
    schema, source, out, check = "k long, seq int, data binary, last boolean", *(str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([(k, 0, bytearray(b"a\nb\r\nc" if k else b""), True) for k in range(3)], schema).write.parquet(source)
    query = stateful.start_append(stateful.lines_of(spark.readStream.schema(schema).parquet(source), ["k"]), out, check)
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(k, i, x) for k in (1, 2) for i, x in enumerate("abc")]
    # A row holds all lines of a channel, and they are made rows by Spark; no table is made for each channel.
    plan = query._jsq.explainInternal(False)
    assert "Generate posexplode" in plan and "InPandasWithState" not in plan
