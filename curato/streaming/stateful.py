"""Streams that keep state of their own: lines of chunked output, exact throttling, and a sink that moves runs on."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from curato.functions.columns import decode_line
from curato.operators.graph import shared_dir

#: The state store that keeps single values by name.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"

_ENDS = re.compile(rb"\r\n|\r|\n")


def cut_lines(pending: bytes, after_cr: bool, chunk: bytes) -> tuple[list[bytes], bytes, bool]:
    """(finished lines, what is left, whether it ended with a carriage return) of what was left before and a chunk.

    Lines end with CR, LF or both; a chunk may end between the two.
    """
    if not chunk:
        return [], pending, after_cr
    if after_cr and chunk[:1] == b"\n":
        chunk = chunk[1:]
        if not chunk:
            return [], pending, False
    # The part before the chunk holds no end.
    *lines, left = _ENDS.split(chunk)
    if not lines:
        return [], pending + left, False
    return [pending + lines[0], *lines[1:]], left, chunk.endswith(b"\r")


def _pack(early: dict[int, tuple[bytes, bool]]) -> bytes:
    return b"".join(struct.pack("<q?q", seq, last, len(data)) + data for seq, (data, last) in sorted(early.items()))


def _unpack(packed: bytes) -> dict[int, tuple[bytes, bool]]:
    found, at, head = {}, 0, struct.calcsize("<q?q")
    while at < len(packed):
        seq, last, size = struct.unpack_from("<q?q", packed, at)
        found[seq] = packed[at + head : at + head + size], last
        at += head + size
    return found


class _Lines(StatefulProcessor):
    """Lines of a channel: a row of all that a batch ends, with the number of the first."""

    def __init__(self, keys: Sequence[str]):
        self.row = Row(*keys, "number", "lines")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.channel = handle.getValueState("channel", "turn long, number long, pending binary, after_cr boolean, early binary, done boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        turn, number, pending, after_cr, packed, done = self.channel.get() or (0, 0, b"", False, b"", False)
        early = _unpack(bytes(packed))
        for row in rows:
            if row["seq"] >= turn:
                early.setdefault(row["seq"], (bytes(row["data"]) if row["data"] is not None else b"", row["last"]))
        pending, out = bytes(pending), []
        while turn in early and not done:
            data, done = early.pop(turn)
            lines, pending, after_cr = cut_lines(pending, after_cr, data)
            out += lines
            turn += 1
        if done and pending:
            out.append(pending)
            pending = b""
        self.channel.update((turn, number + len(out), pending, after_cr, b"" if done else _pack(early), done))
        if out:
            yield self.row(*key, number, out)

    def close(self) -> None:
        pass


def lines_of(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line_no, line) of a stream of chunks (keys, seq, data, last), as soon as a line has ended.

    ``seq`` counts a channel's chunks from 0, ``last`` ends it and with it a line without an end. Chunks that come before
    their turn wait in the state; those that come again are left out. A line is UTF-8 with marks for what isn't; lines of
    no characters are lines too. A null ``data`` is an empty chunk. A channel is handed over as rows, not as a table of
    its own, and its lines are made rows by Spark: most channels are small.
    """
    found = chunks.select(*keys, F.col("seq").cast("long").alias("seq"), "data", F.coalesce("last", F.lit(False)).alias("last"))
    result = T.StructType([*(found.schema[k] for k in keys), T.StructField("number", T.LongType()), T.StructField("lines", T.ArrayType(T.BinaryType()))])
    found = found.groupBy(*keys).transformWithState(statefulProcessor=_Lines(keys), outputStructType=result, outputMode="Append", timeMode="None")
    found = found.select(*keys, "number", F.posexplode("lines").alias("at", "raw"))
    return found.select(*keys, (F.col("number") + F.col("at")).alias("line_no"), decode_line(F.col("raw")).alias("line"))


class _Throttle(StatefulProcessor):
    def __init__(self, key: str, interval: float):
        self.key, self.interval = key, interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.DoubleType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        taken = []
        for at in sorted(at for frame in rows for at in frame["at"]):
            if last is None or at - last >= self.interval:
                taken.append(at)
                last = at
        if taken:
            self.last.update((last,))
            yield pd.DataFrame({self.key: [key[0]] * len(taken), "at": taken})

    def close(self) -> None:
        pass


def throttled(samples: DataFrame, key: str, seconds: str, interval: float) -> DataFrame:
    """(key, at) of a stream: the samples taken when one is due again, an interval after the last taken one of the key.

    That one is the state, so that batches and restarts change nothing, as long as a key's samples come in order over
    batches; one that is older than the last taken one is never due. Nulls are left out.
    """
    rows = samples.select(key, F.col(seconds).cast("double").alias("at")).where(F.col(key).isNotNull() & F.col("at").isNotNull())
    result = T.StructType([rows.schema[key], T.StructField("at", T.DoubleType())])
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_Throttle(key, interval), outputStructType=result, outputMode="Append", timeMode="None")


def start_append(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream over all that is there, which appends its rows to a Parquet table; the checkpoint goes on where it ended."""
    spark = result.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, STATE_STORE)
    try:
        return result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_dir(spark)}/curato/{uuid.uuid4().hex}"


def drained(result: DataFrame) -> DataFrame:
    """Runs a stream that appends over all that is there and returns its rows as a table."""
    folder = fresh_folder(result.sparkSession)
    query = start_append(result, f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/out")


class RunSink:
    """A sink of events (run_id, event_id, stage, and more) that keeps every event and each run's current stage.

    A batch is a partition of the events' table and a snapshot of the runs, both written anew when a batch is repeated:
    nothing is there twice. The snapshot follows from the one before it, so that a repeated batch gives what it gave.
    """

    def __init__(self, spark: SparkSession, folder: str, runs: DataFrame):
        self.spark, self.folder, self.runs = spark, folder, runs

    def _path(self, batch: int) -> str:
        return f"{self.folder}/runs/batch={batch}"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _before(self, batch: int) -> DataFrame:
        """The runs before a batch; at first those which were given."""
        if batch and self._exists(self._path(batch - 1)):
            return self.spark.read.parquet(self._path(batch - 1))
        return self.runs.select("run_id", F.col("current_stage"), F.lit(None).cast("long").alias("event_id"))

    def write(self, batch: DataFrame, number: int) -> None:
        """Takes a batch: its events replace those it had, and runs that are known move to the stage of their last event with one."""
        batch.write.mode("overwrite").parquet(f"{self.folder}/events/batch={number}")
        events = self.spark.read.schema(batch.schema).parquet(f"{self.folder}/events/batch={number}")
        staged = events.where("stage is not null and stage != ''")
        last = staged.groupBy("run_id").agg(F.max_by("stage", "event_id").alias("stage"), F.max("event_id").alias("last"))
        moved = self._before(number).join(last, "run_id", "left")
        newer = F.col("last").isNotNull() & (F.col("event_id").isNull() | (F.col("last") > F.col("event_id")))
        moved = moved.select("run_id", F.when(newer, F.col("stage")).otherwise(F.col("current_stage")).alias("current_stage"), F.when(newer, F.col("last")).otherwise(F.col("event_id")).alias("event_id"))
        moved.write.mode("overwrite").parquet(self._path(number))
        self._drop(number - 2)

    def _drop(self, batch: int) -> None:
        """A repeated batch needs the snapshot before it and no older one."""
        if batch >= 0:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(batch))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def start(self, events: DataFrame) -> StreamingQuery:
        """Starts the stream into the sink."""
        return events.writeStream.foreachBatch(self.write).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()

    def events(self) -> DataFrame:
        """All events so far, with the batch of each."""
        return self.spark.read.parquet(f"{self.folder}/events")

    def current(self) -> DataFrame:
        """(run_id, current_stage) after the last batch."""
        rows = self.spark.read.parquet(f"{self.folder}/runs")
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == last).select("run_id", "current_stage")
