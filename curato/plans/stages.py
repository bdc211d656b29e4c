"""A pipeline of stages whose results are kept by fingerprint, with barriers and resumption."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from curato.operators.graph import shared_dir


def fingerprint(*parts: object) -> str:
    """SHA-256 of the parts as canonical JSON."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


@dataclass(frozen=True)
class Stage:
    """A step from named inputs to a table; ``config`` and ``version`` count for its fingerprint."""

    name: str
    run: Callable[..., DataFrame]
    inputs: Sequence[str] = ()
    config: Mapping[str, object] = field(default_factory=dict)
    version: int = 1


class Pipeline:
    """Runs stages in order; a stage whose fingerprint has a finished table is read instead of run."""

    def __init__(self, spark: SparkSession, stages: Sequence[Stage], folder: str | None = None):
        self.spark, self.stages = spark, stages
        self.folder = folder or f"{shared_dir(spark)}/curato-stages"
        self.log: list[tuple[str, str]] = []

    def _done(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def run(self, sources: Mapping[str, DataFrame], source_ids: Mapping[str, str], until: str | None = None) -> dict[str, DataFrame]:
        """All tables by name, up to and with ``until``: a barrier at which a person may look at them."""
        tables, marks = dict(sources), dict(source_ids)
        for stage in self.stages:
            mark = fingerprint(stage.name, stage.version, dict(stage.config), [marks[i] for i in stage.inputs])
            path = f"{self.folder}/{stage.name}/{mark}"
            cached = self._done(path)
            if not cached:
                stage.run(*(tables[i] for i in stage.inputs), **stage.config).write.mode("overwrite").parquet(path)
            self.log.append((stage.name, "cached" if cached else "run"))
            tables[stage.name], marks[stage.name] = self.spark.read.parquet(path), mark
            if stage.name == until:
                break
        return tables
