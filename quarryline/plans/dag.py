"""A stage graph with fingerprints: a stage runs again only if its inputs, code or settings have changed."""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """run(spark, inputs) gives the stage's table from the tables of those it depends on."""

    name: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    after: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


class Runner:
    """Stages write Parquet under root, with their fingerprint beside them; all through Spark, so root may be in any store."""

    def __init__(self, spark: SparkSession, root: str, stages: list[Stage]):
        self.spark, self.root, self.stages = spark, root.rstrip("/"), {s.name: s for s in stages}
        if len(self.stages) < len(stages):
            raise ValueError("stage names repeat")
        if missing := {d for s in stages for d in s.after} - set(self.stages):
            raise ValueError(f"stages missing: {sorted(missing)}")
        self.order = list(TopologicalSorter({s.name: s.after for s in stages}).static_order())

    def fingerprint(self, name: str, known: dict[str, str]) -> str:
        s = self.stages[name]
        try:
            code = inspect.getsource(s.run)
        except OSError:
            code = s.run.__qualname__
        return hashlib.sha256(json.dumps([name, code, s.settings, [known[d] for d in s.after]], sort_keys=True, default=str).encode()).hexdigest()

    def _stored(self, name: str) -> str | None:
        path = f"{self.root}/{name}.fingerprint"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.text(path).first()["value"] if there else None

    def run(self, *, force: tuple[str, ...] = (), until: str | None = None, dry: bool = False) -> dict[str, str]:
        """By stage: cached, ran, or would run (dry, which writes nothing)."""
        prints, state, tables = {}, {}, {}
        for name in self.order:
            prints[name] = self.fingerprint(name, prints)
            stale = name in force or any(state[d] != "cached" for d in self.stages[name].after) or self._stored(name) != prints[name]
            state[name] = "cached" if not stale else "would run" if dry else "ran"
            if stale and not dry:
                out = self.stages[name].run(self.spark, {d: tables[d] for d in self.stages[name].after})
                out.write.mode("overwrite").parquet(f"{self.root}/{name}.parquet")
                self.spark.createDataFrame([(prints[name],)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{name}.fingerprint")
            if not dry:
                tables[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
            if name == until:
                break
        return state
