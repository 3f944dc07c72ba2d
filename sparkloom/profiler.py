"""Named, nested scopes and the seconds spent in them."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Scope:
    calls: int = 0
    seconds: float = 0.0


class Profiler:
    """Adds up calls and seconds by path ("run/execute"). Switched off, scopes cost and record nothing.

    Given a session, Spark jobs that a scope starts bear its path as their description
    in the UI and the event log, where their own metrics are.
    """

    def __init__(self, spark: SparkSession | None = None, enabled: bool = True):
        self.spark = spark
        self.enabled = enabled
        self.scopes: dict[str, Scope] = {}
        self._open: list[str] = []

    @contextmanager
    def scope(self, name: str) -> Iterator[None]:
        if not self.enabled:
            yield
            return
        self._open.append(name)
        path, began = "/".join(self._open), time.perf_counter()
        self._describe(path)
        try:
            yield
        finally:
            old = self.scopes.get(path, Scope())
            self.scopes[path] = Scope(old.calls + 1, old.seconds + time.perf_counter() - began)
            self._open.pop()
            self._describe("/".join(self._open) or None)

    def _describe(self, path: str | None) -> None:
        if self.spark is not None:
            self.spark.sparkContext.setLocalProperty("spark.job.description", path)

    def report(self) -> str:
        """One line per scope, in order of path: path, calls, seconds."""
        return "\n".join(f"{path}\t{s.calls}\t{s.seconds:.6f}" for path, s in sorted(self.scopes.items()))

    def reset(self) -> None:
        self.scopes.clear()
