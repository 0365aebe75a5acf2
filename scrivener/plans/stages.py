"""Named stages that run in order and are skipped where their table is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import cached

Stage = Callable[[SparkSession, dict], DataFrame]


class Stages:
    """A stage makes one table from the parameters; params["work"] is the shared folder the tables go to."""

    def __init__(self):
        self.order: dict[str, Stage] = {}

    def stage(self, f: Stage) -> Stage:
        self.order[f.__name__] = f
        return f

    def chosen(self, only: list[str] | None = None, first: str | None = None, last: str | None = None) -> list[str]:
        names = list(self.order)
        for n in [*(only or []), *filter(None, (first, last))]:
            if n not in self.order:
                raise KeyError(f"no stage {n}; there are {', '.join(names)}")
        lo, hi = names.index(first) if first else 0, names.index(last) + 1 if last else len(names)
        return [n for n in names[lo:hi] if not only or n in only]

    def run(self, spark: SparkSession, params: dict, force: bool = False, **choice) -> dict[str, DataFrame]:
        return {n: cached(lambda n=n: self.order[n](spark, params), f"{params['work']}/{n}", force) for n in self.chosen(**choice)}
