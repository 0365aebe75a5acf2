"""What produces and scores readings: a protocol, and a stand-in that makes them up from the reference."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edits import char_edits, loss, word_edits
from ..operators.relations import draw
from .q_more import perturb


@dataclass(frozen=True)
class Decoding:
    """How many readings a backend gives: the greedy one, beams, samples."""

    greedy: bool = True
    beams: int = 0
    samples: int = 0

    def methods(self) -> list[tuple[str, int]]:
        return [*([("greedy", 0)] if self.greedy else []), *(("beam", i) for i in range(self.beams)), *(("sample", i) for i in range(self.samples))]


class Backend(Protocol):
    def generate(self, lines: DataFrame, decoding: Decoding) -> DataFrame: ...

    def score(self, readings: DataFrame) -> DataFrame: ...


class MadeUp:
    """Readings of (ID, reference) by keyed draws, the same on every run; worse with rank. Scores fall with the loss."""

    def __init__(self, name: str, percent: int = 12):
        self.name, self.percent = name, percent

    def generate(self, lines: DataFrame, decoding: Decoding) -> DataFrame:
        rows = None
        for method, rank in decoding.methods():
            key = F.concat(F.lit(f"{self.name}:{method}:{rank}:"), F.col("ID"))
            part = lines.select("ID", F.lit(self.name).alias("source"), perturb(F.col("reference"), key, self.percent + 3 * rank).alias("text"), F.lit(method).alias("method"), F.lit(rank).alias("rank"))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def score(self, readings: DataFrame) -> DataFrame:
        """readings with reference -> with gen_mean."""
        l = loss(word_edits(F.col("reference"), F.col("text")), char_edits(F.col("reference"), F.col("text")))
        return readings.withColumn("gen_mean", -40 * l - draw(F.lit(self.name), F.col("ID"), F.col("text")) / 2**32)


BACKENDS = {"made-up": MadeUp}
