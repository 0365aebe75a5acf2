"""Distributed union-find: local forests, merged level by level."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.similar import components
from ..session import checkpoint

#: Links that one task may merge; 16 bytes each on the wire, some 200 bytes each in the task's table. And forests merged by one task.
MERGE_LIMIT = 1_000_000
FAN = 16
_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def local_forest(batches):
    """Arrow batches of links (a, b) -> links (node, smallest node of its tree), roots left out."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a < b:
                up[b] = a
            elif b < a:
                up[a] = b
    nodes = [x for x in up if up[x] != x]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], schema=_SCHEMA)


def _forest(links: DataFrame) -> DataFrame:
    return links.mapInArrow(local_forest, "a long, b long")


def connected_components(links: DataFrame, merge_limit: int = MERGE_LIMIT) -> DataFrame:
    """(a, b) links between long ids -> (node, root) of every linked node; root is the smallest id of its component.

    Each partition first contracts its links to a forest, so that at most one link per node and partition moves on.
    Forests are then brought together level by level, FAN of them in one task, as long as a task gets at most merge_limit links; each level
    drops the links that a tree of the level before holds already. What is left in more than one tree is contracted by star rounds in
    tables, so no task ever holds all links. Null ends and loops are no links; no links give no rows.
    """
    links = links.toDF("a", "b").where("a != b")
    parts = links.rdd.getNumPartitions()
    forest = checkpoint(_forest(links))
    n = forest.count()
    while parts > 1 and n <= merge_limit * (fewer := -(-parts // FAN)):
        # a tree's links go by the range of their root, so trees that share roots meet early; the top level holds what is left of all
        forest = checkpoint(_forest(forest.repartitionByRange(fewer, "b") if fewer > 1 else forest.repartition(1)))
        parts, n = fewer, forest.count()
    if parts > 1:
        return components(forest)
    return forest.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        forest.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
