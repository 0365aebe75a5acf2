"""Problem 3: clusters of mutually similar records."""

from __future__ import annotations

from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint, width
from .components import connected_components

#: Feature -> the most by which two records alike differ in it.
TOLERANCES = {"contrast": 0.03, "stroke_w": 0.004, "lap_var_norm": 0.0002, "core_h": 1.0}
#: Side of a tile in tolerances, and the points from which a tile is cut up.
BLOCK, HEAVY = 8, 4000
_SLACK = 1 + 1e-9  # for values that decimals put on the limit itself
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _copies(points: DataFrame, tol: list[float], block: int, at: list | None = None, margin: float = 1e-6) -> DataFrame:
    """Each point to its tile and, if it lies within a tolerance of the tile's lower face, to the tiles below.
    Of two points alike each has a copy in the tile of the lower corner of both, so they meet there. For cells, `at` are the numbers of their
    corners and the tolerance is one cell."""
    sides = []
    for i, t in enumerate(tol):
        x, side = at[i] if at else F.col(f"x{i}"), t * block
        place = F.floor(x / side)
        edge = (x - place * side == 0) if at else (x - place * side <= t * (1 + margin))
        sides.append(F.when(edge, F.array(place, place - 1)).otherwise(F.array(place)))
    keys = reduce(
        lambda acc, s: F.flatten(F.transform(acc, lambda k: F.transform(s, lambda v: F.xxhash64(k, v)))),
        sides[1:], F.transform(sides[0], lambda v: F.xxhash64(v)),
    )
    return points.withColumn("tile", F.explode(keys))


def _join_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _cluster_tiles(tile: np.ndarray, rep: np.ndarray, x: np.ndarray, tol: np.ndarray) -> pa.RecordBatch:
    """Local clusters of whole tiles, sorted by tile and first feature: links from each point to its cluster's smallest."""
    left, right = [], []
    active = np.arange(len(tile) - 1)
    k = 1
    while len(active):
        to = active + k
        near = (tile[active] == tile[to]) & (x[to, 0] - x[active, 0] <= tol[0])
        active = active[near]
        to = active + k
        hit = (np.abs(x[active] - x[to]) <= tol).all(axis=1)
        left.append(active[hit])
        right.append(to[hit])
        k += 1
        active = active[active + k < len(tile)]
    i, j = (np.concatenate(v) if v else np.zeros(0, int) for v in (left, right))
    label = _join_labels(len(tile), i, j)
    low = np.full(len(tile), np.iinfo(np.int64).max)
    np.minimum.at(low, label, rep)
    a, b = rep, low[label]
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], schema=_EDGES)


def _local(tol: list[float]):
    limit = np.array(tol) * _SLACK

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(whole: bool):
            t = pa.Table.from_batches(held)
            tile, rep = t.column(0).to_numpy(), t.column(1).to_numpy()
            cut = len(tile) if whole else int(np.searchsorted(tile, tile[-1]))
            x = np.column_stack([t.column(2 + i).to_numpy() for i in range(len(tol))])
            held[:] = t.slice(cut).to_batches()
            return _cluster_tiles(tile[:cut], rep[:cut], x[:cut], limit) if cut else None

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 100_000 and (out := flush(False)) is not None:
                yield out
        if held:
            yield flush(True)

    return run


def _extreme(x: np.ndarray) -> np.ndarray:
    """Mask of the points not below another in all features, for some choice of what is up in each feature. Points in order of their sum:
    the first that is left is below none, and takes out all that are below it."""
    keep = np.zeros(len(x), bool)
    for signs in product((1, -1), repeat=x.shape[1]):
        y = x * signs
        left = np.argsort(-y.sum(axis=1), kind="stable")
        while len(left):
            keep[left[0]] = True
            left = left[(y[left] > y[left[0]]).any(axis=1)]
    return keep


def _thinned(t: pa.Table, scale: np.ndarray) -> pa.Table:
    """Of each cell of (cell, x0, x1, ...) its extreme points."""
    cell = t.column(0).to_numpy()
    x = np.column_stack([c.to_numpy() for c in t.columns[1 : 1 + len(scale)]]) / scale
    order = np.argsort(cell, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(cell[order])) + 1), len(order)]
    return t.take(pa.array(np.concatenate([own[_extreme(x[own])] for own in map(lambda i, j: order[i:j], edges, edges[1:])]) if len(order) else order))


def _thin_task(scale: np.ndarray, most: int = 100_000):
    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                t = _thinned(pa.Table.from_batches(held), scale)
                if t.num_rows > most // 2:  # little to gain by holding on
                    yield from t.to_batches()
                    t = t.slice(0, 0)
                held, n = t.to_batches(), t.num_rows
        if n:
            yield from _thinned(pa.Table.from_batches(held), scale).to_batches()

    return run


def _fronts(points: DataFrame, scale: np.ndarray, fan: int = 8) -> DataFrame:
    """(cell, x0, x1, ...) -> the extreme points of each cell, by a tree of partial merges: each task thins its own points, then those of
    `fan` tasks meet per cell, and so on. Of n spread points some log(n)^3 are extreme, and no merge gets more than fan times that."""
    cols = ", ".join(f"x{i} double" for i in range(len(scale)))
    schema = f"cell long, {cols}"
    parts = points.rdd.getNumPartitions()
    points = points.mapInArrow(_thin_task(scale), schema).withColumn("part", F.spark_partition_id())
    points = checkpoint(points)
    while parts > 1:
        parts = -(-parts // fan)
        merge = lambda t: _thinned(t, scale)
        points = points.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("cell", "part").applyInArrow(merge, f"{schema}, part int")
    return points.drop("part")


def _cell_tiles(tol: np.ndarray):
    """Cells (tile, low, k.., least.., most..) of whole tiles, sorted by tile -> (a, b, sure): cells linked, and pairs of cells that the
    extreme points must tell. In each tile are at most (BLOCK + 1) ** features cells, however many points."""
    d = len(tol)
    offsets = [o for o in product((-1, 0, 1), repeat=d) if o > (0,) * d]

    def one(t: pa.Table) -> pa.RecordBatch:
        low = t.column("low").to_numpy()
        k, least, most = (np.column_stack([t.column(f"{c}{i}").to_numpy() for i in range(d)]) for c in "klm")
        k = k - k.min(axis=0)
        base = np.cumprod([1, *(k.max(axis=0)[:-1] + 3)])
        code = (k + 1) @ base
        order = np.argsort(code)
        pairs = []
        for o in offsets:
            want = code + np.array(o) @ base
            at = np.minimum(np.searchsorted(code[order], want), len(order) - 1)
            i = np.flatnonzero(code[order[at]] == want)
            j = order[at[i]]
            up = np.array(o)
            gap = np.where(up > 0, least[j] - most[i], np.where(up < 0, least[i] - most[j], 0.0))
            near = (gap <= tol).all(axis=1)
            pairs.append((i[near], j[near], np.full(near.sum(), np.count_nonzero(up) == 1)))
        i, j, sure = (np.concatenate(v) for v in zip(*pairs))
        label = _join_labels(len(low), i[sure], j[sure])
        open_ = ~sure & (label[i] != label[j])
        own = np.flatnonzero(label != np.arange(len(low)))
        a, b = np.concatenate([low[own], low[i[open_]]]), np.concatenate([low[label[own]], low[j[open_]]])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.arange(len(a)) < len(own))], names=["a", "b", "sure"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            tile = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tile)) + 1), len(tile)] if len(tile) else []
            for i, j in zip(edges, edges[1:]):
                if held and held[0].column(0)[0].as_py() != tile[i]:
                    yield one(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield one(pa.Table.from_batches(held))

    return run


def _meet(tol: np.ndarray):
    """Whether two cells' extreme points hold a pair alike: stops at the first."""

    def run(t: pa.Table) -> pa.Table:
        x = np.column_stack([t.column(f"x{i}").to_numpy() for i in range(len(tol))])
        left = t.column("cell").to_numpy() == t.column("a").to_numpy()
        p, q = x[left], x[~left]
        for row in p:
            if (np.abs(q - row) <= tol).all(axis=1).any():
                return t.select(["a", "b"]).slice(0, 1)
        return t.select(["a", "b"]).slice(0, 0)

    return run


def _dense(points: DataFrame, tol: list[float]) -> tuple[DataFrame, DataFrame]:
    """Points of overfull tiles -> (rep, cell), by which a point stands for its cell's smallest, and links (a, b) of these.

    Points of one cell as wide as a tolerance are all alike, so the cell goes on as one. Cells that differ along one feature are
    alike if the greatest value of one and the least of the other are near; so the bounds of the cells, at most (BLOCK + 1) ** features a
    tile, tell most links. Pairs of cells at a corner that no such link has joined yet are told by their extreme points alone: whatever is
    near a point is at least as near to one that goes further its way.
    """
    d, limit = len(tol), np.array(tol) * _SLACK
    xs, ks = [f"x{i}" for i in range(d)], [f"k{i}" for i in range(d)]
    points = points.select("rep", *xs, *[F.floor(F.col(x) / float(w)).alias(k) for x, k, w in zip(xs, ks, limit)])
    bounds = [f(x).alias(f"{c}{i}") for c, f in (("l", F.min), ("m", F.max)) for i, x in enumerate(xs)]
    cells = checkpoint(points.groupBy(*ks).agg(F.min("rep").alias("low"), *bounds))  # the corner is the key: no hash
    points = checkpoint(points.join(cells.select(*ks, "low"), ks).select("rep", F.col("low").alias("cell"), *xs))
    tiles = _copies(cells, [BLOCK * 1.0] * d, 1, [F.col(k) for k in ks], margin=0.0)
    columns = ["low", *ks, *[f"{c}{i}" for c in "lm" for i in range(d)]]
    told = tiles.select("tile", *columns).repartition(width(points), "tile").sortWithinPartitions("tile").mapInArrow(_cell_tiles(limit), "a long, b long, sure boolean")
    told = checkpoint(told)
    links = told.where("sure").select("a", "b")
    unsure = told.where("not sure").select("a", "b").distinct()
    if told.where("not sure").head(1):
        root = connected_components(links)
        for c in "ab":
            unsure = unsure.join(root.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
        unsure = checkpoint(unsure.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
        if unsure.head(1):
            ends = unsure.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
            fronts = checkpoint(_fronts(checkpoint(points.join(ends, "cell", "left_semi").select("cell", *xs)), limit))
            both = unsure.select("a", "b", F.explode(F.array("a", "b")).alias("cell")).join(fronts, "cell")
            links = links.unionByName(both.groupBy("a", "b").applyInArrow(_meet(limit), "a long, b long"))
    return points.select("rep", "cell"), links


def similarity_groups(rows: DataFrame, tolerances: dict[str, float] = TOLERANCES, min_size: int = 3, block: int = BLOCK, heavy: int = HEAVY) -> DataFrame:
    """(cluster_no, img_no, x0, x1, ...): rows in groups of at least min_size rows that are alike, directly or over others.

    Two rows are alike if they differ in no feature by more than its tolerance; cluster_no is the group's smallest img_no. A row with
    a null, NaN or infinite feature or a null img_no is like none. Equal vectors are folded first, so repeated rows cost nothing more.
    Tiles above `heavy` points are worked off by cells (see _dense), so no task gets more than `heavy` points of a tile or its bounded cells.
    """
    names, tol = list(tolerances), [float(t) for t in tolerances.values()]
    xs = [f"x{i}" for i in range(len(names))]
    rows = rows.select(F.col("img_no").cast("long").alias("img_no"), *[F.col(c).cast("double").alias(x) for c, x in zip(names, xs)])
    rows = rows.where(reduce(lambda a, b: a & b, [F.abs(F.col(x)) < float("inf") for x in xs], F.col("img_no").isNotNull()))
    points = checkpoint(rows.groupBy(*xs).agg(F.min("img_no").alias("rep"), F.count("*").alias("n")))
    copies = _copies(points.select("rep", *xs), tol, block)
    full = checkpoint(copies.groupBy("tile").count().where(F.col("count") > heavy).select("tile"))
    cells = None
    if full.head(1):
        cells, between = _dense(copies.join(full, "tile", "left_semi").drop("tile").distinct(), tol)
        copies = copies.join(full, "tile", "left_anti")
    links = (
        copies.select("tile", "rep", *xs).repartition(width(rows), "tile").sortWithinPartitions("tile", "x0")
        .mapInArrow(_local(tol), "a long, b long")
    )
    points = points.withColumn("node", F.col("rep"))
    if cells is not None:
        for c in "ab":
            links = links.join(cells.toDF(c, f"cell_{c}"), c, "left")
        links = links.select(F.coalesce("cell_a", "a").alias("a"), F.coalesce("cell_b", "b").alias("b")).unionByName(between)
        points = points.join(cells, "rep", "left").withColumn("node", F.coalesce("cell", "rep")).drop("cell")
    groups = points.join(connected_components(links), "node", "left").select(*xs, "n", F.coalesce("root", "node").alias("cluster_no"))
    large = groups.groupBy("cluster_no").agg(F.sum("n").alias("size")).where(F.col("size") >= min_size)
    return rows.join(groups.join(large, "cluster_no").drop("n", "size"), xs).select("cluster_no", "img_no", *xs)


def typical(groups: DataFrame, tolerances: dict[str, float] = TOLERANCES, top: int = 3) -> DataFrame:
    """(cluster_no, size, place, img_no): each group's size and its most typical rows, places 1 to top.

    Typical is a medoid: the row with the least sum of squared distances, in tolerances, to all rows of its group. That is the row nearest
    to the group's mean, so no pair of rows is formed. Distances are rounded to 9 places; ties go to the smallest img_no.
    """
    xs = [f"x{i}" for i in range(len(tolerances))]
    mean = groups.groupBy("cluster_no").agg(F.count("*").alias("size"), *[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)])
    far = reduce(lambda a, b: a + b, [F.pow((F.col(x) - F.col(f"m{i}")) / t, 2) for i, (x, t) in enumerate(zip(xs, tolerances.values()))])
    place = F.row_number().over(Window.partitionBy("cluster_no").orderBy("far", "img_no"))
    return (
        groups.join(mean, "cluster_no").withColumn("far", F.round(far, 9)).withColumn("place", place)
        .where(F.col("place") <= top).select("cluster_no", "size", F.col("place").cast("int").alias("place"), "img_no")
    )
