"""Models on Spark ML: grouped folds, cross-validation, calibration, clusters, projections."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .evaluate import auroc
from .relations import draw, keyed_order


def group_folds(rows: DataFrame, group: str, k: int, seed: str) -> DataFrame:
    """rows with `fold`: groups in the order of a keyed hash, round-robin, so no group is split; rows without a group (null or
    negative) are groups of their own, by `ID`."""
    g = F.when(F.col(group) >= 0, F.concat(F.lit("g"), F.col(group).cast("string"))).otherwise(F.concat(F.lit("i"), F.col("ID")))
    t = rows.withColumn("g_", g)
    order = keyed_order(t.select("g_", F.lit(0).alias("all_")).distinct(), "all_", "g_", seed).select("g_", ((F.col("place") - 1) % k).cast("int").alias("fold"))
    return t.join(order, "g_").drop("g_")


def stratified_group_folds(rows: DataFrame, group: str, stratum: str, k: int, seed: str) -> DataFrame:
    """rows with `fold`: each group whole, folds alike in strata. Groups are dealt round-robin within their main stratum and size, which
    keeps every fold's share of each stratum within one group per size of the others."""
    n = rows.groupBy(group, stratum).agg(F.count("*").alias("n"))
    main = n.groupBy(group).agg(F.max_by(stratum, F.struct("n", stratum)).alias("main"), F.sum("n").alias("size"))
    kind = F.concat_ws(":", F.coalesce(F.col("main").cast("string"), F.lit("")), F.col("size"))
    dealt = keyed_order(main.withColumn("kind", kind), "kind", group, seed)
    turn = F.pmod(F.col("place") - 1 + F.crc32(F.col("kind").cast("binary")), F.lit(k)).cast("int")
    return rows.join(dealt.select(group, turn.alias("fold")), group)


def nested_roles(rows: DataFrame, fold: str, outer: int, seed: str, valid_percent: int = 20) -> DataFrame:
    """rows with `role` for one outer fold: test, valid (a keyed share of the other rows) or train."""
    pick = draw(F.lit(seed), F.col("ID")) % 100 < valid_percent
    return rows.withColumn("role", F.when(F.col(fold) == outer, "test").when(pick, "valid").otherwise("train"))


def with_medians(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Null and NaN features become the column's median (0 where there is none)."""
    real = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    med = rows.agg(*[F.percentile(real[c], F.lit(0.5)).alias(c) for c in cols]).first()
    return rows.withColumns({c: F.coalesce(real[c], F.lit(float(med[c] or 0.0))) for c in cols})


def standard(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean, in population deviations; a constant column becomes 0."""
    s = rows.agg(*[f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).first()
    return rows.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"] or 0.0)) / F.lit(s[f"s_{c}"] or 1.0) for c in cols})


def vectors(rows: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="features").transform(rows)


def cross_predict(rows: DataFrame, estimator, fold: str, k: int, column: str = "prediction") -> DataFrame:
    """Out-of-fold predictions: for each fold a model of the others. rows has features and the estimator's label."""
    rows = checkpoint(rows)
    parts = []
    for i in range(k):
        train = rows.where(F.col(fold) != i)
        if train.limit(1).count():
            parts.append(estimator.fit(train).transform(rows.where(F.col(fold) == i)))
    if not parts:
        return rows.withColumn(column, F.lit(None).cast("double")).limit(0)
    return reduce(lambda a, b: a.unionByName(b), parts)


def drift(rows: DataFrame, side: str, cols: list[str], k: int = 3) -> DataFrame:
    """(auroc): how well a boosted classifier tells two sets apart by their features, out of fold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import vector_to_array

    t = group_folds(vectors(with_medians(rows, cols), cols).withColumn("none_", F.lit(-1)), "none_", k, "drift").withColumn("label", F.col(side).cast("double"))
    p = cross_predict(t.select("ID", "features", "label", "fold"), GBTClassifier(maxIter=8, maxDepth=4, seed=0), "fold", k)
    return auroc(p.select(vector_to_array("probability")[1].alias("p"), F.col("label").cast("int").alias("y")).withColumn("all_", F.lit(0)), "p", "y", ["all_"]).select("auroc")


def cluster(rows: DataFrame, cols: list[str], k: int, seed: int = 0) -> DataFrame:
    """rows with `cluster` by k-means on standardised features."""
    from pyspark.ml.clustering import KMeans

    t = vectors(standard(with_medians(rows, cols), cols), cols)
    return KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(t).transform(t).drop("features")


def mixture_bic(rows: DataFrame, cols: list[str], ks: list[int], seed: int = 0) -> list[tuple[int, float]]:
    """Bayesian information criterion of Gaussian mixtures (full covariance) for several numbers of parts."""
    import math

    from pyspark.ml.clustering import GaussianMixture

    t = checkpoint(vectors(standard(with_medians(rows, cols), cols), cols).select("features"))
    n, d = t.count(), len(cols)
    out = []
    for k in ks:
        free = k - 1 + k * d + k * d * (d + 1) // 2
        out.append((k, free * math.log(max(2, n)) - 2 * GaussianMixture(k=k, seed=seed, maxIter=20).fit(t).summary.logLikelihood))
    return out


def project(rows: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """(key, unit): the first k principal components of array rows, each row scaled to length 1."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    t = rows.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("x"))
    z = PCA(k=k, inputCol="x", outputCol="z").fit(t).transform(t).select(key, vector_to_array("z").alias("z"))
    norm = F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x)) + 1e-9
    return z.withColumn("n_", norm).select(key, F.transform("z", lambda x: x / F.col("n_")).alias("unit"))


def _solved(d: int):
    """Weighted normal equations of groups, one row each -> their coefficients, the constant first."""

    def run(frames):
        for f in frames:
            out = []
            for r in f["sums"]:
                a = np.zeros((d, d))
                a[np.triu_indices(d)] = r[: d * (d + 1) // 2]
                out.append(np.linalg.lstsq(np.triu(a) + np.triu(a, 1).T, np.array(r[d * (d + 1) // 2 :]), rcond=None)[0].tolist())
            yield f[["g_"]].assign(beta=out, scale=f["scale"])

    return run


def length_model(rows: DataFrame, group: str, x: list[str], y: str, rounds: int = 12, epsilon: float = 1.35) -> DataFrame:
    """rows with `predicted` by a Huber regression per group, and `relative`, the residual relative to the prediction.

    All groups are fitted at once, however many or large: each round weighs rows by their residual (1 up to epsilon deviations, then less, the
    deviation from the median of absolute residuals) and brings a group's normal equations together as sums. A null group is a group.
    Rows with a null or NaN y are not fitted and have a null residual. The first round is a plain regression.
    """
    kept, d = rows.columns, len(x) + 1
    null_group = F.struct(F.col(group).isNull().alias("none"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("of")).cast("string")
    rows = checkpoint(with_medians(rows, x).withColumns({"g_": null_group, "y_": F.when(~F.isnan(F.col(y).cast("double")), F.col(y).cast("double"))}))
    terms = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    models = None

    def fitted(t):
        return reduce(lambda a, b: a + b, [F.get("beta", F.lit(i)) * v for i, v in enumerate(terms)])

    for _ in range(rounds):
        t = rows.where("y_ is not null")
        if models is None:
            t = t.withColumns({"r_": F.lit(0.0), "w_": F.lit(1.0)})
        else:
            t = t.join(models, "g_").withColumn("r_", F.abs(F.col("y_") - fitted(t)))
            mad = t.groupBy("g_").agg(F.percentile_approx("r_", 0.5, 10_000).alias("mad"))
            edge = epsilon * F.greatest(F.col("mad") * 1.4826, F.lit(1e-9))
            t = t.join(mad, "g_").withColumn("w_", F.when(F.col("r_") <= edge, 1.0).otherwise(edge / F.col("r_")))
        sums = [F.sum(F.col("w_") * terms[i] * terms[j]) for i in range(d) for j in range(i, d)] + [F.sum(F.col("w_") * v * F.col("y_")) for v in terms]
        grouped = t.groupBy("g_").agg(F.array(*sums).alias("sums"), F.max("r_").alias("scale"))
        models = checkpoint(grouped.mapInPandas(_solved(d), "g_ string, beta array<double>, scale double").drop("scale"))
    t = rows.join(models, "g_", "left").withColumn("predicted", fitted(rows))
    return t.select(*kept, "predicted").withColumn("relative", (F.col(y) - F.col("predicted")) / F.nullif(F.col("predicted"), F.lit(0.0)))


def tree_rules(rows: DataFrame, cols: list[str], y: str, depth: int = 3) -> tuple[DataFrame, str]:
    """rows with `leaf` value of a regression tree of one target, and the tree as text."""
    from pyspark.ml.regression import DecisionTreeRegressor

    t = vectors(with_medians(rows, cols), cols).withColumn("label", F.col(y).cast("double"))
    m = DecisionTreeRegressor(maxDepth=depth, seed=0, predictionCol="leaf").fit(t)
    return m.transform(t).drop("features", "label"), m.toDebugString


def rank_candidates(rows: DataFrame, cols: list[str], loss: str, k: int, seeds: list[int]) -> DataFrame:
    """(ID, cand_id, badness): out-of-fold predictions of a boosted regressor of the loss, folds by ID, averaged over seeds as within-line deviations."""
    from pyspark.ml.regression import GBTRegressor

    from .windows import z_within

    t = group_folds(vectors(with_medians(rows, cols), cols).withColumn("none_", F.lit(-1)), "none_", k, "rank").withColumn("label", F.col(loss))
    t = checkpoint(t.select("ID", "cand_id", "features", "label", "fold"))
    parts = [cross_predict(t, GBTRegressor(maxIter=8, maxDepth=4, seed=s, subsamplingRate=0.8), "fold", k).select("ID", "cand_id", F.lit(s).alias("seed"), "prediction") for s in seeds]
    z = reduce(lambda a, b: a.unionByName(b), parts).withColumn("z", z_within(F.col("prediction"), ["ID", "seed"]))
    return z.groupBy("ID", "cand_id").agg(F.avg("z").alias("badness"))


def choose(badness: DataFrame) -> DataFrame:
    w = Window.partitionBy("ID").orderBy("badness", "cand_id")
    return badness.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
