import random

from scrivener.operators import learn


def test_length_model_fits_every_group(spark):
    """1,001 groups with lines of their own, one of them null, each with a gross outlier: all are fitted, and the outlier draws none away."""
    draw = random.Random(1)
    data = []
    for g in range(1001):
        slope, start = draw.uniform(1, 3), draw.uniform(0, 20)
        for i in range(12):
            x = draw.uniform(0, 50)
            data.append((None if g == 7 else g, x, start + slope * x + (400.0 if i == 5 else draw.gauss(0, 0.1)), i))
    t = spark.createDataFrame(data, "g int, x double, y double, i int").repartition(4)
    out = learn.length_model(t, "g", ["x"], "y").collect()
    assert len(out) == len(data) and all(abs(r["y"] - r["predicted"]) < 1.5 for r in out if r["i"] != 5)
    assert learn.length_model(t.limit(0), "g", ["x"], "y").count() == 0


def test_running_sums_by_ranges(spark):
    from scrivener.operators.evaluate import running, tied_ranks

    draw = random.Random(2)
    data = [(draw.choice(["a", None]), i, draw.randrange(5)) for i in range(500)]
    got = {r["x"]: r["upto_n"] for r in running(spark.createDataFrame(data, "k string, x int, n int").repartition(3), ["k"], "x", ["n"]).collect()}
    assert got == {x: sum(m for k2, y, m in data if k2 == k and y <= x) for k, x, _ in data}
    t = spark.createDataFrame([(0, draw.randrange(40)) for _ in range(300)], "k int, x int")
    ranks = lambda ranges: sorted(map(tuple, tied_ranks(t, "x", ["k"], ranges).select("x", "rank_").collect()))
    assert ranks(True) == ranks(False)
