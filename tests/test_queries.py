from pathlib import Path

import oracle
import pytest

from scrivener.plans.catalog import REGISTRY

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_against_sql(spark, con, name):
    assert oracle.difference(REGISTRY.queries[name](spark, str(FOLDER)), con, REGISTRY.sql[name]) == ""


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.sql)))
def test_runs(spark, name):
    df = REGISTRY.queries[name](spark, str(FOLDER))
    assert df.columns and df.count() >= 0


def test_x_area_in_capitals_and_beyond_int(spark, tmp_path):
    targets = ["Area: 16 ACRES 25 PERCHES", "AREA 7 Acres 3 Perches", "area: 1 acreſ 2 perches", "area: 99999999999 acres 4 perches", "Area: 5 acres", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(targets)], "row_no long, Target string").write.parquet(str(tmp_path / "train.parquet"))
    assert sorted(map(tuple, REGISTRY.queries["x_area"](spark, str(tmp_path)).collect())) == [(0, 16, 25), (1, 7, 3), (2, 1, 2), (3, None, 4)]
