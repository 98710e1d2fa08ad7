import pytest

from rategrid.plans.registry import FLAGSHIP, ORACLES, QUERIES
from tests.conftest import same_rows, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    relation = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert same_rows([tuple(r) for r in df.collect()], df.columns, relation)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows_again(spark, name):
    assert sorted(QUERIES[name](spark, SF).collect()) == sorted(QUERIES[name](spark, SF).collect()) != []


def test_flagship_plan_has_no_cartesian_product(spark):
    plan = QUERIES[FLAGSHIP](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
