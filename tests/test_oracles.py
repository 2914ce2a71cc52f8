"""Every registered query against its DuckDB oracle (exact values, names and
types) on the smallest shared tables; queries without an oracle must run
and return rows."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck
from vigia.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLES = E.oracle_sql()
MODEL_FREE = [k for k in QUERIES if k in ORACLES]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", MODEL_FREE)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert r["cols"], r
    assert "types" not in r, r
    assert r["rows"] == r["orows"], r
    assert r["exact"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["Estacion", "N_AT", "N_Dias", "HHT", "IF", "IS", "Severidad", "Nivel_IF"]


def test_every_query_has_oracle_or_is_a_model():
    no_oracle = set(catalog.QUERIES) - set(ORACLES)
    assert no_oracle <= {"train_rf_metrics", "train_gbt_metrics", "train_lr_metrics", "cv_auc",
                         "feature_importance_top10", "score_cases", "forecast_months"}
