"""Every registered query with an oracle SQL text equals DuckDB's answer
(row count, column names, order-insensitive values) on the smallest tables."""

import pytest

from attrition.config import Params
from attrition.plans import catalog_train
from attrition.plans.catalog import queries
from oracle.compare import compare, duck
from oracle.sql import oracle_queries
from tests.conftest import SF_ORACLE, SF_SMALL

SQL = {k: v for k, v in oracle_queries().items() if k in queries()}
NAMES = sorted(SQL)
#: Where the smallest table is trivial (one user with a subscription before churn).
LARGER = ["level_neighbours", "churn_events", "churn_timestamps", "resubscribe", "resubscribe_summary", "time_to_churn", "churn_context"]


@pytest.fixture(autouse=True, scope="module")
def few_rounds():
    """What is compared doesn't depend on the number of trees."""
    before, catalog_train.P = catalog_train.P, Params(rounds=3)
    yield
    catalog_train.P = before


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(queries()[name](spark, SF_SMALL), con, SQL[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


@pytest.mark.parametrize("name", LARGER)
def test_matches_oracle_on_the_larger_table(spark, name):
    r = compare(queries()[name](spark, SF_ORACLE), duck(SF_ORACLE), SQL[name])
    assert r["columns_match"] and r["values_match"] and r["spark_rows"] == r["oracle_rows"], r


def test_every_query_registered_has_oracle_or_is_model():
    rows_only = set(queries()) - set(SQL)
    assert rows_only <= {
        "training_job", "train_gbt", "predict_proba", "save_model_bundle", "load_model_bundle",
        "save_run_metadata", "log_run", "score_requests",
    }, rows_only
