"""Every registered query against its SQL on the smallest data.

By default one query per operator family; PANELWEAVE_ALL=1 runs all of them.
"""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import compare

SF = os.environ.get("PANELWEAVE_SF", "/root/testdata/sf0.001")
FAMILIES = {
    "log_returns", "split_counts", "split_problems", "pool_impute", "cross_product_features", "calendar_fill", "strategy_grid", "sma_bank", "ema_bank",
    "describe_series", "spearman_matrix", "metric_bundle", "test_table", "best_forecast_lookup", "value_at_risk", "performance_bundle",
    "ar_forecasts", "arma_forecasts", "knn_forecasts", "star_forecasts", "unit_root_test", "model_weights", "dma_forecasts", "pca_axes",
    "ridge_combination", "superior_ability", "confidence_set", "garch_volatility", "marginal_residuals", "adcc_correlation",
    "score_driven_correlation", "copula_degrees", "residual_scenarios", "strategy_metrics", "best_tangent", "factor_file_rows", "merged_parts",
    "stream_resume", "tangent_polished", "strongest_partners", "volatility_orders", "stream_late_totals",
}
ALL = os.environ.get("PANELWEAVE_ALL") == "1"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


SQL = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in SQL if ALL or n in FAMILIES))
def test_query_matches_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, SF), duck.sql(SQL[name])) == ""


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SQL and ALL))
def test_query_without_sql_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_families_exist():
    assert FAMILIES <= set(SQL)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.count() == 20 and "best" in out.columns


def test_filters_and_columns_reach_the_scan(spark):
    from panelweave.sources import tables as T
    plan = T.orders_monthly(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(o_orderdate" in plan and "o_orderpriority" not in plan
