"""All registered queries and the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelweave.operators import evaluate as E
from panelweave.operators import panel as P
from panelweave.operators import windows as N
from panelweave.config import OOS
from panelweave.plans import combination, combined, dependence, evaluation, forecasting, ingest, panels, performance, portfolios  # noqa: F401
from panelweave.plans.registry import QUERIES
from panelweave.sources import tables as T

__all__ = ["QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = P.log_returns(T.orders_monthly(spark, sf_dir))
    loss = E.losses(P.period_filter(N.simple_pool(returns), OOS), returns)
    return E.error_metrics(loss).join(
        E.best_model(loss).select("series_id", "model").withColumnRenamed("model", "best"), "series_id")
