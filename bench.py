"""Time headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Each
query runs in full into Spark's no-op sink twice; the second run is reported,
so that code generation and Python start-up are not part of the figure.
"""

from __future__ import annotations

import json
import os
import time

from panelweave.plans import catalog
from panelweave.session import build_session

HEADLINE = (
    "log_returns", "sma_bank", "ema_bank", "ar_forecasts", "linear_bank", "linear_bank_daily", "ar_forecasts_daily", "knn_forecasts", "star_forecasts",
    "forecast_errors", "metric_bundle", "best_model", "model_weights", "dma_forecasts", "pca_full", "ridge_combination",
    "superior_ability", "confidence_set", "loss_test_table", "combined_forecasts", "describe_series", "performance_bundle",
    "garch_volatility_suppliers", "marginal_residuals_suppliers", "dcc_correlation", "adcc_correlation", "score_driven_correlation",
    "mean_variance_backtest", "mean_cvar_backtest", "mean_cvar_full", "stream_daily_totals", "strongest_partners",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g", "spark.checkpoint.dir": os.environ.get("CHECKPOINTS", "/tmp/panelweave-checkpoints")})
    spark.sparkContext.setLogLevel("ERROR")
    catalog.flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
