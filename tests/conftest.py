import datetime as dt

import pytest

from panelweave.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("stage")), "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def months(n, start=dt.date(1995, 1, 1)):
    """``n`` month ends from the start."""
    out, y, m = [], start.year, start.month
    for _ in range(n):
        y2, m2 = (y + 1, 1) if m == 12 else (y, m + 1)
        out.append(dt.date(y2, m2, 1) - dt.timedelta(days=1))
        y, m = y2, m2
    return out


@pytest.fixture(scope="session")
def make_panel(spark):
    def build(**series):
        rows = [(k, t, None if v is None else float(v)) for k, xs in series.items() for t, v in zip(months(len(xs)), xs)]
        return spark.createDataFrame(rows, "series_id string, ts date, value double")
    return build
