"""Text files of factor returns: a preamble, ``YYYYMM`` rows in percent, a footer.

Rows are recognised by their key, not by position, so a file may be split
over tasks anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.config import Split
from panelweave.functions.scalars import percent_to_log
from panelweave.operators.panel import period_filter


def parse_lines(lines: DataFrame, columns: Sequence[str], drop: Sequence[str] = ("RF",), text: str = "value") -> DataFrame:
    """Lines of the file as a panel in percent, month-end dates.

    Kept are lines with a six-digit key and a number in every column; columns
    named in ``drop`` are read for that rule and left out.
    """
    fields = F.split(F.col(text), ",")
    number = lambda i: F.expr(f"try_cast(trim(get(fields, {i})) AS double)")
    kept = [(i, c) for i, c in enumerate(columns, start=1) if c not in drop]
    rows = (
        lines.select(fields.alias("fields")).where(F.trim(F.col("fields")[0]).rlike(r"^\d{6}$"))
        .select(F.last_day(F.expr("try_to_date(trim(fields[0]), 'yyyyMM')")).alias("ts"),
                *[number(i).alias(c) for i, c in enumerate(columns, start=1)])
        .dropna()
    )
    cells = F.array(*[F.struct(F.lit(c).alias("series_id"), F.col(f"`{c}`").alias("value")) for _, c in kept])
    return rows.select("ts", F.inline(cells)).select("series_id", "ts", "value")


def read_factor_file(spark: SparkSession, path: str, columns: Sequence[str], drop: Sequence[str] = ("RF",)) -> DataFrame:
    return parse_lines(spark.read.text(path), columns, drop)


def period_returns(panel: DataFrame, period: Split, log: bool = False) -> DataFrame:
    """Returns of a period, in percent as stored or as log returns."""
    out = period_filter(panel, period)
    return out.withColumn("value", percent_to_log("value")) if log else out


def decimal_samples(panel: DataFrame, in_sample: Split, out_sample: Split) -> DataFrame:
    """Percent to decimal, each row labelled with the sample it belongs to."""
    decimal = panel.withColumn("value", F.col("value") / 100)
    label = lambda p, name: period_filter(decimal, p).withColumn("sample", F.lit(name))
    return label(in_sample, "in").unionByName(label(out_sample, "out"))


def parse_single(lines: DataFrame, name: str, text: str = "value") -> DataFrame:
    """A two-column file (key, percent) as one decimal series."""
    one = parse_lines(lines, [name], (), text)
    return one.withColumn("value", F.col("value") / 100)
