"""Registry of the shipped queries with the SQL that checks each of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None

    @property
    def sql(self) -> str | None:
        """The check SQL with its fragments, put together when all are known."""
        return None if self.body is None else with_fragments(self.body)


QUERIES: dict[str, Query] = {}
FRAGMENTS: dict[str, str] = {}


def fragment(name: str, body: str) -> None:
    """Add a common table expression that query SQL may mention by name."""
    FRAGMENTS[name] = body


def with_fragments(final: str) -> str:
    """Prefix the SQL with the fragments it mentions, directly or not."""
    ordered: list[str] = []

    def visit(text: str, inside: str | None = None) -> None:
        for name in sorted(set(re.findall(r"[a-z_0-9]+", text)) & FRAGMENTS.keys()):
            if name != inside and name not in ordered:
                visit(FRAGMENTS[name], name)
                ordered.append(name)

    visit(final)
    parts = [f"{name} AS ({FRAGMENTS[name]})" for name in ordered]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + final


def query(name: str, sql: str | None = None, **digits: int):
    """Register a query; ``digits`` rounds columns on both sides alike."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(spark, sf_dir)
            return out.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in digits.items()})

        final = sql
        if sql is not None:
            if digits:
                cols = ", ".join(f"round({c}, {d}) + 0.0::DOUBLE AS {c}" for c, d in digits.items())
                final = f"SELECT * REPLACE ({cols}) FROM ({sql}) AS result"
            else:
                final = f"SELECT * FROM ({sql}) AS result"
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, final)
        return fn

    return wrap
