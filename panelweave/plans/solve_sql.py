"""Check SQL for least squares: Gauss-Jordan elimination on nested lists."""

from __future__ import annotations

from collections.abc import Sequence

from panelweave.plans.registry import fragment


def solve_fragments(name: str, rows: str, keys: str, xs: Sequence[str], y: str = "y", ridge: float = 0.0,
                    inverse: bool = False) -> None:
    """Add fragments that regress ``y`` on ``(1, xs)`` per group of ``rows``.

    ``{name}`` holds the keys, ``n``, ``yy`` and the list ``coef``; with ``inverse`` also
    ``inv``, the inverse of the cross-product matrix, and ``b``, its right side.
    """
    cols = ["1.0::DOUBLE", *xs]
    size = len(cols)
    lines = []
    for i, a in enumerate(cols):
        cells = [f"sum({a} * {b})" + (f" + {ridge!r}::DOUBLE" if i == j and i and ridge else "") for j, b in enumerate(cols)]
        cells.append(f"sum({a} * {y})")
        if inverse:
            cells += ["1.0::DOUBLE" if i == j else "0.0::DOUBLE" for j in range(size)]
        lines.append("[" + ", ".join(cells) + "]")
    right = "[" + ", ".join(f"sum({a} * {y})" for a in cols) + "]"
    fragment(f"{name}_g", f"SELECT {keys}, count(*) AS n, sum({y} * {y}) AS yy, {right} AS b, [{', '.join(lines)}] AS m, 1 AS k "
                          f"FROM {rows} GROUP BY {keys}")
    step = ("list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / m[k][k]) "
            "ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END)")
    fragment(f"{name}_r", f"SELECT * FROM {name}_g UNION ALL SELECT {keys}, n, yy, b, {step}, k + 1 FROM {name}_r WHERE k <= {size}")
    extra = f", list_transform(m, lambda r: r[{size + 2}:{2 * size + 1}]) AS inv" if inverse else ""
    fragment(name, f"SELECT {keys}, n, yy, b, list_transform(m, lambda r: r[{size + 1}]) AS coef{extra} FROM {name}_r WHERE k = {size + 1}")


def value_sql(coef: str, xs: Sequence[str]) -> str:
    return f"{coef}[1] + " + " + ".join(f"{coef}[{i + 2}] * {x}" for i, x in enumerate(xs))


def lags_sql(src: str, n: int, value: str = "value") -> str:
    cols = ", ".join(f"lag({value}, {k}) OVER w AS x{k}" for k in range(1, n + 1))
    return (f"SELECT * FROM (SELECT series_id, ts, {value} AS y, {cols} FROM {src} "
            f"WINDOW w AS (PARTITION BY series_id ORDER BY ts)) AS q WHERE x{n} IS NOT NULL")


def scaled_lags_sql(lags: str, n: int) -> str:
    train = "FILTER (WHERE ts < DATE '1998-01-01') OVER (PARTITION BY series_id)"
    cols = ", ".join(f"(x{k} - avg(x{k}) {train}) / nullif(stddev_pop(x{k}) {train}, 0) AS x{k}" for k in range(1, n + 1))
    return f"SELECT series_id, ts, y, {cols} FROM {lags}"
