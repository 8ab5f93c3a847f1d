"""SQL text building blocks for the independent oracle (DuckDB dialect).

These mirror the fixture mapping and the operator semantics in plain SQL so a
second engine can check every registered query.
"""

from __future__ import annotations

from airseries.functions.constants import NUMERIC_COLS
from airseries.sources.readings import events_readings_sql, lineitem_readings_sql, lineitem_wide_readings_sql


def r6(expr: str, alias: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) AS {alias}"


def readings_cte(dense: bool = True, name: str = "r") -> str:
    return f"{name} AS ({events_readings_sql(dense)})"


def lineitem_readings_cte(name: str = "r", wide: bool = False) -> str:
    return f"{name} AS ({lineitem_wide_readings_sql() if wide else lineitem_readings_sql()})"


def to_double_sql(expr: str) -> str:
    return f"nullif(TRY_CAST({expr} AS DOUBLE), CAST('NaN' AS DOUBLE))"


def pivot_cte(src: str = "r", name: str = "p", keys=("location", "timestamp"), types=NUMERIC_COLS) -> str:
    k = ", ".join(keys)
    cols = ", ".join(
        f"{to_double_sql(f'arg_min(value, ord) FILTER (WHERE value_type = {chr(39)}{t}{chr(39)})')} AS {t}"
        for t in types)
    return (f"{name} AS (SELECT {k}, {cols} FROM {src} "
            f"WHERE value IS NOT NULL AND location IS NOT NULL GROUP BY {k})")


def hourly_cte(src: str = "p", name: str = "h", types=NUMERIC_COLS) -> str:
    cols = ", ".join(f"avg({t}) AS {t}" for t in types)
    return (f"{name} AS (SELECT location, date_trunc('hour', timestamp) AS timestamp, {cols} "
            f"FROM {src} GROUP BY 1, 2)")


def hourly_chain(dense: bool = True) -> str:
    """r -> p -> h, ready for ``WITH``."""
    return ", ".join([readings_cte(dense), pivot_cte(), hourly_cte()])


def features_cte(src: str = "h", name: str = "f") -> str:
    """Calendar + sanitised/interpolated temperature + 18 lags (see operators.features)."""
    lags = []
    for v in ("P0", "P1", "P2"):
        for n in (1, 2, 3, 4, 5, 24):
            lags.append(f"lag({v}, {n}) OVER w AS {v}_lag_{n}")
    return f"""
    s0 AS (SELECT location, timestamp, P0, P1, P2, humidity,
                  CASE WHEN temperature > 60 THEN NULL ELSE temperature END AS temperature,
                  row_number() OVER (PARTITION BY location ORDER BY timestamp) AS rn
           FROM {src}),
    s1 AS (SELECT *,
             last_value(CASE WHEN temperature IS NOT NULL THEN rn END IGNORE NULLS) OVER
               (PARTITION BY location ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_r,
             last_value(temperature IGNORE NULLS) OVER
               (PARTITION BY location ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a_v,
             first_value(CASE WHEN temperature IS NOT NULL THEN rn END IGNORE NULLS) OVER
               (PARTITION BY location ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b_r,
             first_value(temperature IGNORE NULLS) OVER
               (PARTITION BY location ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b_v
           FROM s0),
    {name} AS (SELECT location, timestamp, P0, P1, P2, humidity,
             CASE WHEN temperature IS NOT NULL THEN temperature
                  WHEN a_r IS NULL THEN NULL
                  WHEN b_r IS NULL THEN a_v
                  ELSE a_v + (b_v - a_v) * (rn - a_r) / (b_r - a_r) END AS temperature,
             CAST(hour(timestamp) AS BIGINT) AS heure,
             dayname(timestamp) AS jour_semaine,
             CASE WHEN isodow(timestamp) >= 6 THEN 'weekend' ELSE 'semaine' END AS periode,
             {", ".join(lags)}
           FROM s1 WINDOW w AS (PARTITION BY location ORDER BY timestamp))"""
