"""Resampling and KPI queries."""

from __future__ import annotations

from airseries.operators import hourly as H
from airseries.operators.kpi import calculate_kpis
from airseries.operators.resample import resample_mean
from airseries.plans.oracle import hourly_chain, hourly_cte, lineitem_readings_cte, pivot_cte, r6, readings_cte
from airseries.plans.registry import register
from airseries.sources.readings import events_readings, lineitem_readings

WEEK_MON_SQL = "(CAST(timestamp AS DATE) + CAST((8 - isodow(timestamp)) % 7 AS INTEGER))"


def _hourly(spark, sf_dir):
    return H.hourly_wide(events_readings(spark, sf_dir))


def _li_hourly(spark, sf_dir):
    return H.hourly_wide(lineitem_readings(spark, sf_dir), value_types=["P2"])


def _li_chain():
    return f"{lineitem_readings_cte()}, {pivot_cte(types=['P2'])}, {hourly_cte(types=['P2'])}"


def _resample_sql(chain: str, src: str, bucket: str, step: str, cols, as_date=False) -> str:
    avgs = ", ".join(f"avg({c}) AS {c}" for c in cols)
    outs = ", ".join(r6(f"m.{c}", c) for c in cols)
    lo, hi = ("CAST(lo AS TIMESTAMP)", "CAST(hi AS TIMESTAMP)")
    gen = f"unnest(generate_series({lo}, {hi}, {step}))"
    if as_date:
        gen = f"CAST({gen} AS DATE)"
    return f"""
WITH {chain},
m AS (SELECT location, {bucket} AS b, {avgs} FROM {src} GROUP BY 1, 2),
bd AS (SELECT location, min(b) AS lo, max(b) AS hi FROM m GROUP BY 1),
g AS (SELECT location, {gen} AS b FROM bd)
SELECT g.location, g.b AS timestamp, {outs} FROM g LEFT JOIN m ON g.location = m.location AND g.b = m.b
"""


_HCOLS = ["P0", "P1", "P2", "humidity", "temperature"]
_RAW_CHAIN = f"{readings_cte()}, {pivot_cte()}"


@register("resample_hour", _resample_sql(_RAW_CHAIN, "p", "date_trunc('hour', timestamp)",
                                         "INTERVAL 1 HOUR", _HCOLS))
def resample_hour(spark, sf_dir):
    """A5: regular 1-hour grid of the per-timestamp series, empty hours as NULL."""
    p = H.pivot_first(events_readings(spark, sf_dir))
    return resample_mean(p, "hour", _HCOLS)


@register("resample_day", _resample_sql(hourly_chain(), "h", "date_trunc('day', timestamp)",
                                        "INTERVAL 1 DAY", ["P2", "temperature"]))
def resample_day(spark, sf_dir):
    """Daily means with empty days."""
    return resample_mean(_hourly(spark, sf_dir), "day", ["P2", "temperature"])


@register("resample_week_mon", _resample_sql(hourly_chain(), "h", WEEK_MON_SQL,
                                             "INTERVAL 7 DAY", ["P2", "temperature"], as_date=True))
def resample_week_mon(spark, sf_dir):
    """Weeks Tuesday..Monday labelled by the closing Monday."""
    return resample_mean(_hourly(spark, sf_dir), "week_mon", ["P2", "temperature"])


@register("resample_month", _resample_sql(_li_chain(), "h", "date_trunc('month', timestamp)",
                                          "INTERVAL 1 MONTH", ["P2"]))
def resample_month(spark, sf_dir):
    """Month-start buckets over the multi-year lineitem series."""
    return resample_mean(_li_hourly(spark, sf_dir), "month", ["P2"])


@register("resample_week_mon_long", _resample_sql(_li_chain(), "h", WEEK_MON_SQL,
                                                  "INTERVAL 7 DAY", ["P2"], as_date=True))
def resample_week_mon_long(spark, sf_dir):
    """A7 over the multi-year series (hundreds of weeks, many empty)."""
    return resample_mean(_li_hourly(spark, sf_dir), "week_mon", ["P2"])


# --------------------------------------------------------------------- KPIs
def _var_sql(s: str) -> str:
    ok = f"(p_{s} IS NOT NULL AND NOT isnan(p_{s}) AND p_{s} <> 0)"
    return (f"{r6(f'CASE WHEN {ok} THEN c_{s} - p_{s} END', f'{s}_delta')}, "
            f"{r6(f'CASE WHEN {ok} THEN (c_{s} - p_{s}) / p_{s} * 100 END', f'{s}_delta_pct')}")


def _pack_sql(src: str) -> str:
    return (f"SELECT location, {r6('c_min', 'min')}, {r6('c_mean', 'mean')}, {r6('c_max', 'max')}, "
            f"{_var_sql('min')}, {_var_sql('mean')}, {_var_sql('max')}, period_label FROM {src}")


def _daily_kpi_sql(chain: str) -> str:
    return f"""
WITH {chain},
d AS (SELECT location, CAST(timestamp AS DATE) AS d, P2 FROM h),
d1 AS (SELECT *, max(d) OVER (PARTITION BY location) AS dl FROM d),
a AS (SELECT location,
        min(P2) FILTER (WHERE d = dl) AS c_min, avg(P2) FILTER (WHERE d = dl) AS c_mean,
        max(P2) FILTER (WHERE d = dl) AS c_max,
        min(P2) FILTER (WHERE d = dl - 1) AS p_min, avg(P2) FILTER (WHERE d = dl - 1) AS p_mean,
        max(P2) FILTER (WHERE d = dl - 1) AS p_max,
        strftime(max(dl), '%d/%m/%Y') AS period_label
      FROM d1 GROUP BY location)
{_pack_sql('a')}
"""


def _bucket_kpi_sql(chain: str, bucket: str, step: str, k: int, as_date: bool) -> str:
    gen = "unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), {}))".format(step)
    if as_date:
        gen = f"CAST({gen} AS DATE)"
    return f"""
WITH {chain},
m AS (SELECT location, {bucket} AS b, avg(P2) AS v FROM h GROUP BY 1, 2),
bd AS (SELECT location, min(b) AS lo, max(b) AS hi FROM m GROUP BY 1),
g AS (SELECT location, {gen} AS b FROM bd),
x AS (SELECT g.location, g.b, m.v FROM g LEFT JOIN m ON g.location = m.location AND g.b = m.b),
y AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY b DESC) AS k,
             count(*) OVER (PARTITION BY location) AS n FROM x),
z AS (SELECT *, k <= {k} AS cur,
             CASE WHEN n >= {2 * k} THEN k BETWEEN {k + 1} AND {2 * k}
                  WHEN n >= {k + 1} THEN k BETWEEN 2 AND {k + 1} ELSE false END AS prev
      FROM y WHERE n >= 2),
a AS (SELECT location,
        min(v) FILTER (WHERE cur) AS c_min, avg(v) FILTER (WHERE cur) AS c_mean, max(v) FILTER (WHERE cur) AS c_max,
        min(v) FILTER (WHERE prev) AS p_min, avg(v) FILTER (WHERE prev) AS p_mean, max(v) FILTER (WHERE prev) AS p_max,
        strftime(min(b) FILTER (WHERE cur), '%d/%m') || ' - ' || strftime(max(b) FILTER (WHERE cur), '%d/%m') AS period_label
      FROM z GROUP BY location)
{_pack_sql('a')}
"""


@register("kpi_daily", _daily_kpi_sql(hourly_chain()))
def kpi_daily(spark, sf_dir):
    """A14 'D': last day vs previous calendar day, PM2.5."""
    return calculate_kpis(_hourly(spark, sf_dir), "P2", "D")


@register("kpi_weekly", _bucket_kpi_sql(hourly_chain(), "date_trunc('day', timestamp)", "INTERVAL 1 DAY", 7, False))
def kpi_weekly(spark, sf_dir):
    """A14 'W': last 7 daily means vs previous 7 (30-day span: long branch)."""
    return calculate_kpis(_hourly(spark, sf_dir), "P2", "W")


@register("kpi_4weekly", _bucket_kpi_sql(hourly_chain(), WEEK_MON_SQL, "INTERVAL 7 DAY", 4, True))
def kpi_4weekly(spark, sf_dir):
    """A14 'M': last 4 W-MON means vs previous (5-7 bucket branch on 30 days)."""
    return calculate_kpis(_hourly(spark, sf_dir), "P2", "M")


@register("kpi_daily_long", _daily_kpi_sql(_li_chain()))
def kpi_daily_long(spark, sf_dir):
    """A14 'D' on the multi-year series (previous day often absent)."""
    return calculate_kpis(_li_hourly(spark, sf_dir), "P2", "D")


@register("kpi_4weekly_long", _bucket_kpi_sql(_li_chain(), WEEK_MON_SQL, "INTERVAL 7 DAY", 4, True))
def kpi_4weekly_long(spark, sf_dir):
    """A14 'M' on the multi-year series (>= 8 bucket branch)."""
    return calculate_kpis(_li_hourly(spark, sf_dir), "P2", "M")
