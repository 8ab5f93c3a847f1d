"""Air-quality index, category and guideline functions as native Column expressions.

The band table becomes one ``CASE`` chain evaluated inside whole-stage codegen;
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airseries.functions.constants import (
    AQI_BP_PM10,
    AQI_BP_PM25,
    AQI_CATEGORIES,
    SUBSTANCE_MAP,
    WHO_DEFAULT,
    WHO_THRESHOLDS,
)


def _bands(substance: str):
    # Any substance other than PM2.5 uses the PM10 table.
    return AQI_BP_PM25 if substance == "PM2.5" else AQI_BP_PM10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def aqi(concentration, substance: str = "PM2.5", gaps: str = "as_reference") -> Column:
    """Piecewise-linear index, half-to-even rounded, as BIGINT.

    Null, NaN or negative -> 0; outside every band -> 500.  With the default
    ``gaps="as_reference"`` values that fall between two bands (12.0 < c < 12.1
    for PM2.5, 54 < c < 55 for PM10, ...) match no band and give 500.
    ``gaps="truncate"`` floors the value to the band precision first.
    """
    c = _col(concentration).cast("double")
    bands = _bands(substance)
    if gaps == "truncate":
        scale = 10.0 if substance == "PM2.5" else 1.0
        c = F.floor(c * F.lit(scale)) / F.lit(scale)
    elif gaps != "as_reference":
        raise ValueError("gaps must be 'as_reference' or 'truncate'")
    expr = F.when(c.isNull() | F.isnan(c) | (c < F.lit(0.0)), F.lit(0.0))
    for c_lo, c_hi, i_lo, i_hi in bands:
        lo, hi = float(c_lo), float(c_hi)
        slope = (float(i_hi) - float(i_lo)) / (hi - lo)
        expr = expr.when((c >= F.lit(lo)) & (c <= F.lit(hi)),
                         F.rint(F.lit(slope) * (c - F.lit(lo)) + F.lit(float(i_lo))))
    return expr.otherwise(F.lit(500.0)).cast("bigint")


def aqi_sql(expr: str, substance: str = "PM2.5") -> str:
    """The same band chain as portable SQL text (used by oracles and SQL users)."""
    d = "CAST({} AS DOUBLE)".format
    parts = [f"CASE WHEN ({expr}) IS NULL OR isnan({expr}) OR ({expr}) < 0 THEN 0"]
    for c_lo, c_hi, i_lo, i_hi in _bands(substance):
        slope = f"(({d(i_hi)} - {d(i_lo)}) / ({d(c_hi)} - {d(c_lo)}))"
        parts.append(
            f"WHEN ({expr}) >= {d(c_lo)} AND ({expr}) <= {d(c_hi)} "
            f"THEN round_even({slope} * (({expr}) - {d(c_lo)}) + {d(i_lo)}, 0)")
    parts.append("ELSE 500 END")
    return "CAST(" + " ".join(parts) + " AS BIGINT)"


def aqi_category(aqi_col) -> Column:
    """STRUCT<label, color, marker> for an index value."""
    a = _col(aqi_col)
    expr = None
    for bound, label, color, marker in AQI_CATEGORIES:
        val = F.struct(F.lit(label).alias("label"), F.lit(color).alias("color"),
                       F.lit(marker).alias("marker"))
        if bound is None:
            return expr.otherwise(val)
        cond = a <= F.lit(bound)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return expr


def aqi_category_sql(expr: str, field: str = "label") -> str:
    idx = {"label": 1, "color": 2, "marker": 3}[field]
    arms = []
    for row in AQI_CATEGORIES:
        bound, val = row[0], row[idx]
        if bound is None:
            arms.append(f"ELSE '{val}' END")
        else:
            arms.append(f"WHEN ({expr}) <= {bound} THEN '{val}'")
    return "CASE " + " ".join(arms)


def who_threshold(substance: str) -> float:
    return float(WHO_THRESHOLDS.get(substance, WHO_DEFAULT))


def who_exceedance(mean_col, substance: str = "PM2.5") -> Column:
    """Strictly above the 24 h guideline."""
    return _col(mean_col) > F.lit(who_threshold(substance))


def substance_column(substance: str) -> str:
    return SUBSTANCE_MAP.get(substance, "P2")
