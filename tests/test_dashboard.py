"""The dashboard builder returns every table for all locations at once."""

from airseries.operators import hourly as H
from airseries.operators.features import add_features
from airseries.plans.dashboard import dashboard_tables
from airseries.sources.dimension import fixture_dim
from airseries.sources.readings import events_readings
from tests.conftest import SF001


def test_dashboard_tables(spark):
    series = add_features(H.hourly_wide(events_readings(spark, SF001)))
    tabs = dashboard_tables(series, fixture_dim(spark), "PM2.5", 24, "W")
    assert set(tabs) == {"current", "map", "kpis", "heatmap", "export"}
    cur = tabs["current"].collect()
    assert len(cur) == 6 and all(r["threshold"] == 15.0 for r in cur)
    assert tabs["map"].count() == 6
    assert tabs["kpis"].count() == 6
    assert tabs["heatmap"].where("day_rank BETWEEN 1 AND 7").count() == tabs["heatmap"].count()
