"""Registered queries hold every row of their tables: results against versions without a cut."""

from collections import defaultdict

import pytest

from fluvigrid.plans import catalogue

from oracle import connect, same


def test_simulation_runs_all_nations(spark, sf):
    covers = ["Coniferous Forest", "Grass Land", "Cultivated", "Deciduous Forest"]
    want = defaultdict(float)
    for n, region in connect(sf).execute("select n_nationkey, n_regionkey from nation").fetchall():
        want[region, covers[n % 4], str(n % 2)] += 1 + n % 3
    got = catalogue.brook90_run(spark, sf).select("catchment", "cover", "soil", "area").distinct().collect()
    assert sorted(tuple(r) for r in got) == sorted((*k, area) for k, area in want.items())


def whole(spark, sf, name, cut):
    """The query equals its SQL with ``cut`` taken out."""
    same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name].replace(cut, ""), sf)


def test_gap_fill_reads_all_stations_and_events(spark, sf):
    whole(spark, sf, "gapfill_calendar", " WHERE user_id % 50 < 40 AND event_id % 5 = 0")
    want = connect(sf).execute("select distinct user_id % 50 from events").fetchall()
    assert catalogue.gapfill_calendar(spark, sf).select("station").distinct().count() == len(want)


@pytest.mark.parametrize("name", ["asof_leq", "asof_geq", "asof_nearest"])
def test_as_of_looks_up_all_events(spark, sf, name):
    whole(spark, sf, name, " WHERE event_id % 3 = 0")


@pytest.mark.parametrize("name", ["obs_forecast_splice", "comma_series"])
def test_splice_observes_all_events(spark, sf, name):
    whole(spark, sf, name, " WHERE event_id % 3 = 0")


def test_splice_sums_all_events(spark, sf):
    want = connect(sf).execute("select sum(value::DECIMAL(18,2))::DOUBLE from events").fetchone()[0]
    got = catalogue.obs_forecast_splice(spark, sf).where("kind = 'observed'").groupBy().sum("v").first()[0]
    assert round(got, 2) == round(want, 2)


def test_downstream_starts_at_every_catchment(spark, sf):
    whole(spark, sf, "downstream_ids", " WHERE id % 100 = 99")
