from __future__ import annotations

import datetime as dt

from playlens.sources import dimensions
from playlens.sources.bindings import PHASE_WEIGHTS


def test_growth_weights_sum_to_one_per_phase(spark):
    sums = dimensions.growth_weight_dimension(spark, PHASE_WEIGHTS).groupBy("phase").sum("expected_weight").collect()
    assert {(r[0], round(r[1], 9)) for r in sums} == {(1, 1.0), (2, 1.0), (3, 1.0)}


def test_cohorts(spark):
    start = dt.date(2024, 5, 1)
    rows = {r.cohort_id: (r.name, r.create_date) for r in dimensions.cohort_dimension(spark, start).collect()}
    assert len(rows) == 8
    assert rows[1] == ("veteran_player", start)
    assert rows[5] == ("latam_players", start + dt.timedelta(days=60))


def test_sample_locations(spark):
    rows = dimensions.sample_locations(spark).collect()
    assert len(rows) == 10
    assert rows[0].city == "New York" and rows[0].active_sessions == 150
