"""How often queries make their panels."""

from pathlib import Path

import pytest

from stallwise.plans import check_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no tables")
def test_freshness_groups_the_events_once(spark, monkeypatch):
    made, panel_b = [], check_queries.panels.panel_b
    monkeypatch.setattr(check_queries.panels, "panel_b", lambda *a: made.append(a) or panel_b(*a))
    row = check_queries.freshness(spark, DATA).first()
    assert len(made) == 1 and row["days_behind"] == 3 and row["n_written"] == 2
