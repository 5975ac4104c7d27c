import __spark_entry__ as entry
import pytest
from chronoweave.plans import registry

SMALL = "/root/testdata/sf0.001"


def test_names_and_twins():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {f"p{n}_found" for n in range(1, 8)} <= names
    assert entry.entry.__doc__
    p3 = [n for n in entry.queries() if n.startswith("p3_")]
    assert p3[0] == "p3_method"


def test_flagship(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", ["p1_found", "p3_monthly", "p5_periods", "match_known_by", "track_degree", "fold_assert_retract", "changepoints", "path_edges", "p3_method", "log_assertions", "restore_then_write", "version_rows"])
def test_runs(spark, name):
    frame = registry.queries()[name](spark, SMALL)
    assert frame.count() >= 0 and frame.columns
