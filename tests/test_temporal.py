import pytest
from pyspark.sql import functions as F

from chronoweave import Pattern, Spine, ValidationError, Var
from chronoweave.operators import metrics, temporal


@pytest.fixture
def graph(versions):
    return versions(
        ("A", "L", "B", "2026-01-05", "2026-01-10", 0.5), ("A", "L", "B", "2026-01-20", None, None), ("A", "L", "C", "2026-01-01", None, 0.9),
        ("B", "M", "C", "2026-01-03", "2026-01-05", 0.2), ("A", "L", "A", "2026-01-01", None, 0.0), ("C", "L", "B", "2025-12-01", "2025-12-31", 0.4),
        ("A", "L", "C", "2026-01-02", "2026-01-08", 0.3),
    )


def ids(frame):
    return sorted(r["version_id"] for r in frame.select("version_id").collect())


def test_closed_interval(graph):
    p = Pattern("A", "L", "B")
    assert [ids(temporal.as_of(graph, p, f"2026-01-{d:02d}")) for d in (4, 5, 10, 11, 20, 31)] == [[], [1], [1], [], [2], [2]]


def test_patterns(graph):
    day = "2026-01-05"
    assert ids(temporal.as_of(graph, Pattern("A"), day)) == [1, 3, 5, 7]
    assert ids(temporal.as_of(graph, Pattern(None, None, "C"), day)) == [3, 4, 7]
    assert ids(temporal.as_of(graph, Pattern(None, "M"), day)) == [4]
    assert ids(temporal.as_of(graph, Pattern(), day)) == [1, 3, 4, 5, 7]
    for bad in ("", "a\0b"):
        with pytest.raises(ValidationError):
            temporal.as_of(graph, Pattern(bad), day)


def test_filters_reach_the_scan(spark, graph, tmp_path):
    graph.write.parquet(str(tmp_path / "v"))
    found = temporal.as_of(spark.read.parquet(str(tmp_path / "v")), Pattern("A"), "2026-01-05").select("object_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(subject_id,A)" in plan and "LessThanOrEqual(valid_from,2026-01-05)" in plan
    assert "confidence" not in plan


def test_known_by_is_half_open(graph):
    p = Pattern("A", "L", "B")
    assert ids(temporal.as_known(graph, p, "2026-01-06", "2026-01-07")) == [1]
    assert ids(temporal.as_known(graph, p, "2026-01-06", "2026-01-10T00:00:00")) == []
    assert ids(temporal.as_known(graph, p, "2026-01-06", "2026-01-04T23:59:59.999999")) == []
    assert ids(temporal.as_known(graph, p, "2026-01-06", "2026-01-05T01:00:00+01:00")) == [1]
    assert ids(temporal.as_known(graph, p, "2026-01-06", "2027-01-01")) == []


def test_history_window_and_limit(graph):
    p = Pattern("A", "L", "B")
    assert ids(temporal.history(graph, p)) == [1, 2]
    assert ids(temporal.history(graph, p, "2026-01-11", "2026-01-19")) == []
    assert ids(temporal.history(graph, p, None, "2026-01-19")) == [1]
    assert ids(temporal.history(graph, p, "2026-01-10")) == [1, 2]
    order = temporal.history_order(Pattern("A"))
    rows = temporal.first_rows(temporal.history(graph, Pattern("A")), order, 2).collect()
    assert [r["version_id"] for r in rows] == [3, 5]
    with pytest.raises(ValidationError):
        temporal.first_rows(graph, ["version_id"], -1)


@pytest.mark.parametrize("op, want", [(">", [1, 3]), ("<", [5, 6, 7, 4]), ("=", []), ("!=", [1, 3, 4, 5, 6, 7]), (">=", [1, 3, 6]), ("<=", [4, 5, 6, 7])])
def test_where_never_matches_null(graph, op, want):
    value = 0.4 if op in (">=", "<=") else 0.45
    assert ids(temporal.where_confidence(graph, op, value)) == sorted(want)


def test_diff_counts_what_opens_and_closes_twice(graph):
    tagged = {(r["version_id"], r["change"]) for r in temporal.changes(graph, "2026-01-02", "2026-01-15").collect()}
    assert tagged == {(1, "opened"), (1, "closed"), (3, "persisted"), (4, "opened"), (4, "closed"), (5, "persisted"), (7, "closed")}
    edge = {(r["version_id"], r["change"]) for r in temporal.changes(graph, "2026-01-05", "2026-01-10", Pattern("A", "L", "B")).collect()}
    assert edge == {(1, "persisted")}


def test_node_changes_are_netted(versions):
    v = versions(("N", "S", "AMD", "2026-01-01", "2026-01-02", 1.0), ("N", "S", "Apple", "2026-01-03", None, 1.0), ("N", "S", "Intel", "2026-01-01", "2026-01-02", 1.0), ("N", "S", "Intel", "2026-01-04", None, 1.0))
    delta = temporal.diff(v, "2026-01-01", "2026-01-04", Pattern("N")).as_dict()
    assert (delta["nodes_added"], delta["nodes_removed"]) == (["Apple"], ["AMD"])


def test_day_counts(versions):
    v = versions(("N", "S", "X", "2026-01-01", "2026-01-02", 1.0), ("N", "S", "X", "2026-01-05", "2026-01-06", 1.0), ("M", "S", "X", "2025-12-30", None, 1.0), ("M", "S", "X", "2026-01-02", "2026-01-01", 1.0))
    assert [tuple(r) for r in temporal.day_counts(v, Pattern("N"), "2026-01-01", "2026-01-31").collect()] == [("X", 4)]
    got = dict(map(tuple, temporal.day_counts(v, Pattern(None, None, "X"), "2026-01-01", "2026-01-10").collect()))
    assert got == {"N": 4, "M": 10}


def test_spine_and_series(spark, graph):
    assert [str(r["date"]) for r in Spine.of("2026-01-01", "2026-01-10", 4).frame(spark).orderBy("tick").collect()] == ["2026-01-01", "2026-01-05", "2026-01-09"]
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValidationError):
            Spine.of("2026-01-01", "2026-01-10", bad)
    assert Spine.of("2026-01-10", "2026-01-01").size == 0
    series = temporal.GraphSeries(graph, Pattern("A", "L", "B"), Spine.of("2026-01-04", "2026-01-25", 3))
    slow = [(r["date"], ids(series.at(r["date"]))) for r in series.dates().orderBy("date").collect()]
    assert [(d, sorted(x["version_id"] for x in facts)) for d, facts in series] == slow
    assert [(r["date"], r["facts"]) for r in series.counts().orderBy("date").collect()] == [(d, len(f)) for d, f in slow]
    empty = temporal.GraphSeries(graph, Pattern("nobody"), Spine.of("2026-01-04", "2026-01-05"))
    assert [len(f) for _, f in empty] == [0, 0]


@pytest.mark.parametrize("step", [1, 3, 7])
def test_tracks_equal_the_value_of_every_date(graph, step):
    spine = Spine.of("2025-12-28", "2026-01-25", step)
    degree = {(r["entity"], r["date"]): r["value"] for r in metrics.track_degree(graph, spine).collect()}
    weighted = {(r["entity"], r["date"]): r["value"] for r in metrics.track_weighted_degree(graph, spine).collect()}
    dates = [r["date"] for r in spine.frame(graph.sparkSession).collect()]
    assert len(degree) == len(dates) * 3
    for d in dates:
        at = {r["entity"]: r for r in metrics.degrees(graph, d).collect()}
        for e in "ABC":
            assert degree[e, d] == (at[e]["degree"] if e in at else 0)
            assert weighted.get((e, d), 0.0) == pytest.approx(at[e]["weighted_degree"] if e in at else 0.0)


def test_degree_counts_relationships_once(graph):
    assert metrics.degree(graph, "A", "2026-01-05") == 3  # B, C (two versions), itself
    assert metrics.degree(graph, "A", "2026-01-05", weighted=True) == pytest.approx(0.5 + 0.3 + 0.0)
    assert metrics.degree(graph, "nobody", "2026-01-05") == 0.0


def test_edge_weight_track_is_null_where_nothing_is_open(graph):
    spine = Spine.of("2026-01-08", "2026-01-21", 1)
    signal = metrics.densify(metrics.track_edge_weight(graph, spine, Pattern("A", "L", "B")), spine, None)
    values = [r["value"] for r in signal.orderBy("date").collect()]
    assert values == [0.5] * 3 + [None] * 11


def test_signal_join_keeps_null(spark, graph, day):
    signal = metrics.GraphSignal(spark.createDataFrame([(day("2026-01-01"), 1.0), (day("2026-01-02"), None)], "date date, value double"))
    got = sorted(map(tuple, signal.join({"2026-01-02": 5, "2026-01-03": 6}).collect()))
    assert got == [(day("2026-01-02"), None, 5.0)]


def test_bindings_do_not_unify(graph):
    p = Pattern(Var("x"), "L", Var("x"))
    got = p.filter(graph).select("object_id", p.bindings().alias("b")).collect()
    assert all(r["b"] == {"x": r["object_id"]} for r in got)
    assert Pattern("A").filter(graph).select(Pattern("A").bindings().alias("b")).first()["b"] == {}


def test_early_dates(versions):
    v = versions(("A", "L", "B", "0001-01-01", "9999-12-31", 0.5))
    assert ids(temporal.as_of(v, Pattern(), "0001-01-01")) == [1] == ids(temporal.as_of(v, Pattern(), "9999-12-31"))
    for bad in ("2026-1-5", "2026-02-30", "x", None, 5):
        with pytest.raises(ValidationError):
            temporal.as_of(v, Pattern(), bad)


def test_series_rows_count_like_explode(graph):
    spine = Spine.of("2025-11-01", "2026-02-01", 5)
    total = temporal.series_counts(graph, Pattern(), spine).agg(F.sum("facts")).first()[0]
    assert total == temporal.series_rows(graph, Pattern(), spine).count()
