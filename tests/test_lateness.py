import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoweave.functions.times import written_day
from chronoweave.operators import lateness

A = "assertion_id bigint, source_id bigint, event_time date, published_at string, ingested_at timestamp, confidence double, event_month string, day string"


@pytest.mark.parametrize(
    "text, want",
    [
        ("2022-03-01", "2022-03-01"), ("2022/03/01", "2022-03-01"), ("20220301", "2022-03-01"), ("01.03.2022", "2022-03-01"), ("1.3.2022", "2022-03-01"),
        ("1 March 2022", "2022-03-01"), ("March 1, 2022", "2022-03-01"), ("Mar 1, 2022", "2022-03-01"), ("Tue, 01 Mar 2022 23:59:59 GMT", "2022-03-01"),
        ("2022-03-01T23:30:00-08:00", "2022-03-01"), ("2022-03-01T00:30:00+09:00", "2022-03-01"), ("2022-03-01 10:00", "2022-03-01"), (" 2022-03-01 ", "2022-03-01"),
        ("2022-02-30", None), ("2022-13-01", None), ("0000-00-00", None), ("31.04.2022", None), ("unknown", None), ("", None), (None, None), ("last spring", None),
        ("May 2022", None), ("12 Foo 2022", None), ("29 February 2023", None), ("29 February 2024", "2024-02-29"), ("x" * 5000, None), ("202203011", None),
    ],
)
def test_written_day(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(written_day(F.col("t")).cast("string")).first()[0]
    assert got == want


def rows(at):
    d = dt.date
    return [
        (1, 1, d(2022, 1, 31), None, at("2022-04-01T23:59:59"), 0.5, "x", "y"),  # last instant in time
        (2, 1, d(2022, 1, 1), None, at("2022-04-02"), 0.7, "x", "y"),  # 60 days after 1 February
        (2, 1, d(2022, 1, 1), None, at("2023-04-02"), 0.7, "x", "y"),
        (3, 2, d(2022, 1, 1), None, at("2023-04-02"), float("nan"), "x", "y"),
        (3, 2, d(2022, 1, 1), None, at("2022-01-02"), float("nan"), "x", "y"),  # an earlier copy brings it back in time
        (4, None, None, "5 January 2022", at("2022-01-09"), 0.9, "x", "y"),
        (5, 2, None, "tba", at("2022-01-09"), 0.9, "x", "y"),
        (6, 2, d(2022, 1, 5), None, None, None, "x", "y"),
        (None, 2, d(2022, 1, 5), None, at("2022-01-09"), 0.9, "x", "y"),
    ]


def test_cut_off_and_counters(spark, at):
    records = lateness.registers(spark.createDataFrame(rows(at) * 2, A))
    assert [tuple(x) for x in lateness.late_records(records).collect()] == [("2022-01", 2)]
    for cuts in ((), ("2020-01-01", "2022-01-09", "2023-01-01")):
        (total,) = lateness.totals(lateness.count_by_waves(records, cuts)).collect()
        assert (total.event_month, total.records, total.late_records) == ("2022-01", 4, 1)
        assert total.mean_confidence == pytest.approx(0.7)


def claims(at, spark):
    more = [(k, k % 3 or None, dt.date(2022, 1 + k % 2, 3), None, at(f"2022-0{1 + k % 9}-20"), k / 50, "", "") for k in range(60)]
    return lateness.registers(spark.createDataFrame(more, A))


def held(state):
    return sorted(((m, n, late, round(c, 9)) for m, n, late, c in map(tuple, lateness.totals(state).collect())), key=str)


def test_waves_repeats_and_order_do_not_matter(spark, at):
    records = claims(at, spark)
    want = held(lateness.count_by_waves(records, ()))
    assert sum(n + late for _, n, late, _ in want) == 60 and any(late for _, _, late, _ in want)
    assert held(lateness.count_by_waves(records, ("2022-03-01",))) == want
    assert held(lateness.count_by_waves(records, ("2022-02-01", "2022-04-01", "2022-06-01"), repeat=True)) == want


def test_deliveries_in_any_order_and_a_wave_published_twice(spark, at):
    added = lateness.increments(claims(at, spark), ("2022-04-01",)).cache()
    first = lateness.publish(None, added.where("sequence = 1")).cache()
    second = lateness.publish(first, added.where("sequence = 2")).cache()
    want = held(lateness.merge(first, second))
    assert sum(n + late for _, n, late, _ in want) == 60
    for deliveries in ((second, first), (second, second, first, first), (first, second, first)):
        assert held(lateness.merge(*deliveries)) == want
    # Counting a wave on from a state that has it already adds nothing.
    merged = lateness.merge(first, second)
    assert lateness.publish(merged, added.where("sequence = 2")).count() == 0


def test_empty(spark):
    records = lateness.registers(spark.createDataFrame([], A))
    assert lateness.late_records(records).count() == 0
    assert lateness.totals(lateness.count_by_waves(records)).count() == 0
