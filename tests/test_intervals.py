import datetime as dt
import random

import pytest

from chronoweave.operators import intervals

V = "relationship_id bigint, valid_from date, valid_to date, entity string, n int, after int"
FAR = dt.date(9999, 12, 31)


def brute(rows):
    gaps, periods = set(), set()
    for rel in {r[0] for r in rows} - {None}:
        spans = sorted((a, b or FAR) for r, a, b, *_ in rows if r == rel and a is not None and (b is None or b >= a))
        if not spans:
            continue
        start, end = spans[0]
        for a, b in spans[1:]:
            if end < FAR and a > end + dt.timedelta(days=1):
                gaps.add((rel, end + dt.timedelta(days=1), a - dt.timedelta(days=1)))
                periods.add((rel, start, end))
                start, end = a, b
            end = max(end, b)
        periods.add((rel, start, end if end < FAR else None))
    return gaps, periods


@pytest.mark.parametrize("seed", range(4))
def test_gaps_and_periods(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(300):
        a = dt.date(2022, 1, 1) + dt.timedelta(days=r.randint(0, 200))
        b = a + dt.timedelta(days=r.randint(-5, 12))
        rel = 1 if r.random() < 0.3 else r.randint(1, 40)
        rows.append((None if r.random() < 0.02 else rel, None if r.random() < 0.02 else a, None if r.random() < 0.03 else b, "e", 1, 2))
    rows += rows[:30]
    rows.append((77, dt.date(2022, 1, 1), FAR, "e", 1, 1))
    frame = spark.createDataFrame(rows, V)
    gaps, periods = brute(rows)
    got = [tuple(x) for x in intervals.gaps(frame).collect()]
    assert sorted(got) == sorted(gaps)
    got = [tuple(x) for x in intervals.periods(frame).collect()]
    assert sorted(got, key=str) == sorted(periods, key=str)


def test_touching_nested_and_one_day(spark, day):
    rows = [(1, day("2022-01-01"), day("2022-01-05")), (1, day("2022-01-06"), day("2022-01-09")), (1, day("2022-01-02"), day("2022-01-03")), (1, day("2022-01-11"), day("2022-01-11"))]
    frame = spark.createDataFrame(rows, "relationship_id bigint, valid_from date, valid_to date")
    assert [tuple(x) for x in intervals.gaps(frame).collect()] == [(1, day("2022-01-10"), day("2022-01-10"))]
    assert [tuple(x)[1:] for x in intervals.periods(frame).orderBy("period_from").collect()] == [(day("2022-01-01"), day("2022-01-09")), (day("2022-01-11"), day("2022-01-11"))]


def test_empty(spark):
    frame = spark.createDataFrame([], V)
    assert intervals.gaps(frame).count() == 0 and intervals.periods(frame).count() == 0
