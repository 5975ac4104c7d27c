import datetime as dt
import random

import pytest

from chronoweave.operators import history

S = "snapshot_id bigint, taken_on date, received_at timestamp, subject_id string, predicate string, object_id string, confidence double, day string, op string"


def deliveries(seed, at):
    r = random.Random(seed)
    rows, sid = [], 0
    for s in ("a", "b", "hub"):
        for k in range(60 if s == "hub" else 20):
            if r.random() < 0.15:
                continue
            day = dt.date(2022, 1, 1) + dt.timedelta(days=7 * k)
            for _ in range(r.choice([1, 1, 1, 2])):
                sid += 1
                got = at(f"2022-{r.randint(1, 12):02d}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}") if r.random() > 0.05 else None
                held = [o for o in "pqrst" if r.random() < 0.6] or [None]
                part = [(sid, day, got, s, "P", o, r.choice([None, float("nan"), 0.5]), "x", "y") for o in held]
                rows += part + part[:1] * r.choice([0, 0, 1])
    rows += [(999, None, None, "a", "P", "q", 0.1, "", ""), (998, dt.date(2022, 1, 1), None, None, "P", "q", 0.1, "", "")]
    r.shuffle(rows)
    return rows


def counted(rows):
    low = dt.datetime(1, 1, 1, tzinfo=dt.timezone.utc)
    best = {}
    for sid, day, got, s, p, *_ in rows:
        if None not in (day, s, p):
            best[s, p, day] = max(best.get((s, p, day), (low, -1)), (got or low, sid))
    held = {}
    for sid, day, got, s, p, o, *_ in rows:
        if None not in (day, s, p) and best[s, p, day][1] == sid:
            held.setdefault((s, p), {}).setdefault(day, set()).update({o} - {None})
    return held


def brute(rows):
    out = set()
    for (s, p), days in counted(rows).items():
        order = sorted(days)
        for o in {o for h in days.values() for o in h}:
            run = None
            for k, d in enumerate(order):
                if o in days[d]:
                    run = (run[0], d) if run else (d, d)
                if run and (o not in days[d] or k == len(order) - 1):
                    out.add((s, p, o, str(run[0]), str(run[1]), "open" if o in days[d] else str(run[1])))
                    run = None
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("every", [1, 4, 16])
def test_versions_do_not_depend_on_the_checkpoint_distance(spark, at, seed, every):
    rows = deliveries(seed, at)
    store = history.build(spark.createDataFrame(rows, S), every)
    got = [tuple(x) for x in history.as_text(history.reconstruct(store)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_state_is_read_from_the_nearest_checkpoint(spark, at):
    rows = deliveries(3, at)
    store = history.build(spark.createDataFrame(rows, S), 4)
    held = counted(rows)
    for day in ("2022-02-20", "2022-06-01", "2021-01-01", "2024-01-01"):
        want = set()
        for (s, p), days in held.items():
            upto = [d for d in days if str(d) <= day]
            want |= {(s, p, o) for o in (days[max(upto)] if upto else ())}
        assert {tuple(x)[:3] for x in history.state_at(store, day).collect()} == want


def test_empty(spark):
    store = history.build(spark.createDataFrame([], S))
    assert history.reconstruct(store).count() == 0


def test_snapshots_can_be_appended(spark, at):
    """Late deliveries, corrections and new subjects; the rest of the store is not rebuilt."""
    rows = deliveries(5, at)
    first = [r for k, r in enumerate(rows) if k % 3 and r[3] != "b"]
    rest = [r for k, r in enumerate(rows) if not k % 3 or r[3] == "b"]
    store = history.build(spark.createDataFrame(first, S), 4)
    for part in (rest[: len(rest) // 2], rest[len(rest) // 2 :]):
        store = history.append(store, spark.createDataFrame(part, S))
    store = history.compact(store)
    assert {tuple(x) for x in history.as_text(history.reconstruct(store)).collect()} == brute(rows)
    assert {tuple(x)[:3] for x in history.state_at(store, "2022-06-01").collect()} == {tuple(x)[:3] for x in history.state_at(history.build(spark.createDataFrame(rows, S), 4), "2022-06-01").collect()}
