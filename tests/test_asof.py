import datetime as dt
import random

import numpy as np
import pytest

from chronoweave.operators import asof

V = "version_id bigint, relationship_id bigint, valid_from date, valid_to date, system_from timestamp, system_to timestamp, entity string, slice int"
O = "observation_id bigint, relationship_id bigint, observed_at timestamp, at string"  # noqa: E741


def brute(observations, versions):
    out = set()
    for o, rel, t, _ in observations:
        if None in (o, rel, t):
            continue
        day = t.date()
        fit = [
            (a, s, v)
            for v, r, a, b, s, e, *_ in versions
            if r == rel and v is not None and a is not None and s is not None and a <= day and (b is None or b >= day) and s <= t and (e is None or e > t)
        ]
        if fit:
            out.add((o, max(fit)[2]))
    return out


def data(seed, rels=6, n=200):
    r = random.Random(seed)
    base = dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc)
    maybe = lambda x, p=0.3: None if r.random() < p else x
    versions = []
    for v in range(n):
        a = base.date() + dt.timedelta(days=r.randint(0, 60))
        s = base + dt.timedelta(days=r.randint(-5, 60), hours=r.choice([0, 0, 7, 23]))
        rel = 1 if r.random() < 0.4 else r.randint(1, rels)
        versions.append((v, maybe(rel, 0.02), maybe(a, 0.02), maybe(a + dt.timedelta(days=r.randint(-3, 20))), s, maybe(s + dt.timedelta(hours=r.randint(-9, 900))), "e", 9))
    versions += versions[:20]
    observations = [(o, maybe(1 if r.random() < 0.4 else r.randint(1, rels + 2), 0.05), maybe(base + dt.timedelta(days=r.randint(0, 70), hours=r.choice([0, 0, 5, 23])), 0.05), "x") for o in range(n)]
    return observations + observations[:10], versions


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot, rows", [(250_000, 50), (30, 20), (30, 3)])
def test_same_as_brute_force_with_and_without_hot_entities(spark, seed, hot, rows):
    observations, versions = data(seed)
    got = asof.asof_versions(spark.createDataFrame(observations, O), spark.createDataFrame(versions, V), hot_rows=hot, bucket_rows=rows)
    found = [tuple(x) for x in got.collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute(observations, versions)


def test_slices_follow_the_counted_size_and_open_versions_do_not_multiply(spark):
    """Of versions that cover whole slices one per slice stays: no slice gets all of them."""
    t = dt.datetime(2022, 1, 1, tzinfo=dt.timezone.utc)
    versions = spark.createDataFrame([(v, 1, t.date(), None, t + dt.timedelta(minutes=v), None, "e", 0) for v in range(400)], V)
    observations = spark.createDataFrame([(o, 1, t + dt.timedelta(hours=o), "x") for o in range(400)], O)
    from pyspark.sql import functions as F

    asked = observations.select("observation_id", F.col("relationship_id").alias("entity"), F.unix_micros("observed_at").alias("at"), F.lit(0).alias("slice"), F.lit(0).alias("part"))
    offered = asof.answer_intervals(versions).withColumns({"slice": F.lit(0), "part": F.lit(0)})
    for rows in (200, 50, 10):
        events, cut = asof._slice_hot(asked, offered, spark.createDataFrame([(1,)], "entity bigint"), rows)
        per = [r.n for r in events.select("slice").unionByName(cut.select("slice")).groupBy("slice").agg(F.count("*").alias("n")).collect()]
        assert 0.5 * 800 / rows <= len(per) <= 2 * 800 / rows and cut.count() <= 2 * 400 + len(per)
    assert asof.asof_versions(observations, versions, hot_rows=10, bucket_rows=10).count() == 400


def test_events_of_one_instant_are_split(spark):
    t = dt.datetime(2022, 1, 1, 12, tzinfo=dt.timezone.utc)
    versions = spark.createDataFrame([(v, 1, t.date(), None, t - dt.timedelta(hours=v), None, "e", 0) for v in range(5)], V)
    observations = spark.createDataFrame([(o, 1, t, "x") for o in range(300)], O)
    from pyspark.sql import functions as F

    asked = observations.select("observation_id", F.col("relationship_id").alias("entity"), F.unix_micros("observed_at").alias("at"), F.lit(0).alias("slice"), F.lit(0).alias("part"))
    offered = asof.answer_intervals(versions).withColumns({"slice": F.lit(0), "part": F.lit(0)})
    events, _ = asof._slice_hot(asked, offered, spark.createDataFrame([(1,)], "entity bigint"), 10)
    sizes = [r["count"] for r in events.groupBy("part").count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 60
    got = asof.asof_versions(observations, versions, hot_rows=10, bucket_rows=10).collect()
    assert {(r.observation_id, r.version_id) for r in got} == {(o, 0) for o in range(300)}


def test_tree_nodes_cover_a_range_once(spark):
    from pyspark.sql import functions as F

    cases = [(a, b, n) for n in (1, 2, 8, 16) for a in range(n) for b in range(a, n + 1)]
    rows = spark.createDataFrame(cases, "a int, b int, n bigint").withColumn("nodes", asof._tree(F.col("a"), F.col("b"), F.col("n"))).collect()
    for r in rows:
        leaves = []
        for node in r.nodes:
            low = high = node
            while low < r.n:
                low, high = 2 * low, 2 * high + 1
            leaves += range(low - r.n, high - r.n + 1)
        assert sorted(leaves) == list(range(r.a, r.b)) and len(r.nodes) <= 2 * max(1, int(r.n).bit_length())


def test_timeline_matches_painting():
    r = np.random.default_rng(5)
    group, lo = r.integers(0, 5, 120), r.integers(0, 50, 120)
    hi = lo + r.integers(1, 20, 120)
    rank = r.permutation(120)
    won, begin, end = asof.timeline(group, lo, hi, rank)
    for g in range(5):
        for t in range(75):
            inside = [i for i in range(120) if group[i] == g and lo[i] <= t < hi[i]]
            want = max(inside, key=lambda i: rank[i]) if inside else None
            got = [w for w, b, e in zip(won, begin, end) if group[w] == g and b <= t < e]
            assert got == ([want] if inside else [])


def test_empty(spark):
    some_o, some_v = data(1)
    empty_o, empty_v = spark.createDataFrame([], O), spark.createDataFrame([], V)
    assert asof.asof_versions(empty_o, spark.createDataFrame(some_v, V)).count() == 0
    assert asof.asof_versions(spark.createDataFrame(some_o, O), empty_v).count() == 0
    assert asof.asof_versions(empty_o, empty_v).count() == 0
