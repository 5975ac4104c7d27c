import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators import orphans

V = "version_id bigint, system_from timestamp, assertion_ids array<bigint>, note string"
A = "assertion_id bigint, source_id bigint, version_id bigint, ingested_at timestamp, period string"
S = "source_id bigint, url string"
R = "source_id bigint, removed_at timestamp, restored_at timestamp"


def brute(versions, assertions, sources, removals):
    first = {}
    for a, _, _, t, _ in assertions:
        if a is not None and t is not None:
            first[a] = min(first.get(a, t), t)
    known = {s for s, _ in sources}
    gone = {s for s, _, back in removals if back is None}
    recorded = {}
    for v, t, _, _ in versions:
        recorded[v] = t
    ids = {a for a, *_ in assertions}
    out = set()
    for a, s, v, _, _ in assertions:
        if a is None:
            continue
        if s is not None and (s not in known or s in gone):
            out.add(("assertions.source_id", a, s))
        if v is not None and (v not in recorded or (recorded[v] and a in first and recorded[v] > first[a])):
            out.add(("assertions.version_id", a, v))
    for v, _, refs, _ in versions:
        for r in refs or []:
            if v is not None and r is not None and r not in ids:
                out.add(("versions.assertion_ids", v, r))
    return out


@pytest.mark.parametrize("seed, cuts", [(1, ()), (2, ("2022-07-01",)), (1, ("2021-01-01", "2022-07-01", "2023-06-01")), (2, ("2021-01-01", "2022-07-01", "2023-06-01"))])
def test_same_as_brute_force_whatever_the_epochs(spark, at, seed, cuts):
    r = random.Random(seed)
    t = lambda: at(f"202{r.randint(0, 3)}-0{r.randint(1, 9)}-15")
    maybe = lambda x: None if r.random() < 0.15 else x
    versions = [(v, t(), maybe([maybe(r.randint(1, 60)) for _ in range(r.randint(0, 3))]), "x") for v in range(1, 30)]
    versions += versions[:4]
    claims = [(a, maybe(1 if r.random() < 0.4 else r.randint(1, 20)), maybe(r.randint(1, 40)), t(), "clash") for a in range(1, 50)]
    claims += [(a, s, v, t(), p) for a, s, v, _, p in claims[:10]] + claims[:3] + [(None, 1, 1, t(), "n")]
    sources = [(s, "u") for s in range(1, 15)] * 2
    removals = [(1, t(), None), (2, t(), t()), (3, t(), None), (3, t(), t()), (99, t(), None), (None, t(), None)]
    frames = [spark.createDataFrame(x, s) for x, s in ((versions, V), (claims, A), (sources, S), (removals, R))]
    tracker = orphans.track_graph(spark, *frames, cuts=cuts)
    rows = [tuple(x) for x in orphans.found(tracker).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == brute(versions, claims, sources, removals)
    last = tracker.snapshots().where(F.col("epoch") == len(cuts) + 1).agg(F.sum("orphans")).first()[0]
    assert last == len(rows)


def test_empty_tables(spark):
    frames = [spark.createDataFrame([], s) for s in (V, A, S, R)]
    assert orphans.found(orphans.track_graph(spark, *frames)).count() == 0


def test_parents_resolve_and_deletions_reopen(spark):
    refs = "ref_field string, row_id bigint, ref_id bigint, known_at timestamp, period string"
    parents = "ref_field string, ref_id bigint, available_at timestamp"
    dels = "ref_field string, ref_id bigint"
    none = lambda s: spark.createDataFrame([], s)
    tracker = orphans.OrphanTracker(spark)
    held = lambda f: sorted((x.row_id, x.ref_id) for x in f.collect())
    first = tracker.advance(spark.createDataFrame([("f", 1, 7, None, "2022-01"), ("f", 2, 8, None, "2022-01"), ("f", 3, None, None, "2022-01")], refs), none(parents), none(dels))
    assert held(first) == [(1, 7), (2, 8)]
    second = tracker.advance(none(refs), spark.createDataFrame([("f", 7, None)] * 2, parents), none(dels))
    assert held(second) == [(2, 8)]
    third = tracker.advance(spark.createDataFrame([("f", 4, 7, None, "2022-02")], refs), none(parents), spark.createDataFrame([("f", 7)], dels))
    assert held(third) == [(1, 7), (2, 8), (4, 7)]
    counts = {(x.epoch, x.period): x.orphans for x in tracker.snapshots().collect()}
    assert counts == {(1, "2022-01"): 2, (2, "2022-01"): 1, (3, "2022-01"): 2, (3, "2022-02"): 1}


def test_a_parent_that_comes_again_resolves_its_orphans(spark):
    refs = "ref_field string, row_id bigint, ref_id bigint, known_at timestamp, period string"
    parents = "ref_field string, ref_id bigint, available_at timestamp"
    dels = "ref_field string, ref_id bigint"
    frame = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    tracker = orphans.OrphanTracker(spark)
    held = lambda f: sorted((x.row_id, x.ref_id) for x in f.collect())
    assert held(tracker.advance(frame(refs, ("f", 1, 7, None, "m")), frame(parents, ("f", 7, None)), frame(dels))) == []
    assert held(tracker.advance(frame(refs), frame(parents), frame(dels, ("f", 7), ("f", 7)))) == [(1, 7)]
    assert held(tracker.advance(frame(refs, ("f", 2, 7, None, "m")), frame(parents, ("f", 7, None)), frame(dels))) == []
    assert held(tracker.advance(frame(refs), frame(parents), frame(dels, ("f", 7)))) == [(1, 7), (2, 7)]


def test_a_source_is_missing_only_while_it_is_away(spark, at):
    versions, sources = spark.createDataFrame([], V), spark.createDataFrame([(1, "u"), (2, "u")], S)
    claims = spark.createDataFrame([(5, 1, None, at("2020-01-01"), "x"), (6, 2, None, at("2020-01-01"), "x")], A)
    gone = [(1, at("2021-01-01"), at("2022-01-01")), (2, at("2021-03-01"), at("2021-04-01")), (2, at("2022-03-01"), None)]
    tracker = orphans.track_graph(spark, versions, claims, sources, spark.createDataFrame(gone, R), cuts=("2020-06-01", "2021-06-01", "2022-02-01"))
    assert {x.epoch: x.orphans for x in tracker.snapshots().collect()} == {2: 1, 4: 1}
    assert [tuple(x) for x in orphans.found(tracker).collect()] == [("assertions.source_id", 6, 2)]
