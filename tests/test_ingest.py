import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronoweave.model import BASE, EVENTS
from chronoweave.operators import ingest

START = dt.date(2026, 1, 1)
NOW = dt.datetime(2026, 6, 1, tzinfo=dt.timezone.utc)

event = st.one_of(
    st.tuples(st.just("assert"), st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(0, 20), st.sampled_from([None, 0.1, 0.9])),
    st.tuples(st.just("retract"), st.sampled_from("ab"), st.sampled_from("xyz"), st.integers(0, 20), st.none()),
    st.tuples(st.just("sync"), st.sampled_from("ab"), st.dictionaries(st.sampled_from("xyz"), st.sampled_from([None, 0.2, 0.8])), st.integers(0, 20), st.none()),
)


def row(seq, e):
    op, s, o, day, c = e
    sync = op == "sync"
    return (seq, op, s, "P", None if sync else o, START + dt.timedelta(days=day), c, o if sync else None, None, None, NOW + dt.timedelta(seconds=seq))


def model(events):
    """The write verbs, one after the other; a retract before the start is refused."""
    opened, done = {}, []

    def touch(s, o, day, c, seq):
        if (s, o) in opened:
            v = opened[s, o]
            v["last"] = max(v["last"], day)
            v["conf"] = v["conf"] if c is None else c
        else:
            opened[s, o] = {"from": day, "last": day, "conf": c, "at": seq}

    def close(s, o, to):
        done.append((s, o, opened.pop((s, o)), to))

    for seq, (op, s, o, day, c) in enumerate(events, 1):
        if op == "assert":
            touch(s, o, day, c, seq)
        elif op == "retract" and (s, o) in opened and day >= opened[s, o]["from"]:
            close(s, o, day)
        elif op == "sync":
            for x, conf in o.items():
                touch(s, x, day, conf, seq)
            for key in [k for k in opened if k[0] == s and k[1] not in o]:
                close(*key, opened[key]["last"])
    rows = [(s, o, v["from"], to, v["last"], v["conf"], v["at"]) for s, o, v, to in done] + [(s, o, v["from"], None, v["last"], v["conf"], v["at"]) for (s, o), v in opened.items()]
    return sorted(rows, key=str)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(logs=st.lists(st.lists(event, min_size=1, max_size=12), min_size=6, max_size=6))
def test_fold_equals_the_verbs_one_by_one(spark, logs):
    """Several logs at once, each under its own predicate; folded whole, and in two parts, the second onto the first."""
    rows = [(r[0], r[1], r[2], f"P{k}", *r[4:]) for k, log in enumerate(logs) for r in (row(i, e) for i, e in enumerate(log, 1))]
    events = spark.createDataFrame(rows, EVENTS)
    bad = ingest.inverted_retracts(events).select(*ingest.TRIPLE, "seq").collect()
    clean = events.join(spark.createDataFrame(bad, "subject_id string, predicate string, object_id string, seq bigint"), [*ingest.TRIPLE, "seq"], "left_anti").cache() if bad else events
    whole = ingest.fold(clean).collect()
    base = spark.createDataFrame(ingest.fold(clean.where("seq <= 5")).collect(), BASE)
    onto = ingest.fold_onto(base, clean.where("seq > 5")).collect()
    for folded in (whole, onto):
        for k, log in enumerate(logs):
            got = [(r.subject_id, r.object_id, (r.valid_from - START).days, (r.valid_to - START).days if r.valid_to else None, (r.last_confirmed - START).days, r.confidence, r.version_id >> ingest.SEQ_SHIFT) for r in folded if r.predicate == f"P{k}"]
            assert sorted(got, key=str) == model(log)
    assert {r.version_id: r.relationship_id for r in whole} == {r.version_id: r.relationship_id for r in onto}


def test_ids(spark):
    rows = [row(1, ("assert", "a", "x", 1, 0.5)), row(2, ("retract", "a", "x", 5, None)), row(3, ("assert", "a", "x", 9, None)), row(4, ("sync", "b", {"x": 0.1, "y": None}, 3, None))]
    v = ingest.folded_versions(spark.createDataFrame(rows, EVENTS)).orderBy("version_id").collect()
    assert len({r.version_id for r in v}) == 4
    assert v[0].relationship_id == v[1].relationship_id == v[0].version_id
    assert (v[0].system_to, v[0].valid_to) == (dt.datetime(2026, 6, 1, 0, 0, 2), dt.date(2026, 1, 6))


def test_bad_events_come_out_with_a_reason(spark):
    good, bad = row(1, ("assert", "a", "x", 1, 0.5)), [row(2, ("assert", "", "x", 1, None)), row(3, ("assert", "a", "x\0", 1, None)), row(4, ("retract", "a", "", 1, None)), row(5, ("sync", "a", {"": 0.5}, 1, None))]
    kept, rejected = ingest.split_events(spark.createDataFrame([good, *bad, (6, "other", *good[2:])], EVENTS))
    assert [r.seq for r in kept.collect()] == [1]
    assert {r.seq: r.reason for r in rejected.collect()} == {2: "bad subject", 3: "bad object", 4: "bad object", 5: "bad object in sync", 6: "unknown op"}


def test_evidence_follows_its_version(spark):
    src = lambda *u: [(x, "t", "d", None) for x in u]
    rows = [list(row(1, ("assert", "a", "x", 1, 0.5))), list(row(2, ("retract", "a", "x", 5, None))), list(row(3, ("assert", "a", "x", 9, None))), list(row(4, ("sync", "a", {"x": 0.1}, 12, None)))]
    rows[0][8], rows[2][8], rows[3][9] = src("u1", "u2"), src("u1"), {"x": src("u3")}
    events = spark.createDataFrame([tuple(r) for r in rows], EVENTS)
    cited, versions = ingest.cited(events), ingest.fold(events)
    got = sorted((r.version_id >> 20, str(r.event_time)) for r in ingest.assertions_of(cited, versions).collect())
    assert got == [(1, "2026-01-02"), (1, "2026-01-02"), (3, "2026-01-10"), (3, "2026-01-13")]
    ids = {i for r in versions.collect() for i in r.assertion_ids}
    assert ids == {r.assertion_id for r in ingest.assertions_of(cited, versions).collect()} and len(ids) == 4
    assert sorted(r.url for r in ingest.sources_of(cited).collect()) == ["u1", "u2", "u3"]
    assert {r.entity_id: (str(r.first_seen), str(r.last_seen)) for r in ingest.entities_of(ingest.touches(events)).collect()} == dict.fromkeys("ax", ("2026-01-02", "2026-01-13"))


@pytest.mark.parametrize("frame", [[]])
def test_empty_log(spark, frame):
    events = spark.createDataFrame(frame, EVENTS)
    assert ingest.folded_versions(events).count() == ingest.cited(events).count() == 0


def test_an_inverted_retract_changes_nothing(spark):
    log = [("assert", "a", "x", 60, 0.5), ("retract", "a", "x", 1, None), ("assert", "a", "x", 70, None), ("retract", "a", "x", 55, None), ("retract", "a", "x", 80, None), ("assert", "a", "x", 90, None), ("retract", "a", "x", 85, None)]
    events = spark.createDataFrame([row(k, e) for k, e in enumerate(log, 1)], EVENTS)
    assert sorted((r.seq, (r.day - START).days, (r.valid_from - START).days) for r in ingest.inverted_retracts(events).collect()) == [(2, 1, 60), (4, 55, 60), (7, 85, 90)]
    got = sorted(((r.valid_from - START).days, (r.valid_to - START).days if r.valid_to else None, (r.last_confirmed - START).days) for r in ingest.folded_versions(events).collect())
    assert got == [(60, 80, 70), (90, None, 90)]


def test_ids_of_a_sync_larger_than_one_number_has_room_for(spark, monkeypatch):
    monkeypatch.setattr(ingest, "SEQ_SHIFT", 2)
    many = {f"o{k:02d}": 0.1 for k in range(11)}
    assert spark.range(1).select(ingest.extra_seqs(F.create_map(*(x for o in many for x in (F.lit(o), F.lit(0.1)))))).first()[0] == 2
    rows = [row(1, ("sync", "a", many, 1, None)), row(4, ("assert", "b", "x", 2, None)), row(5, ("assert", "b", "y", 2, None))]
    ids = [r.version_id for r in ingest.fold(spark.createDataFrame(rows, EVENTS)).collect()]
    assert len(set(ids)) == len(ids) == 13


def test_events_from_json_lines(spark, tmp_path):
    lines = [
        {"op": "assert", "s": "a", "p": "P", "o": "x", "d": "2026-01-02", "c": 0.5, "sources": ["http://u", {"url": "http://v", "title": "t"}]},
        {"op": "sync", "s": "b", "p": "P", "d": "2026-01-03", "objects": {"y": 0.1, "z": None}, "sources": {"y": ["http://w"]}},
        {"op": "retract", "s": "a", "p": "P", "o": "x", "d": "2026-01-09"}, {"op": "assert", "s": "a", "p": "P", "o": "x", "d": "2026-13-09"},
    ]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "1.jsonl").write_text("\n".join(map(json.dumps, lines[:2])) + "\n\n")
    (tmp_path / "log" / "2.jsonl").write_text("no event\n" + "\n".join(map(json.dumps, lines[2:])))
    events = ingest.read_events(spark, str(tmp_path / "log"))
    got = events.orderBy("seq").collect()
    assert [r.op for r in got] == ["assert", "sync", None, "retract", "assert"] and len({r.seq for r in got}) == 5
    assert [s.url for s in got[0].sources] == ["http://u", "http://v"] and got[0].sources[1].title == "t"
    assert got[1].objects == {"y": 0.1, "z": None} and got[1].object_sources["y"][0].url == "http://w"
    good, bad = ingest.split_events(events)
    assert good.count() == 3 and sorted(r.reason for r in bad.collect()) == ["no day", "unknown op"]
