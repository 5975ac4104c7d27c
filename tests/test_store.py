import json

import pytest

from chronoweave import Pattern, SchemaVersionError, StorageError, TemporalGraph, ValidationError, open_graph


@pytest.fixture
def db(spark, tmp_path):
    return open_graph(spark, str(tmp_path / "g"), map_size=1)


def spans(db, pattern=Pattern()):
    return [(r.object_id, str(r.valid_from), str(r.valid_to) if r.valid_to else None) for r in db.history(pattern).collect()]


def test_open_confirm_close_reopen(db):
    first = db.assert_fact("A", "L", "B", "2026-01-01", 0.5)
    assert db.assert_fact("A", "L", "B", "2026-01-05", 0.9) == first
    assert db.assert_fact("A", "L", "B", "2026-01-03") == first
    row = db.versions.first()
    assert (str(row.last_confirmed), row.confidence) == ("2026-01-05", 0.9)
    with pytest.raises(ValidationError):
        db.retract_fact("A", "L", "B", "2025-12-31")
    assert db.retract_fact("A", "L", "B", "2026-01-05") == first
    assert db.retract_fact("A", "L", "B", "2026-01-06") is None
    again = db.assert_fact("A", "L", "B", "2026-02-01")
    rows = {r.version_id: r for r in db.versions.collect()}
    assert set(rows) == {first, again} and rows[first].relationship_id == rows[again].relationship_id


def test_a_snapshot_states_everything_that_holds(db):
    a = db.sync_snapshot("FERRY_7", "CALLS_AT", {"Ålesund": 0.5, "Bergen": None, "Måløy": 0.2}, "2024-03-04")
    b = db.sync_snapshot("FERRY_7", "CALLS_AT", {"Florø": 0.1, "Måløy": 0.6}, "2024-03-11", {"Måløy": ["http://timetable"]})
    assert len(a["opened"]) == 3 and not a["closed"] and not a["confirmed"]
    assert (len(b["opened"]), len(b["closed"]), len(b["confirmed"])) == (1, 2, 1)
    assert sorted(spans(db)) == [("Bergen", "2024-03-04", "2024-03-04"), ("Florø", "2024-03-11", None), ("Måløy", "2024-03-04", None), ("Ålesund", "2024-03-04", "2024-03-04")]
    assert set(b["opened"]) | set(a["opened"]) == {r.version_id for r in db.versions.collect()}
    db.sync_snapshot("FERRY_7", "CALLS_AT", {}, "2024-03-18")
    assert {s[0]: s[2] for s in spans(db)} == {"Bergen": "2024-03-04", "Ålesund": "2024-03-04", "Florø": "2024-03-11", "Måløy": "2024-03-11"}
    kept = db.history(Pattern("FERRY_7", "CALLS_AT", "Måløy")).first()
    assert [r.assertion_id for r in db.assertions_for_version(b["confirmed"][0]).collect()] == kept.assertion_ids and kept.properties == "{}"


def test_batch_is_all_or_nothing(db):
    with pytest.raises(RuntimeError):
        with db.write_batch():
            db.assert_fact("A", "L", "B", "2026-01-01")
            raise RuntimeError
    assert db.versions.count() == 0
    with db.write_batch():
        one = db.assert_fact("A", "L", "B", "2026-01-01")
        assert db.assert_fact("A", "L", "B", "2026-01-02") == one
        assert db.versions.count() == 0
        with pytest.raises(StorageError):
            with db.write_batch():
                pass
    assert db.versions.count() == 1


def test_validation(db):
    for call in (
        lambda: db.assert_fact("", "L", "B", "2026-01-01"), lambda: db.assert_fact("A", "L\0", "B", "2026-01-01"), lambda: db.assert_fact("A", "L", "B", "2026-1-1"),
        lambda: db.sync_snapshot("A", "L", {"": 1}, "2026-01-01"), lambda: db.track("size", "A", "2026-01-01", "2026-01-02"), lambda: db.track("edge_weight", "A", "2026-01-01", "2026-01-02"),
        lambda: db.assert_fact("A", "L", "B", "2026-01-01", sources=[{"title": "no url"}]), lambda: db.why_changed(Pattern("A"), "2026-01-01", "2026-01-02"),
    ):
        with pytest.raises(ValidationError):
            call()


def test_schema_version(spark, tmp_path):
    open_graph(spark, str(tmp_path / "g"))
    open_graph(spark, str(tmp_path / "g"))
    (tmp_path / "g" / "_meta.json").write_text(json.dumps({"schema_version": 1}))
    (tmp_path / "g" / "._meta.json.crc").unlink(missing_ok=True)
    with pytest.raises(SchemaVersionError):
        open_graph(spark, str(tmp_path / "g"))


def test_dump_restore_backup_stats(spark, db, tmp_path):
    with db.write_batch():
        db.assert_fact("A", "L", "B", "2026-01-01", 0.5, sources=["http://a", {"url": "http://b", "title": "t", "published_at": "soon"}])
        db.retract_fact("A", "L", "B", "2026-01-09")
        db.assert_fact("A", "L", "B", "2025-01-01")
        db.assert_fact("Ä 'x'", "L", "B", "2026-01-01")
    assert db.stats() == {"relationships": 2, "versions": 3, "assertions": 2, "entities": 3, "sources": 2}
    db.dump(str(tmp_path / "dump"))
    back = TemporalGraph.restore(spark, str(tmp_path / "dump"), str(tmp_path / "r"))
    facts = ["subject_id", "predicate", "object_id", "valid_from", "valid_to", "confidence"]
    key = lambda g: sorted((tuple(r) for r in g.versions.select(*facts).collect()), key=str)
    assert key(back) == key(db)
    assert back.assert_fact("C", "L", "D", "2026-01-01") > 0 and back.versions.count() == 4
    db.backup(str(tmp_path / "b"))
    db.assert_fact("Z", "L", "B", "2026-01-01")
    copy = open_graph(spark, str(tmp_path / "b"))
    assert copy.versions.count() == 3 and copy.stats()["sources"] == 2
    back.backup(str(tmp_path / "b2"))
    assert open_graph(spark, str(tmp_path / "b2")).versions.count() == 4
    with pytest.raises(StorageError):
        db.backup(str(tmp_path / "b"))


def test_statements(db):
    made = db.execute("ASSERT (A, LINKS, B) VALID FROM '2026-01-01' CONFIDENCE 0.5")
    assert db.execute("RETRACT (A, LINKS, B) VALID TO '2026-01-10'") == made
    assert db.execute("RETRACT (A, LINKS, B) VALID TO '2026-01-10'") == {"version_id": None}
    db.execute("ASSERT (A, LINKS, C) VALID FROM '2026-01-05'")
    (hit,) = db.execute("MATCH (A, ?how, B) AS OF '2026-01-02'")
    assert hit["bindings"] == {"how": "LINKS"} and hit["version_id"] == made["version_id"]
    assert db.execute("RANGE (A, ?p, ?o) BETWEEN '2026-01-01' AND '2026-01-31'") != []
    delta = db.execute("DIFF BETWEEN '2026-01-02' AND '2026-01-31' FOR (A, ?p, ?o)")
    assert delta["nodes_added"] == ["C"] and delta["nodes_removed"] == ["B"] and delta["edges_closed"][0]["bindings"] == {"p": "LINKS", "o": "B"}
    assert [x["value"] for x in db.execute("TRACK DEGREE(A) BETWEEN '2026-01-04' AND '2026-01-12' RESOLUTION '4d'")] == [1.0, 2.0, 1.0]
    assert [len(x["facts"]) for x in db.execute("SERIES (A, ?p, ?o) BETWEEN '2026-01-04' AND '2026-01-12' RESOLUTION '4d'")] == [1, 2, 1]
    path = db.execute("PATH (B, C) AS OF '2026-01-06'")
    assert path["connected"] and [v["object_id"] for v in path["path"]] == ["B", "C"]
    assert db.execute("PATH (B, C) AS OF '2026-01-16'") == {"connected": False, "path": None}
    assert str(db.execute("FIRST_CONNECTED (B, C)")["first_connected"]) == "2026-01-05"
    assert [x["path"] is None for x in db.execute("PATH_HISTORY (B, C) BETWEEN '2026-01-04' AND '2026-01-05'")] == [True, False]
    assert db.execute("WHY_CHANGED (A, LINKS, B) BETWEEN '2026-01-02' AND '2026-01-31'")["status"] == "closed"
    assert db.execute("WHY_CHANGED (A, LINKS, NOBODY) BETWEEN '2026-01-02' AND '2026-01-31'")["status"] == "no_relationship"
    assert db.execute("CHANGEPOINTS DEGREE(C) BETWEEN '2025-12-20' AND '2026-01-31'")["changepoints"]
    assert db.get_entity("nobody") is None and str(db.get_entity("A")["last_seen"]) == "2026-01-05"


def test_weekly_snapshots_with_things_that_come_back(db):
    weeks = [{"kelp"}, {"kelp", "eel"}, {"eel"}, set(), {"kelp"}, {"kelp", "eel", "cod"}]
    with db.write_batch():
        for k, held in enumerate(weeks):
            db.sync_snapshot("PIER", "LANDS", dict.fromkeys(held, 0.3), f"2023-05-{1 + 7 * k if k < 4 else 29 + k - 4:02d}")
    want = [("cod", "2023-05-30", None), ("eel", "2023-05-08", "2023-05-15"), ("eel", "2023-05-30", None), ("kelp", "2023-05-01", "2023-05-08"), ("kelp", "2023-05-29", None)]
    assert sorted(spans(db, Pattern("PIER", "LANDS")), key=str) == want
    relationships = {r.object_id: r.relationship_id for r in db.relationships.collect()}
    assert len(relationships) == 3 and all(relationships[r.object_id] == r.relationship_id for r in db.versions.collect())


def restored(spark, tmp_path, lines):
    (tmp_path / "dump.jsonl").write_text("\n".join(json.dumps(dict(zip(("subject_id", "predicate", "object_id", "valid_from", "valid_to", "confidence"), x))) for x in lines))
    return TemporalGraph.restore(spark, str(tmp_path / "dump.jsonl"), str(tmp_path / "back"))


def test_restored_facts_are_confirmed_and_closed(spark, tmp_path):
    db = restored(spark, tmp_path, [("A", "L", "B", "2022-01-01", None, 0.5), ("A", "L", "C", "2022-01-01", "2022-02-01", 0.5), ("A", "L", "D", "2022-03-01", None, None), ("A", "M", "E", "2022-03-01", None, None), ("A", "L", "D", "2022-01-01", None, 0.1)])
    ids = {(r.object_id, str(r.valid_from)): r for r in db.versions.collect()}
    assert db.assert_fact("A", "L", "B", "2022-05-01", 0.9) == ids["B", "2022-01-01"].version_id
    assert db.degree("A", "2022-05-01") == 3.0
    with pytest.raises(ValidationError):
        db.retract_fact("A", "L", "B", "2021-12-31")
    assert db.retract_fact("A", "L", "B", "2022-06-01") == ids["B", "2022-01-01"].version_id
    again = db.assert_fact("A", "L", "C", "2022-07-01")
    done = db.sync_snapshot("A", "M", {"F": 0.2}, "2022-08-01")
    assert done["closed"] == [ids["E", "2022-03-01"].version_id]
    # Of the two open intervals of D the one that started last goes on.
    assert db.retract_fact("A", "L", "D", "2022-09-01") == ids["D", "2022-03-01"].version_id

    def check(graph):
        now = {(r.object_id, str(r.valid_from)): (str(r.valid_to) if r.valid_to else None, str(r.last_confirmed), r.confidence, r.relationship_id) for r in graph.versions.collect()}
        rel = {k: r.relationship_id for k, r in ids.items()}
        assert now == {
            ("B", "2022-01-01"): ("2022-06-01", "2022-05-01", 0.9, rel["B", "2022-01-01"]), ("C", "2022-01-01"): ("2022-02-01", "2022-02-01", 0.5, rel["C", "2022-01-01"]),
            ("C", "2022-07-01"): (None, "2022-07-01", None, rel["C", "2022-01-01"]), ("D", "2022-03-01"): ("2022-09-01", "2022-03-01", None, rel["D", "2022-03-01"]),
            ("D", "2022-01-01"): (None, "2022-01-01", 0.1, rel["D", "2022-03-01"]), ("E", "2022-03-01"): ("2022-03-01", "2022-03-01", None, rel["E", "2022-03-01"]),
            ("F", "2022-08-01"): (None, "2022-08-01", 0.2, done["opened"][0]),
        }
        assert {r.version_id for r in graph.versions.collect()} >= {again, *(r.version_id for r in ids.values())}

    check(db)
    check(open_graph(spark, db.path))
    db.compact()
    check(db)
    assert db.assert_fact("A", "L", "C", "2022-10-01") == again


def test_bulk_retracts_before_the_start_are_refused(spark, db):
    import datetime as dt

    from chronoweave.model import EVENTS

    event = lambda k, op, o, d, c=None: (k, op, "A", "L", o, dt.date.fromisoformat(d), c, None, None, None, dt.datetime(2026, 7, 1))
    db.assert_fact("A", "L", "Old", "2026-02-01")
    log = [event(1, "assert", "B", "2026-03-01"), event(2, "retract", "B", "2026-01-01"), event(3, "assert", "B", "2026-04-01"), event(4, "retract", "Old", "2026-01-01"), event(5, "retract", "Nobody", "2026-01-01"), event(6, "assert", "C", "2026-01-01"), event(7, "retract", "C", "2026-01-01")]
    refused = db.load_events(spark.createDataFrame(log, EVENTS)).collect()
    assert sorted((r.object_id, r.reason) for r in refused) == [("B", "before the start"), ("Old", "before the start")]
    assert sorted(spans(db)) == [("B", "2026-03-01", None), ("C", "2026-01-01", "2026-01-01"), ("Old", "2026-02-01", None)]
    assert db.events().count() == 6 and db.retract_fact("A", "L", "B", "2026-05-01") is not None


def test_many_writes_in_a_batch_take_few_jobs(spark, db):
    tracker, group = spark.sparkContext.statusTracker(), "batch"
    spark.sparkContext.setJobGroup(group, "")
    with db.write_batch():
        made = [db.assert_fact(f"S{k % 50}", "L", f"O{k}", "2026-01-01") for k in range(300)]
        assert [db.assert_fact(f"S{k % 50}", "L", f"O{k}", "2026-01-02") for k in range(300)] == made
        assert all(db.retract_fact(f"S{k % 50}", "L", f"O{k}", "2026-02-01") for k in range(0, 300, 2))
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 5 and len(set(made)) == 300
    assert db.versions.where("valid_to is null").count() == 150


def test_writes_beyond_what_is_kept_in_memory(spark, tmp_path):
    db = TemporalGraph(spark, str(tmp_path / "g"), open_rows=2)
    ids = [db.assert_fact("A", f"P{k}", "x", "2026-01-01") for k in range(5)]
    again = TemporalGraph(spark, str(tmp_path / "g"), open_rows=2)
    assert [again.assert_fact("A", f"P{k}", "x", "2026-01-03") for k in range(5)] == ids
    assert again.retract_fact("A", "P0", "x", "2026-01-04") == ids[0] and again.retract_fact("A", "P0", "x", "2026-01-05") is None


def test_bulk_load(spark, db):
    from chronoweave.model import EVENTS
    import datetime as dt

    now = dt.datetime(2026, 1, 1)
    rows = [(1, "assert", "A", "L", "B", dt.date(2026, 1, 1), 0.5, None, None, None, now), (2, "sync", "A", "L", None, dt.date(2026, 1, 2), None, {"C": 0.1}, None, None, now), (3, "assert", "", "L", "B", dt.date(2026, 1, 1), None, None, None, None, now)]
    rejected = db.load_events(spark.createDataFrame(rows, EVENTS))
    assert [r.reason for r in rejected.collect()] == ["bad subject"]
    assert sorted(spans(db)) == [("B", "2026-01-01", "2026-01-01"), ("C", "2026-01-02", None)]
    assert db.assert_fact("A", "L", "C", "2026-01-04") == db.history(Pattern("A", "L", "C")).first().version_id


def test_compaction(spark, db, tmp_path):
    with db.write_batch():
        for k in range(5):
            db.assert_fact(f"S{k}", "L", "B", "2026-01-01", 0.5)
    before = sorted(map(tuple, db.versions.collect()))
    db.compact()
    assert "versions-5" in db.versions._jdf.queryExecution().toString()
    assert sorted(map(tuple, db.versions.collect())) == before
    again = open_graph(spark, db.path)
    assert sorted(map(tuple, again.versions.collect())) == before
    # A later write goes on from the log until the next compaction.
    again.retract_fact("S0", "L", "B", "2026-02-01")
    assert again.history(Pattern("S0")).first().valid_to is not None
    again.compact()
    assert again.history(Pattern("S0")).first().valid_to is not None and again.versions.count() == 5
    # A pattern by object reads the copy clustered by object; only triples written since are folded.
    reverse = lambda: again.as_of(Pattern(None, None, "B"), "2026-01-15")
    assert "reverse-6" in reverse()._jdf.queryExecution().toString() and reverse().count() == 5
    assert open_graph(spark, db.path)._seq == again._seq == 6
    again.assert_fact("S9", "L", "B", "2026-01-02")
    assert again.query("MATCH (?s, ?p, B) AS OF '2026-01-15'").count() == 6
    assert reverse().count() == 6 and again.as_of(Pattern("S9"), "2026-01-15").count() == 1
    again.backup(str(tmp_path / "copy"))
    assert open_graph(spark, str(tmp_path / "copy")).versions.count() == 6
