import random

import pytest

from chronoweave.streaming import changefeed

A = "assertion_id bigint, relationship_id bigint, polarity int, ingested_at timestamp, last string, batch int"


def brute(rows):
    first = {}
    for a, rel, pol, t, *_ in rows:
        if pol in (1, -1) and a is not None and rel is not None:
            key = (t is not None, t)
            if a not in first or key < first[a][0]:
                first[a] = (key, rel, pol)
    held = {}
    for a, (key, rel, pol) in sorted(first.items(), key=lambda x: (x[1][0], x[0])):
        held[rel] = (a, pol)
    return {(rel, a) for rel, (a, pol) in held.items() if pol == 1}


def feed(seed, at, n=300):
    r = random.Random(seed)
    rows = []
    for a in range(n):
        t = at(f"2022-0{r.randint(1, 9)}-{r.randint(10, 28)}")
        rel = 1 if r.random() < 0.3 else r.randint(1, 40)
        row = (a, None if r.random() < 0.03 else rel, r.choice([1, 1, -1, 0, None]), t, "x", 3)
        rows.append(row)
        if r.random() < 0.3:
            rows.append((*row[:3], at(f"2022-0{r.randint(1, 9)}-{r.randint(10, 28)}"), "y", 4))
    rows.append((None, 5, 1, at("2023-01-01"), "z", 1))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("files, per_batch", [(1, 100), (5, 1)])
def test_out_of_order_and_repeated_changes(spark, at, tmp_path, seed, files, per_batch):
    rows = feed(seed, at)
    spark.createDataFrame(rows, A).repartition(files).write.parquet(str(tmp_path / "feed"))
    got = [tuple(x) for x in changefeed.apply_feed(spark, str(tmp_path / "feed"), files_per_batch=per_batch).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)


def test_goes_on_where_it_stopped(spark, at, tmp_path):
    rows = feed(7, at)
    path, root = str(tmp_path / "feed"), f"file://{tmp_path}/state"
    spark.createDataFrame(rows[:200], A).coalesce(1).write.parquet(path)
    assert {tuple(x) for x in changefeed.apply_feed(spark, path, root).collect()} == brute(rows[:200])
    spark.createDataFrame(rows[200:], A).coalesce(1).write.mode("append").parquet(path)
    assert {tuple(x) for x in changefeed.apply_feed(spark, path, root).collect()} == brute(rows)
    # Nothing new: the state and the output stay as they are.
    assert {tuple(x) for x in changefeed.apply_feed(spark, path, root).collect()} == brute(rows)


def test_one_file_and_empty(spark, at, tmp_path):
    rows = feed(3, at, 40)
    spark.createDataFrame(rows, A).coalesce(1).write.parquet(str(tmp_path / "one"))
    (single,) = (tmp_path / "one").glob("*.parquet")
    assert {tuple(x) for x in changefeed.apply_feed(spark, str(single)).collect()} == brute(rows)
    spark.createDataFrame([], A).write.parquet(str(tmp_path / "none"))
    assert changefeed.apply_feed(spark, str(tmp_path / "none")).count() == 0


def test_settings_come_back(spark, at, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.createDataFrame(feed(1, at, 10), A).write.parquet(str(tmp_path / "f"))
    changefeed.apply_feed(spark, str(tmp_path / "f"))
    assert spark.conf.get(name, None) == before


def test_only_changes_lowered_after_they_were_emitted_mark_their_key(spark, at, tmp_path):
    old, new = at("2022-01-01"), at("2022-05-01")
    path, root = str(tmp_path / "feed"), f"file://{tmp_path}/state"
    marked = lambda: {r[0] for r in changefeed._newest(spark, f"{root}/rows").where("lowered").select("relationship_id").collect()}
    first = [(1, 10, 1, new, "", 0), (1, 10, 1, old, "", 0), (2, 20, 1, new, "", 0), (3, 20, -1, at("2022-03-01"), "", 0), (4, 30, 1, old, "", 0)]
    spark.createDataFrame(first, A).coalesce(1).write.parquet(path)
    assert {tuple(x) for x in changefeed.apply_feed(spark, path, root).collect()} == {(10, 1), (20, 2), (30, 4)}
    # Copies in one micro-batch are merged before anything is emitted.
    assert marked() == set()
    # 2 turns out to be older than the removal 3; the copy of 4 is newer and lowers nothing.
    later = [(2, 20, 1, old, "", 0), (4, 30, 1, new, "", 0)]
    spark.createDataFrame(later, A).coalesce(1).write.mode("append").parquet(path)
    assert {tuple(x) for x in changefeed.apply_feed(spark, path, root).collect()} == {(10, 1), (30, 4)}
    assert marked() == {20}


def test_compaction_of_upserts(spark, at, tmp_path):
    rows = feed(11, at, 120)
    path, root = str(tmp_path / "feed"), f"file://{tmp_path}/state"
    spark.createDataFrame(rows[:90], A).repartition(4).write.parquet(path)
    assert {tuple(x) for x in changefeed.apply_feed(spark, path, root, files_per_batch=1, compact_after=2).collect()} == brute(rows[:90])
    assert len(list((tmp_path / "state" / "rows").glob("batch=*"))) == 1
    spark.createDataFrame(rows[90:], A).repartition(2).write.mode("append").parquet(path)
    assert {tuple(x) for x in changefeed.apply_feed(spark, path, root, files_per_batch=1, compact_after=2).collect()} == brute(rows)
