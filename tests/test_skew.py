import datetime as dt
import random

from pyspark.sql import functions as F

from chronoweave.operators import skew

V = "version_id bigint, subject_id string, object_id string, valid_from date, valid_to date, partner string, salt int, heavy string"


def table(seed=1, n=600):
    r = random.Random(seed)
    rows = []
    for v in range(n):
        a = dt.date(2022, 1, 1) + dt.timedelta(days=r.randint(0, 90))
        b = None if r.random() < 0.2 else a + dt.timedelta(days=r.randint(-4, 30))
        s = "hub" if r.random() < 0.35 else f"s{r.randint(1, 300)}"
        o = "hub" if r.random() < 0.3 else f"o{r.randint(1, 80)}"
        rows.append((None if r.random() < 0.01 else v, None if r.random() < 0.02 else s, None if r.random() < 0.02 else o, a, b, "x", 1, "y"))
    return rows + rows[:30]


def brute(rows):
    last = max([r[3] for r in rows] + [r[4] for r in rows if r[4]])
    out = {}
    for v, s, o, a, b, *_ in rows:
        if v is None:
            continue
        for field, key, partner in (("subject_id", s, o), ("object_id", o, s)):
            if key is None:
                continue
            vs, ps, days = out.setdefault((field, key), (set(), set(), set()))
            vs.add(v)
            ps.add(partner)
            days.update(a.toordinal() + k for k in range(((b or last) - a).days + 1))
    return {k: (len(v), len(p - {None}), len(d)) for k, (v, p, d) in out.items()}


def test_summary(spark):
    rows = table()
    got = skew.key_summary(spark.createDataFrame(rows, V), salt_share=0.05, salts=4).collect()
    kept = [r for r in rows if r[0] is not None]
    assert {(r.field_name, r.entity_id): (r.versions, r.partners, r.days) for r in got} == brute(kept)
    assert len(got) == len(brute(kept))


def test_frequent_keys_and_salts(spark):
    rows = table(2)
    total = len({r[0] for r in rows} - {None})
    want = {k for k, v in brute([r for r in rows if r[0] is not None]).items() if v[0] >= 0.01 * total}
    frame = spark.createDataFrame(rows, V)
    got = skew.frequent_keys(frame, salt_share=0.05, salts=4).collect()
    assert {(r.field_name, r.entity_id) for r in got} == want
    assert {k for _, k in skew.heavy_keys(frame, 0.05)} == {"hub"}
    ends = skew.endpoint_rows(frame, with_total=True)
    counted = skew.salted_counts(ends, [("subject_id", "hub"), (skew.TOTAL, "")], 4)
    used = {(r.field_name, r.entity_id): r.salts_used for r in counted.collect()}
    assert {k for k, n in used.items() if n > 1} == {("subject_id", "hub"), (skew.TOTAL, "")} and max(used.values()) == 4


def test_a_heavy_key_with_one_partner_uses_all_salts(spark):
    rows = [(v, "hub", "only", None, None, "x", 1, "y") for v in range(400)]
    ends = skew.endpoint_rows(spark.createDataFrame(rows, V))
    sizes = [r.n for r in skew._salted(ends, [("subject_id", "hub")], 8).where("field_name = 'subject_id'").groupBy("salt").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 400 / 8


def test_empty(spark):
    frame = spark.createDataFrame([], V)
    assert skew.frequent_keys(frame).count() == 0
    assert skew.key_summary(frame).count() == 0
