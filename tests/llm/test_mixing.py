import math
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("chronoweave.llm")
from chronoweave.llm import measure, mixing  # noqa: E402

D = "doc_id bigint, text string, source string, tokens string, bucket string, key string"
T = "source string, target_share double, max_repeats int, epochs string"


def documents(seed=1):
    r = random.Random(seed)
    rows = []
    for d in range(400):
        source = "big" if d % 2 else r.choice(["mid", "small", "other", None])
        text = " ".join(f"w{r.randint(1, 999)}" for _ in range(r.randint(1, 60)))
        rows.append((d, None if d % 97 == 0 else "" if d % 89 == 0 else text, source, "t", "b", "k"))
    return rows


TARGETS = [("big", 0.5, 1, "x"), ("mid", 0.3, 2, "x"), ("small", 0.2, 3, "x"), ("nothing", 0.0, 3, "x"), (None, 0.1, 1, "x")]


def test_shares_repeats_and_budgets(spark):
    frame, targets = spark.createDataFrame(documents(), D), spark.createDataFrame(TARGETS, T)
    mixture, plan = mixing.mix(frame, targets)
    rows = mixture.collect()
    limits = {s: m for s, _, m, _ in TARGETS}
    assert len({r.doc_id for r in rows}) == len(rows)
    assert all(1 <= r.uses <= limits[r.source] for r in rows)
    report = {r.source: r for r in mixing.shares(mixture, plan).collect()}
    largest = max(r.tokens for r in rows)
    for source, share, repeats, _ in TARGETS[:3]:
        r = report[source]
        assert abs(r.tokens_used - r.budget) <= largest / 2 + 1
        assert r.actual_share == pytest.approx(share, abs=0.01)
        used = [x for x in rows if x.source == source]
        # Whole epochs first: every document at least that often, none more than once beyond.
        assert {x.uses for x in used} <= {r.epochs, r.epochs + 1}
        assert not r.epochs or sum(x.tokens for x in used) == r.available
    # One source is at its limit, so the mixture could not be larger.
    assert any(report[s].budget >= report[s].available * limits[s] - 1 for s in ("big", "mid", "small"))


def test_selection_follows_the_keys(spark):
    frame, targets = spark.createDataFrame(documents(), D), spark.createDataFrame([("big", 1.0, 1, "")], T)
    taken = {r.doc_id for r in mixing.mix(frame, targets, total_tokens=2_000)[0].collect()}
    assert taken == {r.doc_id for r in mixing.mix(frame, targets, total_tokens=2_000, bucket_rows=7)[0].collect()}
    keyed = mixing.sampling_keys(measure.measure(frame).where("tokens > 0 and source = 'big'")).orderBy("key").collect()
    upto, want = 0, set()
    for r in keyed:
        if upto + r.tokens / 2 <= 2_000:
            want.add(r.doc_id)
        upto += r.tokens
    assert taken == want


@pytest.mark.parametrize("quality", [1.0, 0.05, None])
def test_buckets_are_even_whatever_the_quality(spark, quality):
    n, rows = 20_000, 250
    some = F.lit(quality) if quality else F.when(F.col("id") % 3 == 0, 0.05).otherwise(F.pmod(F.xxhash64("id"), F.lit(100)) / 100)
    keyed = mixing.binned(mixing.sampling_keys(spark.range(n).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(1).alias("tokens"), some.alias("quality"))), n, rows)
    assert keyed.groupBy("bin").count().agg(F.max("count")).first()[0] <= 1.2 * rows
    sizes = [r["count"] for r in keyed.join(mixing.key_buckets(keyed, rows), ["source", "bin"]).groupBy("bucket").count().collect()]
    assert max(sizes) <= 2 * n / len(sizes)
    order = [r.bucket for r in keyed.join(mixing.key_buckets(keyed, rows), ["source", "bin"]).orderBy("key").collect()]
    assert order == sorted(order)


def test_keys_are_exponential_by_weight(spark):
    frame = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.25).alias("quality"))
    means = {r.quality: r.m for r in mixing.sampling_keys(frame).groupBy("quality").agg(F.avg("key").alias("m")).collect()}
    assert means[1.0] == pytest.approx(1, rel=0.03) and means[0.25] == pytest.approx(4, rel=0.03)
    assert math.isclose(sum(means.values()), 5, rel_tol=0.03)


def test_null_ids_are_documents(spark):
    draws = mixing.sampling_keys(measure.measure(spark.createDataFrame([(None, "a few words", "big", "", "", ""), (None, "others entirely", "big", "", "", "")], D))).select("key").distinct()
    assert draws.count() == 2
    rows = [(None, "a few words", "big", "", "", ""), (None, "some more words than that", "big", "", "", ""), (1, "word", "big", "", "", "")]
    mixture, plan = mixing.mix(spark.createDataFrame(rows, D), spark.createDataFrame([("big", 1.0, 1, "")], T))
    assert mixture.count() == 3 and mixing.shares(mixture, plan).first().tokens_used == plan.first().available


def test_same_draw_again_another_with_another_seed(spark):
    frame, targets = spark.createDataFrame(documents(), D), spark.createDataFrame([("big", 1.0, 1, "")], T)
    draw = lambda seed: {r.doc_id for r in mixing.mix(frame, targets, seed=seed, total_tokens=1_500)[0].collect()}
    assert draw(1) == draw(1) != draw(2)


def test_empty_sides(spark):
    frame, targets = spark.createDataFrame(documents(), D), spark.createDataFrame(TARGETS, T)
    none = mixing.mix(spark.createDataFrame([], D), targets)
    assert none[0].count() == 0 and {r.tokens_used for r in mixing.shares(*none).collect()} == {0}
    assert mixing.mix(frame, spark.createDataFrame([], T))[0].count() == 0
    missing = mixing.mix(frame, spark.createDataFrame([("big", 0.5, 1, ""), ("absent", 0.5, 2, "")], T))
    report = {r.source: r.actual_share for r in mixing.shares(*missing).collect()}
    assert report["absent"] == 0.0 and report["big"] == 1.0
