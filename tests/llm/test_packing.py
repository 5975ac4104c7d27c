import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("chronoweave.llm")
from chronoweave.llm import measure, packing  # noqa: E402

D = "doc_id bigint, text string, source string, tokens string, curve int, lang string"


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3)])
def test_hilbert_curve_visits_every_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("seed", range(5))
def test_fill_keeps_every_token_once_and_cuts_only_what_must_be(seed):
    r = random.Random(seed)
    capacity = r.choice([16, 100, 512])
    items = [(d, r.choice([1, capacity, capacity - 1, capacity + 1, r.randint(1, 3 * capacity), 5 * capacity])) for d in range(300)]
    used, pieces = Counter(), defaultdict(list)
    for container, doc, piece, first, tokens in packing.fill(items, capacity, 8 * capacity):
        assert tokens > 0
        used[container] += tokens
        pieces[doc].append((piece, first, tokens))
    assert max(used.values()) <= capacity
    for doc, tokens in items:
        parts = sorted(pieces[doc])
        assert [p for p, *_ in parts] == list(range(len(parts)))
        assert [f for _, f, _ in parts] == [sum(t for *_, t in parts[:k]) for k in range(len(parts))]
        assert sum(t for *_, t in parts) == tokens
        assert len(parts) == -(-tokens // capacity)


def test_small_items_fill_well():
    r = random.Random(1)
    items = [(d, r.randint(5, 300)) for d in range(3000)]
    used = Counter()
    for container, *_, tokens in packing.fill(items, 512, 256 * 512):
        used[container] += tokens
    assert sum(used.values()) / (len(used) * 512) > 0.985


def documents():
    words = [f"w{k}" for k in range(50)]
    r = random.Random(2)
    rows = [(d, " ".join(r.choices(words, k=r.randint(1, 400))), "s", "x", 1, None) for d in range(60)]
    return rows + [(None, "no id " * 9, "s", "x", 1, None), (None, "no id either " * 5, "s", "x", 1, None), (100, None, "s", "x", 1, None), (101, "", None, "x", 1, None), (102, "long " * 30_000, "s", "x", 1, None), rows[0], (103, "ünïcödé ​ 😀", "s", "x", 1, None)]


def test_pack_documents(spark):
    rows = documents()
    frame = spark.createDataFrame(rows, D)
    sizes = spark.createDataFrame([("a", 64), ("b", 1000), (None, 5), ("c", 0), ("d", None)], "pack_name string, capacity_tokens int")
    packed = packing.pack(frame, sizes, task_tokens=20_000).collect()
    count = measure.encoding()
    for name, capacity in (("a", 64), ("b", 1000)):
        mine = [p for p in packed if p.pack_name == name]
        used, total = Counter(), Counter()
        for p in mine:
            if p.container_id is not None:
                used[p.container_id] += p.n_tokens
            total[p.doc_id] += p.n_tokens
        assert max(used.values()) <= capacity
        want = Counter()
        for d, text, *_ in rows:
            want[d] += len(count.encode_ordinary(text or ""))
        assert total == want
        assert {p.doc_id for p in mine if p.container_id is None} == {100, 101}
    assert {p.pack_name for p in packed} == {"a", "b"}
    report = packing.fill_report(packing.pack(frame, sizes, positions=True), sizes).where("pack_name = 'b'").first()
    assert report.filled > 0.9 and report.documents_cut >= 1 and 0 <= report.locality <= 1


def test_any_number_of_capacities(spark):
    frame = measure.measure(spark.createDataFrame(documents()[:6], D)).cache()
    sizes = spark.range(1, 1_102).select(F.concat(F.lit("p"), "id").alias("pack_name"), (F.col("id") + 50).alias("capacity_tokens"))
    total = frame.agg(F.sum("tokens")).first()[0]
    got = packing.pack_measured(frame, sizes, at_once=500).groupBy("pack_name").agg(F.sum("n_tokens").alias("n")).collect()
    assert len(got) == 1_101 and {r.n for r in got} == {total}


def test_containers_hold_neighbours_at_every_capacity(spark):
    r = random.Random(4)
    kinds = [[f"{k}{w}" for w in ("alpha", "beta", "gamma", "delta")] for k in "pqrs"]
    rows = [(d, " ".join(r.choices(kinds[d % 4], k=r.randint(20, 200))), "s", "", 0, "") for d in range(400)]
    sizes = spark.createDataFrame([("small", 300), ("large", 3_000)], "pack_name string, capacity_tokens int")
    measured = measure.measure(spark.createDataFrame(rows, D)).cache()
    near, far = ({x.pack_name: x.locality for x in packing.fill_report(packing.pack_measured(measured, sizes, w, positions=True), sizes).collect()} for w in (2_000, 10**9))
    assert near["large"] > 0.6 and near["large"] > far["large"] + 0.2 and near["small"] > 0.6


def test_neighbours_on_the_curve_are_alike(spark):
    rows = [(d, ("import os def return class self " if d % 2 else "select from where group order by ") * (5 + d % 7), "s", "", 0, "") for d in range(80)]
    keyed = packing.curve_keys(measure.measure(spark.createDataFrame(rows, D))).orderBy("curve", "doc_id").collect()
    kinds = [r.doc_id % 2 for r in keyed]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) <= 4


def test_empty(spark):
    sizes = spark.createDataFrame([("a", 64)], "pack_name string, capacity_tokens int")
    assert packing.pack(spark.createDataFrame([], D), sizes).count() == 0
    assert packing.pack(spark.createDataFrame(documents()[:3], D), sizes.where(F.lit(False))).count() == 0


def test_tokenizer_path_is_a_parameter(spark):
    with pytest.raises(FileNotFoundError):
        measure.encoding("/nowhere/else.tiktoken")
    other = measure.describe(["some words here"], "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    assert other[0][0] > 0
