import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("chronoweave.llm")
from chronoweave.llm import abuse  # noqa: E402

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "word, want",
    [("MORON", "moron"), ("m0r0n", "moron"), ("moooron", "moron"), ("mоrоn", "moron"), ("MÓron", "moron"), ("@sshole", "ashole"), ("r4+5", "rats"), ("2022", "#"), ("hello", "helo")],
)
def test_disguises_come_off(word, want):
    assert abuse.normal(word)[0] == want


@pytest.mark.parametrize("text", ["you m***n!", "you m o r o n here", "you m.o.r.o.n", "you mo-ron", "you mo​ron", "you m0r0n", "you mOrOn", "you mооооron"])
def test_seed_words_are_found_in_any_spelling(text):
    codes, *_ = abuse.encode_texts([text], abuse.Words())
    assert (codes & abuse.INSULT).any()


def test_offsets_features_and_odd_texts():
    texts = [None, "", "   ", "!!! 123", "a" * 200_000, "x y z " * 50_000, "you moron, fuck off", "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "plain words here"]
    codes, offsets, marks = abuse.encode_texts(texts, abuse.Words())
    assert len(offsets) == len(texts) + 1 and offsets[-1] == len(codes) and marks[3].tolist() == [3, 1]
    x = abuse.dense(codes, offsets, marks, abuse.Cues(np.zeros(0, np.uint64), np.zeros(0)))
    assert x.shape == (len(texts), len(abuse.FEATURES)) and np.isfinite(x).all()
    k = abuse.FEATURES.index
    assert x[6, k("insults")] > 0 and x[6, k("sexual")] > 0 and x[6, k("second_distance")] == 1 and x[6, k("person_distance")] == 30 and x[8, k("insults")] == 0 and x[3, k("emphasis")] > 0


def test_features_of_a_document_do_not_depend_on_its_batch():
    texts = ["you moron", "the quick brown fox", "sell porn now", "", "word " * 30]
    label = np.array([1, 0, 1, 0, 0] * 5, dtype=float)
    words = abuse.Words()
    keys, marked, seen = abuse.count_sequences([abuse.encode_texts([t], words)[0] for t in texts * 5], label, np.arange(25) % 2, 2)
    cues = abuse.learn_cues(keys, marked.sum(1), seen.sum(1), label.mean())
    whole = abuse.dense(*abuse.encode_texts(texts, abuse.Words()), cues)
    single = np.concatenate([abuse.dense(*abuse.encode_texts([t], abuse.Words()), cues) for t in texts])
    assert np.allclose(whole, single, atol=1e-5)
    assert whole[0, 0] > whole[1, 0]


def test_scores_do_not_depend_on_neighbours_or_on_what_was_read_before():
    texts, y = planted(300, 8)
    texts += ["m 0 r 0 n you 1 2 3 4 5", "7 8 9 0 x", "you i d 1 0 t", "a 4 b 5 c 6 moron", "3 3 3 3"] * 3
    model = abuse.train([(texts, np.r_[y, [1, 0, 1, 0, 0] * 3])])
    want = model.score(texts)
    for order in (np.arange(len(texts))[::-1], np.random.default_rng(2).permutation(len(texts))):
        model._words = None
        assert np.array_equal(model.score([texts[k] for k in order]), want[order])
    model._words = None
    assert np.array_equal(np.concatenate([model.score([t]) for t in texts]), want)
    codes, *_ = abuse.encode_texts(["1 1 1 1", "you m 0 r 0 n now"], abuse.Words())
    assert (codes & abuse.INSULT).any()


def test_trees_and_calibration():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = abuse.Trees(40, 3).fit(x[:1000], y[:1000])
    score = trees.score(x[1000:])
    assert ((score > 0) == (y[1000:] > 0.5)).mean() > 0.9
    p = abuse.Isotonic(score, y[1000:])(np.sort(score))
    assert (np.diff(p) >= 0).all() and 0 <= p.min() <= p.max() <= 1
    assert p.mean() == pytest.approx(y[1000:].mean(), abs=0.02)


def test_too_few_labels():
    for texts, y in (([], np.zeros(0)), (["one"], np.ones(1)), (["a", "b"], np.zeros(2))):
        model = abuse.train([(texts, y)])
        assert np.isfinite(model.score(["x", None])).all()


def planted(n, seed):
    """Neutral lines, some with an insult of a person in some disguise, some with the same words put to harmless use."""
    r = random.Random(seed)
    insult = ["you are a pathetic {}", "only a {} like you would write this", "shut up you {}", "that reviewer is a {}"]
    fine = ["blocked terms {} listed here", "idiot proof default for {}", "this stupid {} driver hangs again"]
    dress = [str, str.upper, lambda w: w.replace("o", "0"), lambda w: w[0] + "*" * (len(w) - 2) + w[-1], lambda w: "-".join((w[:2], w[2:])), lambda w: " ".join(w)]
    texts, y = [], []
    for k in range(n):
        lines = [f"the {r.choice(['crate', 'hull', 'gauge'])} must {r.choice(['pack', 'scan', 'fold'])} row {r.randint(1, 999)}" for _ in range(r.randint(1, 12))]
        kind = r.random()
        word = r.choice(["moron", "idiot", "bastard", "scumbag"])
        if kind < 0.25:
            lines.insert(r.randint(0, len(lines)), r.choice(insult).format(r.choice(dress)(word)))
        elif kind < 0.5:
            lines.insert(r.randint(0, len(lines)), r.choice(fine).format(word))
        texts.append("\n".join(lines))
        y.append(float(kind < 0.25))
    return texts, np.array(y)


def test_held_out_accuracy_on_planted_cases():
    texts, y = planted(1500, 1)
    noisy = np.where(np.random.default_rng(3).random(1500) < 0.04, 1 - y, y)
    model = abuse.train([(texts[:700], noisy[:700]), (texts[700:], noisy[700:])])
    more, truth = planted(600, 2)
    found = model.score(more) >= 0.6
    assert (found & (truth > 0)).sum() / found.sum() > 0.95
    assert (found & (truth > 0)).sum() / truth.sum() > 0.9


def test_held_out_accuracy_on_review_marks(spark):
    documents, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/review_labels.parquet")
    marked = abuse.labelled(documents, labels).orderBy("doc_id").toPandas()
    test = marked.doc_id % 4 == 0
    model = abuse.train([(marked.text[~test].tolist(), marked.label[~test].to_numpy())])
    found, truth = model.score(marked.text[test].tolist()) >= 0.6, marked.label[test].to_numpy() > 0.5
    # The marks themselves are wrong for some documents, hence the modest recall.
    assert (found & truth).sum() / found.sum() > 0.8
    assert (found & truth).sum() / truth.sum() > 0.5


def test_order_and_batches_do_not_change_the_model():
    texts, y = planted(400, 5)
    texts = [f"{t}\n{k % 10} {k % 7} {k % 3} x {k % 4}" for k, t in enumerate(texts)]
    r = np.random.default_rng(1)
    want = abuse.train([(texts, y)]).score(texts)
    for _ in range(2):
        p = r.permutation(len(texts))
        shuffled = [texts[k] for k in p]
        model = abuse.train([(shuffled[:150], y[p][:150]), (shuffled[150:], y[p][150:])])
        assert np.array_equal(model.score(texts), want)


def test_copies_count_once_and_only_whole_texts_are_copies():
    start = " ".join(f"word{k}" for k in range(5000))
    seen = []
    original, abuse.count_sequences = abuse.count_sequences, lambda docs, *a: (seen.append(len(docs)), original(docs, *a))[1]
    try:
        # Alike for 5,000 words and different after; then copies, and copies with opposite marks.
        abuse.train([([start, f"{start} you moron", start, "plain", "odd one", "odd one"], np.array([0.0, 1, 0, 0, 1, 0]))])
    finally:
        abuse.count_sequences = original
    assert seen == [3]


def test_sample_is_bounded_in_documents_and_characters(spark):
    texts, y = planted(60, 6)
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("source", F.lit("s"))
    labels = spark.createDataFrame([(k, int(v), "r") for k, v in enumerate(y)], "doc_id bigint, abusive int, reviewer string")
    assert abuse.labelled(documents, labels, 20).count() == 20
    small = pickle.loads(abuse.fit(documents, labels, max_characters=0))
    assert np.ptp(small.score(texts)) == 0
    one, other = (abuse.fit(documents.repartition(n), labels.repartition(n)) for n in (1, 5))
    assert np.array_equal(pickle.loads(one).score(texts), pickle.loads(other).score(texts))


def test_operator(spark):
    texts, y = planted(300, 4)
    documents = spark.createDataFrame([(k, t, "a" if k % 2 else None, "x") for k, t in enumerate(texts)] + [(900, None, "a", "x"), (901, "", "b", "x"), (None, "you are a pathetic moron", "c", "x")], "doc_id bigint, text string, source string, score string")
    labels = spark.createDataFrame([(k, int(v), "r") for k, v in enumerate(y)] + [(0, None, "r"), (None, 1, "r"), (5000, 1, "r"), (1, 0, "r"), (1, 1, "s")], "doc_id bigint, abusive int, reviewer string")
    assert abuse.labelled(documents, labels, 100).count() <= 100
    scored = abuse.score_documents(documents, abuse.fit(documents, labels)).cache()
    assert scored.count() == 303 and scored.where("score is null or score < 0 or score > 1").count() == 0
    found = {r.doc_id for r in abuse.abusive(scored).collect()}
    assert not found & {900, 901} and len(found & set(np.flatnonzero(y).tolist())) > 0.7 * y.sum()
    rates = {r.source: r for r in abuse.source_rates(scored).collect()}
    assert rates["b"].rate == 0 and sum(r.documents for r in rates.values()) == 303 and sum(r.abusive for r in rates.values()) == len(found) + rates["c"].abusive
    empty = abuse.score_documents(documents.limit(0), abuse.fit(documents.limit(0), labels.limit(0)))
    assert empty.count() == 0
