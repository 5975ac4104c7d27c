import numpy as np
import pytest

from chronoweave import ValidationError
from chronoweave.operators.changepoint import changepoints, segment


def slow(x, min_size, penalty):
    x = list(map(float, x))
    n = len(x)
    if n < 2 * min_size:
        return []
    rss = lambda a, b: sum((v - np.mean(x[a:b])) ** 2 for v in x[a:b])
    penalty = float(np.var(x)) * np.log(n) if penalty is None else penalty

    def cut(a, b):
        best, at = penalty, None
        for k in range(a + min_size, b - min_size + 1):
            gain = rss(a, b) - rss(a, k) - rss(k, b)
            if gain > best + 1e-9:
                best, at = gain, k
        return [] if at is None else cut(a, at) + [at] + cut(at, b)

    return cut(0, n)


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("min_size, penalty", [(1, None), (2, None), (4, 1.0), (2, 0.5)])
def test_same_as_plain_segmentation(seed, min_size, penalty):
    r = np.random.default_rng(seed)
    x = np.repeat(r.integers(0, 9, 4), r.integers(3, 14)) + r.normal(0, 0.3, 1)
    x = x + r.normal(0, 0.4, len(x))
    assert segment(x, min_size, penalty) == slow(x, min_size, penalty)


def test_flat_short_and_step():
    assert segment(np.full(50, 0.1), 2, 0.0) == []
    assert segment(np.array([1.0, 5.0, 1.0])) == []
    assert segment(np.array([])) == []
    assert segment(np.r_[np.zeros(20), np.ones(20) * 5, np.zeros(20)]) == [20, 40]


def test_many_signals(spark, day):
    rows = [(s, day(f"2026-01-{d:02d}"), (None if d == 3 else 4.0 if d > 14 else 1.0) if s == "a" else 2.0) for s in "ab" for d in range(1, 29)]
    got = [tuple(r) for r in changepoints(spark.createDataFrame(rows, "signal string, date date, value double"), ["signal"]).collect()]
    assert got == [("a", day("2026-01-15"))]
    with pytest.raises(ValidationError):
        changepoints(spark.createDataFrame(rows, "signal string, date date, value double"), ["signal"], 0)
