import datetime as dt
import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from chronoweave import Spine, ValidationError
from chronoweave.operators import brandes as hubs
from chronoweave.operators import graph


def brandes(n, edges, depth):
    nbr = {v: set() for v in range(n)}
    for a, b in edges:
        if a != b:
            nbr[a].add(b)
            nbr[b].add(a)
    score = np.zeros(n)
    for s in range(n):
        dist, sigma, order, pred = {s: 0}, {s: 1.0}, [s], {s: []}
        for v in order:
            if dist[v] == depth:
                continue
            for w in nbr[v]:
                if w not in dist:
                    dist[w], sigma[w], pred[w] = dist[v] + 1, 0.0, []
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    pred[w].append(v)
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in pred[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                score[w] += delta[w]
    return score / 2


def random_graph(versions, seed, n=12, p=0.2):
    r = random.Random(seed)
    pairs = [(a, b) for a, b in itertools.permutations(range(n), 2) if r.random() < p]
    return pairs, versions(*((f"n{a:02d}", "L", f"n{b:02d}", "2026-01-01", None, 0.5) for a, b in pairs), ("n00", "L", "n00", "2026-01-01", None, 0.5))


@pytest.mark.parametrize("seed, depth", [(1, 1), (2, 2), (3, 3), (4, 10)])
@pytest.mark.parametrize("local", [200_000, 0])
def test_betweenness(versions, seed, depth, local):
    pairs, v = random_graph(versions, seed)
    got = {r["entity"]: r["betweenness"] for r in graph.betweenness(v, "2026-01-01", depth, local_edges=local).collect()}
    want = brandes(12, pairs, depth)
    assert set(got) == {f"n{k:02d}" for k in {*itertools.chain(*pairs), 0}}
    for name, score in got.items():
        assert score == pytest.approx(want[int(name[1:])], abs=1e-9)


@pytest.mark.parametrize("local", [200_000, 0])
def test_pagerank(versions, local):
    pairs, v = random_graph(versions, 5)
    got = {r["entity"]: r["pagerank"] for r in graph.pagerank(v, "2026-01-01", max_iterations=8, tolerance=0.0, local_edges=local).collect()}
    assert sum(got.values()) == pytest.approx(1)
    nodes = sorted({*itertools.chain(*pairs), 0})
    out = {a: {b for x, b in pairs if x == a} for a in nodes}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(8):
        loose = sum(rank[a] for a in nodes if not out[a])
        rank = {b: 0.15 / len(nodes) + 0.85 * (sum(rank[a] / len(out[a]) for a in nodes if b in out[a]) + loose / len(nodes)) for b in nodes}
    assert got == pytest.approx({f"n{k:02d}": x for k, x in rank.items()})


@pytest.mark.parametrize("seed", [7, 8])
def test_both_ways_agree(versions, seed):
    pairs, v = random_graph(versions, seed, 14, 0.12)
    for depth in (2, 4):
        near, far = (sorted((r["entity"], round(r["closeness"], 9)) for r in graph.closeness(v, "2026-01-01", None, depth, n).collect()) for n in (200_000, 0))
        assert near == far and near
    one, other = ([[x["version_id"] for x in r["path"]] for r in graph.shortest_paths(v, "n01", "n09", "2026-01-01", 6, n).collect()] for n in (200_000, 0))
    assert one == other


def test_star_and_path(versions):
    star = versions(*((f"leaf{k}", "L", "hub", "2026-01-01", None, None) for k in range(4)))
    close = {r["entity"]: r["closeness"] for r in graph.closeness(star, "2026-01-01").collect()}
    assert close["hub"] == 4.0 and close["leaf1"] == 2.5
    rank = {r["entity"]: r["pagerank"] for r in graph.pagerank(star, "2026-01-01").collect()}
    assert max(rank, key=rank.get) == "hub" and sum(rank.values()) == pytest.approx(1)
    line = versions(("A", "L", "B", "2026-01-01", None, None), ("A", "M", "B", "2026-01-01", None, None), ("B", "L", "C", "2026-01-01", None, None))
    assert {r["entity"]: r["betweenness"] for r in graph.betweenness(line, "2026-01-01").collect()} == {"A": 0.0, "B": 1.0, "C": 0.0}


@pytest.fixture
def chain(versions):
    return versions(
        ("A", "L", "B", "2026-01-01", None, None), ("C", "L", "B", "2026-01-01", "2026-01-20", None), ("C", "L", "D", "2026-01-05", None, None),
        ("A", "L", "D", "2026-01-15", None, None), ("A", "K", "D", "2026-01-16", None, None), ("X", "L", "Y", "2026-01-01", None, None), ("A", "L", "B", "2026-01-03", None, None),
    )


@pytest.mark.parametrize("local", [200_000, 0])
def test_paths(chain, local):
    ids = lambda a, b, d, depth=4: [[v["version_id"] for v in r["path"]] for r in graph.shortest_paths(chain, a, b, d, depth, local).collect()]
    assert ids("A", "D", "2026-01-04") == []
    assert ids("A", "D", "2026-01-05") == [[1, 2, 3]]
    assert ids("A", "D", "2026-01-05", 2) == []
    assert ids("A", "D", "2026-01-15") == [[4]]
    assert ids("A", "D", "2026-01-16") == [[5]]  # predicate K comes before L in scan order
    assert ids("A", "A", "2026-01-16") == [[]]
    assert ids("A", "Y", "2026-01-16") == [] == ids("nobody", "A", "2026-01-16")
    for bad in (0, 11, True, 2.0):
        with pytest.raises(ValidationError):
            graph.shortest_paths(chain, "A", "B", "2026-01-01", bad)


def test_path_history_equals_each_date(chain):
    spine = Spine.of("2026-01-03", "2026-01-18", 3)
    for r in graph.path_history(chain, "A", "D", spine).collect():
        single = graph.shortest_paths(chain, "A", "D", r["date"]).collect()
        assert (r["path"] is None) == (not single) and (not single or r["path"] == single[0]["path"])


@pytest.mark.parametrize("seed", range(6))
def test_first_connected_equals_search_per_date(versions, seed):
    r = random.Random(seed)
    facts = []
    for _ in range(14):
        a, b = r.sample("ABCDEF", 2)
        x = r.randint(1, 20)
        facts.append((a, "L", b, f"2026-01-{x:02d}", r.choice([None, f"2026-01-{min(28, x + r.randint(0, 8)):02d}"]), None))
    v = versions(*facts)
    start, end = r.choice([(None, None), ("2026-01-05", "2026-01-18"), ("2026-01-09", None)])
    depth = r.choice([1, 2, 3])
    got = graph.first_connected(v, "A", "F", start, end, depth).first()[0]
    want = None
    for d in sorted({f[3] for f in facts}):
        if (start is None or d >= start) and (end is None or d <= end):
            live = [(a, b) for a, _, b, x, y, _ in facts if x <= d and (y is None or y >= d)]
            reach = {"A"}
            for _ in range(depth):
                reach |= {q for a, b in live for p, q in ((a, b), (b, a)) if p in reach}
            if "F" in reach:
                want = d
                break
    assert (str(got) if got else None) == want


def test_first_connected_to_itself(chain, day):
    assert graph.first_connected(chain, "A", "A", "2026-01-02").first()[0] == day("2026-01-02")
    assert graph.first_connected(chain, "A", "A").first()[0] is None


def test_empty_graph(versions):
    v = versions(("A", "L", "B", "2026-01-01", None, None))
    day = "2020-01-01"
    assert graph.betweenness(v, day).count() == graph.pagerank(v, day).count() == graph.closeness(v, day).count() == 0


def moving(versions, seed=11, n=9):
    """Edges that come and go, some in overlapping parallel versions."""
    r = random.Random(seed)
    facts = []
    for _ in range(40):
        a, b = r.sample(range(n), 2)
        x = r.randint(1, 20)
        facts.append((f"n{a}", r.choice("LM"), f"n{b}", f"2026-01-{x:02d}", r.choice([None, f"2026-01-{min(28, x + r.randint(0, 9)):02d}"]), None))
    return versions(*facts)


@pytest.mark.parametrize("local", [500_000, 0])
def test_a_spine_gives_what_each_date_gives(versions, local):
    v, spine = moving(versions), Spine.of("2026-01-02", "2026-01-20", 9)
    dates = [f"2026-01-{d:02d}" for d in (2, 11, 20)]
    near = {(str(r["date"]), r["entity"]): round(r["closeness"], 9) for r in graph.closeness(v, spine, None, 3, local).collect()}
    between = {(str(r["date"]), r["entity"]): round(r["betweenness"], 9) for r in graph.betweenness(v, spine, 3, None, local).collect()}
    rank = {(str(r["date"]), r["entity"]): round(r["pagerank"], 9) for r in graph.pagerank(v, spine, max_iterations=5, tolerance=0.0, local_edges=local).collect()}
    hops = {(str(r["date"]), r["node"]): r["hops"] for r in graph.path_lengths(v, ["n1"], spine, 3, local).collect()}
    paths = {str(r["date"]): [x["version_id"] for x in r["path"]] for r in graph.shortest_paths(v, "n1", "n7", spine, 4, local).collect()}
    for d in dates:
        of = lambda found: {k[1]: x for k, x in found.items() if k[0] == d}  # noqa: E731, B023
        assert of(near) == {r["entity"]: round(r["closeness"], 9) for r in graph.closeness(v, d, None, 3).collect()}
        assert of(between) == {r["entity"]: round(r["betweenness"], 9) for r in graph.betweenness(v, d, 3).collect()}
        assert of(rank) == {r["entity"]: round(r["pagerank"], 9) for r in graph.pagerank(v, d, max_iterations=5, tolerance=0.0).collect()}
        assert of(hops) == {r["node"]: r["hops"] for r in graph.path_lengths(v, ["n1"], d, 3).collect()}
        assert paths.get(d) == next(([x["version_id"] for x in r["path"]] for r in graph.shortest_paths(v, "n1", "n7", d, 4).collect()), None)


@pytest.mark.parametrize("local", [500_000, 0])
def test_betweenness_of_one_equals_that_among_all(versions, local):
    v = moving(versions, 12)
    everyone = {r["entity"]: r["betweenness"] for r in graph.betweenness(v, "2026-01-12", 3).collect()}
    for name in ("n0", "n3"):
        (one,) = graph.betweenness(v, "2026-01-12", 3, [name], local).collect()
        assert one["betweenness"] == pytest.approx(everyone[name])


def test_what_is_dealt_does_not_grow_with_the_number_of_dates(versions):
    v = moving(versions)
    edges = graph.undirected_edges(v, Spine.of("2026-01-01", "2035-12-31", 1))
    sizes = []
    for days in (100, 3_000):
        spine = Spine(Spine.of("2026-01-01", "2026-01-02").start, dt.date(2026, 1, 1) + dt.timedelta(days=days), 1)
        kept = graph.undirected_edges(v, spine)
        seen = graph._deal(kept, spine, lambda part, ticks, k, parts: pd.DataFrame({"n": [len(part)]}), "n bigint", 1)
        sizes.append(sum(r.n for r in seen.collect()))
    assert max(sizes) <= graph.TASKS * edges.count()


@pytest.mark.parametrize("depth", [2, 3, 4, 6])
@pytest.mark.parametrize("parts", [1, 3])
def test_betweenness_beside_hubs(monkeypatch, depth, parts):
    """Hubs that share leaves, light paths as short as those through hubs, shorter ones, and parts of the graph without a hub."""
    monkeypatch.setattr(hubs, "LEAST_DEGREE", 5)
    r = random.Random(depth)
    pairs = {(h, leaf) for h in range(3) for leaf in range(3, 40) if r.random() < 0.4}
    pairs |= {tuple(sorted(r.sample(range(3, 40), 2))) for _ in range(30)} | {(0, 1), (50, 51), (51, 52), (52, 53), (50, 53)}
    src, dst = np.array(sorted(pairs)).T
    both = np.concatenate([src, dst]), np.concatenate([dst, src])
    got = sum(hubs.betweenness_share(*both, 54, depth, k, parts) for k in range(parts))
    assert got == pytest.approx(brandes(54, pairs, depth), abs=1e-9)


def test_betweenness_of_a_hub_of_many_leaves_is_not_searched_leaf_by_leaf(monkeypatch):
    """A search from each of 6,000 leaves would take 6,000 x 12,000 steps; the leaves are alike and go through the sums as one."""
    leaves = 6_000
    hub, leaf = np.zeros(leaves, dtype=np.int64), np.arange(1, leaves + 1)
    steps = []
    leave = hubs._leave
    monkeypatch.setattr(hubs, "_leave", lambda *x: (steps.append(len((got := leave(*x))[0])), got)[1])
    score = hubs.betweenness_share(np.concatenate([hub, leaf]), np.concatenate([leaf, hub]), leaves + 1, 4)
    assert score[0] == leaves * (leaves - 1) / 2 and not score[1:].any()
    assert sum(steps) < 10 * leaves


def test_track_betweenness_of_more_edges_than_names_allow(versions, monkeypatch):
    """Above ``local_edges`` all entities are still solved by numbers, not by joins over all pairs."""
    v, spine = moving(versions, 13), Spine.of("2026-01-02", "2026-01-20", 9)
    joined = {(r["date"], r["entity"]): round(r["betweenness"], 8) for r in graph.betweenness(v, spine, 2, None, 0).collect()}
    monkeypatch.delattr(graph, "_betweenness_joins")
    seen = {(r["date"], r["entity"]): round(r["betweenness"], 8) for r in graph.betweenness(v, spine, 2, None, 4).collect()}
    assert seen == joined and any(seen.values())


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("least", [2, 5, 99])
def test_betweenness_cut_at_two_hops_searches_nothing(monkeypatch, parts, least):
    """Any number of hubs, and lists of pairs cut anywhere."""
    monkeypatch.delattr(hubs, "_Component")
    monkeypatch.setattr(hubs, "LEAST_DEGREE", least)
    monkeypatch.setattr(hubs, "WEDGES", 7)
    r = random.Random(least)
    pairs = {(h, leaf) for h in range(4) for leaf in range(4, 60) if r.random() < 0.5}
    pairs |= {tuple(sorted(r.sample(range(4, 60), 2))) for _ in range(60)} | {(0, 1), (1, 2), (61, 62), (62, 63)}
    src, dst = np.array(sorted(pairs)).T
    got = sum(hubs.betweenness_share(np.concatenate([src, dst]), np.concatenate([dst, src]), 64, 2, k, parts) for k in range(parts))
    assert got == pytest.approx(brandes(64, pairs, 2), abs=1e-9)


def test_pairs_of_alike_leaves_are_not_listed(monkeypatch):
    """8,000 leaves of two hubs have 32 million pairs; they go through the sums as a few classes."""
    leaf = np.arange(2, 8_002)
    src, dst = np.concatenate([np.zeros(7_000, int), np.ones(7_000, int)]), np.concatenate([leaf[:7_000], leaf[1_000:]])
    listed = []
    unique = np.unique
    monkeypatch.setattr(hubs.np, "unique", lambda x, **k: (listed.append(len(x)), unique(x, **k))[1])
    score = hubs.betweenness_share(np.concatenate([src, dst]), np.concatenate([dst, src]), 8_002, 2)
    # Pairs of leaves that have both hubs are shared.
    alone, shared = 7_000 * 6_999 / 2 - 6_000 * 5_999 / 2, 6_000 * 5_999 / 2
    assert score[:2] == pytest.approx([alone + shared / 2] * 2)
    # The hubs themselves are a pair with 6,000 neighbours in common.
    assert score[2:] == pytest.approx(np.where((leaf >= 1_002) & (leaf < 7_002), 1 / 6_000, 0))
    assert sum(listed) < 100_000


def test_pairs_are_listed_from_the_lesser_end(monkeypatch):
    """A node beside 2,000 that have 10 neighbours each would list 20,000 pairs at once, its neighbours' leaves list 9 at most."""
    middle = np.arange(1, 2_001)
    src = np.concatenate([np.zeros(2_000, int), np.repeat(middle, 10)])
    dst = np.concatenate([middle, np.arange(2_001, 22_001)])
    monkeypatch.setattr(hubs, "WEDGES", 1_000)
    held = []
    unique = np.unique
    monkeypatch.setattr(hubs.np, "unique", lambda x, **k: (held.append(len(x) if "return_inverse" in k and "return_counts" in k else 0), unique(x, **k))[1])
    score = hubs.betweenness_share(np.concatenate([src, dst]), np.concatenate([dst, src]), 22_001, 2)
    assert score[0] == 2_000 * 1_999 / 2 and (score[1:2_001] == 55).all() and not score[2_001:].any()
    assert max(held) <= 1_100


@pytest.mark.parametrize("depth", [2, 4])
def test_parts_of_betweenness_agree_whatever_the_order_of_rows(depth):
    r = random.Random(depth)
    pairs = {tuple(sorted(r.sample(range(30), 2))) for _ in range(60)}
    rows = [{"src": f"n{a:02d}", "dst": f"n{b:02d}", "t0": 0, "t1": 0} for a, b in pairs] + [{"src": x, "dst": x, "t0": 0, "t1": 0} for x in (None, "alone")]
    score: dict = {}
    for part in range(3):
        r.shuffle(rows)
        for found in graph._shares_of(pa.Table.from_pylist(rows), range(1), depth, part, 3):
            for x in found.to_pylist():
                score[x["entity"]] = score.get(x["entity"], 0.0) + x["score"]
    want = brandes(30, pairs, depth)
    assert set(score) == {f"n{k:02d}" for k in itertools.chain(*pairs)} | {None, "alone"}
    assert score.pop(None) == score.pop("alone") == 0
    for name, x in score.items():
        assert x == pytest.approx(want[int(name[1:])], abs=1e-9)


@pytest.mark.parametrize("local", [500_000, 0])
def test_betweenness_of_what_has_no_edge(versions, local):
    """Ends of self-loops and of versions without one end are active."""
    v = versions(*((a, "L", b, "2026-01-01", None, None) for a, b in (("a", "b"), ("b", "c"), ("d", "d"), (None, "e"), ("b", "a"))))
    got = {r["entity"]: r["betweenness"] for r in graph.betweenness(v, "2026-01-02", 2, None, local).collect()}
    assert got == {"a": 0, "b": 1, "c": 0, "d": 0, "e": 0, None: 0}
