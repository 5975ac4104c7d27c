"""Bounded traversal, centrality and connection over active edges.

One job answers for all dates of a spine and all source entities at once; a
date or entity asked for is a filter.  Edges stay intervals - (src, dst, t0,
t1), the first and last date of the spine they are active on - and are never
written once per date.  Two ways are built in and chosen by counted size:

* Graphs within ``local_edges`` are dealt to a fixed number of tasks, each with
  a stretch of the dates and a part of the sources, and solved there by array
  kernels.  What is shuffled does not grow with the number of dates.
* Larger ones go level by level: the frontier, which has a row per date, meets
  the interval edges in a join by node.  Every level is written to the shared
  folder before it is used twice, which keeps plans flat and lets a lost
  executor's work be read back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.errors import ValidationError
from chronoweave.functions.times import FAR_DAY, day_literal
from chronoweave.operators.brandes import betweenness_share
from chronoweave.operators.temporal import Day, Spine
from chronoweave.sources.scratch import discard, materialize, scratch_path
from chronoweave.sources.shipping import ship_package

Dates = Day | Spine
PAIR = ["src", "dst"]
SPAN = ["t0", "t1"]
#: Tasks that a local graph is dealt to.
TASKS = 16
#: Edges that betweenness of all is dealt, times ``local_edges``: its tasks keep names once and edges as numbers.
CODED = 16
#: Tasks for betweenness cut at two hops, most of which is getting the edges.
TASKS_OF_TWO = 6


def check_depth(depth: int) -> int:
    if isinstance(depth, bool) or not isinstance(depth, int) or not 1 <= depth <= 10:
        raise ValidationError("max_depth must be a whole number from 1 to 10")
    return depth


def spine_of(dates: Dates) -> Spine:
    return dates if isinstance(dates, Spine) else Spine.of(dates, dates)


def spans(versions: DataFrame, spine: Spine) -> DataFrame:
    """Versions that are active on a date of the spine, with the first and last one (t0, t1)."""
    if not spine.size:
        return versions.where(F.lit(False)).withColumns({"t0": F.lit(0), "t1": F.lit(0)})
    return spine.bounded(versions)


def both_ways(rows: DataFrame, *more: str) -> DataFrame:
    """(src, dst, more...): each row in both directions."""
    pair = F.array(
        F.struct(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")),
        F.struct(F.col("object_id").alias("src"), F.col("subject_id").alias("dst")),
    )
    return rows.select(F.explode(pair).alias("e"), *more).select("e.*", *more)


def undirected_edges(versions: DataFrame, spine: Spine) -> DataFrame:
    """(src, dst, t0, t1): both directions, equal ones once, no self-loops; intervals of a pair may overlap."""
    return both_ways(spans(versions.where(F.col("subject_id") != F.col("object_id")), spine), *SPAN).distinct()


def merged(edges: DataFrame) -> DataFrame:
    """Edges whose intervals are disjoint per pair, so that a pair counts once on a date."""
    order = Window.partitionBy(*PAIR).orderBy(*SPAN)
    reached = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = edges.withColumn("run", F.sum(F.coalesce((reached < F.col("t0") - 1).cast("int"), F.lit(1))).over(order))
    return runs.groupBy(*PAIR, "run").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).drop("run")


def _stored(edges: DataFrame, label: str, limit: int) -> tuple[DataFrame, bool]:
    """The edges, written once, and whether they are few enough for the local way."""
    kept = materialize(edges, label)
    return kept, kept.count() <= limit


def _on(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Frontier rows (tick, node, ...) beside the edges that leave the node on that date."""
    return frontier.join(edges, (frontier["node"] == edges["src"]) & frontier["tick"].between(edges["t0"], edges["t1"]))


def _dated(found: DataFrame, spine: Spine) -> DataFrame:
    return found.select(spine.date(F.col("tick")).alias("date"), *(c for c in found.columns if c != "tick"))


# --- the local way ------------------------------------------------------------------------------


def _deal(edges: DataFrame, spine: Spine, solve: Callable, schema: str, parts: int) -> DataFrame:
    """Run ``solve`` (edges of a stretch of dates, its ticks, part, parts) in at most ``TASKS`` tasks.

    A task has the edges of its stretch, which the caller has bounded.  There
    are as many stretches as dates at most, and ``parts`` of the sources per
    stretch only if dates alone do not make enough tasks.
    """
    ship_package(edges.sparkSession)
    stretches = max(1, min(spine.size, TASKS))
    parts = max(1, min(parts, -(-TASKS // stretches)))
    length = -(-max(1, spine.size) // stretches)
    stretch = F.explode(F.sequence(F.floor(F.col("t0") / length), F.floor(F.col("t1") / length))).alias("stretch")
    dealt = edges.select("*", stretch)
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) if parts > 1 else dealt.withColumn("part", F.lit(0))
    size = spine.size

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * length
        return solve(part, range(first, min(first + length, size)), int(key[1]), parts)

    return dealt.groupBy("stretch", "part").applyInPandas(run, schema)


class _Codes:
    """Edges of a task with their ends as numbers, cut to one date at a time."""

    def __init__(self, part: pd.DataFrame):
        ends = np.concatenate([part["src"].to_numpy(), part["dst"].to_numpy()])
        self.names, codes = np.unique(ends.astype(str), return_inverse=True)
        self.src, self.dst = codes[: len(part)], codes[len(part) :]
        self.t0, self.t1 = part["t0"].to_numpy(), part["t1"].to_numpy()

    def at(self, tick: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(names, src, dst) of the date, each pair once, with the nodes of that date numbered from 0."""
        on = (self.t0 <= tick) & (self.t1 >= tick)
        pair = np.unique(self.src[on] * len(self.names) + self.dst[on])
        nodes, codes = np.unique(np.concatenate([pair // len(self.names), pair % len(self.names)]) if len(pair) else pair, return_inverse=True)
        return self.names[nodes], codes[: len(pair)], codes[len(pair) :]


def _scores(edges: DataFrame, spine: Spine, kernel: Callable, entities: list[str] | None, rooted: bool = True, ball: int = 0) -> DataFrame:
    """(tick, entity, score) by a kernel (src, dst, nodes, roots); ``ball``: also from roots that many hops around the entities."""

    def solve(part: pd.DataFrame, ticks: range, k: int, parts: int) -> pd.DataFrame:
        codes, found = _Codes(part), []
        for tick in ticks:
            names, src, dst = codes.at(tick)
            wanted = np.arange(len(names)) if entities is None else np.flatnonzero(np.isin(names, entities))
            if not len(names) or not len(wanted):
                continue
            roots = wanted if entities is None or not ball else _around(src, dst, len(names), wanted, ball)
            score = kernel(src, dst, len(names), roots[k::parts])
            kept = wanted[score[wanted] != 0]
            found.append(pd.DataFrame({"tick": np.int32(tick), "entity": names[kept], "score": score[kept]}))
        return pd.concat(found) if found else pd.DataFrame({"tick": np.zeros(0, np.int32), "entity": np.zeros(0, object), "score": np.zeros(0)})

    dealt = _deal(edges, spine, solve, "tick int, entity string, score double", TASKS if rooted else 1)
    return dealt.groupBy("tick", "entity").agg(F.sum("score").alias("score")) if rooted else dealt


def _around(src: np.ndarray, dst: np.ndarray, n: int, start: np.ndarray, hops: int) -> np.ndarray:
    near = np.zeros(n, dtype=bool)
    near[start] = True
    for _ in range(hops):
        near[dst[near[src]]] = True
    return np.flatnonzero(near)


# --- distances ----------------------------------------------------------------------------------


def bfs_distances(edges: DataFrame, sources: DataFrame, max_depth: int = 4) -> DataFrame:
    """(tick, source, node, dist) of the nodes within ``max_depth`` hops, the source itself left out, level by level.

    ``edges``: src, dst, t0, t1 in both directions.  ``sources``: tick, source.
    Neighbours of a level lie on the level before, on it, or after it, so a new
    level is checked against two and not against all that was seen.
    """
    check_depth(max_depth)
    key = ["tick", "source", "node"]
    levels = [sources.select("tick", "source", F.col("source").alias("node"))]
    for _ in range(max_depth):
        step = _on(edges, levels[-1]).select("tick", "source", F.col("dst").alias("node")).distinct()
        for known in levels[-2:]:
            step = step.join(known, key, "left_anti")
        levels.append(materialize(step, "bfs"))
    return reduce(DataFrame.unionByName, (level.withColumn("dist", F.lit(k)) for k, level in enumerate(levels) if k))


def path_lengths(versions: DataFrame, sources: list[str], dates: Dates, max_depth: int = 4, local_edges: int = 500_000) -> DataFrame:
    """(date, source, node, hops) from some sources to everything within reach."""
    check_depth(max_depth)
    spine = spine_of(dates)
    edges, small = _stored(undirected_edges(versions, spine), "edges", local_edges)
    if not small:
        named = edges.sparkSession.createDataFrame([(s,) for s in sorted(set(sources))], "source string")
        return _dated(bfs_distances(edges, _on_spine(edges, named.select("source"), spine), max_depth), spine).withColumnRenamed("dist", "hops")

    def solve(part: pd.DataFrame, ticks: range, k: int, parts: int) -> pd.DataFrame:
        codes, found = _Codes(part), [pd.DataFrame({"tick": np.zeros(0, np.int32), "source": np.zeros(0, object), "node": np.zeros(0, object), "hops": np.zeros(0, np.int32)})]
        for tick in ticks:
            names, src, dst = codes.at(tick)
            roots = np.flatnonzero(np.isin(names, sources))[k::parts]
            for root, node, dist in waves(src, dst, len(names), max_depth, roots) if len(roots) else ():
                found.append(pd.DataFrame({"tick": np.int32(tick), "source": names[root], "node": names[node], "hops": np.int32(dist)}))
        return pd.concat(found)

    return _dated(_deal(edges, spine, solve, "tick int, source string, node string, hops int", len(set(sources))), spine)


def _on_spine(edges: DataFrame, sources: DataFrame, spine: Spine) -> DataFrame:
    """(tick, source): the given sources on every date on which they have an edge."""
    own = edges.join(sources, edges["src"] == sources["source"], "left_semi")
    return own.select(F.explode(F.sequence("t0", "t1")).alias("tick"), F.col("src").alias("source")).distinct()


def waves(src: np.ndarray, dst: np.ndarray, n: int, max_depth: int, roots: np.ndarray, at_once: int = 64):
    """(roots, nodes, distance) of what is reached, wave by wave, ``at_once`` roots at a time."""
    for first in range(0, len(roots), at_once):
        some = roots[first : first + at_once]
        seen = np.zeros((len(some), n), dtype=bool)
        seen[np.arange(len(some)), some] = True
        wave = seen.copy()
        for level in range(1, max_depth + 1):
            wave = (_spread(wave, src, dst, n) > 0) & ~seen
            if not wave.any():
                break
            seen |= wave
            root, node = np.nonzero(wave)
            yield some[root], node, level


def closeness(versions: DataFrame, dates: Dates, entities: list[str] | None = None, max_depth: int = 4, local_edges: int = 500_000) -> DataFrame:
    """(date, entity, closeness): sum of 1/distance; entities without an edge on the date give no row."""
    check_depth(max_depth)
    spine = spine_of(dates)
    edges, small = _stored(undirected_edges(versions, spine), "edges", local_edges)
    if small:
        scores = _scores(edges, spine, lambda s, d, n, roots: closeness_kernel(s, d, n, max_depth, roots), entities)
    else:
        scores = _closeness_joins(edges, spine, entities, max_depth)
    return _dated(scores, spine).withColumnRenamed("score", "closeness")


def _closeness_joins(edges: DataFrame, spine: Spine, entities: list[str] | None, max_depth: int) -> DataFrame:
    sources = edges.select(F.col("src").alias("source")).distinct()
    if entities is not None:
        sources = sources.where(F.col("source").isin(entities))
    return (
        bfs_distances(edges, _on_spine(edges, sources, spine), max_depth)
        .groupBy("tick", "dist", F.col("source").alias("entity"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("tick", "entity")
        .agg(F.sum(F.col("n") / F.col("dist")).alias("score"))
    )


def closeness_kernel(src: np.ndarray, dst: np.ndarray, n: int, max_depth: int, roots: np.ndarray) -> np.ndarray:
    total = np.zeros(n)
    for root, _, level in waves(src, dst, n, max_depth, roots):
        total += np.bincount(root, minlength=n) / level
    return total


# --- paths --------------------------------------------------------------------------------------


def path_steps(versions: DataFrame, spine: Spine) -> DataFrame:
    """(src, dst, t0, t1, side, p, s, f, v): each active version in both directions with its place in scan order.

    The place ends with the version_id; the version's other columns are fetched
    for the finished paths only.
    """
    wanted = spans(versions.where(F.col("subject_id") != F.col("object_id")).select("version_id", "subject_id", "predicate", "object_id", "valid_from", "valid_to"), spine)
    place = [F.col("predicate").alias("p"), F.unix_date("valid_from").alias("f"), F.col("version_id").alias("v"), *SPAN]
    forward = wanted.select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), F.lit(0).alias("side"), F.lit("").alias("s"), *place)
    backward = wanted.select(F.col("object_id").alias("src"), F.col("subject_id").alias("dst"), F.lit(1).alias("side"), F.col("subject_id").alias("s"), *place)
    return forward.unionByName(backward)


STEP = ["side", "p", "s", "f", "v"]


def shortest_paths(versions: DataFrame, a: str, b: str, dates: Dates, max_depth: int = 4, local_edges: int = 500_000) -> DataFrame:
    """(date, hops, path): a shortest undirected path per date that has one within ``max_depth`` hops.

    Ties go to the path that breadth-first search in scan order meets first:
    every node keeps its least *rank*, the list of steps that led to it.  From
    an entity to itself the path is empty, on every date.
    """
    check_depth(max_depth)
    spark, spine = versions.sparkSession, spine_of(dates)
    if a == b:
        kind = versions.select(F.struct(*versions.columns).alias("x")).schema["x"].dataType.simpleString()
        return spine.frame(spark).select("date", F.lit(0).alias("hops"), F.from_json(F.lit("[]"), f"array<{kind}>").alias("path"))
    steps, small = _stored(path_steps(versions, spine), "path-steps", local_edges)
    ranked = _paths_local(steps, spine, a, b, max_depth) if small else _paths_joins(steps, a, b, max_depth)
    version = F.struct(*versions.columns).alias("version")
    return (
        _dated(ranked, spine).select("date", "hops", F.posexplode("ids").alias("hop", "version_id"))
        .join(versions.select(F.col("version_id").alias("id"), version), F.col("id") == F.col("version_id"))
        .groupBy("date", "hops")
        .agg(F.array_sort(F.collect_list(F.struct("hop", "version"))).alias("p"))
        .select("date", "hops", F.col("p.version").alias("path"))
    )


def _paths_joins(steps: DataFrame, a: str, b: str, max_depth: int) -> DataFrame:
    """(tick, hops, ids) by a join per level; every node keeps its least rank on every date."""
    levels: list[DataFrame] = []
    step = F.struct(*STEP)
    for level in range(1, max_depth + 1):
        # The last level is only asked for the target.
        usable = steps.where(F.col("dst") == b) if level == max_depth else steps.where(F.col("dst") != a)
        if not levels:
            found = usable.where(F.col("src") == a).select(F.explode(F.sequence("t0", "t1")).alias("tick"), F.col("dst").alias("node"), F.array(step).alias("rank"))
        else:
            # Dates whose target is reached are done; their frontier is not expanded any more.
            done = reduce(DataFrame.unionByName, levels).where(F.col("node") == b).select("tick")
            frontier = levels[-1].join(done, "tick", "left_anti")
            found = _on(usable, frontier).select("tick", F.col("dst").alias("node"), F.concat("rank", F.array(step)).alias("rank"))
        new = found.groupBy("tick", "node").agg(F.min("rank").alias("rank"))
        for known in levels[-2:]:
            new = new.join(known.select("tick", "node"), ["tick", "node"], "left_anti")
        levels.append(materialize(new, "path"))
    return reduce(DataFrame.unionByName, (x.where(F.col("node") == b).select("tick", F.lit(k).alias("hops"), F.col("rank.v").alias("ids")) for k, x in enumerate(levels, 1)))


def _paths_local(steps: DataFrame, spine: Spine, a: str, b: str, max_depth: int) -> DataFrame:
    """(tick, hops, ids), a stretch of dates per task."""

    def solve(part: pd.DataFrame, ticks: range, k: int, parts: int) -> pd.DataFrame:
        part = part.sort_values(["src", *STEP], kind="stable")
        names, codes = np.unique(np.concatenate([part["src"].to_numpy(), part["dst"].to_numpy(), [a, b]]).astype(str), return_inverse=True)
        src, dst, ids = codes[: len(part)], codes[len(part) : -2], part["v"].to_numpy()
        t0, t1, start, target = part["t0"].to_numpy(), part["t1"].to_numpy(), int(codes[-2]), int(codes[-1])
        order = np.argsort(src, kind="stable")
        found: list[tuple[int, int, list[int]]] = []
        for tick in ticks:
            on = order[(t0[order] <= tick) & (t1[order] >= tick)]
            border = np.searchsorted(src[on], np.arange(len(names) + 1))
            came: dict[int, tuple[int, int] | None] = {start: None}
            wave = [start]
            for _ in range(max_depth):
                following = []
                for node in wave:
                    for e in on[border[node] : border[node + 1]]:
                        if (end := int(dst[e])) not in came:
                            came[end] = (node, int(ids[e]))
                            following.append(end)
                wave = following
                if target in came or not wave:
                    break
            if target in came:
                path: list[int] = []
                node = target
                while came[node] is not None:
                    node, version = came[node]
                    path.append(version)
                found.append((tick, len(path), path[::-1]))
        return pd.DataFrame(found, columns=["tick", "hops", "ids"])

    return _deal(steps, spine, solve, "tick int, hops int, ids array<bigint>", 1)


def path_history(versions: DataFrame, a: str, b: str, spine: Spine, max_depth: int = 4) -> DataFrame:
    """(date, hops, path) on every date of the spine, NULL where there is no path."""
    return spine.frame(versions.sparkSession).select("date").join(shortest_paths(versions, a, b, spine, max_depth), "date", "left")


def first_connected(versions: DataFrame, a: str, b: str, start: Day | None = None, end: Day | None = None, max_depth: int = 4) -> DataFrame:
    """(first_connected): the earliest start of any version in [start, end] on which a path exists; NULL if none.

    Instead of searching date by date, paths carry the intersection of their
    versions' intervals; empty and dominated intersections are dropped, so a
    node keeps few.  A pair connected already at ``start`` is reported at the
    first date inside on which something opens.
    """
    check_depth(max_depth)
    spark = versions.sparkSession
    low, high, never = day_literal(start or "0001-01-01", "start"), day_literal(end or FAR_DAY, "end"), day_literal(FAR_DAY)
    if a == b:
        return spark.range(1).select((low if start else F.lit(None).cast("date")).alias("first_connected"))
    opens = versions.where(F.col("valid_from").between(low, high)).agg(F.min("valid_from").cast("string")).first()[0]
    if opens is None:
        return spark.range(1).select(F.lit(None).cast("date").alias("first_connected"))
    links = versions.where((F.col("subject_id") != F.col("object_id")) & (F.col("valid_from") <= high) & (F.col("valid_to").isNull() | (F.col("valid_to") >= low))).select(
        F.explode(F.array(F.struct(F.col("subject_id").alias("src"), F.col("object_id").alias("dst")), F.struct(F.col("object_id").alias("src"), F.col("subject_id").alias("dst")))).alias("e"),
        F.greatest("valid_from", low).alias("since"),
        F.coalesce("valid_to", never).alias("until"),
    ).select("e.*", "since", "until")
    links = materialize(_undominated(links, ["src", "dst"]), "links")
    frontier = spark.range(1).select(F.lit(a).alias("node"), low.alias("since"), never.alias("until"))
    arrivals: list[DataFrame] = []
    for level in range(1, max_depth + 1):
        f = frontier.alias("f")
        step = f.join(links.alias("l"), F.col("f.node") == F.col("l.src")).select(
            F.col("l.dst").alias("node"), F.greatest("f.since", "l.since").alias("since"), F.least("f.until", "l.until").alias("until")
        ).where("since <= until")
        step = step.where(F.col("node") == b) if level == max_depth else step.where(F.col("node") != a)
        frontier = materialize(_undominated(step, ["node"]), "reach")
        arrivals.append(frontier.where(F.col("node") == b))
        frontier = frontier.where(F.col("node") != b)
    reached = arrivals[0]
    for more in arrivals[1:]:
        reached = reached.unionByName(more)
    # A path that is there at ``low`` counts from the first date something opens.
    dates = reached.select(F.greatest("since", day_literal(opens)).alias("at"), "until").where((F.col("at") <= F.col("until")) & (F.col("at") <= high))
    return dates.agg(F.min("at").alias("first_connected"))


def _undominated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals of a key that no other interval of the key contains."""
    best = rows.groupBy(*keys, "since").agg(F.max("until").alias("until"))
    before = Window.partitionBy(*keys).orderBy("since").rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("reach", F.max("until").over(before)).where("reach is null or until > reach").drop("reach")


# --- centrality -----------------------------------------------------------------------------


def betweenness(versions: DataFrame, dates: Dates, max_depth: int = 4, entities: list[str] | None = None, local_edges: int = 500_000) -> DataFrame:
    """(date, entity, betweenness) of active entities: Brandes, unweighted, undirected, cut at ``max_depth``.

    For given ``entities`` only the sources around them are searched: a path
    through an entity starts less than ``max_depth`` hops from it.  For all,
    tasks number the ends, so that ``CODED`` times as many edges are dealt to them.
    """
    check_depth(max_depth)
    spine = spine_of(dates)
    if entities is None:
        links, small = _stored(_links(versions, spine), "links", local_edges * CODED // 2)
        if small:
            return _dated(_betweenness_coded(links, spine, max_depth), spine)
        versions_of = links.select(F.col("src").alias("subject_id"), F.col("dst").alias("object_id"), *SPAN)
        edges = both_ways(versions_of.where("subject_id <> object_id"), *SPAN)
    else:
        versions_of = spans(versions, spine)
        edges, small = _stored(undirected_edges(versions, spine), "edges", local_edges)
    active = versions_of.select(F.explode(F.array("subject_id", "object_id")).alias("entity"), *SPAN)
    if entities is not None:
        active = active.where(F.col("entity").isin(entities))
    # Self-loops make an entity active though they are no edge.
    nodes = active.distinct().select("entity", F.explode(F.sequence("t0", "t1")).alias("tick")).distinct()
    if small:
        scores = _scores(edges, spine, lambda s, d, n, roots: betweenness_kernel(s, d, n, max_depth, roots), entities, ball=max_depth - 1)
    else:
        scores = _betweenness_joins(materialize(merged(edges), "edges"), spine, entities, max_depth)
    return _dated(nodes.join(scores, ["tick", "entity"], "left").select("tick", "entity", F.coalesce("score", F.lit(0.0)).alias("betweenness")), spine)


def _links(versions: DataFrame, spine: Spine) -> DataFrame:
    """(src, dst, t0, t1): edges in one direction, equal ones once; what is active without one comes beside itself."""
    a, b = F.col("subject_id"), F.col("object_id")
    pair = lambda x, y: F.struct(x.alias("src"), y.alias("dst"))
    links = F.when(a < b, F.array(pair(a, b))).when(a > b, F.array(pair(b, a))).otherwise(F.array(pair(a, a), pair(b, b)))
    return spans(versions, spine).select(F.explode(links).alias("e"), *SPAN).select("e.*", *SPAN).distinct()


def _betweenness_coded(links: DataFrame, spine: Spine, max_depth: int) -> DataFrame:
    """(tick, entity, betweenness) of all entities; tasks number the ends as they come."""
    ship_package(links.sparkSession)
    size = spine.size
    stretches = max(1, min(size, TASKS))
    parts = -(-(TASKS if max_depth > 2 else TASKS_OF_TWO) // stretches)
    length = -(-max(1, size) // stretches)
    stretch = F.explode(F.sequence(F.floor(F.col("t0") / length), F.floor(F.col("t1") / length))).alias("stretch")
    dealt = links.select("*", stretch).select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = dealt.select(*PAIR, *SPAN, (F.col("stretch") * parts + F.col("part")).cast("int").alias("task"))

    def run(batches):
        got = [batch for batch in batches if len(batch)]
        if got:
            edge = pa.Table.from_batches(got)
            del got
            task = edge["task"][0].as_py()
            first = task // parts * length
            for found in _shares_of(edge, range(first, min(first + length, size)), max_depth, task % parts, parts):
                yield from found.to_batches(65_536)

    # One task each: hashed keys would meet in some and leave others out.
    shares = dealt.repartitionById(stretches * parts, F.col("task")).mapInArrow(run, "tick int, entity string, score double")
    # The tenth digit is the order of addition.
    return shares.groupBy("tick", "entity").agg(F.round(F.sum("score"), 10).alias("betweenness"))


def _shares_of(edge: pa.Table, ticks: range, max_depth: int, part: int, parts: int) -> Iterator[pa.Table]:
    """(tick, entity, score) that a part of the sources gives; the first part names all that are active."""
    count, t0, t1 = len(edge), edge["t0"].to_numpy(), edge["t1"].to_numpy()
    ends = pa.chunked_array([*edge["src"].chunks, *edge["dst"].chunks]).dictionary_encode(null_encoding="encode").combine_chunks()
    # Rows come in any order; sources are dealt to parts by their numbers, which must be the same in every task.
    order = pc.sort_indices(ends.dictionary).to_numpy().astype(np.int64)
    names, rank = ends.dictionary.take(pa.array(order)), np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[ends.indices.to_numpy()]
    schema = pa.schema([("tick", pa.int32()), ("entity", names.type), ("score", pa.float64())])
    for tick in ticks:
        on = (t0 <= tick) & (t1 >= tick)
        a, b = codes[:count][on], codes[count:][on]
        there = np.zeros(len(names), dtype=bool)
        there[a] = there[b] = True
        nodes, number = np.flatnonzero(there), np.cumsum(there) - 1
        # Intervals of a pair may overlap; it counts once.
        pair = np.unique(number[a[a != b]] * len(nodes) + number[b[a != b]])
        x, y = pair // max(1, len(nodes)), pair % max(1, len(nodes))
        score = betweenness_share(np.concatenate([x, y]), np.concatenate([y, x]), len(nodes), max_depth, part, parts)
        kept = np.flatnonzero(score) if part else np.arange(len(nodes))
        yield pa.table({"tick": np.full(len(kept), tick, np.int32), "entity": names.take(pa.array(nodes[kept])), "score": score[kept]}, schema=schema)


def betweenness_kernel(src: np.ndarray, dst: np.ndarray, n: int, max_depth: int, sources: np.ndarray, at_once: int = 64) -> np.ndarray:
    """Brandes from some sources, ``at_once`` at a time, with frontier steps on arrays."""
    order = np.argsort(src, kind="stable")
    s, d = src[order], dst[order]
    total = np.zeros(n)
    for first in range(0, len(sources), at_once):
        roots = sources[first : first + at_once]
        k = len(roots)
        sigma = np.zeros((k, n))
        dist = np.full((k, n), -1, dtype=np.int16)
        sigma[np.arange(k), roots] = 1
        dist[np.arange(k), roots] = 0
        last = 0
        for level in range(1, max_depth + 1):
            wave = np.where(dist == level - 1, sigma, 0.0)
            if not wave.any():
                break
            arriving = _spread(wave, s, d, n)
            fresh = (arriving > 0) & (dist < 0)
            sigma[fresh] = arriving[fresh]
            dist[fresh] = level
            last = level
        delta = np.zeros((k, n))
        for level in range(last, 0, -1):
            here = dist == level
            share = np.zeros((k, n))
            share[here] = (1 + delta[here]) / sigma[here]
            back = _spread(share, s, d, n)
            above = dist == level - 1
            delta[above] += (sigma * back)[above]
        delta[np.arange(k), roots] = 0
        total += delta.sum(0)
    return total / 2


def _spread(values: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    """For each row, sum over edges of the value at src into dst."""
    return np.stack([np.bincount(dst, weights=row[src], minlength=n) for row in values])


def _betweenness_joins(edges: DataFrame, spine: Spine, entities: list[str] | None, max_depth: int) -> DataFrame:
    """Level-synchronous Brandes with all sources as a key; path counts are doubles.

    The intervals of a pair are disjoint, so that it counts once on a date.
    """
    key = ["tick", "source", "node"]
    sources = edges.select(F.col("src").alias("source")).distinct()
    start = _on_spine(edges, sources if entities is None else sources.where(F.col("source").isin(entities)), spine)
    if entities is not None and max_depth > 1:
        near = bfs_distances(edges, start, max_depth - 1).select("tick", F.col("node").alias("source"))
        start = materialize(start.unionByName(near).distinct(), "around")
    levels = [materialize(start.select("tick", "source", F.col("source").alias("node"), F.lit(1.0).alias("sigma")), "sigma")]
    for _ in range(max_depth):
        step = _on(edges, levels[-1]).groupBy("tick", "source", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        # Neighbours of a level lie on the level before, on it, or after it.
        for known in levels[-2:]:
            step = step.join(known.select(*key), key, "left_anti")
        levels.append(materialize(step, "sigma"))
    below = levels[-1].withColumn("delta", F.lit(0.0))
    scored: list[DataFrame] = []
    for level in range(max_depth, 0, -1):
        pushed = (
            _on(edges, below.withColumn("share", (1 + F.col("delta")) / F.col("sigma")))
            .groupBy("tick", "source", F.col("dst").alias("node"))
            .agg(F.sum("share").alias("share"))
        )
        scored.append(below.select("tick", "node", "delta"))
        below = materialize(
            levels[level - 1].join(pushed, key, "left").select(*key, "sigma", (F.col("sigma") * F.coalesce("share", F.lit(0.0))).alias("delta")), "delta"
        )
    return reduce(DataFrame.unionByName, scored).groupBy("tick", F.col("node").alias("entity")).agg((F.sum("delta") / 2).alias("score"))


def pagerank(versions: DataFrame, dates: Dates, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, local_edges: int = 500_000) -> DataFrame:
    """(date, entity, pagerank) of all active entities; every date sums to 1.

    Directed, each edge once, self-loops left out, uniform start, the rank of
    dead ends spread over all.  Iteration of a date stops when its ranks change
    by less than ``tolerance`` in sum; 0 runs all iterations.
    """
    if not 0 < damping < 1 or max_iterations < 1:
        raise ValidationError("damping lies between 0 and 1, max_iterations from 1 on")
    spine = spine_of(dates)
    # A self-loop keeps its entity in the graph: it is marked by equal ends and never followed.
    rows = spans(versions, spine).select(F.col("subject_id").alias("src"), F.col("object_id").alias("dst"), *SPAN).distinct()
    edges, small = _stored(rows, "directed", local_edges)
    if small:
        ranks = _scores(edges, spine, lambda s, d, n, _: pagerank_kernel(s, d, n, damping, max_iterations, tolerance), None, rooted=False)
    else:
        ranks = _pagerank_joins(edges, damping, max_iterations, tolerance)
    return _dated(ranks, spine).withColumnRenamed("score", "pagerank")


def pagerank_kernel(src: np.ndarray, dst: np.ndarray, n: int, damping: float, max_iterations: int, tolerance: float) -> np.ndarray:
    real = src != dst
    src, dst = src[real], dst[real]
    out = np.bincount(src, minlength=n)
    rank = np.full(n, 1 / n)
    for _ in range(max_iterations):
        share = np.divide(rank, out, out=np.zeros(n), where=out > 0)
        new = (1 - damping) / n + damping * (np.bincount(dst, weights=share[src], minlength=n) + rank[out == 0].sum() / n)
        moved = np.abs(new - rank).sum()
        rank = new
        if moved < tolerance:
            break
    return rank


def _pagerank_joins(edges: DataFrame, damping: float, max_iterations: int, tolerance: float) -> DataFrame:
    spark = edges.sparkSession
    links = materialize(merged(edges.where("src != dst")), "rank-links")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity"), *SPAN).distinct().select("entity", F.explode(F.sequence("t0", "t1")).alias("tick")).distinct()
    out = links.select(F.col("src").alias("entity"), F.explode(F.sequence("t0", "t1")).alias("tick")).groupBy("tick", "entity").agg(F.count(F.lit(1)).alias("out"))
    counts = ends.groupBy("tick").agg(F.count(F.lit(1)).alias("n"))
    start = ends.join(out, ["tick", "entity"], "left").join(counts, "tick").select("tick", "entity", "out", "n", (1.0 / F.col("n")).alias("rank"))
    paths = [scratch_path(spark, "ranks")]
    ranks = materialize(start, "ranks", paths[0])
    for _ in range(max_iterations):
        going = _on(links, ranks.withColumnRenamed("entity", "node"))
        flow = going.groupBy("tick", F.col("dst").alias("entity")).agg(F.sum(F.col("rank") / F.col("out")).alias("flow"))
        loose = ranks.groupBy("tick").agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("loose"))
        rank = (1 - damping) / F.col("n") + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / F.col("n"))
        new = ranks.join(flow, ["tick", "entity"], "left").join(loose, "tick").select("tick", "entity", "out", "n", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved"))
        paths.append(scratch_path(spark, "ranks"))
        written = materialize(new, "ranks", paths[-1])
        # Only the newest round is read from here on.
        discard(spark, paths[-2])
        most = written.groupBy("tick").agg(F.sum("moved").alias("m")).agg(F.max("m")).first()[0]
        ranks = written.drop("moved")
        if (most or 0.0) < tolerance:
            break
    return ranks.select("tick", "entity", F.col("rank").alias("score"))
