"""Attributes as known at event time: one version per event, never one recorded later.

A version answers for an event at instant ``t`` if the day of ``t`` lies in
its valid interval and ``t`` in its recorded interval, so it answers exactly
for ``t`` in one half-open interval of instants.  Entities are hash-partitioned
into buckets.  In each bucket the versions of an entity are first turned into
its *current-state timeline* - disjoint segments in order of availability, each
owned by the version that wins the tie (latest valid_from, then system_from,
then version_id) - and an embedded DuckDB runs ``ASOF LEFT JOIN`` of the events
against that timeline.

Hot entities are cut into time slices of a bounded number of rows, as many as
their counted size asks for.  An event falls in one slice; a version goes to
the slices it overlaps only in part (two at most) and, of the versions that
cover a slice whole, only the strongest is kept.  The slices a version covers
whole are not listed one by one: their range is cut into the few nodes of a
binary tree over the slices, the strongest version is kept per node by a
map-side combined maximum, and a slice takes the strongest of the nodes above
it.  Slices end at minutes; if one minute of an entity exceeds the bound, its
events are dealt to parts by a hash and its versions go to every part, so
events of one instant are split as well.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.times import DAY_MICROS, midnight_micros
from chronoweave.sources.scratch import materialize
from chronoweave.sources.shipping import ship_package

OPEN_END = 2**62
MINUTE = 60_000_000
INTERVAL = ["lo", "hi", "valid_from", "system_from", "version_id"]


def answer_intervals(versions: DataFrame) -> DataFrame:
    """(entity, lo, hi, valid_from, system_from, version_id) in microseconds; empty intervals dropped."""
    start = F.greatest(midnight_micros(F.col("valid_from")), F.unix_micros("system_from"))
    valid_end = F.coalesce(midnight_micros(F.col("valid_to")) + F.lit(DAY_MICROS), F.lit(OPEN_END))
    end = F.least(valid_end, F.coalesce(F.unix_micros("system_to"), F.lit(OPEN_END)))
    return (
        versions.where("relationship_id is not null and valid_from is not null and system_from is not null")
        .select(
            F.col("relationship_id").alias("entity"), start.alias("lo"), end.alias("hi"),
            F.unix_date("valid_from").cast("bigint").alias("valid_from"), F.unix_micros("system_from").alias("system_from"), "version_id",
        )
        .where("lo < hi and version_id is not null")
    )


def asof_versions(events: DataFrame, versions: DataFrame, hot_rows: int = 250_000, bucket_rows: int = 100_000) -> DataFrame:
    """(observation_id, version_id): each event with the version known and valid at its time.

    ``events``: observation_id, relationship_id, observed_at.  Events without a
    version give no row; NULL keys or instants match nothing; equal rows count
    once; other columns are ignored.  An entity with more than ``hot_rows``
    events and versions together is cut into time slices of about
    ``bucket_rows``, the size that buckets have on average too.
    """
    ship_package(events.sparkSession)
    asked = (
        events.where("observation_id is not null and relationship_id is not null and observed_at is not null")
        .select("observation_id", F.col("relationship_id").alias("entity"), F.unix_micros("observed_at").alias("at"))
        .withColumns({"slice": F.lit(0), "part": F.lit(0)})
    )
    offered = answer_intervals(versions).withColumns({"slice": F.lit(0), "part": F.lit(0)})
    sizes = (
        asked.select("entity").unionByName(offered.select("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    )
    # One small job: the number of rows, and the entities above the bound (at most rows / hot_rows of them).
    counted = materialize(sizes.groupBy((F.col("n") > hot_rows).alias("hot"), F.when(F.col("n") > hot_rows, F.col("entity")).alias("entity")).agg(F.sum("n").alias("n")), "asof-sizes")
    rows, hot_count = counted.agg(F.sum("n"), F.count("entity")).first()
    if hot_count:
        asked, offered = _slice_hot(asked, offered, counted.where("hot").select("entity"), bucket_rows)
    buckets = max(1, -(-(rows or 0) // bucket_rows))
    bucket = F.pmod(F.xxhash64("entity", "slice", "part"), F.lit(buckets)).alias("bucket")
    left = asked.select(bucket, "entity", _piece(), "at", "observation_id")
    right = offered.select(bucket, "entity", _piece(), *INTERVAL)
    joined = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(
        _join_bucket, "observation_id bigint, version_id bigint"
    )
    return joined.distinct()


def _piece() -> Column:
    return (F.shiftleft(F.col("slice").cast("bigint"), 24) + F.col("part")).alias("slice")


def _minute(at: Column) -> Column:
    return F.floor(at / F.lit(MINUTE)).cast("bigint")


def time_slices(marks: DataFrame, slice_rows: int) -> DataFrame:
    """(entity, minute, slice, slices, opens, closes, parts) of every marked minute.

    ``marks``: entity, minute, weight (rows to be spread).  Consecutive minutes
    share a slice until it holds about ``slice_rows``; ``opens`` and ``closes``
    are its first minute and that of the next slice, NULL at the ends.  An
    entity has one row per minute here, whatever its size.
    """
    line = Window.partitionBy("entity").orderBy("minute")
    before = F.coalesce(F.sum("weight").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = marks.groupBy("entity", "minute").agg(F.sum("weight").alias("weight")).withColumn("at", F.floor(before / slice_rows))
    # Slices that no minute starts in are left out, so they are numbered without gaps.
    fresh = placed.withColumn("fresh", F.coalesce((F.lag("at").over(line) != F.col("at")).cast("int"), F.lit(0)))
    numbered = fresh.withColumn("slice", F.sum("fresh").over(line).cast("int"))
    of = numbered.groupBy("entity", "slice").agg(F.min("minute").alias("opens"), F.sum("weight").alias("weight"))
    along = Window.partitionBy("entity").orderBy("slice")
    bounds = of.select(
        "entity", "slice", F.when(F.col("slice") > 0, F.col("opens")).alias("opens"), F.lead("opens").over(along).alias("closes"),
        F.greatest(F.lit(1), F.floor(F.col("weight") / (2 * slice_rows))).cast("int").alias("parts"), F.count(F.lit(1)).over(Window.partitionBy("entity")).cast("int").alias("slices"),
    )
    return numbered.select("entity", "minute", "slice").join(bounds, ["entity", "slice"])


def _tree(first: Column, behind: Column, leaves: Column) -> Column:
    """Numbers of the tree nodes that make up the slices from ``first`` to the one before ``behind``.

    The tree has ``leaves`` leaves, a power of two; its root is 1, the children
    of n are 2n and 2n + 1.  At most two nodes per level.
    """
    def nodes(level: Column) -> Column:
        step = F.pow(F.lit(2), level)
        low = F.ceil((first + leaves) / step).cast("bigint")
        high = F.floor((behind + leaves) / step).cast("bigint")
        open_ = low < high
        return F.array_compact(F.array(F.when(open_ & (low % 2 == 1), low), F.when(open_ & (high % 2 == 1), high - 1)))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.log2(leaves).cast("int")), nodes))


def _slice_hot(asked: DataFrame, offered: DataFrame, hot: DataFrame, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """Give the rows of hot entities their time slice and part; all others keep slice 0."""
    mine, theirs = asked.join(hot, "entity", "left_semi"), offered.join(hot, "entity", "left_semi")
    mark = lambda frame, at, weight: frame.groupBy("entity", _minute(at).alias("minute")).agg((F.count(F.lit(1)) * weight).alias("weight"))
    last = F.col("hi") - 1
    marks = mark(mine, F.col("at"), 1).unionByName(mark(theirs, F.col("lo"), 1)).unionByName(mark(theirs, last, 0))
    slices = materialize(time_slices(marks, slice_rows), "asof-slices")
    spot = slices.select("entity", "minute", F.col("slice").alias("s"), F.col("parts").alias("p"))
    events = (
        mine.withColumn("minute", _minute(F.col("at")))
        .join(spot, ["entity", "minute"])
        .select("observation_id", "entity", "at", F.col("s").alias("slice"), F.pmod(F.xxhash64("observation_id"), F.col("p")).cast("int").alias("part"))
    )
    edge = lambda name: slices.select("entity", F.col("minute").alias(f"{name}_minute"), F.col("slice").alias(name), F.col("slices").alias(f"{name}_n"))
    ranged = (
        theirs.select("entity", *INTERVAL, _minute(F.col("lo")).alias("a_minute"), _minute(last).alias("b_minute"))
        .join(edge("a"), ["entity", "a_minute"])
        .join(edge("b"), ["entity", "b_minute"])
    )
    bounds = materialize(slices.select("entity", "slice", "opens", "closes", "parts", "slices").distinct(), "asof-bounds")
    opens, closes = (F.coalesce(F.col("opens") * MINUTE, F.lit(-OPEN_END)), F.coalesce(F.col("closes") * MINUTE, F.lit(OPEN_END)))
    # The first and the last slice of a version are cut; what lies between is covered whole.
    partly = (
        ranged.select("entity", *INTERVAL, F.explode(F.array_distinct(F.array("a", "b"))).alias("slice"))
        .join(bounds, ["entity", "slice"])
        .withColumns({"lo": F.greatest("lo", opens), "hi": F.least("hi", closes)})
        .select("entity", "slice", "parts", *INTERVAL)
    )
    leaves = lambda n: F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("bigint")
    strong = F.max(F.struct("valid_from", "system_from", "version_id")).alias("v")
    nodes = (
        ranged.where("b - a > 1")
        .select("entity", "valid_from", "system_from", "version_id", F.explode(_tree(F.col("a") + 1, F.col("b"), leaves(F.col("a_n")))).alias("node"))
        .groupBy("entity", "node")
        .agg(strong)
    )
    above = F.transform(F.sequence(F.lit(0), F.log2(leaves(F.col("slices"))).cast("int")), lambda k: F.floor((F.col("slice") + leaves(F.col("slices"))) / F.pow(F.lit(2), k)).cast("bigint"))
    whole = (
        bounds.select("entity", "slice", "parts", opens.alias("lo"), closes.alias("hi"), F.explode(above).alias("node"))
        .join(nodes, ["entity", "node"])
        .groupBy("entity", "slice", "parts", "lo", "hi")
        .agg(F.max("v").alias("v"))
        .select("entity", "slice", "parts", "lo", "hi", "v.valid_from", "v.system_from", "v.version_id")
    )
    cut = partly.unionByName(whole).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cold_events, cold = asked.join(hot, "entity", "left_anti"), offered.join(hot, "entity", "left_anti")
    columns = ["entity", "slice", "part", *INTERVAL]
    return cold_events.unionByName(events), cold.select(*columns).unionByName(cut.select(*columns))


def timeline(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint winning segments of intervals: (index of the winner, start, end).

    ``group`` numbers the entity, ``rank`` is the strength; among the intervals
    that cover an instant the strongest owns it.  Entities whose intervals do
    not overlap are passed through vectorised, the others are swept with a heap
    in O(n log n).
    """
    order = np.lexsort((lo, group))
    g, s, e = group[order], lo[order], hi[order]
    clash = np.zeros(len(g), dtype=bool)
    if len(g) > 1:
        clash[1:] = (g[1:] == g[:-1]) & (s[1:] < e[:-1])
    messy = np.isin(g, g[clash])
    won, begin, end = [order[~messy]], [s[~messy]], [e[~messy]]
    left = order[messy]
    if len(left):
        edges = np.flatnonzero(np.r_[True, group[left][1:] != group[left][:-1], True])
        for a, b in zip(edges[:-1], edges[1:]):
            w, x, y = _sweep(left[a:b], lo, hi, rank)
            won.append(np.asarray(w, dtype=np.int64))
            begin.append(np.asarray(x, dtype=np.int64))
            end.append(np.asarray(y, dtype=np.int64))
    return np.concatenate(won), np.concatenate(begin), np.concatenate(end)


def _sweep(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> tuple[list, list, list]:
    starts, ends, ranks, ids = lo[rows].tolist(), hi[rows].tolist(), rank[rows].tolist(), rows.tolist()
    moments = sorted({*starts, *ends})
    won: list[int] = []
    begin: list[int] = []
    end: list[int] = []
    heap: list[tuple[int, int, int]] = []
    k = 0
    for at, until in zip(moments[:-1], moments[1:]):
        while k < len(starts) and starts[k] <= at:
            heapq.heappush(heap, (-ranks[k], ends[k], ids[k]))
            k += 1
        while heap and heap[0][1] <= at:
            heapq.heappop(heap)
        if not heap:
            continue
        winner = heap[0][2]
        if won and won[-1] == winner and end[-1] == at:
            end[-1] = until
        else:
            won.append(winner)
            begin.append(at)
            end.append(until)
    return won, begin, end


def _join_bucket(events: pa.Table, versions: pa.Table) -> pa.Table:
    schema = pa.schema([("observation_id", pa.int64()), ("version_id", pa.int64())])
    if not events.num_rows or not versions.num_rows:
        return schema.empty_table()
    column = lambda name: versions.column(name).to_numpy()
    entity, piece = column("entity"), column("slice")
    strength = np.empty(len(entity), dtype=np.int64)
    strength[np.lexsort((column("version_id"), column("system_from"), column("valid_from")))] = np.arange(len(entity))
    pairs = np.empty(len(entity), dtype=[("entity", "i8"), ("slice", "i8")])
    pairs["entity"], pairs["slice"] = entity, piece
    _, group = np.unique(pairs, return_inverse=True)
    won, begin, end = timeline(group, column("lo"), column("hi"), strength)
    state = pa.table({"entity": entity[won], "slice": piece[won], "since": begin, "until": end, "version_id": column("version_id")[won]})
    db = _duckdb()
    db.register("asked", events.select(["entity", "slice", "at", "observation_id"]))
    db.register("state", state)
    try:
        got = db.sql(
            "SELECT a.observation_id, CASE WHEN a.at < s.until THEN s.version_id END AS version_id "
            "FROM asked a ASOF LEFT JOIN state s "
            "ON a.entity = s.entity AND a.slice = s.slice AND a.at >= s.since"
        ).to_arrow_table()
    finally:
        db.unregister("asked")
        db.unregister("state")
    return got.filter(pa.compute.is_valid(got.column("version_id"))).cast(schema)


def _duckdb():
    """One in-memory DuckDB per Python worker, single-threaded like the task it serves."""
    global _DB
    if _DB is None:
        import duckdb

        _DB = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "preserve_insertion_order": False})
    return _DB


_DB = None
