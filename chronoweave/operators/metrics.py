"""Degree, weighted degree and edge weight, at a date or along a spine of dates.

Everything is set-oriented: all entities come out of one job and a single
entity is a filter in front of it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.changepoint import changepoints
from chronoweave.operators.patterns import Pattern
from chronoweave.operators.temporal import Day, Spine, active, as_of
from chronoweave.functions.times import day_literal


def touching(versions: DataFrame, entities: list[str] | None = None) -> DataFrame:
    """(entity, version...): each version under both endpoints, once for a self-loop."""
    ends = F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity")
    rows = versions
    if entities is not None:
        rows = rows.where(F.col("subject_id").isin(entities) | F.col("object_id").isin(entities))
    found = rows.select(ends, *versions.columns)
    return found if entities is None else found.where(F.col("entity").isin(entities))


def degrees(versions: DataFrame, day: Day, entities: list[str] | None = None) -> DataFrame:
    """(entity, degree, weighted_degree) of all entities with an active relationship.

    Relationships count once.  Of several active versions of one, the one that
    started last gives the weight; no confidence weighs 0.
    """
    return (
        touching(versions.where(active(day_literal(day))), entities)
        .groupBy("entity", "relationship_id")
        .agg(F.max_by("confidence", F.struct("valid_from", "version_id")).alias("confidence"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).cast("double").alias("degree"), F.sum(F.coalesce("confidence", F.lit(0.0))).alias("weighted_degree"))
    )


def degree(versions: DataFrame, entity: str, day: Day, weighted: bool = False) -> float:
    row = degrees(versions, day, [entity]).first()
    return 0.0 if row is None else row["weighted_degree" if weighted else "degree"]


def edge_weights(versions: DataFrame, day: Day, pattern: Pattern | None = None) -> DataFrame:
    """(subject_id, predicate, object_id, weight): confidence of the first active version of each triple."""
    return (
        as_of(versions, pattern or Pattern(), day)
        .groupBy("subject_id", "predicate", "object_id")
        .agg(F.min_by("confidence", F.struct("valid_from", "version_id")).alias("weight"))
    )


def active_entities(versions: DataFrame, day: Day) -> DataFrame:
    """Endpoints of active versions."""
    ends = F.explode(F.array("subject_id", "object_id")).alias("entity")
    return versions.where(active(day_literal(day))).select(ends).distinct()


def neighbors(versions: DataFrame, day: Day) -> DataFrame:
    """(entity, neighbor): undirected, each pair once per side, no self-loops."""
    pair = F.array(
        F.struct(F.col("subject_id").alias("entity"), F.col("object_id").alias("neighbor")),
        F.struct(F.col("object_id").alias("entity"), F.col("subject_id").alias("neighbor")),
    )
    return versions.where(active(day_literal(day)) & (F.col("subject_id") != F.col("object_id"))).select(F.explode(pair).alias("p")).select("p.*").distinct()


def out_neighbors(versions: DataFrame, day: Day) -> DataFrame:
    return (
        versions.where(active(day_literal(day)) & (F.col("subject_id") != F.col("object_id")))
        .select(F.col("subject_id").alias("entity"), F.col("object_id").alias("neighbor"))
        .distinct()
    )


def track_degree(versions: DataFrame, spine: Spine, entities: list[str] | None = None) -> DataFrame:
    """(entity, date, value): relationships per entity on every date.

    Overlapping versions of one relationship are merged first, in ticks, then
    each merged run gives +1 and -1; running totals go over the border events
    of an entity only.  Dates before its first event are there with 0, so the
    result is dense for the entities that occur.
    """
    bounded = spine.bounded(touching(versions.select("version_id", "relationship_id", "subject_id", "object_id", "valid_from", "valid_to"), entities))
    order = Window.partitionBy("entity", "relationship_id").orderBy("t0", "t1")
    reached = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    # A run starts where no earlier version of the relationship reaches the tick before.
    runs = (
        bounded.withColumn("run", F.sum(F.coalesce((reached < F.col("t0") - 1).cast("int"), F.lit(1))).over(order))
        .groupBy("entity", "relationship_id", "run")
        .agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    )
    events = runs.select(
        "entity",
        F.explode(F.array(F.struct(F.col("t0").alias("tick"), F.lit(1).alias("step")), F.struct((F.col("t1") + 1).alias("tick"), F.lit(-1).alias("step")))).alias("b"),
    )
    steps = events.groupBy("entity", "b.tick").agg(F.sum("b.step").alias("step"))
    line = Window.partitionBy("entity").orderBy("tick")
    levels = steps.select(
        "entity", "tick", F.sum("step").over(line).alias("value"),
        (F.lead("tick", 1, spine.size).over(line) - 1).alias("until"), (F.row_number().over(line) == 1).alias("first"),
    )
    zero = F.struct(F.lit(0).alias("a"), (F.col("tick") - 1).alias("b"), F.lit(0).cast("bigint").alias("v"))
    own = F.struct(F.col("tick").alias("a"), F.col("until").alias("b"), F.col("value").alias("v"))
    pieces = levels.select("entity", F.explode(F.when(F.col("first"), F.array(zero, own)).otherwise(F.array(own))).alias("p")).where("p.a <= p.b")
    return pieces.select("entity", F.explode(F.sequence("p.a", "p.b")).alias("tick"), "p.v").select(
        "entity", spine.date(F.col("tick")).alias("date"), F.col("v").cast("double").alias("value")
    )


def track_weighted_degree(versions: DataFrame, spine: Spine, entities: list[str] | None = None) -> DataFrame:
    """(entity, date, value): summed confidence; dates without a relationship give no row here (see ``densify``)."""
    wanted = versions.select("version_id", "relationship_id", "subject_id", "object_id", "valid_from", "valid_to", "confidence")
    return (
        spine.cover(touching(wanted, entities))
        .groupBy("entity", "tick", "relationship_id")
        .agg(F.max_by("confidence", F.struct("valid_from", "version_id")).alias("confidence"))
        .groupBy("entity", "tick")
        .agg(F.sum(F.coalesce("confidence", F.lit(0.0))).alias("value"))
        .select("entity", spine.date(F.col("tick")).alias("date"), "value")
    )


def track_edge_weight(versions: DataFrame, spine: Spine, pattern: Pattern) -> DataFrame:
    """(subject_id, predicate, object_id, date, value) where something is open: the version that started last."""
    triple = ["subject_id", "predicate", "object_id"]
    return (
        spine.cover(pattern.filter(versions))
        .groupBy(*triple, "tick")
        .agg(F.max_by("confidence", F.struct("valid_from", "version_id")).alias("value"))
        .select(*triple, spine.date(F.col("tick")).alias("date"), "value")
    )


def densify(signal: DataFrame, spine: Spine, missing: float | None) -> DataFrame:
    """One target's (date, value) on every date of the spine."""
    frame = spine.frame(signal.sparkSession).select("date").join(signal.select("date", "value"), "date", "left")
    return frame if missing is None else frame.withColumn("value", F.coalesce("value", F.lit(float(missing))))


@dataclass
class GraphSignal:
    """A time series (date, value) of one metric of one target."""

    frame: DataFrame

    def points(self) -> list[tuple]:
        return [(r["date"], r["value"]) for r in self.frame.select("date", "value").orderBy("date").collect()]

    def join(self, other: DataFrame | dict) -> DataFrame:
        """(date, value, other) on the dates both have; NULL values stay.

        ``other``: a DataFrame (date, other) or a dict of date to number.
        """
        return join_signal(self.frame, other)

    def changepoints(self, min_size: int = 2, penalty: float | None = None) -> list:
        keyed = self.frame.select(F.lit(0).alias("signal"), "date", "value")
        return [r["date"] for r in changepoints(keyed, ["signal"], min_size, penalty).orderBy("date").collect()]


def join_signal(signal: DataFrame, other: DataFrame | dict) -> DataFrame:
    if isinstance(other, dict):
        from chronoweave.functions.times import parse_day

        other = signal.sparkSession.createDataFrame([(parse_day(k), None if v is None else float(v)) for k, v in other.items()], "date date, other double")
    return signal.join(other.select("date", "other"), "date")
