"""Time travel over versions: as-of, as-known, history, diff, day counts, series.

Valid time is closed at both ends, system time half-open.  Every function is a
declarative plan over the ``versions`` table; dates are validated.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.errors import ValidationError
from chronoweave.functions.times import day_literal, instant_literal, parse_day
from chronoweave.operators.patterns import Pattern

Day = str | dt.date


def active(day: Column) -> Column:
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


def overlaps(start: Column | None, end: Column | None) -> Column:
    touched = F.lit(True)
    if start is not None:
        touched = touched & (F.col("valid_to").isNull() | (F.col("valid_to") >= start))
    if end is not None:
        touched = touched & (F.col("valid_from") <= end)
    return touched


def as_of(versions: DataFrame, pattern: Pattern, day: Day) -> DataFrame:
    return pattern.filter(versions).where(active(day_literal(day)))


def as_known(versions: DataFrame, pattern: Pattern, day: Day, cutoff: str | dt.datetime) -> DataFrame:
    """``as_of`` restricted to rows recorded at ``cutoff`` and not yet replaced then.

    Closing a version sets its valid and system end together, so after the
    close it is not known any more, also for days inside its interval.
    """
    t = instant_literal(cutoff)
    known = (F.col("system_from") <= t) & (F.col("system_to").isNull() | (F.col("system_to") > t))
    return as_of(versions, pattern, day).where(known)


def history(versions: DataFrame, pattern: Pattern, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Versions whose interval meets [start, end]; sort with ``history_order``."""
    return pattern.filter(versions).where(
        overlaps(None if start is None else day_literal(start, "start"), None if end is None else day_literal(end, "end"))
    )


def history_order(pattern: Pattern) -> list[str]:
    return list(dict.fromkeys(["valid_from", *pattern.order()]))


_COMPARE = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def where_confidence(versions: DataFrame, operator: str, value: float) -> DataFrame:
    """A comparison on confidence; NULL never matches, also not ``!=``."""
    if operator not in _COMPARE:
        raise ValidationError(f"unknown comparison {operator!r}")
    return versions.where(_COMPARE[operator](F.col("confidence"), F.lit(float(value))))


def first_rows(frame: DataFrame, order: list[str], n: int) -> DataFrame:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValidationError("a limit must be a whole number from 0 on")
    return frame.orderBy(*order).limit(n)


def changes(versions: DataFrame, start: Day, end: Day, pattern: Pattern | None = None) -> DataFrame:
    """Versions tagged ``opened``, ``closed`` or ``persisted`` between two days, in one scan.

    Opened: start < valid_from <= end.  Closed: start <= valid_to < end.
    Persisted: from start or before to end or after.  A version that opens and
    closes inside comes out twice.
    """
    a, b = day_literal(start, "start"), day_literal(end, "end")
    opened = (F.col("valid_from") > a) & (F.col("valid_from") <= b)
    closed = (F.col("valid_to") >= a) & (F.col("valid_to") < b)
    persisted = (F.col("valid_from") <= a) & (F.col("valid_to").isNull() | (F.col("valid_to") >= b))
    tags = F.array_compact(F.array(F.when(opened, "opened"), F.when(closed, "closed"), F.when(persisted, "persisted")))
    return (pattern or Pattern()).filter(versions).where(opened | closed | persisted).select("*", F.explode(tags).alias("change"))


def node_changes(tagged: DataFrame) -> DataFrame:
    """(node, change): objects that are only opened (``added``) or only closed (``removed``)."""
    has = {c: F.bool_or(F.col("change") == c) for c in ("opened", "closed", "persisted")}
    return (
        tagged.groupBy(F.col("object_id").alias("node"))
        .agg(*(x.alias(c) for c, x in has.items()))
        .where("not persisted and opened != closed")
        .select("node", F.when(F.col("opened"), "added").otherwise("removed").alias("change"))
    )


@dataclass
class GraphDelta:
    """A structured diff: tagged edges and netted nodes, both lazy."""

    edges: DataFrame
    nodes: DataFrame

    def as_dict(self) -> dict:
        """The diff as lists, for the edge of the program; two jobs whose rows stream to the driver."""
        out: dict = {f"edges_{name}": [] for name in ("opened", "closed", "persisted")} | {f"nodes_{name}": [] for name in ("added", "removed")}
        when = F.when(F.col("change") == "opened", F.col("valid_from")).when(F.col("change") == "closed", F.col("valid_to"))
        for r in self.edges.orderBy("change", when, "version_id").toLocalIterator():
            row = r.asDict()
            out[f"edges_{row.pop('change')}"].append(row)
        for r in self.nodes.orderBy("change", "node").toLocalIterator():
            out[f"nodes_{r['change']}"].append(r["node"])
        return out


def diff(versions: DataFrame, start: Day, end: Day, pattern: Pattern | None = None) -> GraphDelta:
    tagged = changes(versions, start, end, pattern)
    return GraphDelta(tagged, node_changes(tagged))


def day_counts(versions: DataFrame, pattern: Pattern, start: Day, end: Day) -> DataFrame:
    """(object_id or subject_id, day_count): days of [start, end] covered, summed per version.

    Keyed by subject only if the subject is open and the object is not.  A day
    covered by two versions counts twice.
    """
    a, b = day_literal(start, "start"), day_literal(end, "end")
    key = "subject_id" if pattern.reversed() else "object_id"
    last = F.least(b, F.coalesce("valid_to", b))
    days = F.greatest(F.lit(0), F.datediff(last, F.greatest(a, F.col("valid_from"))) + 1)
    return history(versions, pattern, start, end).groupBy(key).agg(F.sum(days).cast("bigint").alias("day_count"))


@dataclass(frozen=True)
class Spine:
    """Dates from start to end, ``step`` days apart; the last may fall short of end."""

    start: dt.date
    end: dt.date
    step: int = 1

    @classmethod
    def of(cls, start: Day, end: Day, step: int = 1) -> "Spine":
        if isinstance(step, bool) or not isinstance(step, int) or step < 1:
            raise ValidationError("a resolution must be a whole number of days from 1 on")
        return cls(parse_day(start, "start"), parse_day(end, "end"), step)

    @property
    def size(self) -> int:
        return max(0, (self.end - self.start).days // self.step + 1)

    def frame(self, spark) -> DataFrame:
        """(tick, date): one row per date."""
        return spark.range(self.size).select(F.col("id").cast("int").alias("tick"), self.date(F.col("id")).alias("date"))

    def date(self, tick: Column) -> Column:
        return F.date_add(day_literal(self.start), (tick * self.step).cast("int"))

    def first(self) -> Column:
        """First tick that a version covers, from 0."""
        return F.greatest(F.lit(0), F.ceil(F.datediff("valid_from", day_literal(self.start)) / self.step)).cast("int")

    def last(self) -> Column:
        """Last tick that a version covers, below ``size``."""
        return F.least(
            F.lit(self.size - 1), F.floor(F.datediff(F.coalesce("valid_to", day_literal(self.end)), day_literal(self.start)) / self.step)
        ).cast("int")

    def cover(self, versions: DataFrame) -> DataFrame:
        """One row per version and tick it covers - no join with the spine."""
        if not self.size:
            return versions.where(F.lit(False)).withColumn("tick", F.lit(0))
        return self.bounded(versions).select("*", F.explode(F.sequence("t0", "t1")).alias("tick")).drop("t0", "t1")

    def bounded(self, versions: DataFrame) -> DataFrame:
        """Versions that cover a tick at all, with the first and last one (t0, t1)."""
        return (
            versions.where(overlaps(day_literal(self.start), day_literal(self.end)))
            .withColumns({"t0": self.first(), "t1": self.last()})
            .where("t0 <= t1")
        )


def series_rows(versions: DataFrame, pattern: Pattern, spine: Spine) -> DataFrame:
    """(date, version...): a row per date and version active then."""
    found = spine.cover(pattern.filter(versions))
    return found.select(spine.date(F.col("tick")).alias("date"), *versions.columns)


def series_counts(versions: DataFrame, pattern: Pattern, spine: Spine) -> DataFrame:
    """(date, facts): active versions per date, dates without any included.

    Each version gives two border events; they are added up per tick before
    the running total, whose single window holds one row per date.
    """
    bounded = spine.bounded(pattern.filter(versions))
    borders = bounded.select(
        F.explode(F.array(F.struct(F.col("t0").alias("tick"), F.lit(1).alias("step")), F.struct((F.col("t1") + 1).alias("tick"), F.lit(-1).alias("step")))).alias("b")
    )
    per_tick = borders.groupBy("b.tick").agg(F.sum("b.step").alias("step"))
    running = Window.orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    return (
        spine.frame(versions.sparkSession)
        .join(per_tick, "tick", "left")
        .select("date", F.sum(F.coalesce("step", F.lit(0))).over(running).cast("bigint").alias("facts"))
    )


class GraphSeries:
    """A lazy view of a pattern across a spine of dates."""

    def __init__(self, versions: DataFrame, pattern: Pattern, spine: Spine):
        self.versions, self.pattern, self.spine = versions, pattern, spine

    def dates(self) -> DataFrame:
        return self.spine.frame(self.versions.sparkSession).select("date")

    def at(self, day: Day) -> DataFrame:
        return as_of(self.versions, self.pattern, day)

    def diff(self, start: Day | None = None, end: Day | None = None) -> GraphDelta:
        return diff(self.versions, start or self.spine.start, end or self.spine.end, self.pattern)

    def rows(self) -> DataFrame:
        return series_rows(self.versions, self.pattern, self.spine)

    def counts(self) -> DataFrame:
        return series_counts(self.versions, self.pattern, self.spine)

    def __iter__(self):
        """(date, rows) per date, streamed partition by partition."""
        order = ["date", *history_order(self.pattern)]
        rows = iter(self.rows().orderBy(*order).toLocalIterator())
        row = next(rows, None)
        day = self.spine.start
        for k in range(self.spine.size):
            day = self.spine.start + dt.timedelta(days=k * self.spine.step)
            found = []
            while row is not None and row["date"] == day:
                found.append({k: v for k, v in row.asDict().items() if k != "date"})
                row = next(rows, None)
            yield day, found
