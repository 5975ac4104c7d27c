"""Per-period aggregates by event time that late and repeated records correct.

Counters are conflict-free.  Each *source* owns its counter per period and
publishes it as a row ``(period, source, sequence, ...)`` whose values are
totals up to ``sequence``, the wave of ingestion it has seen.  Merging takes,
per period and source, the row with the greatest sequence and then sums over
sources.  Repeating, dropping or reordering published rows cannot change the
result as long as the last one of a source arrives.  Records past the cut-off
are counted apart.

Copies of a record are merged first, by the same kind of rule: its ingestion
is the least of its copies' - a register whose merge is idempotent too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.times import instant_literal, month_of, utc_day, written_day
from chronoweave.sources.scratch import materialize

VALUES = ("records", "late_records", "confidence_sum", "confidence_n")
COUNTER = ("event_month", "source_id", "sequence", *VALUES)
#: Days that part the waves of ingestion; any others give the same totals.
WAVES = ("2022-01-01", "2024-01-01")


def registers(assertions: DataFrame, lateness_days: int = 60) -> DataFrame:
    """One row per assertion: month it happened in, its ingestion, and whether it is past the cut-off.

    The day is event_time, else the day written in published_at; records that
    state no day are left out.  Past the cut-off means ingested at or after
    00:00 UTC of the day ``lateness_days`` after the first of the next month.
    A NULL assertion_id is no record; a NULL ingestion is never late.
    """
    day = F.coalesce(F.col("event_time"), written_day(F.col("published_at")))
    confidence = F.nanvl(F.col("confidence"), F.lit(None).cast("double"))
    merged = (
        assertions.where("assertion_id is not null")
        .groupBy("assertion_id", "source_id", "event_time", "published_at", confidence.alias("confidence"))
        .agg(F.min("ingested_at").alias("ingestion"))
        .withColumn("day", day)
        .where("day is not null")
    )
    closes = F.date_add(F.add_months(F.trunc("day", "month"), 1), lateness_days)
    return merged.select(
        "assertion_id",
        "source_id",
        month_of(F.col("day")).alias("event_month"),
        "confidence",
        "ingestion",
        F.coalesce(utc_day(F.col("ingestion")) >= closes, F.lit(False)).alias("past_cutoff"),
    )


def increments(records: DataFrame, cuts: tuple[str, ...] = WAVES) -> DataFrame:
    """What each source adds to its counter per period and wave: one row per (period, source, wave).

    ``cuts`` are days that part the waves of ingestion, numbered from 1.  Rows
    are added up with map-side combining, so a source that holds a third of all
    records has one row per month and wave.
    """
    bounds = [instant_literal(c, "cut") for c in cuts]
    wave = reduce(lambda n, b: n + F.coalesce((F.col("ingestion") >= b).cast("bigint"), F.lit(0)), bounds, F.lit(1).cast("bigint"))
    timely = ~F.col("past_cutoff")
    confidence = F.when(timely, F.col("confidence"))
    return records.groupBy("event_month", "source_id", wave.alias("sequence")).agg(
        F.count_if(timely).alias("records"), F.count_if(F.col("past_cutoff")).alias("late_records"),
        F.sum(F.coalesce(confidence, F.lit(0.0))).alias("confidence_sum"), F.count(confidence).alias("confidence_n"),
    )


def publish(state: DataFrame | None, added: DataFrame) -> DataFrame:
    """The counters of the sources in ``added``, counted on from ``state``, with the sequence of ``added``.

    A source knows only its own counter: the row of its last delivery.  What
    that row has counted already is not counted again, so a wave may be
    published twice.
    """
    own = lambda frame, held: frame.select(*COUNTER, F.lit(held).alias("held"))
    rows = own(added, False) if state is None else own(added, False).unionByName(own(state, True))
    had, wave = F.max(F.when(F.col("held"), F.col("sequence"))), F.max(F.when(~F.col("held"), F.col("sequence")))
    counted = rows.groupBy("event_month", "source_id").agg(wave.alias("sequence"), had.alias("had"), *(F.sum(v).alias(v) for v in VALUES))
    return counted.where("sequence is not null and (had is null or had < sequence)").select(*COUNTER)


def merge(*published: DataFrame) -> DataFrame:
    """Counter rows from any number of deliveries, brought down to the newest per period and source."""
    rows = published[0].select(*COUNTER)
    for more in published[1:]:
        rows = rows.unionByName(more.select(*COUNTER))
    return (
        rows.groupBy("event_month", "source_id")
        .agg(F.max(F.struct("sequence", *VALUES)).alias("c"))
        .select("event_month", "source_id", "c.*")
    )


class LateCounters:
    """Conflict-free counters in the shared folder, corrected wave by wave.

    ``deliver`` merges published counters into the state; a delivery that comes
    twice, or after a newer one of its source, changes nothing.
    """

    def __init__(self) -> None:
        self.state: DataFrame | None = None
        self.last: DataFrame | None = None

    def deliver(self, published: DataFrame) -> None:
        merged = merge(published) if self.state is None else merge(self.state, published)
        self.state = materialize(merged, "late-counters")

    def advance(self, added: DataFrame) -> None:
        """Take in one wave: every source counts on from its own row and delivers."""
        self.last = publish(self.state, added)
        self.deliver(self.last)


def count_by_waves(records: DataFrame, cuts: tuple[str, ...] = WAVES, repeat: bool = False) -> DataFrame:
    """The merged counters after all waves of ``records``; ``repeat`` delivers each wave again after the next one.

    Both give the same counters, as the merge is idempotent and orderless.
    """
    added = materialize(increments(records, cuts), "late-increments")
    counters = LateCounters()
    for wave in range(1, len(cuts) + 2):
        before = counters.last
        counters.advance(added.where(F.col("sequence") == wave))
        if repeat and before is not None:
            counters.deliver(before)
    return counters.state


def totals(merged: DataFrame) -> DataFrame:
    """(event_month, records, late_records, mean_confidence): the counters of all sources added up.

    The mean is over the records in time; months with late records only have 0 records.
    """
    return merged.groupBy("event_month").agg(
        F.sum("records").alias("records"), F.sum("late_records").alias("late_records"),
        F.try_divide(F.sum("confidence_sum"), F.sum("confidence_n")).alias("mean_confidence"),
    )


def late_records(records: DataFrame) -> DataFrame:
    """(event_month, assertion_id) of the records that came after the cut-off.

    Counters hold numbers and no ids, so the list is read from the registers
    that feed them; per month it has as many rows as the counters' late_records.
    """
    return records.where("past_cutoff").select("event_month", "assertion_id").distinct()
