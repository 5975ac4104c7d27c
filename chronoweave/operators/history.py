"""Full history of changing attributes from periodic snapshots: checkpoints and patches.

What a (subject, predicate) held is stored as a full *checkpoint* on every
``every``-th counted day and as *patches* - one per object that came, went or
changed its attribute - on the days between.  Validity rows are rebuilt by
folding the patches of a segment forward from its checkpoint and joining the
segments where an object is carried over.  An item has at most one row per
counted day, so no task gets more of a hot one than the calendar has days.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.times import day_literal, iso_day
from chronoweave.sources.scratch import materialize

LINE = ["subject_id", "predicate"]
ITEM = [*LINE, "object_id"]


@dataclass
class DeltaStore:
    """The stored history: tables in the shared folder."""

    every: int
    deliveries: DataFrame  # the snapshots it was built from, kept for lines that are delivered to again
    days: DataFrame  # subject_id, predicate, taken_on, ordinal, last_ordinal, last_day: one row per counted day
    checkpoints: DataFrame  # subject_id, predicate, object_id, segment, ordinal, day, confidence
    patches: DataFrame  # subject_id, predicate, object_id, segment, ordinal, op, day, confidence


def counted_days(snapshots: DataFrame) -> DataFrame:
    """One row per subject, predicate and day: the delivery that counts, and the day's ordinal.

    The delivery received last counts; one without received_at loses, the
    greater snapshot_id wins a tie.  Rows with a NULL key or day are ignored.
    """
    picked = (
        snapshots.where("subject_id is not null and predicate is not null and taken_on is not null")
        .groupBy(*LINE, "taken_on")
        .agg(F.max(F.struct("received_at", "snapshot_id")).alias("pick"))
    )
    line = Window.partitionBy(*LINE)
    return picked.select(
        *LINE, "taken_on", "pick.received_at", "pick.snapshot_id",
        (F.row_number().over(line.orderBy("taken_on")) - 1).alias("ordinal"),
        (F.count(F.lit(1)).over(line) - 1).cast("int").alias("last_ordinal"),
        F.max("taken_on").over(line).alias("last_day"),
    )


def build(snapshots: DataFrame, every: int = 16) -> DeltaStore:
    """Store snapshots as checkpoints and patches; equal rows and repeated deliveries change nothing.

    If a delivery lists an object twice, its greatest confidence is kept (NaN is none).
    """
    days = materialize(counted_days(snapshots), "history-days")
    rows, d = snapshots.alias("r"), days.alias("d")
    same = (
        (F.col("r.subject_id") == F.col("d.subject_id")) & (F.col("r.predicate") == F.col("d.predicate"))
        & (F.col("r.taken_on") == F.col("d.taken_on")) & F.col("r.snapshot_id").eqNullSafe(F.col("d.snapshot_id"))
        & F.col("r.received_at").eqNullSafe(F.col("d.received_at"))
    )
    held = (
        rows.where("r.object_id is not null")
        .join(d, same)
        .groupBy("r.subject_id", "r.predicate", "r.object_id", "d.ordinal", "d.last_ordinal", F.col("d.taken_on").alias("day"))
        .agg(F.max(F.nanvl("r.confidence", F.lit(None).cast("double"))).alias("confidence"))
    )
    run = Window.partitionBy(*ITEM).orderBy("ordinal")
    marked = held.select(
        "*", F.lag("ordinal").over(run).alias("before"), F.lead("ordinal").over(run).alias("after"), F.lag("confidence").over(run).alias("was")
    )
    at_checkpoint = F.col("ordinal") % every == 0
    comes = F.col("before").isNull() | (F.col("before") < F.col("ordinal") - 1)
    goes = (F.col("after").isNull() | (F.col("after") > F.col("ordinal") + 1)) & (F.col("ordinal") < F.col("last_ordinal"))
    entry = lambda op, step: F.struct(F.lit(op).alias("op"), (F.col("ordinal") + step).alias("ordinal"))
    entries = F.array_compact(
        F.array(
            F.when(at_checkpoint, entry("full", 0)),
            F.when(~at_checkpoint & comes, entry("add", 0)),
            F.when(~at_checkpoint & ~comes & ~F.col("confidence").eqNullSafe(F.col("was")), entry("set", 0)),
            # Taken off on the next counted day; it belongs to the segment it was last held in.
            F.when(goes, entry("drop", 1)),
        )
    )
    log = materialize(
        marked.select(*ITEM, F.floor(F.col("ordinal") / every).cast("int").alias("segment"), "day", "confidence", F.explode(entries).alias("e"))
        .select(*ITEM, "segment", "day", "confidence", "e.op", "e.ordinal"),
        "history-log",
    )
    return DeltaStore(every, snapshots, days, log.where("op = 'full'").drop("op"), log.where("op != 'full'"))


def append(store: DeltaStore, snapshots: DataFrame) -> DeltaStore:
    """The store with further snapshots, later or corrected ones: as if it had been built from all of them.

    Only the subjects and predicates that they deliver to are taken apart and
    checkpointed again, from their own deliveries; everything else is kept as
    it lies.  ``compact`` writes the parts together after many appends.
    """
    names = [c for c in snapshots.columns if c in store.deliveries.columns]
    lines = snapshots.where("subject_id is not null and predicate is not null").select(*LINE).distinct()
    own = store.deliveries.select(*names).join(lines, LINE, "left_semi").unionByName(snapshots.select(*names))
    new = build(own, store.every)
    kept = lambda old, added: old.join(lines, LINE, "left_anti").unionByName(added)
    return DeltaStore(
        store.every, store.deliveries.select(*names).unionByName(snapshots.select(*names)),
        kept(store.days, new.days), kept(store.checkpoints, new.checkpoints), kept(store.patches, new.patches),
    )


def compact(store: DeltaStore) -> DeltaStore:
    """The same store with every table written in one part."""
    parts = {name: materialize(getattr(store, name), f"history-{name}") for name in ("deliveries", "days", "checkpoints", "patches")}
    return DeltaStore(store.every, **parts)


def reconstruct(store: DeltaStore) -> DataFrame:
    """(subject_id, predicate, object_id, valid_from, last_confirmed, is_open): folded validity rows.

    A patch carries the last day it knew the object held, so a dropped object
    needs no look-up of the day before.
    """
    log = store.checkpoints.withColumn("op", F.lit("full")).unionByName(store.patches)
    fold = Window.partitionBy(*ITEM, "segment").orderBy("ordinal")
    pieces = (
        # One shuffle serves the fold, the joining of segments and the final grouping.
        log.where("op != 'set'").repartition(*ITEM)
        .withColumn("dropped_after", F.lead(F.when(F.col("op") == "drop", F.col("day"))).over(fold))
        .where("op != 'drop'")
    )
    line = Window.partitionBy(*ITEM).orderBy("ordinal")
    numbered = pieces.withColumn(
        # A piece opens a version unless the piece before was carried over into this checkpoint.
        "version", F.sum(F.when((F.col("op") == "full") & F.lag(F.col("dropped_after").isNull()).over(line), 0).otherwise(1)).over(line)
    )
    versions = numbered.groupBy(*ITEM, "version").agg(F.min("day").alias("valid_from"), F.max("dropped_after").alias("dropped_after"))
    heads = store.days.where("ordinal = last_ordinal").select(*LINE, "last_day")
    return versions.join(heads, LINE).select(
        *ITEM, "valid_from", F.coalesce("dropped_after", "last_day").alias("last_confirmed"), F.col("dropped_after").isNull().alias("is_open")
    )


def state_at(store: DeltaStore, day: str | dt.date) -> DataFrame:
    """(subject_id, predicate, object_id, confidence) held on the last counted day up to ``day``.

    Only the nearest checkpoint of each subject and predicate and the patches
    after it are read into the fold.
    """
    at = (
        store.days.where(F.col("taken_on") <= day_literal(day))
        .groupBy(*LINE)
        .agg(F.max("ordinal").alias("at"))
        .withColumn("segment", F.floor(F.col("at") / store.every).cast("int"))
    )
    log = store.checkpoints.withColumn("op", F.lit("full")).unionByName(store.patches)
    return (
        log.join(at, [*LINE, "segment"])
        .where("ordinal <= at")
        .groupBy(*ITEM)
        .agg(F.max(F.struct("ordinal", "op", "confidence")).alias("s"))
        .where("s.op != 'drop'")
        .select(*ITEM, F.col("s.confidence").alias("confidence"))
    )


def as_text(rows: DataFrame) -> DataFrame:
    """The history with days as text and ``open`` for a version that still holds."""
    return rows.select(
        *ITEM, iso_day(F.col("valid_from")).alias("valid_from"), iso_day(F.col("last_confirmed")).alias("last_confirmed"),
        F.when(F.col("is_open"), F.lit("open")).otherwise(iso_day(F.col("last_confirmed"))).alias("valid_to"),
    )
