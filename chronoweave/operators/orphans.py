"""References to records that do not exist, kept up to date epoch by epoch.

State lives in the shared folder as tables, keyed by ``(ref_field, ref_id)``:

* a *parent index*: every record seen, with the instant it became available
  and the sequence of its last arrival,
* *tombstones*: every deletion by key and sequence, and whether it was lifted,
* a *reference log* of every reference seen,
* a *pending set*: the references that dangle now.

``advance`` does the work of one epoch.  One aggregation by key brings together
the index, what arrived, the tombstones, and the keys that new references and
waiting orphans ask for; it gives the new index and a verdict per asked key.
New references probe it, waiting orphans whose key was touched are resolved,
and the references of parents that went come back from the log.  A reference
that is settled and whose parent is not deleted is not looked at again, and
raw parents are read in the epoch they arrive in only.

Hot parents: references are reduced to their distinct keys before they meet
the index, in a hash aggregation with map-side combining, so a parent that a
third of all rows refer to is one row there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.sources.scratch import discard, materialize, scratch_path

REFERENCE_COLUMNS = ("ref_field", "row_id", "ref_id", "known_at", "period")
KEY = ["ref_field", "ref_id"]
#: What a side of the aggregation by key may say; NULL where it says nothing.
SAYS = {"available_at": "timestamp", "arrived": "bigint", "gone": "bigint", "touched": "boolean", "first_asked": "timestamp", "asked": "boolean", "waits": "boolean"}
FIRST = -(2**62)


class OrphanTracker:
    """Keyed pending-orphan state over epochs of references, parents and deletions.

    ``references``: ref_field, row_id, ref_id, known_at, period - each distinct
    ``(ref_field, row_id, ref_id)`` once; rows with a NULL ``ref_id`` refer to
    nothing and are dropped.  ``parents``: ref_field, ref_id, available_at.
    ``deletions``: ref_field, ref_id and, if there is one, ``lifts``: whether
    the row takes the deletion of the same key and sequence back.  Parents and
    deletions may have a ``seq`` that orders them; else the epoch does, and a
    NULL one comes before all others.

    A reference dangles if its parent is unknown or deleted, or if both
    instants are given and the parent became available after ``known_at``.  A
    parent is deleted while it has a tombstone that is not lifted and that no
    later arrival of the parent outdates; an arrival in the sequence of the
    deletion does not.  Empty inputs are fine; NULL instants switch the time
    test off; repeated parents and deletions count once (a parent by its
    earliest instant).  Extra columns are ignored.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.epoch = 0
        self._references: list[DataFrame] = []
        self._index: DataFrame | None = None
        self._tombstones: DataFrame | None = None
        self._paths: dict[str, str] = {}
        self.pending: DataFrame | None = None
        self._counts: list[DataFrame] = []

    def advance(self, references: DataFrame, parents: DataFrame, deletions: DataFrame) -> DataFrame:
        """Take in one epoch and return the references that dangle after it."""
        self.epoch += 1
        new = references.select(*REFERENCE_COLUMNS).where(F.col("ref_id").isNotNull())
        gone = deletions.select(*KEY, self._sequence(deletions), (F.col("lifts") if "lifts" in deletions.columns else F.lit(False)).alias("lifted"))
        bury = gone if self._tombstones is None else self._tombstones.unionByName(gone)
        tombstones = materialize(bury.groupBy(*KEY, "seq").agg(F.max("lifted").alias("lifted")), "tombstones")

        yes = F.lit(True)
        sides = [
            _says(parents.withColumn("seq", self._sequence(parents)), available_at=F.col("available_at"), arrived=F.col("seq"), touched=yes),
            _says(tombstones.where("not lifted"), gone=F.col("seq")),
            _says(gone.where("lifted"), touched=yes),
            _says(new, first_asked=F.col("known_at"), asked=yes),
        ]
        if self._index is not None:
            sides.append(_says(self._index, available_at=F.col("available_at"), arrived=F.col("arrived")))
            sides.append(_says(self.pending, first_asked=F.col("known_at"), waits=yes))
        folded = _union(sides).groupBy(*KEY).agg(
            F.min("available_at").alias("available_at"), F.max("arrived").alias("arrived"), F.max("gone").alias("gone"),
            F.max("touched").alias("touched"), F.min("first_asked").alias("first_asked"), F.max("asked").alias("asked"), F.max("waits").alias("waits"),
        )
        state = self._keep(folded, "parent-index")
        self._tombstones = tombstones
        self._index = state.where("arrived is not null").select(*KEY, "available_at", "arrived")

        # Keys none of whose references can be at fault leave before the join with the references.
        there = F.col("arrived").isNotNull() & (F.col("gone").isNull() | (F.col("gone") < F.col("arrived")))
        faulty = ~there | (F.col("available_at") > F.col("first_asked"))
        verdict = state.where(faulty).select(*KEY, F.when(there, F.col("available_at")).alias("available_at"), "asked")
        found = [_faulty(new, verdict.where("asked").drop("asked"))]
        if self.pending is not None:
            touched = state.where("waits and touched").select(*KEY)
            found.append(self.pending.join(touched, KEY, "left_anti"))
            found.append(_faulty(self.pending.join(touched, KEY, "left_semi"), verdict.drop("asked")))
            # Settled references of a parent that went in this epoch; those that wait already come out above as well, hence distinct.
            dead = gone.where("not lifted").select(*KEY).distinct()
            if not dead.isEmpty():
                found.append(_faulty(_union(self._references).join(dead, KEY, "left_semi"), verdict.drop("asked")))
        self._references.append(new)
        rows = _union(found)
        self.pending = materialize(rows.distinct() if len(found) > 1 else rows, "orphans", scratch_path(self.spark, f"orphans-epoch{self.epoch}"))
        self._counts.append(
            self.pending.groupBy("ref_field", "period")
            .agg(F.count(F.lit(1)).alias("orphans"))
            .withColumn("epoch", F.lit(self.epoch))
        )
        return self.pending

    def _sequence(self, frame: DataFrame) -> Column:
        return (F.coalesce("seq", F.lit(FIRST)) if "seq" in frame.columns else F.lit(self.epoch)).cast("bigint").alias("seq")

    def _keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write the newest state and delete the one it replaces."""
        last = self._paths.get(name)
        path = scratch_path(self.spark, name)
        kept = materialize(frame, name, path)
        if last is not None:
            discard(self.spark, last)
        self._paths[name] = path
        return kept

    def snapshots(self) -> DataFrame:
        """Orphans per epoch, referring field and period."""
        return _union(self._counts).select("epoch", "ref_field", "period", "orphans")


def _says(frame: DataFrame, **what: Column) -> DataFrame:
    return frame.select(*KEY, *(what.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SAYS.items()))


def _faulty(references: DataFrame, verdict: DataFrame) -> DataFrame:
    """Those of ``references`` that their key's verdict does not satisfy; a verdict without instant means no parent."""
    return (
        references.join(verdict, KEY)
        .where(F.col("available_at").isNull() | (F.col("available_at") > F.col("known_at")))
        .select(*REFERENCE_COLUMNS)
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def graph_references(versions: DataFrame, assertions: DataFrame) -> DataFrame:
    """Every non-null reference of the graph tables, each once, with the instant it became known.

    An assertion's instant is the earliest of its copies.  ``period`` is the
    month of that instant, for versions of ``system_from``; ``seen_at`` orders
    references into epochs.
    """
    from chronoweave.functions.times import month_of, utc_day

    claims = assertions.groupBy("assertion_id", "source_id", "version_id").agg(F.min("ingested_at").alias("known_at"))
    fields = F.array(
        F.struct(F.lit("assertions.source_id").alias("ref_field"), F.col("source_id").alias("ref_id")),
        F.struct(F.lit("assertions.version_id").alias("ref_field"), F.col("version_id").alias("ref_id")),
    )
    from_claims = claims.select(
        F.col("assertion_id").alias("row_id"), "known_at", F.col("known_at").alias("seen_at"), F.explode(fields).alias("r")
    ).select("r.ref_field", "row_id", "r.ref_id", "known_at", "seen_at")
    from_versions = (
        versions.select("version_id", "system_from", F.explode("assertion_ids").alias("ref_id"))
        .where("ref_id is not null")
        .groupBy("version_id", "ref_id")
        .agg(F.min("system_from").alias("seen_at"))
        .select(
            F.lit("versions.assertion_ids").alias("ref_field"), F.col("version_id").alias("row_id"), "ref_id",
            F.lit(None).cast("timestamp").alias("known_at"), "seen_at",
        )
    )
    both = from_claims.where("row_id is not null and ref_id is not null").unionByName(from_versions.where("row_id is not null"))
    # Only a version's instant counts against a reference; sources have none.
    known = F.when(F.col("ref_field") == "assertions.version_id", F.col("known_at"))
    return both.withColumn("known_at", known).withColumn("period", month_of(utc_day(F.col("seen_at"))))


def graph_parents(versions: DataFrame, assertions: DataFrame, sources: DataFrame) -> DataFrame:
    """Every record that can be referred to, with the instant it became available (NULL: always was)."""
    never = F.lit(None).cast("timestamp")
    field = lambda name: F.lit(name).alias("ref_field")
    return (
        sources.select(field("assertions.source_id"), F.col("source_id").alias("ref_id"), never.alias("available_at"), never.alias("seen_at"))
        .unionByName(versions.select(field("assertions.version_id"), F.col("version_id").alias("ref_id"), F.col("system_from").alias("available_at"), F.col("system_from").alias("seen_at")))
        .unionByName(assertions.select(field("versions.assertion_ids"), F.col("assertion_id").alias("ref_id"), never.alias("available_at"), F.col("ingested_at").alias("seen_at")))
        .where("ref_id is not null")
    )


def graph_deletions(removals: DataFrame) -> DataFrame:
    """Removals of sources, and for those that came back a second row, at that instant, that lifts the first."""
    key = (F.lit("assertions.source_id").alias("ref_field"), F.col("source_id").alias("ref_id"), F.unix_micros("removed_at").alias("seq"))
    known = removals.where("source_id is not null")
    went = known.select(*key, F.lit(False).alias("lifts"), F.col("removed_at").alias("seen_at"))
    # A removal that was taken back and another of the same instant that was not are two removals.
    back = known.groupBy("source_id", "removed_at").agg(F.max("restored_at").alias("restored_at"), F.count_if(F.col("restored_at").isNull()).alias("open")).where("open = 0")
    return went.unionByName(back.select(*key, F.lit(True).alias("lifts"), F.col("restored_at").alias("seen_at")))


def track_graph(spark: SparkSession, versions: DataFrame, assertions: DataFrame, sources: DataFrame, removals: DataFrame, cuts: tuple[str, ...] = ("2022-07-01",)) -> OrphanTracker:
    """Feed the graph tables to a tracker, one epoch up to each cut and one after the last.

    Rows without an instant belong to the first epoch.
    """
    from chronoweave.functions.times import instant_literal

    bounds = [instant_literal(c) for c in cuts]
    epoch = reduce(lambda acc, b: acc + F.coalesce((F.col("seen_at") >= b).cast("int"), F.lit(0)), bounds, F.lit(0)).alias("epoch")
    references = materialize(graph_references(versions, assertions).select(*REFERENCE_COLUMNS, epoch), "references")
    parents = graph_parents(versions, assertions, sources).select(*KEY, "available_at", F.unix_micros("seen_at").alias("seq"), epoch)
    deletions = graph_deletions(removals).select(*KEY, "seq", "lifts", epoch)
    tracker = OrphanTracker(spark)
    for k in range(len(cuts) + 1):
        tracker.advance(*(frame.where(F.col("epoch") == k) for frame in (references, parents, deletions)))
    return tracker


def found(tracker: OrphanTracker) -> DataFrame:
    """The references that dangle after the last epoch."""
    return tracker.pending.select("ref_field", "row_id", "ref_id")
