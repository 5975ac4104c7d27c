"""Continuous periods and gaps of overlapping, nested, touching and open intervals.

Starts and ends of an entity are sorted *independently*.  With both numbered,
the union of the intervals breaks after rank ``i`` exactly where start ``i+1``
lies beyond end ``i``; the paired boundaries are the gap, and what lies between
two breaks is a continuous period.

Both orders are kept run-length encoded - one row per entity, kind and day with
its count - which a map-side combined aggregation makes before anything is
shuffled by entity.  An entity with a third of all intervals therefore sorts at
most two rows per calendar day, not its intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.times import FAR_DAY


def ranked_pairs(intervals: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """Rows ``(entity, after, ends, starts)``: end number ``after`` beside start number ``after + 1``.

    Only ranks at the borders of runs are listed; between them both sides
    repeat and cannot break.  ``ends`` is NULL before the first start,
    ``starts`` NULL after the last end.
    """
    border = F.array(
        F.struct(F.lit(0).alias("kind"), F.col(start).alias("day")),
        F.struct(F.lit(1).alias("kind"), F.coalesce(F.col(end), F.lit(FAR_DAY).cast("date")).alias("day")),
    )
    runs = (
        intervals.where(F.col(entity).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col(start))))
        .select(F.col(entity).alias("entity"), F.explode(border).alias("b"))
        .groupBy("entity", "b.kind", "b.day")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    is_start = F.col("kind") == 0
    # Both kinds in one window: counts up to the day, the day included.
    w = Window.partitionBy("entity").orderBy("day")
    numbered = runs.withColumn(
        "upto", F.when(is_start, F.sum(F.when(is_start, F.col("n"))).over(w)).otherwise(F.sum(F.when(~is_start, F.col("n"))).over(w))
    )
    return (
        numbered.select(
            "entity",
            F.when(is_start, F.col("upto") - F.col("n")).otherwise(F.col("upto")).alias("after"),
            F.when(is_start, F.col("day")).alias("starts"),
            F.when(~is_start, F.col("day")).alias("ends"),
        )
        .groupBy("entity", "after")
        .agg(F.max("ends").alias("ends"), F.max("starts").alias("starts"))
    )


def gaps(intervals: DataFrame, entity: str = "relationship_id", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(entity, gap_from, gap_to): the longest runs of uncovered days between covered days.

    Intervals are closed; a NULL end covers everything from the start on, an
    end before the start covers nothing; rows with a NULL entity or start
    cover nothing; equal rows change nothing.
    """
    return (
        ranked_pairs(intervals, entity, start, end)
        .where(F.datediff("starts", "ends") > 1)
        .select(F.col("entity").alias(entity), F.date_add("ends", 1).alias("gap_from"), F.date_sub("starts", 1).alias("gap_to"))
    )


def periods(intervals: DataFrame, entity: str = "relationship_id", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """(entity, period_from, period_to): continuous covered periods; NULL period_to is open.

    Touching intervals (next day) are one period.  The start of each break and
    the end of the next one are neighbours in rank order.
    """
    of_entity = Window.partitionBy("entity")
    following = of_entity.orderBy("after")
    breaks = (
        ranked_pairs(intervals, entity, start, end)
        .withColumn("last", F.max("after").over(of_entity))
        .where("after = 0 or after = last or datediff(starts, ends) > 1")
    )
    return (
        breaks.withColumn("period_to", F.lead("ends").over(following))
        .where("starts is not null")
        .select(
            F.col("entity").alias(entity),
            F.col("starts").alias("period_from"),
            F.when(F.col("period_to") < F.lit(FAR_DAY).cast("date"), F.col("period_to")).alias("period_to"),
        )
    )
