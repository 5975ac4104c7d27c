"""Readers for the graph tables and the views other operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.times import midnight_micros
from chronoweave.model import EVENTS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def clean_confidence(column: str = "confidence") -> Column:
    """Confidence with NaN, the stored form of 'none', turned into NULL."""
    return F.nanvl(F.col(column), F.lit(None).cast("double"))


#: Columns of a version without its JSON and its evidence list.
VERSION_COLUMNS = (
    "version_id", "relationship_id", "subject_id", "predicate", "object_id",
    "valid_from", "valid_to", "system_from", "system_to", "last_confirmed", "confidence",
)


def graph_versions(spark: SparkSession, folder: str, columns: tuple[str, ...] = VERSION_COLUMNS) -> DataFrame:
    """The fact table: equal rows once, NaN confidence as NULL.

    Copies of one ``version_id`` are equal in every column, so a hash
    ``distinct`` over the wanted columns (always with the id) removes them,
    combines map-side, and keeps column pruning down to the scan.
    """
    wanted = list(dict.fromkeys(("version_id", *columns)))
    frame = table(spark, folder, "versions").select(*wanted)
    if "confidence" in wanted:
        frame = frame.withColumn("confidence", clean_confidence())
    return frame.distinct().select(*columns)


def trade_touches(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (customer, supplier, day) of the star schema: who bought from whom."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    weight = F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / F.lit(50.0))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .groupBy("o_custkey", "l_suppkey", "day")
        .agg(F.max(weight).alias("confidence"))
        .select(
            F.concat(F.lit("CUST_"), F.col("o_custkey")).alias("subject_id"),
            F.lit("BUYS_FROM").alias("predicate"),
            F.concat(F.lit("SUPP_"), F.col("l_suppkey")).alias("object_id"),
            "day", "confidence", (F.col("o_custkey") % 30).cast("int").alias("lag_days"),
            (F.col("o_custkey") % 400).alias("filing"),
        )
    )


def trade_versions(spark: SparkSession, folder: str, quiet_days: int = 90, last_day: str = "2001-08-01") -> DataFrame:
    """Trade facts as versions: a pause of more than ``quiet_days`` closes one and opens the next.

    Ids are hashes of what they stand for, so no global numbering is needed.
    """
    triple = ["subject_id", "predicate", "object_id"]
    w = Window.partitionBy(*triple).orderBy("day")
    marked = trade_touches(spark, folder).withColumn(
        "starts", (F.datediff("day", F.coalesce(F.lag("day").over(w), F.lit("1900-01-01").cast("date"))) > quiet_days).cast("int")
    )
    islands = (
        marked.withColumn("island", F.sum("starts").over(w))
        .groupBy(*triple, "island")
        .agg(
            F.min("day").alias("valid_from"), F.max("day").alias("last_confirmed"),
            F.max("confidence").alias("confidence"), F.max("lag_days").alias("lag_days"),
        )
    )
    ends = F.date_add("last_confirmed", quiet_days)
    known = lambda day: F.timestamp_micros(midnight_micros(F.date_add(day, F.col("lag_days"))))
    return islands.withColumn("valid_to", F.when(ends <= F.lit(last_day).cast("date"), ends)).select(
        F.shiftrightunsigned(F.xxhash64(*triple, "valid_from"), 1).alias("version_id"), F.shiftrightunsigned(F.xxhash64(*triple), 1).alias("relationship_id"),
        *triple, "valid_from", "valid_to", known(F.col("valid_from")).alias("system_from"), known(F.col("valid_to")).alias("system_to"), "last_confirmed", "confidence",
    )


def trade_events(spark: SparkSession, folder: str, quiet_days: int = 90, last_day: str = "2001-08-01") -> DataFrame:
    """The trade graph as a write log: an assert per touch, a retract ``quiet_days`` after the last touch before a pause.

    ``seq`` orders the events of one triple.
    """
    triple = ["subject_id", "predicate", "object_id"]
    following = F.lead("day").over(Window.partitionBy(*triple).orderBy("day"))
    touched = trade_touches(spark, folder).withColumn("end", F.date_add("day", quiet_days)).withColumn("next", following)
    closes = F.coalesce(F.col("next") > F.col("end"), F.col("end") <= F.lit(last_day).cast("date"))
    event = lambda op, day: F.struct(F.lit(op).alias("op"), day.alias("day"))
    rows = touched.select(*triple, "confidence", F.explode(F.array_compact(F.array(event("assert", F.col("day")), F.when(closes, event("retract", F.col("end")))))).alias("e"))
    seq = F.unix_date("e.day").cast("bigint") * 2 + (F.col("e.op") == "retract").cast("bigint")
    columns = {f.name: F.lit(None).cast(f.dataType) for f in EVENTS.fields}
    columns |= {c: F.col(c) for c in triple} | {"seq": seq, "op": F.col("e.op"), "day": F.col("e.day")}
    columns |= {"confidence": F.when(F.col("e.op") == "assert", F.col("confidence")), "recorded_at": F.timestamp_micros(midnight_micros(F.col("e.day")))}
    return rows.select(*(c.alias(name) for name, c in columns.items()))


def snapshot_events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as syncs: per user and day, the types of event that occurred, with their greatest value."""
    per_type = (
        table(spark, folder, "events")
        .select(F.concat(F.lit("USER_"), F.col("user_id")).alias("subject_id"), F.col("ts").cast("date").alias("day"), "event_type", "value")
        .groupBy("subject_id", "day", "event_type")
        .agg(F.max(F.col("value") / 500.0).alias("value"))
    )
    syncs = per_type.groupBy("subject_id", "day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))).alias("objects"))
    columns = {f.name: F.lit(None).cast(f.dataType) for f in EVENTS.fields}
    columns |= {"seq": F.unix_date("day").cast("bigint"), "op": F.lit("sync"), "subject_id": F.col("subject_id"), "predicate": F.lit("DID")}
    columns |= {"day": F.col("day"), "objects": F.col("objects"), "recorded_at": F.timestamp_micros(midnight_micros(F.col("day")))}
    return syncs.select(*(c.alias(name) for name, c in columns.items()))
