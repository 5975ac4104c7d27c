"""Results per key when a handful of keys hold most rows.

Two-stage salted aggregation: rows of heavy keys get a salt, partial results
are computed per key and salt, and the partials are merged by the original
key.  The salt is a hash of the version's id rather than a fresh random number:
it spreads the rows of any key as evenly, however few partners the key has, and
gives the same partials when a lost task is run again.

Which keys are heavy is only a hint for the salt and never changes a result.
It comes from a frequent-items sketch of bounded size, made in the scan and
merged from one small row per task, so rows are counted once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.operators.intervals import periods
from chronoweave.sources.scratch import materialize

FIELDS = ("subject_id", "object_id")
#: Under this field every version is counted once, as the number of all.
TOTAL = "version_id"
KEY = ["field_name", "entity_id"]


def endpoint_rows(versions: DataFrame, with_total: bool = False) -> DataFrame:
    """Each version twice, under its subject and under its object, with the other one as partner.

    Equal rows count once.  A NULL endpoint gives no row of its own; a version
    without id is not a version.  ``with_total``: once more under ``TOTAL``.
    """
    all_ = [F.struct(F.lit(TOTAL).alias("field_name"), F.lit("").alias("entity_id"), F.lit(None).cast("string").alias("partner"))] if with_total else []
    ends = F.array(
        *all_,
        F.struct(F.lit("subject_id").alias("field_name"), F.col("subject_id").alias("entity_id"), F.col("object_id").alias("partner")),
        F.struct(F.lit("object_id").alias("field_name"), F.col("object_id").alias("entity_id"), F.col("subject_id").alias("partner")),
    )
    return (
        versions.select("version_id", "subject_id", "object_id")
        .where("version_id is not null")
        .distinct()
        .select("version_id", F.explode(ends).alias("e"))
        .select("version_id", "e.*")
        .where("entity_id is not null")
    )


def heavy_keys(versions: DataFrame, share: float, tracked: int = 8_192, groups: int = 256) -> list[tuple[str, str]]:
    """(field_name, entity_id) that may hold ``share`` of the rows or more: at most ``1 / share`` per field, whatever the data.

    The sketch keeps ``tracked`` counters per field, which finds every key above
    a few times ``1 / tracked`` of the rows; equal rows count as often as they
    come.  Sketches of tasks are combined in ``groups`` first, so that the last
    step has few of them however many tasks there are.
    """
    top = min(round(1 / share), tracked)
    call = F.call_function
    per_group = versions.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), *(call("approx_top_k_accumulate", F.col(f), F.lit(tracked)).alias(f) for f in FIELDS)
    )
    # Grouped by a constant: an empty table has no group, and no sketch to combine.
    whole = per_group.withColumn("all", F.lit(True)).groupBy("all").agg(F.sum("n").alias("n"), *(call("approx_top_k_combine", F.col(f), F.lit(tracked)).alias(f) for f in FIELDS))
    row = whole.select("n", *(call("approx_top_k_estimate", F.col(f), F.lit(top)).alias(f) for f in FIELDS)).first()
    return [] if row is None else [(f, r["item"]) for f in FIELDS for r in row[f] or [] if r["item"] is not None and r["count"] >= row["n"] * share]


def _salted(rows: DataFrame, heavy: list[tuple[str, str]], salts: int) -> DataFrame:
    """Rows with their salt; keys that are not heavy have the salt 0."""
    salt = F.pmod(F.xxhash64("version_id"), F.lit(salts)).cast("int")
    if not heavy:
        return rows.withColumn("salt", F.lit(0))
    # heavy_keys bounds this table, so it may be broadcast.
    named = rows.sparkSession.createDataFrame([(*k, True) for k in heavy], "field_name string, entity_id string, heavy boolean")
    return rows.join(F.broadcast(named), KEY, "left").withColumn("salt", F.when(F.col("heavy"), salt).otherwise(F.lit(0)))


def salted_counts(rows: DataFrame, heavy: list[tuple[str, str]], salts: int = 32) -> DataFrame:
    """(field_name, entity_id, versions, salts_used) by the two-stage aggregation."""
    partial = _salted(rows, heavy, salts).groupBy(*KEY, "salt").agg(F.count(F.lit(1)).alias("versions"))
    return partial.groupBy(*KEY).agg(F.sum("versions").alias("versions"), F.count(F.lit(1)).alias("salts_used"))


def salted_partners(rows: DataFrame, heavy: list[tuple[str, str]], salts: int = 32) -> DataFrame:
    """(field_name, entity_id, versions, partners): the same with distinct partners.

    Partials are per key, salt and partner; merging them by key makes partners
    distinct, in steps by key and partner first, so no task gets all of a key.
    """
    partial = _salted(rows, heavy, salts).groupBy(*KEY, "salt", "partner").agg(F.count(F.lit(1)).alias("versions"))
    per_partner = partial.groupBy(*KEY, "partner").agg(F.sum("versions").alias("versions"))
    return per_partner.groupBy(*KEY).agg(F.sum("versions").alias("versions"), F.count("partner").alias("partners"))


def frequent_keys(versions: DataFrame, share: float = 0.01, salt_share: float = 0.001, salts: int = 32) -> DataFrame:
    """(field_name, entity_id, versions): keys held by at least ``share`` of all distinct versions.

    Equal rows count once; versions without subject or object count in the
    total only; an empty table gives no row.
    """
    rows = endpoint_rows(versions, with_total=True)
    # The total is a key like the others and comes out of the same pass; the counts are kept, so that it stays one.
    counts = materialize(salted_counts(rows, heavy_keys(versions, salt_share) + [(TOTAL, "")], salts), "key-counts")
    total = counts.where(F.col("field_name") == TOTAL).select(F.col("versions").alias("total"))
    found = counts.where((F.col("field_name") != TOTAL) & (F.col("versions") >= share * F.lit(total.scalar())))
    return found.select(*KEY, "versions")


def days_covered(versions: DataFrame) -> DataFrame:
    """(field_name, entity_id, days): distinct days on which any version of the key is valid.

    Open versions count up to the last day that the table names.  Versions are
    reduced to borders per key and day before they meet in a key.
    """
    last_day = versions.agg(F.greatest(F.max("valid_from"), F.max("valid_to")).alias("d")).first()["d"]
    until = F.coalesce("valid_to", F.lit(last_day).cast("date"))
    key = F.explode(F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("entity_id")) for f in FIELDS))).alias("k")
    spans = versions.select(key, "valid_from", until.alias("until")).where("k.entity_id is not null")
    return (
        periods(spans, "k", "valid_from", "until")
        # The last day itself may be the calendar's end; an open period then ends there.
        .withColumn("period_to", F.coalesce("period_to", F.lit("9999-12-31").cast("date")))
        .groupBy("k.field_name", "k.entity_id")
        .agg(F.sum(F.datediff("period_to", "period_from") + 1).cast("bigint").alias("days"))
    )


def key_summary(versions: DataFrame, salt_share: float = 0.001, salts: int = 32) -> DataFrame:
    """(field_name, entity_id, versions, partners, days) for every subject and every object."""
    rows = endpoint_rows(versions)
    counts = salted_partners(rows, heavy_keys(versions, salt_share), salts)
    days = days_covered(versions.where("version_id is not null"))
    return (
        counts.join(days, KEY, "left")
        .select(*KEY, "versions", "partners", F.coalesce("days", F.lit(0).cast("bigint")).alias("days"))
    )
