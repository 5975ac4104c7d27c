"""Queries of the data-processing problems p1 to p7 and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.times import iso_day
from chronoweave.operators import asof, history, intervals, lateness, orphans, skew
from chronoweave.sources.tables import table
from chronoweave.streaming import changefeed


#: Ends of the epochs that p1_monthly counts after; one more follows the last.
CUTS = ("2021-07-01", "2022-07-01", "2023-07-01")


def _tracker(spark: SparkSession, folder: str, **how) -> orphans.OrphanTracker:
    names = ("versions", "assertions", "sources", "source_removals")
    return orphans.track_graph(spark, *(table(spark, folder, n) for n in names), **how)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.found(_tracker(spark, folder))


def p1_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per referring field and month, as they stood after each epoch."""
    return _tracker(spark, folder, cuts=CUTS).snapshots()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return asof.asof_versions(table(spark, folder, "observations"), table(spark, folder, "versions"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return lateness.late_records(lateness.registers(table(spark, folder, "assertions")))


def p3_method(spark: SparkSession, folder: str) -> DataFrame:
    """Per month what the conflict-free counters hold after all waves of ingestion: records in time, late ones, mean confidence."""
    counters = lateness.count_by_waves(lateness.registers(table(spark, folder, "assertions")))
    return lateness.totals(counters).withColumn("mean_confidence", F.round("mean_confidence", 6))


def p3_monthly(spark: SparkSession, folder: str) -> DataFrame:
    """Assertions and mean confidence per month, corrected by what came late but in time; every wave is delivered twice, once out of order."""
    counters = lateness.count_by_waves(lateness.registers(table(spark, folder, "assertions")), repeat=True)
    return lateness.totals(counters).where("records > 0").select("event_month", "records", F.round("mean_confidence", 6).alias("mean_confidence"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return changefeed.apply_feed(spark, f"{folder.rstrip('/')}/assertions.parquet")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    found = intervals.gaps(table(spark, folder, "versions"))
    return found.select("relationship_id", iso_day(F.col("gap_from")).alias("gap_from"), iso_day(F.col("gap_to")).alias("gap_to"))


def p5_periods(spark: SparkSession, folder: str) -> DataFrame:
    found = intervals.periods(table(spark, folder, "versions"))
    return found.select(
        "relationship_id", iso_day(F.col("period_from")).alias("period_from"), F.coalesce(iso_day(F.col("period_to")), F.lit("open")).alias("period_to")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.frequent_keys(table(spark, folder, "versions")).select("field_name", "entity_id")


def p6_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Versions, distinct partners and days covered of every subject and object."""
    return skew.key_summary(table(spark, folder, "versions"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.as_text(history.reconstruct(history.build(table(spark, folder, "sync_snapshots"))))


def p7_state(spark: SparkSession, folder: str) -> DataFrame:
    """What every subject and predicate held on a day, from the nearest checkpoint."""
    return history.state_at(history.build(table(spark, folder, "sync_snapshots")), "2022-06-30")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_monthly, p2_found, p3_method, p3_found, p3_monthly, p4_found,
        p5_found, p5_periods, p6_found, p6_summary, p7_found, p7_state,
    )
}

_P1 = """
WITH ing AS (SELECT assertion_id, min(ingested_at) AS t FROM assertions GROUP BY 1),
ver AS (SELECT version_id, min(system_from) AS sf FROM versions GROUP BY 1),
refs AS (
  SELECT DISTINCT 'assertions.source_id' AS ref_field, a.assertion_id AS row_id, a.source_id AS ref_id, i.t AS seen_at
  FROM assertions a JOIN ing i USING (assertion_id)
  WHERE a.source_id IS NOT NULL AND (a.source_id NOT IN (SELECT source_id FROM sources WHERE source_id IS NOT NULL)
    OR a.source_id IN (SELECT source_id FROM source_removals WHERE restored_at IS NULL AND source_id IS NOT NULL))
  UNION
  SELECT DISTINCT 'assertions.version_id', a.assertion_id, a.version_id, i.t
  FROM assertions a JOIN ing i USING (assertion_id) LEFT JOIN ver v ON v.version_id = a.version_id
  WHERE a.version_id IS NOT NULL AND (v.version_id IS NULL OR v.sf > i.t)
  UNION
  SELECT DISTINCT 'versions.assertion_ids', u.version_id, u.ref_id, u.seen_at
  FROM (SELECT version_id, system_from AS seen_at, unnest(assertion_ids) AS ref_id FROM versions) u
  WHERE u.ref_id IS NOT NULL AND u.ref_id NOT IN (SELECT assertion_id FROM ing WHERE assertion_id IS NOT NULL)
)"""



def _p1_monthly() -> str:
    """What dangled at each cut, told from the whole tables as they were then."""
    parts = []
    for k, cut in enumerate((*CUTS, "9999-01-01"), 1):
        t = f"TIMESTAMPTZ '{cut} 00:00:00+00'"
        seen = f"(seen_at IS NULL OR seen_at < {t})"
        parts.append(f"""
  SELECT {k} AS epoch, ref_field, period FROM refs WHERE {seen} AND ref_field = 'assertions.source_id' AND (ref_id NOT IN (SELECT source_id FROM sources WHERE source_id IS NOT NULL)
    OR ref_id IN (SELECT source_id FROM source_removals WHERE source_id IS NOT NULL AND (removed_at IS NULL OR removed_at < {t}) AND (restored_at IS NULL OR restored_at >= {t})))
  UNION ALL SELECT {k}, ref_field, period FROM refs LEFT JOIN ver ON version_id = ref_id WHERE {seen} AND ref_field = 'assertions.version_id' AND (version_id IS NULL OR sf >= {t} OR sf > seen_at)
  UNION ALL SELECT {k}, ref_field, period FROM refs LEFT JOIN ing ON assertion_id = ref_id WHERE {seen} AND ref_field = 'versions.assertion_ids' AND (assertion_id IS NULL OR t >= {t})""")
    return f"""
WITH ing AS (SELECT assertion_id, min(ingested_at) AS t FROM assertions GROUP BY 1),
ver AS (SELECT version_id, min(system_from) AS sf FROM versions GROUP BY 1),
r AS (SELECT 'assertions.source_id' AS ref_field, assertion_id AS row_id, source_id AS ref_id, min(ingested_at) AS seen_at FROM assertions WHERE assertion_id IS NOT NULL AND source_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'assertions.version_id', assertion_id, version_id, min(ingested_at) FROM assertions WHERE assertion_id IS NOT NULL AND version_id IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'versions.assertion_ids', version_id, ref_id, min(system_from) FROM (SELECT version_id, system_from, unnest(assertion_ids) AS ref_id FROM versions) WHERE version_id IS NOT NULL AND ref_id IS NOT NULL GROUP BY ALL),
refs AS (SELECT *, strftime(seen_at AT TIME ZONE 'UTC', '%Y-%m') AS period FROM r),
o AS ({" UNION ALL ".join(parts)})
SELECT epoch::INTEGER AS epoch, ref_field, period, count(*)::BIGINT AS orphans FROM o GROUP BY ALL"""


_DAY = """
CASE
 WHEN regexp_matches(trim(published_at), '^\\d{4}[-/]?\\d{2}[-/]?\\d{2}')
  THEN try_strptime(regexp_replace(trim(published_at), '^(\\d{4})[-/]?(\\d{2})[-/]?(\\d{2}).*$', '\\1-\\2-\\3'), '%Y-%m-%d')::DATE
 WHEN regexp_matches(trim(published_at), '^\\d{1,2}\\.\\d{1,2}\\.\\d{4}') THEN try_strptime(trim(published_at), '%d.%m.%Y')::DATE
 WHEN regexp_matches(trim(published_at), '^[A-Za-z]{3}, ') THEN try_strptime(substr(trim(published_at), 6, 11), '%d %b %Y')::DATE
 WHEN regexp_matches(trim(published_at), '^\\d{1,2} [A-Za-z]+ \\d{4}$') THEN try_strptime(trim(published_at), '%d %B %Y')::DATE
 WHEN regexp_matches(trim(published_at), '^[A-Za-z]+ \\d{1,2}, \\d{4}$') THEN try_strptime(trim(published_at), '%b %d, %Y')::DATE
END"""

_P3 = f"""
WITH a AS (
  SELECT assertion_id, source_id, coalesce(event_time, {_DAY}) AS d, min(ingested_at) AS t,
    any_value(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END) AS c
  FROM assertions WHERE assertion_id IS NOT NULL GROUP BY 1, 2, 3),
r AS (SELECT *, strftime(d, '%Y-%m') AS event_month,
    (t AT TIME ZONE 'UTC')::DATE >= (date_trunc('month', d) + INTERVAL 1 MONTH)::DATE + 60 AS late
  FROM a WHERE d IS NOT NULL)"""

_COVER = """
WITH v AS (SELECT DISTINCT relationship_id AS r, valid_from AS f, coalesce(valid_to, DATE '9999-12-31') AS t FROM versions
  WHERE relationship_id IS NOT NULL AND valid_from IS NOT NULL AND (valid_to IS NULL OR valid_to >= valid_from)),
m AS (SELECT *, max(t) OVER (PARTITION BY r ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM v),
g AS (SELECT *, CASE WHEN upto IS NULL OR date_diff('day', upto, f) > 1 THEN 1 ELSE 0 END AS starts FROM m)"""

_P6 = """
WITH e AS (
  SELECT 'subject_id' AS field_name, subject_id AS entity_id, object_id AS partner, version_id, valid_from, valid_to FROM versions
  UNION ALL SELECT 'object_id', object_id, subject_id, version_id, valid_from, valid_to FROM versions)"""

_P7 = """
WITH d AS (SELECT subject_id, predicate, taken_on, arg_max(snapshot_id, received_at) AS snapshot_id, max(received_at) AS received_at
  FROM sync_snapshots GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY taken_on) AS k,
  max(taken_on) OVER (PARTITION BY subject_id, predicate) AS head FROM d),
h AS (SELECT DISTINCT s.subject_id, s.predicate, s.object_id, n.k, n.taken_on, n.head FROM sync_snapshots s
  JOIN n USING (subject_id, predicate, taken_on, snapshot_id, received_at) WHERE s.object_id IS NOT NULL),
i AS (SELECT *, k - row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY k) AS run FROM h)"""

ORACLES = {
    "p1_found": f"{_P1} SELECT ref_field, row_id, ref_id FROM refs",
    "p1_monthly": _p1_monthly(),
    "p2_found": """
WITH c AS (SELECT o.observation_id, v.version_id, row_number() OVER (PARTITION BY o.observation_id, o.relationship_id, o.observed_at
    ORDER BY v.valid_from DESC, v.system_from DESC, v.version_id DESC) AS rn
  FROM observations o JOIN versions v ON v.relationship_id = o.relationship_id
   AND v.valid_from <= (o.observed_at AT TIME ZONE 'UTC')::DATE AND (v.valid_to IS NULL OR v.valid_to >= (o.observed_at AT TIME ZONE 'UTC')::DATE)
   AND v.system_from <= o.observed_at AND (v.system_to IS NULL OR v.system_to > o.observed_at))
SELECT DISTINCT observation_id, version_id FROM c WHERE rn = 1""",
    "p3_method": f"{_P3} SELECT event_month, (count(*) FILTER (NOT late))::BIGINT AS records, (count(*) FILTER (late))::BIGINT AS late_records, round(avg(c) FILTER (NOT late), 6) AS mean_confidence FROM r GROUP BY 1",
    "p3_found": f"{_P3} SELECT event_month, assertion_id FROM r WHERE late",
    "p3_monthly": f"{_P3} SELECT event_month, count(*)::BIGINT AS records, round(avg(c), 6) AS mean_confidence FROM r WHERE NOT late GROUP BY 1",
    "p4_found": """
WITH c AS (SELECT assertion_id, relationship_id, polarity, min(ingested_at) AS t FROM assertions
  WHERE polarity IN (1, -1) AND assertion_id IS NOT NULL AND relationship_id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY relationship_id ORDER BY t DESC, assertion_id DESC) AS rn FROM c)
SELECT relationship_id, assertion_id FROM r WHERE rn = 1 AND polarity = 1""",
    "p5_found": f"{_COVER} SELECT r AS relationship_id, strftime(upto + 1, '%Y-%m-%d') AS gap_from, strftime(f - 1, '%Y-%m-%d') AS gap_to FROM g WHERE starts = 1 AND upto IS NOT NULL",
    "p5_periods": f"""{_COVER}, p AS (SELECT *, sum(starts) OVER (PARTITION BY r ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT r AS relationship_id, strftime(min(f), '%Y-%m-%d') AS period_from,
  CASE WHEN max(t) = DATE '9999-12-31' THEN 'open' ELSE strftime(max(t), '%Y-%m-%d') END AS period_to FROM p GROUP BY r, k""",
    "p6_found": f"{_P6} SELECT field_name, entity_id FROM e WHERE entity_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT version_id) >= 0.01 * (SELECT count(DISTINCT version_id) FROM versions)",
    "p6_summary": f"""{_P6},
h AS (SELECT greatest(max(valid_from), max(valid_to)) AS d FROM versions),
x AS (SELECT field_name, entity_id, unnest(range(epoch(valid_from)::BIGINT // 86400, epoch(coalesce(valid_to, h.d))::BIGINT // 86400 + 1)) AS day FROM e, h),
y AS (SELECT field_name, entity_id, count(DISTINCT day) AS days FROM x GROUP BY 1, 2)
SELECT e.field_name, e.entity_id, count(DISTINCT version_id)::BIGINT AS versions, count(DISTINCT partner)::BIGINT AS partners, coalesce(any_value(y.days), 0)::BIGINT AS days
FROM e LEFT JOIN y ON y.field_name = e.field_name AND y.entity_id = e.entity_id WHERE e.entity_id IS NOT NULL GROUP BY 1, 2""",
    "p7_found": f"""{_P7} SELECT subject_id, predicate, object_id, strftime(min(taken_on), '%Y-%m-%d') AS valid_from, strftime(max(taken_on), '%Y-%m-%d') AS last_confirmed,
  CASE WHEN max(taken_on) = any_value(head) THEN 'open' ELSE strftime(max(taken_on), '%Y-%m-%d') END AS valid_to FROM i GROUP BY subject_id, predicate, object_id, run""",
    "p7_state": """
WITH d AS (SELECT subject_id, predicate, max(taken_on) AS taken_on FROM sync_snapshots WHERE taken_on <= DATE '2022-06-30' GROUP BY ALL),
p AS (SELECT s.subject_id, s.predicate, s.taken_on, arg_max(s.snapshot_id, s.received_at) AS snapshot_id, max(s.received_at) AS received_at
  FROM sync_snapshots s JOIN d USING (subject_id, predicate, taken_on) GROUP BY ALL)
SELECT s.subject_id, s.predicate, s.object_id, max(CASE WHEN isnan(s.confidence) THEN NULL ELSE s.confidence END) AS confidence
FROM sync_snapshots s JOIN p USING (subject_id, predicate, taken_on, snapshot_id, received_at) WHERE s.object_id IS NOT NULL GROUP BY ALL""",
}
