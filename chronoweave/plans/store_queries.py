"""Queries that run the store, the write log and the write verbs over whole tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions.times import iso_day, midnight_micros
from chronoweave.model import EVENTS
from chronoweave.operators import ingest
from chronoweave.operators.patterns import Pattern
from chronoweave.plans.graph_queries import DAY, HUB, KNOWN_FACTS, YARD, graph_versions
from chronoweave.sources import store
from chronoweave.sources.scratch import scratch_path
from chronoweave.sources.tables import clean_confidence, table, trade_touches

TRIPLE = ["subject_id", "predicate", "object_id"]
CONFIRMED, CLOSED = "2030-01-01", "2030-06-30"


def _events(rows: DataFrame, **given) -> DataFrame:
    """``rows`` as a write log; what is not given is NULL."""
    columns = {f.name: given.get(f.name, F.lit(None)) for f in EVENTS.fields}
    return rows.select(*(c.cast(EVENTS[name].dataType).alias(name) for name, c in columns.items()))


def claim_events(spark: SparkSession, folder: str) -> DataFrame:
    """The assertions that set a relationship, or say nothing usable, as a write log in the order of their ids.

    Each assertion once, at its first ingestion, with the triple of its
    relationship and the record of its source.
    """
    claims = (
        table(spark, folder, "assertions")
        .where("polarity is null or polarity != -1")
        .groupBy("assertion_id", "relationship_id", "source_id", "event_time", "published_at", "polarity", clean_confidence().alias("confidence"))
        .agg(F.min("ingested_at").alias("recorded_at"))
    )
    triples = table(spark, folder, "relationships").select("relationship_id", *TRIPLE).distinct()
    known = table(spark, folder, "sources").select("source_id", "url", "title", "domain").distinct()
    rows = claims.join(triples, "relationship_id", "left").join(known, "source_id", "left")
    source = F.struct("url", "title", "domain", "published_at")
    return _events(
        rows, seq=F.col("assertion_id"), op=F.when(F.col("polarity") == 1, "assert").otherwise("none"), day=F.col("event_time"), confidence=F.col("confidence"),
        sources=F.when(F.col("url").isNotNull(), F.array(source)), recorded_at=F.col("recorded_at"), **{c: F.col(c) for c in TRIPLE},
    )


def _log(spark: SparkSession, folder: str) -> tuple[store.TemporalGraph, DataFrame]:
    db = store.open_graph(spark, scratch_path(spark, "graph"))
    return db, db.load_events(claim_events(spark, folder))


def log_versions(spark: SparkSession, folder: str) -> DataFrame:
    """What the asserts of the log fold to, with the last confidence given."""
    found = _log(spark, folder)[0].versions
    return found.select(*TRIPLE, iso_day(F.col("valid_from")).alias("valid_from"), iso_day(F.col("last_confirmed")).alias("last_confirmed"), F.round("confidence", 6).alias("confidence"), F.size("assertion_ids").cast("bigint").alias("assertions"))


def log_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Events of the log that cannot be taken in, by reason."""
    return _log(spark, folder)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("events"))


def log_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One source per url, in the first writer's words."""
    return _log(spark, folder)[0].sources.drop("source_id")


def log_assertions(spark: SparkSession, folder: str) -> DataFrame:
    """The assertions of the log with the triple of the version they are tied to and the url of their source."""
    db, _ = _log(spark, folder)
    tied = db.assertions.join(db.versions.select("version_id", *TRIPLE), "version_id").join(db.sources.select("source_id", "url"), "source_id")
    return tied.select(*TRIPLE, "url", iso_day(F.col("event_time")).alias("event_time"), "published_at", "polarity")


def log_entities(spark: SparkSession, folder: str) -> DataFrame:
    """First and last day of every entity, over asserts and confirmations."""
    return _log(spark, folder)[0].entities.select("entity_id", iso_day(F.col("first_seen")).alias("first_seen"), iso_day(F.col("last_seen")).alias("last_seen"))


def log_entity(spark: SparkSession, folder: str) -> DataFrame:
    """One entity by id."""
    found = _log(spark, folder)[0].get_entity(HUB)
    rows = [] if found is None else [(found["entity_id"], str(found["first_seen"]), str(found["last_seen"]))]
    return spark.createDataFrame(rows, "entity_id string, first_seen string, last_seen string")


def log_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of the five tables of the store."""
    return _log(spark, folder)[0].counts()


def fold_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Of every customer and supplier: first trade, a retract before it, last trade, a retract after it.

    The retract before the start is refused and changes nothing.
    """
    spans = trade_touches(spark, folder).groupBy(*TRIPLE).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    event = lambda k, op, day: F.struct(F.lit(k).alias("k"), F.lit(op).alias("op"), day.alias("day"))
    four = F.array(event(0, "assert", F.col("a")), event(1, "retract", F.date_sub("a", 30)), event(2, "assert", F.col("b")), event(3, "retract", F.date_add("b", 90)))
    rows = spans.select(*TRIPLE, F.explode(four).alias("e")).select(*TRIPLE, "e.*")
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).cast("bigint")
    seq = (number("subject_id") * 1_000_000 + number("object_id")) * 4 + F.col("k")
    db = store.open_graph(spark, scratch_path(spark, "graph"))
    refused = db.load_events(_events(rows, seq=seq, op=F.col("op"), day=F.col("day"), recorded_at=F.timestamp_micros(midnight_micros(F.col("day"))), **{c: F.col(c) for c in TRIPLE}))
    version = db.versions.select(F.lit("version").alias("kind"), *TRIPLE, iso_day(F.col("valid_from")).alias("valid_from"), iso_day(F.col("valid_to")).alias("valid_to"), iso_day(F.col("last_confirmed")).alias("last_confirmed"))
    return version.unionByName(refused.select(F.col("reason").alias("kind"), *TRIPLE, iso_day(F.col("day")).alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit(None).cast("string").alias("last_confirmed")))


def _restored(spark: SparkSession, folder: str) -> store.TemporalGraph:
    dump, place = scratch_path(spark, "dump"), scratch_path(spark, "restored")
    store.dump_facts(graph_versions(spark, folder, KNOWN_FACTS), dump)
    return store.TemporalGraph.restore(spark, dump, place)


def restore_then_write(spark: SparkSession, folder: str) -> DataFrame:
    """Every triple of a restored graph is asserted and then retracted: what is open is confirmed and closed, the rest opens anew."""
    db = _restored(spark, folder)
    event = lambda k, op, day: F.struct(F.lit(k).alias("k"), F.lit(op).alias("op"), F.lit(day).cast("date").alias("day"))
    rows = db.relationships.select("relationship_id", *TRIPLE, F.explode(F.array(event(0, "assert", CONFIRMED), event(1, "retract", CLOSED))).alias("e")).select("relationship_id", *TRIPLE, "e.*")
    # Relationship ids of a restored graph count down from -1.
    db.load_events(_events(rows, seq=F.col("relationship_id") * -2 + F.col("k"), op=F.col("op"), day=F.col("day"), confidence=F.when(F.col("k") == 0, 0.5), recorded_at=F.timestamp_micros(midnight_micros(F.col("day"))), **{c: F.col(c) for c in TRIPLE}))
    found = db.versions.select(*TRIPLE, iso_day(F.col("valid_from")).alias("valid_from"), iso_day(F.col("valid_to")).alias("valid_to"), iso_day(F.col("last_confirmed")).alias("last_confirmed"), "confidence")
    return found.groupBy(*found.columns).agg(F.count(F.lit(1)).alias("n"))


def dump_order(spark: SparkSession, folder: str) -> DataFrame:
    """The start of the fact in every line of a dump."""
    dump = scratch_path(spark, "dump")
    store.dump_facts(graph_versions(spark, folder, KNOWN_FACTS), dump)
    return ingest.numbered_lines(spark, dump).select(F.col("number").alias("line"), F.get_json_object("value", "$.valid_from").alias("valid_from"))


def backup_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """A pattern by object over a backup, opened again, of a compacted graph."""
    db, place = _restored(spark, folder), scratch_path(spark, "backup")
    db.compact()
    db.backup(place)
    found = store.open_graph(spark, place).as_of(Pattern(None, None, YARD), DAY)
    return found.groupBy("subject_id", "predicate", iso_day(F.col("valid_from")).alias("valid_from"), iso_day(F.col("valid_to")).alias("valid_to"), "confidence").agg(F.count(F.lit(1)).alias("n"))


def replay_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Trades written as a log of JSON lines and replayed: asserts with sources, in the order of their lines."""
    path = scratch_path(spark, "jsonl")
    lines = trade_touches(spark, folder).select(
        F.lit("assert").alias("op"), F.col("subject_id").alias("s"), F.col("predicate").alias("p"), F.col("object_id").alias("o"), iso_day(F.col("day")).alias("d"),
        F.col("confidence").alias("c"), F.array(F.struct(F.concat(F.lit("http://filings/"), "filing").alias("url"))).alias("sources"),
    )
    lines.orderBy("d", "s", "o").write.json(path)
    db = store.open_graph(spark, scratch_path(spark, "graph"))
    db.load_jsonl(path)
    return db.versions.select(*TRIPLE, iso_day(F.col("valid_from")).alias("valid_from"), iso_day(F.col("last_confirmed")).alias("last_confirmed"), F.size("assertion_ids").cast("bigint").alias("assertions"))


def statement_writes(spark: SparkSession, folder: str) -> DataFrame:
    """Nations written by ASSERT statements in one batch, and taken back by RETRACT where their region is the first."""
    db = store.open_graph(spark, scratch_path(spark, "graph"))
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey").collect()
    with db.write_batch():
        for n, r in nations:
            db.execute(f"ASSERT (NATION_{n}, LIES_IN, REGION_{r}) VALID FROM '2020-01-01' CONFIDENCE 0.5")
        for n, r in nations:
            if r == 0:
                db.execute(f"RETRACT (NATION_{n}, LIES_IN, REGION_{r}) VALID TO '2021-01-01'")
    return db.versions.select("subject_id", "object_id", iso_day(F.col("valid_from")).alias("valid_from"), iso_day(F.col("valid_to")).alias("valid_to"), "confidence")


QUERIES = {
    f.__name__: f
    for f in (
        log_versions, log_rejects, log_sources, log_assertions, log_entities, log_entity, log_stats, fold_rejects, restore_then_write, dump_order, backup_compacted, replay_jsonl, statement_writes,
    )
}

_D = lambda c: f"strftime({c}, '%Y-%m-%d')"
_V = """v AS (SELECT DISTINCT version_id, relationship_id, subject_id, predicate, object_id, valid_from, valid_to,
  CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence FROM versions)"""
_CLAIMS = """
WITH a AS (SELECT assertion_id, relationship_id, source_id, event_time, published_at, polarity, any_value(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END) AS c
  FROM assertions WHERE polarity IS NULL OR polarity <> -1 GROUP BY ALL),
e AS (SELECT a.*, r.subject_id, r.predicate, r.object_id, s.url, s.title, s.domain, coalesce(polarity = 1, false) AS is_assert FROM a
  LEFT JOIN (SELECT DISTINCT relationship_id, subject_id, predicate, object_id FROM relationships) r USING (relationship_id)
  LEFT JOIN (SELECT DISTINCT source_id, url, title, domain FROM sources) s USING (source_id)),
g AS (SELECT * FROM e WHERE is_assert AND subject_id IS NOT NULL AND event_time IS NOT NULL),
k AS (SELECT subject_id, predicate, object_id, arg_min(event_time, assertion_id) AS f, max(event_time) AS l, arg_max(c, assertion_id) AS c, count(url)::BIGINT AS n FROM g GROUP BY ALL),
t AS (SELECT subject_id AS entity_id, event_time FROM g UNION ALL SELECT object_id, event_time FROM g)"""
_SPANS = """
WITH t AS (SELECT 'CUST_' || o_custkey AS subject_id, 'BUYS_FROM' AS predicate, 'SUPP_' || l_suppkey AS object_id, CAST(o_orderdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT subject_id, predicate, object_id, min(d) AS a, max(d) AS b, count(DISTINCT d)::BIGINT AS n FROM t GROUP BY ALL)"""

ORACLES = {
    "log_versions": f"{_CLAIMS} SELECT subject_id, predicate, object_id, {_D('f')} AS valid_from, {_D('l')} AS last_confirmed, round(c, 6) AS confidence, n AS assertions FROM k",
    "log_rejects": f"{_CLAIMS} SELECT CASE WHEN NOT is_assert THEN 'unknown op' WHEN subject_id IS NULL THEN 'bad subject' ELSE 'no day' END AS reason, count(*)::BIGINT AS events FROM e WHERE NOT is_assert OR subject_id IS NULL OR event_time IS NULL GROUP BY 1",
    "log_sources": f"{_CLAIMS} SELECT url, coalesce(arg_min_null(title, assertion_id), '') AS title, coalesce(arg_min_null(domain, assertion_id), '') AS domain FROM g WHERE url IS NOT NULL GROUP BY 1",
    "log_assertions": f"{_CLAIMS} SELECT subject_id, predicate, object_id, url, {_D('event_time')} AS event_time, published_at, 1 AS polarity FROM g WHERE url IS NOT NULL",
    "log_entities": f"{_CLAIMS} SELECT entity_id, {_D('min(event_time)')} AS first_seen, {_D('max(event_time)')} AS last_seen FROM t GROUP BY 1",
    "log_entity": f"{_CLAIMS} SELECT entity_id, {_D('min(event_time)')} AS first_seen, {_D('max(event_time)')} AS last_seen FROM t WHERE entity_id = '{HUB}' GROUP BY 1",
    "log_stats": f"""{_CLAIMS} SELECT 'relationships' AS name, count(*)::BIGINT AS n FROM k UNION ALL SELECT 'versions', count(*) FROM k UNION ALL SELECT 'assertions', count(url) FROM g
UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM t UNION ALL SELECT 'sources', count(DISTINCT url) FROM g""",
    "fold_rejects": f"""{_SPANS} SELECT 'version' AS kind, subject_id, predicate, object_id, {_D('a')} AS valid_from, {_D('b + 90')} AS valid_to, {_D('b')} AS last_confirmed FROM s
UNION ALL SELECT 'before the start', subject_id, predicate, object_id, {_D('a - 30')}, NULL, NULL FROM s""",
    "restore_then_write": f"""
WITH {_V}, o AS (SELECT *, row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY valid_to IS NULL DESC, valid_from DESC, confidence DESC NULLS LAST) AS k FROM v),
w AS (SELECT subject_id, predicate, object_id, valid_from, CASE WHEN k = 1 AND valid_to IS NULL THEN DATE '{CLOSED}' ELSE valid_to END AS valid_to,
    CASE WHEN k = 1 AND valid_to IS NULL THEN DATE '{CONFIRMED}' ELSE coalesce(valid_to, valid_from) END AS last_confirmed, CASE WHEN k = 1 AND valid_to IS NULL THEN 0.5::DOUBLE ELSE confidence END AS confidence FROM o
  UNION ALL SELECT subject_id, predicate, object_id, DATE '{CONFIRMED}', DATE '{CLOSED}', DATE '{CONFIRMED}', 0.5 FROM v GROUP BY ALL HAVING count(*) FILTER (valid_to IS NULL) = 0)
SELECT subject_id, predicate, object_id, {_D('valid_from')} AS valid_from, {_D('valid_to')} AS valid_to, {_D('last_confirmed')} AS last_confirmed, confidence, count(*)::BIGINT AS n FROM w GROUP BY ALL""",
    "dump_order": f"WITH {_V} SELECT row_number() OVER (ORDER BY valid_from)::BIGINT AS line, {_D('valid_from')} AS valid_from FROM v",
    "backup_compacted": f"WITH {_V} SELECT subject_id, predicate, {_D('valid_from')} AS valid_from, {_D('valid_to')} AS valid_to, confidence, count(*)::BIGINT AS n FROM v WHERE object_id = '{YARD}' AND valid_from <= DATE '{DAY}' AND (valid_to IS NULL OR valid_to >= DATE '{DAY}') GROUP BY ALL",
    "replay_jsonl": f"{_SPANS} SELECT subject_id, predicate, object_id, {_D('a')} AS valid_from, {_D('b')} AS last_confirmed, n AS assertions FROM s",
    "statement_writes": "SELECT 'NATION_' || n_nationkey AS subject_id, 'REGION_' || n_regionkey AS object_id, '2020-01-01' AS valid_from, CASE WHEN n_regionkey = 0 THEN '2021-01-01' END AS valid_to, 0.5::DOUBLE AS confidence FROM nation",
}
