"""Queries of the temporal graph over the ``versions`` table and the trade graph, with SQL twins.

Days come out as text and numbers that depend on the order of addition are
rounded, so that both sides can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions.times import iso_day
from chronoweave.operators import changepoint, graph, ingest, metrics, provenance, temporal
from chronoweave.operators.patterns import Pattern
from chronoweave.operators.temporal import Spine
from chronoweave.plans.compiler import compile_statement
from chronoweave.sources import store
from chronoweave.sources.scratch import scratch_path
from chronoweave.sources.tables import graph_versions, snapshot_events, table, trade_events, trade_versions

DAY, START, END, KNOWN = "2022-06-01", "2022-01-01", "2022-12-31", "2022-09-01"
HUB, YARD, FAR = "CARR_0000017", "YARD_0000033", "CARR_0000204"
MONTHS = Spine.of(START, END, 30)
HALVES = Spine.of(START, END, 180)
QUARTERS = Spine.of("2019-01-01", "2025-12-31", 90)
FLAGSHIP = "MATCH (?s, BUYS_FROM, SUPP_1) AS OF '1998-06-01'"
#: What a query reads of a version; a distinct does not prune by itself.
SPANS = ("version_id", "relationship_id", "subject_id", "object_id", "valid_from", "valid_to")
#: What a set of links reads of it; copies of a version add nothing to that.
LINKS = ("subject_id", "object_id", "valid_from", "valid_to")
WEIGHTED = (*SPANS, "confidence")
FACTS = (*WEIGHTED, "predicate")
KNOWN_FACTS = (*FACTS, "system_from", "system_to")
DATES = ("valid_from", "valid_to", "last_confirmed", "date", "first_seen", "last_seen", "event_time", "first_connected")


def _text_days(frame: DataFrame) -> DataFrame:
    return frame.select(*(iso_day(F.col(c)).alias(c) if c in DATES else F.col(c) for c in frame.columns))


def _facts(frame: DataFrame, *more: str) -> DataFrame:
    return _text_days(frame.select("version_id", "relationship_id", "subject_id", "predicate", "object_id", "valid_from", "valid_to", "confidence", *more))


def _statement(text: str):
    columns = KNOWN_FACTS if "KNOWN BY" in text else FACTS

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _facts(compile_statement(text, graph_versions(spark, folder, columns)))

    return run


def match_bindings(spark: SparkSession, folder: str) -> DataFrame:
    found = compile_statement(f"MATCH ({HUB}, ?how, ?what) AS OF '{DAY}'", graph_versions(spark, folder, FACTS))
    return found.select("version_id", F.col("bindings")["how"].alias("how"), F.col("bindings")["what"].alias("what"))


def trade_match(spark: SparkSession, folder: str) -> DataFrame:
    found = compile_statement(FLAGSHIP, trade_versions(spark, folder))
    return _text_days(found.select("subject_id", "predicate", "object_id", "valid_from", "valid_to", "last_confirmed", F.round("confidence", 6).alias("confidence"), F.col("bindings")["s"].alias("s")))


def diff_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(compile_statement(f"DIFF BETWEEN '{START}' AND '{END}'", graph_versions(spark, folder, FACTS)), "change")


def diff_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.diff(graph_versions(spark, folder, FACTS), START, END, Pattern(HUB)).nodes


def range_days(spark: SparkSession, folder: str) -> DataFrame:
    return compile_statement(f"RANGE ({HUB}, ?p, ?o) BETWEEN '{START}' AND '{END}'", graph_versions(spark, folder, FACTS))


def range_days_reverse(spark: SparkSession, folder: str) -> DataFrame:
    return compile_statement(f"RANGE (?s, ?p, {YARD}) BETWEEN '{START}' AND '{END}'", graph_versions(spark, folder, FACTS))


def range_days_all(spark: SparkSession, folder: str) -> DataFrame:
    return temporal.day_counts(graph_versions(spark, folder, SPANS), Pattern(), START, END)


def series_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(temporal.series_counts(graph_versions(spark, folder, SPANS), Pattern(), Spine.of("2019-01-01", "2025-12-31", 7)))


def series_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(compile_statement(f"SERIES ({HUB}, ?p, ?o) BETWEEN '{START}' AND '{END}' RESOLUTION '30d'", graph_versions(spark, folder, FACTS)), "date")


def degree_all(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.degrees(graph_versions(spark, folder, WEIGHTED), DAY).withColumn("weighted_degree", F.round("weighted_degree", 6))


def edge_weight_all(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.edge_weights(graph_versions(spark, folder, FACTS), DAY)


def track_degree(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(metrics.track_degree(graph_versions(spark, folder, SPANS), MONTHS))


def track_weighted_degree(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(metrics.track_weighted_degree(graph_versions(spark, folder, WEIGHTED), MONTHS)).withColumn("value", F.round("value", 6))


def track_edge_weight(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(metrics.track_edge_weight(graph_versions(spark, folder, FACTS), MONTHS, Pattern(HUB)))


def signal_join(spark: SparkSession, folder: str) -> DataFrame:
    """Facts active per week beside the number of assertions of that day."""
    signal = temporal.series_counts(graph_versions(spark, folder, SPANS), Pattern(), Spine.of("2019-01-01", "2025-12-31", 7)).withColumn("value", F.col("facts").cast("double"))
    other = table(spark, folder, "assertions").where("event_time is not null").groupBy(F.col("event_time").alias("date")).agg(F.count_distinct("assertion_id").cast("double").alias("other"))
    return _text_days(metrics.join_signal(signal.select("date", "value"), other))


def active_entities(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.active_entities(graph_versions(spark, folder, SPANS), DAY)


def neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.neighbors(graph_versions(spark, folder, SPANS), DAY)


def out_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.out_neighbors(graph_versions(spark, folder, SPANS), DAY)


def bfs_distances(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(graph.path_lengths(graph_versions(spark, folder, SPANS), [HUB], DAY, 4))


def closeness_all(spark: SparkSession, folder: str) -> DataFrame:
    return graph.closeness(graph_versions(spark, folder, SPANS), DAY).select("entity", F.round("closeness", 6).alias("closeness"))


def track_closeness(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.closeness(graph_versions(spark, folder, SPANS), MONTHS, [HUB, FAR], 3)
    return _text_days(found.select("date", "entity", F.round("closeness", 6).alias("value")))


def path_hops(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.shortest_paths(graph_versions(spark, folder, FACTS), HUB, FAR, MONTHS)
    return _text_days(found.select("date", "hops"))


def path_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The versions along the path; of several shortest paths the first in scan order."""
    found = graph.shortest_paths(graph_versions(spark, folder, FACTS), HUB, FAR, DAY)
    return _facts(found.select(F.posexplode("path").alias("hop", "v")).select("hop", "v.*"), "hop")


def path_history(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.path_history(graph_versions(spark, folder, FACTS), HUB, YARD, MONTHS)
    return _text_days(found.select("date", F.coalesce("hops", F.lit(-1)).alias("hops")))


def first_connected(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(graph.first_connected(graph_versions(spark, folder, SPANS), HUB, FAR, START, END, 2))


def pagerank_fixed_iters(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.pagerank(graph_versions(spark, folder, SPANS), DAY, max_iterations=20, tolerance=0.0)
    return found.select("entity", F.round("pagerank", 8).alias("pagerank"))


def pagerank_converged(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks at which the iteration stops by itself, to as many digits as its tolerance settles."""
    found = graph.pagerank(graph_versions(spark, folder, SPANS), DAY)
    return found.select("entity", F.round("pagerank", 5).alias("pagerank"))


def track_pagerank(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.pagerank(graph_versions(spark, folder, SPANS), HALVES, max_iterations=10, tolerance=0.0)
    return _text_days(found.select("date", "entity", F.round("pagerank", 8).alias("pagerank")))


def betweenness_all(spark: SparkSession, folder: str) -> DataFrame:
    return graph.betweenness(table(spark, folder, "versions").select(*LINKS), DAY).select("entity", F.round("betweenness", 4).alias("betweenness"))


def track_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    found = graph.betweenness(table(spark, folder, "versions").select(*LINKS), HALVES, 2)
    return _text_days(found.select("date", "entity", F.round("betweenness", 4).alias("betweenness")))


def changepoints(spark: SparkSession, folder: str) -> DataFrame:
    """Change points of the monthly degree of every entity; binary segmentation is not told in SQL."""
    signal = metrics.track_degree(graph_versions(spark, folder, SPANS), Spine.of("2019-01-01", "2025-12-31", 30))
    return _text_days(changepoint.changepoints(signal, ["entity"]))


def changepoints_planted(spark: SparkSession, folder: str) -> DataFrame:
    """Signals of every entity that rise once, on the day it was first seen, and nowhere else."""
    seen = table(spark, folder, "entities").where("first_seen is not null").groupBy("entity_id").agg(F.min("first_seen").alias("first_seen"))
    ticks = seen.select("entity_id", "first_seen", F.explode(F.sequence(F.lit(0), F.lit(QUARTERS.size - 1))).alias("tick"))
    signal = ticks.withColumn("date", QUARTERS.date(F.col("tick"))).withColumn("value", F.when(F.col("date") >= F.col("first_seen"), 10.0).otherwise(1.0))
    return _text_days(changepoint.changepoints(signal, ["entity_id"], min_size=1))


def version_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All fields of the versions of a statement's answer."""
    found = compile_statement(f"MATCH (?s, ?p, ?o) AS OF '{DAY}'", graph_versions(spark, folder, (*KNOWN_FACTS, "last_confirmed", "properties", "assertion_ids")))
    ids = F.concat_ws(",", F.transform("assertion_ids", lambda x: F.coalesce(x.cast("string"), F.lit("-")))).alias("assertion_ids")
    instant = lambda c: F.unix_micros(c).alias(c)
    return _text_days(found.select(*FACTS, "last_confirmed", "properties", instant("system_from"), instant("system_to"), ids))


def _numbered(found: DataFrame) -> DataFrame:
    """Rows with their position in the order they come in."""
    return found.withColumn("at", F.monotonically_increasing_id()).withColumn("position", F.row_number().over(Window.orderBy("at"))).drop("at")


def history_order(spark: SparkSession, folder: str) -> DataFrame:
    """The answer of HISTORY with the place of each row."""
    found = compile_statement(f"HISTORY ({HUB}, ?p, ?o)", graph_versions(spark, folder, FACTS))
    return _numbered(found.select("version_id"))


def evidence_order(spark: SparkSession, folder: str) -> DataFrame:
    """The assertions of a version in the order they were ingested."""
    claims = provenance.unique_assertions(table(spark, folder, "assertions").select("assertion_id", "version_id", "ingested_at"))
    return _numbered(provenance.evidence_of(claims, 5702).select("assertion_id"))


def _tracked(text: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = compile_statement(text, graph_versions(spark, folder, FACTS))
        return _text_days(found.select("date", F.round("value", 6).alias("value")))

    return run


def path_statement(spark: SparkSession, folder: str) -> DataFrame:
    found = compile_statement(f"PATH ({HUB}, {FAR}) AS OF '{DAY}' MAX_DEPTH 5", graph_versions(spark, folder, FACTS))
    return found.select("hops", F.size("path").alias("edges"))


def first_connected_statement(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(compile_statement(f"FIRST_CONNECTED ({HUB}, {YARD}) BETWEEN '{START}' AND '{END}' MAX_DEPTH 2", graph_versions(spark, folder, FACTS)))


def path_history_statement(spark: SparkSession, folder: str) -> DataFrame:
    found = compile_statement(f"PATH_HISTORY ({HUB}, {FAR}) BETWEEN '{START}' AND '{END}' RESOLUTION '30d' MAX_DEPTH 3", graph_versions(spark, folder, FACTS))
    return _text_days(found.select("date", F.coalesce("hops", F.lit(-1)).alias("hops")))


def why_changed_statement(spark: SparkSession, folder: str) -> DataFrame:
    return compile_statement(f"WHY_CHANGED ({HUB}, HAULS, CMDY_0001042) BETWEEN '{START}' AND '{END}'", graph_versions(spark, folder, FACTS))


def why_changed_status(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.change_status(graph_versions(spark, folder, FACTS), START, END)


def why_changed_evidence(spark: SparkSession, folder: str) -> DataFrame:
    claims = provenance.unique_assertions(table(spark, folder, "assertions"))
    found = provenance.evidence(graph_versions(spark, folder, FACTS), claims, table(spark, folder, "sources"), START, END)
    return _text_days(found.select("assertion_id", "version_id", "subject_id", "predicate", "object_id", "event_time", "source_id", "url"))


def assertions_for_version(spark: SparkSession, folder: str) -> DataFrame:
    claims = provenance.unique_assertions(table(spark, folder, "assertions").select("assertion_id", "version_id", "source_id", "ingested_at"))
    return provenance.evidence_of(claims, 42).select("assertion_id", "source_id")


def fold_assert_retract(spark: SparkSession, folder: str) -> DataFrame:
    folded = ingest.fold(trade_events(spark, folder), syncs=False)
    return _text_days(folded.select("subject_id", "predicate", "object_id", "valid_from", "valid_to", "last_confirmed", F.round("confidence", 6).alias("confidence")))


def fold_sync_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    folded = ingest.fold(snapshot_events(spark, folder))
    return _text_days(folded.select("subject_id", "predicate", "object_id", "valid_from", "valid_to", "last_confirmed", F.round("confidence", 6).alias("confidence")))


def entities_seen(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(ingest.entities_seen(graph_versions(spark, folder, ("version_id", "subject_id", "object_id", "valid_from", "last_confirmed"))))


def entity_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _text_days(table(spark, folder, "entities").where(F.col("entity_id") == HUB).select("entity_id", "type", "first_seen", "last_seen"))


def sources_dedup(spark: SparkSession, folder: str) -> DataFrame:
    first = F.min(F.struct("source_id", "title", "domain")).alias("s")
    return table(spark, folder, "sources").groupBy("url").agg(first).select("url", "s.source_id", "s.title", "s.domain")


def relationships_found(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.relationships_of(graph_versions(spark, folder, ("version_id", "relationship_id", "subject_id", "predicate", "object_id", "system_from"))).drop("created_at")


def stats(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"relationships": "relationship_id", "versions": "version_id", "assertions": "assertion_id", "entities": "entity_id", "sources": "source_id"}
    parts = [table(spark, folder, t).agg(F.count_distinct(k).alias("n")).select(F.lit(t).alias("name"), "n") for t, k in keys.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def dump_restore_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    dump, place = scratch_path(spark, "dump"), scratch_path(spark, "restored")
    store.dump_facts(graph_versions(spark, folder, FACTS), dump)
    restored = store.TemporalGraph.restore(spark, dump, place).versions
    return _text_days(restored.groupBy("subject_id", "predicate", "object_id", "valid_from", "valid_to", "confidence").agg(F.count(F.lit(1)).alias("n")))


QUERIES = {
    "trade_match": trade_match,
    "match_as_of": _statement(f"MATCH ({HUB}, ?p, ?o) AS OF '{DAY}'"),
    "match_reverse": _statement(f"MATCH (?s, ?p, {YARD}) AS OF '{DAY}'"),
    "match_predicate_only": _statement(f"MATCH (?s, HAULS, ?o) AS OF '{DAY}'"),
    "match_all_wild": _statement(f"MATCH (?s, ?p, ?o) AS OF '{DAY}'"),
    "match_known_by": _statement(f"MATCH (?s, ?p, ?o) AS OF '{DAY}' KNOWN BY '{KNOWN}'"),
    "match_where": _statement(f"MATCH (?s, ?p, ?o) AS OF '{DAY}' WHERE confidence >= 0.8"),
    "match_above": _statement(f"MATCH (?s, ?p, ?o) AS OF '{DAY}' WHERE confidence > 0.9"),
    "match_at_most": _statement(f"MATCH (?s, ?p, ?o) AS OF '{DAY}' WHERE confidence <= 0.3"),
    "match_equal": _statement(f"MATCH (?s, ?p, ?o) AS OF '{DAY}' WHERE confidence = 1.2"),
    "match_where_not": _statement(f"MATCH ({HUB}, ?p, ?o) AS OF '{DAY}' WHERE confidence != 0.5"),
    "match_limit": _statement(f"MATCH ({HUB}, ?p, ?o) AS OF '{DAY}' LIMIT 10"),
    "track_degree_statement": _tracked(f"TRACK DEGREE({HUB}) BETWEEN '{START}' AND '{END}' RESOLUTION '30d'"),
    "track_weighted_statement": _tracked(f"TRACK WEIGHTED_DEGREE({HUB}) BETWEEN '{START}' AND '{END}' RESOLUTION '30d'"),
    "track_edge_statement": _tracked(f"TRACK EDGE_WEIGHT({HUB}, HAULS, CMDY_0001042) BETWEEN '{START}' AND '{END}' RESOLUTION '30d'"),
    "track_closeness_statement": _tracked(f"TRACK CLOSENESS({HUB}) BETWEEN '{START}' AND '{END}' RESOLUTION '30d' MAX_DEPTH 2"),
    "track_betweenness_statement": _tracked(f"TRACK BETWEENNESS({FAR}) BETWEEN '{START}' AND '{END}' RESOLUTION '180d' MAX_DEPTH 2"),
    "history": _statement(f"HISTORY ({HUB}, ?p, ?o)"),
    "history_between": _statement(f"HISTORY (?s, FEEDS, ?o) BETWEEN '{START}' AND '{END}' WHERE confidence < 0.9"),
} | {
    f.__name__: f
    for f in (
        match_bindings, diff_edges, diff_nodes, range_days, range_days_reverse, range_days_all, series_counts, series_facts, degree_all,
        edge_weight_all, track_degree, track_weighted_degree, track_edge_weight, signal_join, active_entities, neighbors, out_neighbors,
        bfs_distances, closeness_all, track_closeness, path_hops, path_edges, path_history, first_connected, pagerank_fixed_iters,
        pagerank_converged, track_pagerank, betweenness_all, track_betweenness, changepoints, changepoints_planted, why_changed_status,
        version_rows, history_order, evidence_order, path_statement, first_connected_statement, path_history_statement, why_changed_statement, why_changed_evidence, assertions_for_version,
        fold_assert_retract, fold_sync_snapshot, entities_seen, entity_lookup, sources_dedup, relationships_found, stats, dump_restore_roundtrip,
    )
}

# --- SQL twins --------------------------------------------------------------------------------

_V = """WITH v AS (SELECT DISTINCT version_id, relationship_id, subject_id, predicate, object_id, valid_from, valid_to, system_from, system_to,
  last_confirmed, CASE WHEN isnan(confidence) THEN NULL ELSE confidence END AS confidence FROM versions)"""
_D = lambda c: f"strftime({c}, '%Y-%m-%d')"
_FACTS = f"version_id, relationship_id, subject_id, predicate, object_id, {_D('valid_from')} AS valid_from, {_D('valid_to')} AS valid_to, confidence"
_ACTIVE = lambda d: f"valid_from <= {d} AND (valid_to IS NULL OR valid_to >= {d})"
_DAYQ = f"DATE '{DAY}'"
_A, _B = f"DATE '{START}'", f"DATE '{END}'"


def _spine(start: str, size: int, step: int) -> str:
    return f"sp AS (SELECT DATE '{start}' + CAST(k * {step} AS INTEGER) AS date FROM range({size}) t(k))"


_MONTHS = _spine(START, MONTHS.size, MONTHS.step)
_HALVES = _spine(START, HALVES.size, HALVES.step)
_QUARTERS = _spine("2019-01-01", QUARTERS.size, QUARTERS.step)
_WEEKS = _spine("2019-01-01", Spine.of("2019-01-01", "2025-12-31", 7).size, 7)
_E = f"e AS (SELECT DISTINCT * FROM (SELECT subject_id AS src, object_id AS dst FROM v WHERE {_ACTIVE(_DAYQ)} UNION ALL SELECT object_id, subject_id FROM v WHERE {_ACTIVE(_DAYQ)}) WHERE src <> dst)"
_DE = f"e AS (SELECT DISTINCT * FROM (SELECT date, subject_id AS src, object_id AS dst FROM v, sp WHERE {_ACTIVE('date')} UNION ALL SELECT date, object_id, subject_id FROM v, sp WHERE {_ACTIVE('date')}) WHERE src <> dst)"
_TOUCH = "t AS (SELECT subject_id AS entity, v.* FROM v UNION ALL SELECT object_id, v.* FROM v WHERE subject_id <> object_id)"
_TRADE = """
WITH touch AS (SELECT 'CUST_' || o_custkey AS s, 'SUPP_' || l_suppkey AS o, CAST(o_orderdate AS DATE) AS d, max(CASE WHEN l_returnflag <> 'R' THEN l_quantity / 50.0 END) AS c
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
g AS (SELECT *, CASE WHEN date_diff('day', lag(d) OVER (PARTITION BY s, o ORDER BY d), d) <= 90 THEN 0 ELSE 1 END AS b FROM touch),
i AS (SELECT *, sum(b) OVER (PARTITION BY s, o ORDER BY d ROWS UNBOUNDED PRECEDING) AS k FROM g),
tv AS (SELECT s AS subject_id, 'BUYS_FROM' AS predicate, o AS object_id, min(d) AS valid_from, CASE WHEN max(d) + 90 <= DATE '2001-08-01' THEN max(d) + 90 END AS valid_to, max(d) AS last_confirmed, max(c) AS confidence, arg_max(c, d) AS confidence_last
  FROM i GROUP BY s, o, k)"""


def _hops(levels: int, dated: bool, source: str = "") -> str:
    """CTEs d1..dn of nodes reached by walks, and ``dist`` with the least number of hops per pair."""
    key, on = ("date, ", " AND a.date = e.date") if dated else ("", "")
    parts = [f"d1 AS (SELECT {key}src AS s, dst AS n FROM e {source})"]
    for k in range(2, levels + 1):
        akey = "a.date, " if dated else ""
        parts.append(f"d{k} AS (SELECT DISTINCT {akey}a.s, e.dst AS n FROM d{k - 1} a JOIN e ON a.n = e.src{on})")
    union = " UNION ALL ".join(f"SELECT {key}s, n, {k} AS d FROM d{k}" for k in range(1, levels + 1))
    parts.append(f"dist AS (SELECT {key}s, n, min(d) AS d FROM ({union}) WHERE s <> n GROUP BY ALL)")
    return ", ".join(parts)


def _pagerank(rounds: int, spine: str | None = None, digits: int = 8) -> str:
    """Rounds of the published iteration; with a spine per date."""
    source = f"SELECT DISTINCT date, subject_id AS src, object_id AS dst FROM v, sp WHERE {_ACTIVE('date')}" if spine else f"SELECT DISTINCT '{DAY}' AS date, subject_id AS src, object_id AS dst FROM v WHERE {_ACTIVE(_DAYQ)}"
    parts = [
        _V, *([spine] if spine else []),
        f"r AS ({source})",
        "e AS (SELECT * FROM r WHERE src <> dst)",
        "nd AS (SELECT date, src AS entity FROM r UNION SELECT date, dst FROM r)",
        "c AS (SELECT date, count(*) AS n FROM nd GROUP BY 1)",
        "o AS (SELECT date, src, count(*) AS k FROM e GROUP BY 1, 2)",
        "r0 AS MATERIALIZED (SELECT nd.date, entity, 1.0::DOUBLE / n AS x, k FROM nd JOIN c ON c.date = nd.date LEFT JOIN o ON o.src = entity AND o.date = nd.date)",
    ]
    for k in range(1, rounds + 1):
        last = f"r{k - 1}"
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT p.date, p.entity, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(f.x, 0) + coalesce(loose, 0) / n) AS x, p.k FROM {last} p JOIN c ON c.date = p.date "
            f"LEFT JOIN (SELECT date, sum(x) AS loose FROM {last} WHERE k IS NULL GROUP BY 1) l ON l.date = p.date "
            f"LEFT JOIN (SELECT q.date, dst, sum(q.x / q.k) AS x FROM {last} q JOIN e ON e.src = q.entity AND e.date = q.date GROUP BY 1, 2) f ON f.dst = p.entity AND f.date = p.date)"
        )
    dated = f"{_D('date')} AS date, " if spine else ""
    return ", ".join(parts) + f" SELECT {dated}entity, round(x, {digits}) AS pagerank FROM r{rounds}"


def _between(depth: int, spine: str | None = None, entity: str | None = None) -> str:
    """Pairs and their numbers of shortest paths up to ``depth``; an entity's score from the pairs it lies between."""
    edges = _DE if spine else _E.replace("SELECT DISTINCT *", f"SELECT DISTINCT '{DAY}' AS date, *")
    parts = [_V, *([spine] if spine else []), edges, "s1 AS (SELECT date, src AS s, dst AS n, 1 AS d, 1.0::DOUBLE AS g FROM e)"]
    for k in range(2, depth + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM s{j} b WHERE b.date = a.date AND b.s = a.s AND b.n = e.dst)" for j in range(max(1, k - 2), k))
        parts.append(f"s{k} AS MATERIALIZED (SELECT a.date, a.s, e.dst AS n, {k} AS d, sum(a.g) AS g FROM s{k - 1} a JOIN e ON a.date = e.date AND a.n = e.src WHERE a.s <> e.dst {seen} GROUP BY ALL)")
    parts.append("z AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(1, depth + 1)) + ")")
    parts.append(f"b AS (SELECT x.date, x.n AS entity, sum(x.g * y.g / w.g) / 2 AS c FROM z x JOIN z y ON x.date = y.date AND x.n = y.s AND x.d + y.d <= {depth} JOIN z w ON w.date = x.date AND w.s = x.s AND w.n = y.n AND w.d = x.d + y.d GROUP BY 1, 2)")
    days = f"SELECT date, {{}} AS entity FROM v, sp WHERE {_ACTIVE('date')}" if spine else f"SELECT '{DAY}' AS date, {{}} AS entity FROM v WHERE {_ACTIVE(_DAYQ)}"
    parts.append(f"nd AS ({days.format('subject_id')} UNION {days.format('object_id')})")
    if entity:
        return ", ".join(parts) + f" SELECT {_D('sp.date')} AS date, round(coalesce(c, 0), 6) AS value FROM sp LEFT JOIN b ON b.date = sp.date AND b.entity = '{entity}'"
    dated = f"{_D('nd.date')} AS date, " if spine else ""
    return ", ".join(parts) + f" SELECT {dated}nd.entity, round(coalesce(c, 0), 4) AS betweenness FROM nd LEFT JOIN b ON b.date = nd.date AND b.entity = nd.entity"


#: Walks in scan order: an outgoing version by predicate, start and id, then an incoming one by predicate, subject, start and id.
_PATH = f"""{_V}, a AS (SELECT * FROM v WHERE {_ACTIVE(_DAYQ)} AND subject_id <> object_id),
st AS (SELECT src, dst, min(struct_pack(side := side, p := predicate, s := s, f := valid_from, v := version_id)) AS step FROM (
  SELECT subject_id AS src, object_id AS dst, 0 AS side, predicate, '' AS s, valid_from, version_id FROM a UNION ALL SELECT object_id, subject_id, 1, predicate, subject_id, valid_from, version_id FROM a) GROUP BY 1, 2),
w1 AS (SELECT dst AS n, [step] AS w FROM st WHERE src = '{HUB}'), """ + ", ".join(
    f"w{k} AS (SELECT st.dst AS n, min(list_append(w, step)) AS w FROM w{k - 1} JOIN st ON st.src = n WHERE st.dst <> '{HUB}' "
    + " ".join(f"AND NOT EXISTS (SELECT 1 FROM w{j} x WHERE x.n = st.dst)" for j in range(1, k)) + " GROUP BY 1)" for k in range(2, 5)
) + ", " + "f AS (" + " UNION ALL ".join(f"SELECT w FROM w{k} WHERE n = '" + FAR + "'" for k in range(1, 5)) + "), h AS (SELECT unnest(w).v AS version_id, generate_subscripts(w, 1) - 1 AS hop FROM f)"

_MATCH = f"{_V} SELECT {_FACTS} FROM v WHERE {_ACTIVE(_DAYQ)}"
_CHANGES = f"""c AS (SELECT *, 'opened' AS change FROM v WHERE valid_from > {_A} AND valid_from <= {_B}
  UNION ALL SELECT *, 'closed' FROM v WHERE valid_to >= {_A} AND valid_to < {_B}
  UNION ALL SELECT *, 'persisted' FROM v WHERE valid_from <= {_A} AND (valid_to IS NULL OR valid_to >= {_B}))"""
_DAYS = f"sum(greatest(0, date_diff('day', greatest({_A}, valid_from), least({_B}, coalesce(valid_to, {_B}))) + 1))::BIGINT AS day_count FROM v WHERE valid_from <= {_B} AND (valid_to IS NULL OR valid_to >= {_A})"
_RUNS = """
WITH p AS (SELECT 'USER_' || user_id AS s, CAST(ts AS DATE) AS d, event_type AS o, max(value / 500.0) AS c FROM events GROUP BY ALL),
n AS (SELECT s, d, row_number() OVER (PARTITION BY s ORDER BY d) AS k, max(d) OVER (PARTITION BY s) AS head FROM (SELECT DISTINCT s, d FROM p)),
h AS (SELECT p.*, n.k, n.head, n.k - row_number() OVER (PARTITION BY p.s, p.o ORDER BY n.k) AS run FROM p JOIN n USING (s, d))"""

ORACLES = {
    "trade_match": f"{_TRADE} SELECT subject_id, predicate, object_id, {_D('valid_from')} AS valid_from, {_D('valid_to')} AS valid_to, {_D('last_confirmed')} AS last_confirmed, round(confidence, 6) AS confidence, subject_id AS s FROM tv WHERE object_id = 'SUPP_1' AND {_ACTIVE("DATE '1998-06-01'")}",
    "match_as_of": f"{_MATCH} AND subject_id = '{HUB}'",
    "match_reverse": f"{_MATCH} AND object_id = '{YARD}'",
    "match_predicate_only": f"{_MATCH} AND predicate = 'HAULS'",
    "match_all_wild": _MATCH,
    "match_known_by": f"{_MATCH} AND system_from <= TIMESTAMPTZ '{KNOWN} 00:00:00+00' AND (system_to IS NULL OR system_to > TIMESTAMPTZ '{KNOWN} 00:00:00+00')",
    "match_where": f"{_MATCH} AND confidence >= 0.8",
    "match_where_not": f"{_MATCH} AND subject_id = '{HUB}' AND confidence <> 0.5",
    "match_limit": f"{_V}, m AS (SELECT * FROM v WHERE {_ACTIVE(_DAYQ)} AND subject_id = '{HUB}' ORDER BY predicate, valid_from, version_id LIMIT 10) SELECT {_FACTS} FROM m",
    "match_bindings": f"{_V} SELECT version_id, predicate AS how, object_id AS what FROM v WHERE {_ACTIVE(_DAYQ)} AND subject_id = '{HUB}'",
    "history": f"{_V} SELECT {_FACTS} FROM v WHERE subject_id = '{HUB}'",
    "history_between": f"{_V} SELECT {_FACTS} FROM v WHERE predicate = 'FEEDS' AND valid_from <= {_B} AND (valid_to IS NULL OR valid_to >= {_A}) AND confidence < 0.9",
    "diff_edges": f"{_V}, {_CHANGES} SELECT {_FACTS}, change FROM c",
    "diff_nodes": f"{_V}, {_CHANGES}, k AS (SELECT object_id AS node, bool_or(change = 'opened') AS o, bool_or(change = 'closed') AS c, bool_or(change = 'persisted') AS p FROM c WHERE subject_id = '{HUB}' GROUP BY 1) SELECT node, CASE WHEN o THEN 'added' ELSE 'removed' END AS change FROM k WHERE NOT p AND o <> c",
    "range_days": f"{_V} SELECT object_id, {_DAYS} AND subject_id = '{HUB}' GROUP BY 1",
    "range_days_reverse": f"{_V} SELECT subject_id, {_DAYS} AND object_id = '{YARD}' GROUP BY 1",
    "range_days_all": f"{_V} SELECT object_id, {_DAYS} GROUP BY 1",
    "series_counts": f"{_V}, {_WEEKS} SELECT {_D('date')} AS date, count(version_id)::BIGINT AS facts FROM sp LEFT JOIN v ON {_ACTIVE('date')} GROUP BY 1",
    "series_facts": f"{_V}, {_MONTHS} SELECT {_FACTS}, {_D('date')} AS date FROM sp JOIN v ON {_ACTIVE('date')} WHERE subject_id = '{HUB}'",
    "degree_all": f"{_V}, {_TOUCH}, r AS (SELECT entity, relationship_id, arg_max(coalesce(confidence, 0), (valid_from, version_id)) AS c FROM t WHERE {_ACTIVE(_DAYQ)} GROUP BY 1, 2) SELECT entity, count(*)::DOUBLE AS degree, round(sum(c), 6) AS weighted_degree FROM r GROUP BY 1",
    "edge_weight_all": f"{_V}, r AS (SELECT subject_id, predicate, object_id, confidence AS weight, row_number() OVER (PARTITION BY subject_id, predicate, object_id ORDER BY valid_from, version_id) AS k FROM v WHERE {_ACTIVE(_DAYQ)}) SELECT subject_id, predicate, object_id, weight FROM r WHERE k = 1",
    "track_degree": f"{_V}, {_TOUCH}, {_MONTHS}, a AS (SELECT entity, date, count(DISTINCT relationship_id)::DOUBLE AS value FROM sp JOIN t ON {_ACTIVE('date')} GROUP BY 1, 2), n AS (SELECT DISTINCT entity FROM a) SELECT n.entity, {_D('sp.date')} AS date, coalesce(a.value, 0) AS value FROM n CROSS JOIN sp LEFT JOIN a ON a.entity = n.entity AND a.date = sp.date",
    "track_weighted_degree": f"{_V}, {_TOUCH}, {_MONTHS}, r AS (SELECT entity, date, relationship_id, arg_max(coalesce(confidence, 0), (valid_from, version_id)) AS c FROM sp JOIN t ON {_ACTIVE('date')} GROUP BY 1, 2, 3) SELECT entity, {_D('date')} AS date, round(sum(c), 6) AS value FROM r GROUP BY ALL",
    "track_edge_weight": f"{_V}, {_MONTHS}, r AS (SELECT subject_id, predicate, object_id, date, confidence AS value, row_number() OVER (PARTITION BY subject_id, predicate, object_id, date ORDER BY valid_from DESC, version_id DESC) AS k FROM sp JOIN v ON {_ACTIVE('date')} WHERE subject_id = '{HUB}') SELECT subject_id, predicate, object_id, {_D('date')} AS date, value FROM r WHERE k = 1",
    "signal_join": f"{_V}, {_WEEKS}, s AS (SELECT date, count(version_id)::DOUBLE AS value FROM sp LEFT JOIN v ON {_ACTIVE('date')} GROUP BY 1), o AS (SELECT event_time AS date, count(DISTINCT assertion_id)::DOUBLE AS other FROM assertions WHERE event_time IS NOT NULL GROUP BY 1) SELECT {_D('s.date')} AS date, value, other FROM s JOIN o ON o.date = s.date",
    "active_entities": f"{_V} SELECT subject_id AS entity FROM v WHERE {_ACTIVE(_DAYQ)} UNION SELECT object_id FROM v WHERE {_ACTIVE(_DAYQ)}",
    "neighbors": f"{_V}, {_E} SELECT src AS entity, dst AS neighbor FROM e",
    "out_neighbors": f"{_V} SELECT DISTINCT subject_id AS entity, object_id AS neighbor FROM v WHERE {_ACTIVE(_DAYQ)} AND subject_id <> object_id",
    "bfs_distances": f"{_V}, {_E}, {_hops(4, False, f'''WHERE src = '{HUB}' ''')} SELECT '{DAY}' AS date, s AS source, n AS node, d AS hops FROM dist",
    "closeness_all": f"{_V}, {_E}, {_hops(4, False)} SELECT s AS entity, round(sum(1.0::DOUBLE / d), 6) AS closeness FROM dist GROUP BY 1",
    "track_closeness": f"{_V}, {_MONTHS}, {_DE}, {_hops(3, True, f'''WHERE src IN ('{HUB}', '{FAR}') ''')} SELECT {_D('date')} AS date, s AS entity, round(sum(1.0::DOUBLE / d), 6) AS value FROM dist GROUP BY ALL",
    "path_hops": f"{_V}, {_MONTHS}, {_DE}, {_hops(4, True, f'''WHERE src = '{HUB}' ''')} SELECT {_D('date')} AS date, d AS hops FROM dist WHERE n = '{FAR}'",
    "path_history": f"{_V}, {_MONTHS}, {_DE}, {_hops(4, True, f'''WHERE src = '{HUB}' ''')} SELECT {_D('sp.date')} AS date, coalesce(d, -1) AS hops FROM sp LEFT JOIN (SELECT * FROM dist WHERE n = '{YARD}') x ON x.date = sp.date",
    "first_connected": f"{_V}, sp AS (SELECT DISTINCT valid_from AS date FROM v WHERE valid_from BETWEEN {_A} AND {_B}), {_DE}, {_hops(2, True, f'''WHERE src = '{HUB}' ''')} SELECT {_D('min(date)')} AS first_connected FROM dist WHERE n = '{FAR}'",
    "pagerank_fixed_iters": _pagerank(20),
    "betweenness_all": _between(4),
    "track_betweenness": _between(2, _HALVES),
    "track_betweenness_statement": _between(2, _HALVES, FAR),
    "track_pagerank": _pagerank(10, _HALVES),
    "pagerank_converged": _pagerank(60, digits=5),
    "path_edges": f"{_PATH} SELECT h.hop, {_FACTS} FROM h JOIN v USING (version_id)",
    "changepoints_planted": f"WITH {_QUARTERS}, s AS (SELECT entity_id, min(first_seen) AS f FROM entities WHERE first_seen IS NOT NULL GROUP BY 1) SELECT entity_id, {_D('min(date)')} AS date FROM s JOIN sp ON date >= f GROUP BY entity_id HAVING min(date) > (SELECT min(date) FROM sp)",
    "version_rows": f"""{_V.replace("SELECT DISTINCT ", "SELECT DISTINCT properties, assertion_ids, ")} SELECT {_FACTS}, {_D('last_confirmed')} AS last_confirmed, properties, epoch_us(system_from) AS system_from, epoch_us(system_to) AS system_to,
  coalesce(array_to_string(list_transform(assertion_ids, lambda x: coalesce(x::VARCHAR, '-')), ','), '') AS assertion_ids FROM v WHERE {_ACTIVE(_DAYQ)}""",
    "history_order": f"{_V} SELECT version_id, row_number() OVER (ORDER BY valid_from, predicate, version_id)::INTEGER AS position FROM v WHERE subject_id = '{HUB}'",
    "evidence_order": "SELECT assertion_id, row_number() OVER (ORDER BY t, assertion_id)::INTEGER AS position FROM (SELECT assertion_id, min(ingested_at) AS t FROM assertions WHERE version_id = 5702 GROUP BY 1)",
    "track_degree_statement": f"{_V}, {_TOUCH}, {_MONTHS} SELECT {_D('date')} AS date, count(DISTINCT relationship_id)::DOUBLE AS value FROM sp LEFT JOIN t ON entity = '{HUB}' AND {_ACTIVE('date')} GROUP BY 1",
    "track_weighted_statement": f"{_V}, {_TOUCH}, {_MONTHS}, r AS (SELECT date, relationship_id, arg_max(coalesce(confidence, 0), (valid_from, version_id)) AS c FROM sp LEFT JOIN t ON entity = '{HUB}' AND {_ACTIVE('date')} GROUP BY 1, 2) SELECT {_D('date')} AS date, round(coalesce(sum(c), 0), 6) AS value FROM r GROUP BY 1",
    "track_edge_statement": f"{_V}, {_MONTHS}, r AS (SELECT date, confidence AS value, row_number() OVER (PARTITION BY date ORDER BY valid_from DESC, version_id DESC) AS k FROM sp LEFT JOIN v ON subject_id = '{HUB}' AND predicate = 'HAULS' AND object_id = 'CMDY_0001042' AND {_ACTIVE('date')}) SELECT {_D('date')} AS date, round(value, 6) AS value FROM r WHERE k = 1",
    "track_closeness_statement": f"{_V}, {_MONTHS}, {_DE}, {_hops(2, True, f'''WHERE src = '{HUB}' ''')} SELECT {_D('sp.date')} AS date, round(coalesce(sum(1.0::DOUBLE / d), 0), 6) AS value FROM sp LEFT JOIN dist ON dist.date = sp.date GROUP BY 1",
    "path_statement": f"{_V}, {_E}, {_hops(5, False, f'''WHERE src = '{HUB}' ''')} SELECT d AS hops, d AS edges FROM dist WHERE n = '{FAR}'",
    "first_connected_statement": f"{_V}, sp AS (SELECT DISTINCT valid_from AS date FROM v WHERE valid_from BETWEEN {_A} AND {_B}), {_DE}, {_hops(2, True, f'''WHERE src = '{HUB}' ''')} SELECT {_D('min(date)')} AS first_connected FROM dist WHERE n = '{YARD}'",
    "path_history_statement": f"{_V}, {_MONTHS}, {_DE}, {_hops(3, True, f'''WHERE src = '{HUB}' ''')} SELECT {_D('sp.date')} AS date, coalesce(d, -1) AS hops FROM sp LEFT JOIN (SELECT * FROM dist WHERE n = '{FAR}') x ON x.date = sp.date",
    "why_changed_statement": f"""{_V}, {_CHANGES}, k AS (SELECT count(*) FILTER (change = 'opened') AS o, count(*) FILTER (change = 'closed') AS c, count(*) FILTER (change = 'persisted') AS p FROM c WHERE subject_id = '{HUB}' AND predicate = 'HAULS' AND object_id = 'CMDY_0001042')
SELECT DISTINCT subject_id, predicate, object_id, CASE WHEN o > 0 AND k.c > 0 THEN 'churned' WHEN o > 0 THEN 'opened' WHEN k.c > 0 THEN 'closed' WHEN p > 0 THEN 'persisted' ELSE 'no_relationship' END AS status, o AS opened, k.c AS closed, p AS persisted
  FROM v, k WHERE subject_id = '{HUB}' AND predicate = 'HAULS' AND object_id = 'CMDY_0001042'""",
    "match_above": f"{_MATCH} AND confidence > 0.9",
    "match_at_most": f"{_MATCH} AND confidence <= 0.3",
    "match_equal": f"{_MATCH} AND confidence = 1.2",
    "why_changed_status": f"""{_V}, {_CHANGES}, k AS (SELECT subject_id, predicate, object_id, count(*) FILTER (change = 'opened') AS opened, count(*) FILTER (change = 'closed') AS closed, count(*) FILTER (change = 'persisted') AS persisted FROM c GROUP BY 1, 2, 3),
n AS (SELECT DISTINCT subject_id, predicate, object_id FROM v)
SELECT subject_id, predicate, object_id, CASE WHEN opened > 0 AND closed > 0 THEN 'churned' WHEN opened > 0 THEN 'opened' WHEN closed > 0 THEN 'closed' WHEN persisted > 0 THEN 'persisted' ELSE 'no_relationship' END AS status,
  coalesce(opened, 0)::BIGINT AS opened, coalesce(closed, 0)::BIGINT AS closed, coalesce(persisted, 0)::BIGINT AS persisted FROM n LEFT JOIN k USING (subject_id, predicate, object_id)""",
    "why_changed_evidence": f"{_V}, a AS (SELECT DISTINCT assertion_id, version_id, source_id, event_time FROM assertions WHERE event_time BETWEEN {_A} AND {_B}), s AS (SELECT DISTINCT source_id, url FROM sources) SELECT assertion_id, a.version_id, subject_id, predicate, object_id, {_D('event_time')} AS event_time, a.source_id, url FROM a JOIN v ON v.version_id = a.version_id LEFT JOIN s ON s.source_id = a.source_id",
    "assertions_for_version": "SELECT DISTINCT assertion_id, source_id FROM assertions WHERE version_id = 42",
    "fold_assert_retract": f"{_TRADE} SELECT subject_id, predicate, object_id, {_D('valid_from')} AS valid_from, {_D('valid_to')} AS valid_to, {_D('last_confirmed')} AS last_confirmed, round(confidence_last, 6) AS confidence FROM tv",
    "fold_sync_snapshot": f"{_RUNS} SELECT s AS subject_id, 'DID' AS predicate, o AS object_id, {_D('min(d)')} AS valid_from, CASE WHEN max(d) < any_value(head) THEN {_D('max(d)')} END AS valid_to, {_D('max(d)')} AS last_confirmed, round(arg_max(c, d), 6) AS confidence FROM h GROUP BY s, o, run",
    "entities_seen": f"{_V}, x AS (SELECT subject_id AS entity_id, valid_from, last_confirmed FROM v UNION ALL SELECT object_id, valid_from, last_confirmed FROM v) SELECT entity_id, {_D('min(least(valid_from, last_confirmed))')} AS first_seen, {_D('max(greatest(valid_from, last_confirmed))')} AS last_seen FROM x GROUP BY 1",
    "entity_lookup": f"SELECT entity_id, type, {_D('first_seen')} AS first_seen, {_D('last_seen')} AS last_seen FROM entities WHERE entity_id = '{HUB}'",
    "sources_dedup": "SELECT url, source_id, title, domain FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY source_id, title NULLS FIRST, domain NULLS FIRST) AS k FROM sources) WHERE k = 1",
    "relationships_found": f"{_V} SELECT DISTINCT relationship_id, subject_id, predicate, object_id FROM v",
    "stats": " UNION ALL ".join(f"SELECT '{t}' AS name, count(DISTINCT {k})::BIGINT AS n FROM {t}" for t, k in (("relationships", "relationship_id"), ("versions", "version_id"), ("assertions", "assertion_id"), ("entities", "entity_id"), ("sources", "source_id"))),
    "dump_restore_roundtrip": f"{_V} SELECT subject_id, predicate, object_id, {_D('valid_from')} AS valid_from, {_D('valid_to')} AS valid_to, confidence, count(*)::BIGINT AS n FROM v GROUP BY ALL",
}
