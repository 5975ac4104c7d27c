"""A graph on disk: an append-only event log in Parquet, and the tables folded from it.

Layout below the root: ``_meta.json`` (schema version, state of compaction),
``events/`` (the log, one append per write batch), ``versions-N/`` (the log
folded up to event N, clustered by subject and predicate; N is 0 for what a
dump was restored to) and ``reverse-N/`` (the same, clustered by object).
Reading folds only the events after N, onto the triples that they touch.  One
writer at a time; readers see whole appends.
"""

from __future__ import annotations

import datetime as dt
import json
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.errors import SchemaVersionError, StorageError, ValidationError
from chronoweave.functions.times import parse_day
from chronoweave.model import BASE, EVENTS, FACTS, SCHEMA_VERSION, VERSIONS
from chronoweave.operators import graph, ingest, metrics, provenance, temporal
from chronoweave.operators.patterns import Pattern, identifier
from chronoweave.sources.scratch import discard, materialize, scratch_path

TRIPLE = ["subject_id", "predicate", "object_id"]
LINE = ["subject_id", "predicate"]
METRICS = {"degree": 1, "weighted_degree": 1, "edge_weight": 3, "closeness": 1, "betweenness": 1, "pagerank": 1}


def open_graph(spark: SparkSession, path: str, map_size: int | None = None) -> "TemporalGraph":
    """Open or create the graph at ``path``.  ``map_size`` is accepted and has no meaning here."""
    del map_size
    return TemporalGraph(spark, path)


class _Files:
    """The few file operations that Spark's readers and writers lack, on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def read_text(self, name: str) -> str:
        # Spark's readers skip names that start with an underscore.
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.root}/{name}"), True)
        out.write(bytearray(text.encode()))
        out.close()


class _OpenFacts:
    """What is open, by subject and predicate: object to (version_id, valid_from).

    Read once and kept up to date by the writer, so that a write needs no job.
    If more than ``most`` versions are open, subjects and predicates are read
    as they come up and the ones used longest ago are forgotten.
    """

    def __init__(self, opened: DataFrame | None, most: int):
        self._most, self._n = most, 0
        self._held: OrderedDict[tuple[str, str], dict[str, tuple[int, dt.date]]] = OrderedDict()
        self._opened = None if opened is None else opened.select(*TRIPLE, "version_id", "valid_from")
        first = [] if opened is None else self._opened.limit(most + 1).collect()
        self._whole = len(first) <= most
        for s, p, o, version, day in first if self._whole else ():
            self._held.setdefault((s, p), {})[o] = (version, day)

    def of(self, subject: str, predicate: str) -> dict[str, tuple[int, dt.date]]:
        key = (subject, predicate)
        if key in self._held:
            self._held.move_to_end(key)
        elif self._whole:
            self._held[key] = {}
        else:
            rows = self._opened.where((F.col("subject_id") == subject) & (F.col("predicate") == predicate)).collect()
            self._held[key] = {r["object_id"]: (r["version_id"], r["valid_from"]) for r in rows}
            self._n += len(rows)
            # What was written since is known here only, so what is forgotten must be read from the log: see ``stale``.
        return self._held[key]

    @property
    def stale(self) -> bool:
        return not self._whole and self._n > self._most


class TemporalGraph:
    """Facts with two time axes: reading operators, write verbs and storage operations."""

    def __init__(self, spark: SparkSession, path: str, open_rows: int = 200_000):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = _Files(spark, self.path)
        self._staged: list[tuple] | None = None
        self._open_rows = open_rows
        self._open: _OpenFacts | None = None
        self._check_schema()
        self._last_written, self._seq = self._last_seq()

    # --- storage ------------------------------------------------------------------------

    def _check_schema(self) -> None:
        self._compacted: int | None = None
        if not self._files.exists("_meta.json"):
            self._files.write_text("_meta.json", json.dumps({"schema_version": SCHEMA_VERSION}))
            return
        try:
            meta = json.loads(self._files.read_text("_meta.json"))
            found, self._compacted = meta.get("schema_version"), meta.get("compacted")
            self._taken, self._has_syncs = meta.get("taken", 0), meta.get("syncs", False)
        except (ValueError, AttributeError) as exc:
            raise StorageError(f"{self.path}/_meta.json cannot be read") from exc
        if found != SCHEMA_VERSION:
            raise SchemaVersionError(f"schema version {found} found, {SCHEMA_VERSION} expected")

    def _mark(self, at: int) -> None:
        self._compacted, self._taken = at, self._seq
        self._files.write_text("_meta.json", json.dumps({"schema_version": SCHEMA_VERSION, "compacted": at, "taken": self._taken, "syncs": self._has_syncs}))

    _has_syncs, _taken, _seq = False, 0, 0

    def _last_seq(self) -> tuple[int, int]:
        """(number of the last event, last number that is taken); of the log only what came after the compaction is read."""
        at = self._compacted or 0
        if not self._files.exists("events"):
            return at, max(at, self._taken)
        later = self.events().where(F.col("seq") > at)
        last, taken, syncs = later.agg(F.max("seq"), F.max(F.col("seq") + ingest.extra_seqs(F.col("objects"))), F.bool_or(F.col("op") == "sync")).first()
        self._has_syncs = self._has_syncs or bool(syncs)
        return last or at, max(taken or 0, at, self._taken)

    def events(self) -> DataFrame:
        """The log, without what an open batch has staged."""
        if not self._files.exists("events"):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/events")

    def _stored(self, at: int | None, by_object: bool = False) -> DataFrame | None:
        if at is None:
            return None
        name = f"reverse-{at}" if by_object and self._files.exists(f"reverse-{at}") else f"versions-{at}"
        return self.spark.read.schema(BASE).parquet(f"{self.path}/{name}")

    def _folded(self, by_object: bool = False) -> DataFrame:
        """All versions as ``model.BASE``: the stored table, and the events since folded onto it."""
        base = self._stored(self._compacted, by_object)
        if base is not None and self._compacted == self._last_written:
            return base
        if base is None:
            return ingest.fold(self.events(), syncs=self._has_syncs).select(*BASE.names)
        return ingest.fold_onto(base, self.events().where(F.col("seq") > self._compacted), self._has_syncs)

    @property
    def versions(self) -> DataFrame:
        """The fact table: what the log folds to, onto what a restore or a compaction stored."""
        return self._folded().select(*VERSIONS.names)

    def versions_for(self, pattern: Pattern) -> DataFrame:
        """The fact table for a pattern: an object without a subject is read from the table that is clustered by object."""
        return self._folded(by_object=pattern.reversed()).select(*VERSIONS.names)

    def compact(self) -> None:
        """Fold the log and keep the result, in two orders, so that a pattern by subject or by object reads few row groups.

        The new tables are written beside the old ones before the marker is
        switched to them, so a reader never sees half of one.  The log stays.
        """
        at = self._last_written
        folded = self._folded()
        if at == self._compacted:
            # Its own table is read here and cannot be overwritten.
            if not self._files.exists(f"reverse-{at}"):
                self._write(folded, f"reverse-{at}", "object_id", "predicate")
            return
        self._write(folded, f"versions-{at}", "subject_id", "predicate")
        self._write(self._stored(at), f"reverse-{at}", "object_id", "predicate")
        self._mark(at)

    def _write(self, frame: DataFrame, name: str, *order: str) -> None:
        clustered = frame.repartitionByRange(*order).sortWithinPartitions(*order, "valid_from", "version_id")
        clustered.write.mode("overwrite").parquet(f"{self.path}/{name}")

    @property
    def relationships(self) -> DataFrame:
        return ingest.relationships_of(self.versions)

    @property
    def sources(self) -> DataFrame:
        return ingest.sources_of(ingest.cited(self.events()))

    @property
    def assertions(self) -> DataFrame:
        return ingest.assertions_of(ingest.cited(self.events()), self._folded())

    @property
    def entities(self) -> DataFrame:
        seen = ingest.entities_of(ingest.touches(self.events()))
        if self._files.exists("versions-0"):
            loaded = ingest.entities_seen(self._stored(0))
            seen = seen.unionByName(loaded).groupBy("entity_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
        return seen

    def stats(self) -> dict[str, int]:
        """Row counts of the five tables, in one job."""
        return {r["name"]: r["n"] for r in self.counts().collect()}

    def counts(self) -> DataFrame:
        """(name, n): row counts of the five tables."""
        tables = ("relationships", "versions", "assertions", "entities", "sources")
        counts = [getattr(self, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in tables]
        return reduce(DataFrame.unionByName, counts)

    def dump(self, path: str) -> None:
        """Facts as JSON lines, sorted by start; NULLs are written."""
        dump_facts(self.versions, path)

    @classmethod
    def restore(cls, spark: SparkSession, dump_path: str, path: str) -> "TemporalGraph":
        """A new graph from a dump: intervals are loaded as they are, none is merged or lost.

        Later writes go on from what is open: an assert confirms, a retract
        closes.  If a triple is open in several intervals, that is the one that
        started last.  Ids are negative, and the system time is that of the
        restore.
        """
        graph_ = cls(spark, path)
        if graph_._compacted is not None or graph_._files.exists("events"):
            raise StorageError(f"{path} already holds a graph")
        now = F.lit(dt.datetime.now(dt.timezone.utc))
        triple = Window.partitionBy(*TRIPLE)
        newest = triple.orderBy(F.col("valid_to").isNull().desc(), F.col("valid_from").desc(), F.col("confidence").desc_nulls_last(), "version_id")
        # Numbers are given where a row is read, so they are unique without any shuffle.
        facts = spark.read.schema(FACTS).json(dump_path).withColumn("version_id", -1 - F.monotonically_increasing_id())
        loaded = facts.select(
            "version_id", F.min("version_id").over(triple).alias("relationship_id"), *TRIPLE, "valid_from", "valid_to",
            now.alias("system_from"), F.when(F.col("valid_to").isNotNull(), now).alias("system_to"),
            F.coalesce("valid_to", "valid_from").alias("last_confirmed"), "confidence", F.lit("{}").alias("properties"), F.array().cast("array<bigint>").alias("assertion_ids"),
            F.lit(0).cast("bigint").alias("opened"), (F.row_number().over(newest) == 1).alias("anchor"),
        )
        loaded.write.parquet(f"{path.rstrip('/')}/versions-0")
        graph_._mark(0)
        return graph_

    def backup(self, path: str) -> None:
        """An independent copy of the log and of the stored tables."""
        copy = _Files(self.spark, path)
        if copy.exists("_meta.json"):
            raise StorageError(f"{path} already holds a graph")
        stored = sorted({0, self._compacted or 0})
        parts = [("events", EVENTS, LINE)] + [(f"versions-{n}", BASE, LINE) for n in stored] + [(f"reverse-{n}", BASE, ["object_id", "predicate"]) for n in stored]
        for name, schema, order in parts:
            if self._files.exists(name):
                self.spark.read.schema(schema).parquet(f"{self.path}/{name}").repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path.rstrip('/')}/{name}")
        copy.write_text("_meta.json", self._files.read_text("_meta.json"))

    # --- writes -------------------------------------------------------------------------

    @contextmanager
    def write_batch(self) -> Iterator["TemporalGraph"]:
        """Stage writes and append them together; nothing is written if the block raises.

        Reads inside do not see what is staged; writes do.  Batches do not nest.
        """
        if self._staged is not None:
            raise StorageError("a write batch is already open")
        self._staged = []
        kept = self._seq
        try:
            yield self
            staged, self._staged = self._staged, None
            self._append(staged)
        except BaseException:
            self._staged, self._seq, self._open = None, kept, None
            raise

    def _append(self, rows: list[tuple]) -> None:
        if rows:
            # The verbs have checked the values; checking them against the schema again would take longer than writing them.
            self.spark.createDataFrame(rows, EVENTS, verifySchema=False).coalesce(1).write.mode("append").parquet(f"{self.path}/events")
            self._last_written = max(r[0] for r in rows)
            self._has_syncs = self._has_syncs or any(r[1] == "sync" for r in rows)
            if self._open is not None and self._open.stale:
                self._open = None

    def _record(self, row: tuple) -> None:
        if self._staged is not None:
            self._staged.append(row)
            return
        try:
            self._append([row])
        except BaseException:
            self._open = None
            raise

    def _held(self, subject: str, predicate: str) -> dict[str, tuple[int, dt.date]]:
        """Open versions of a subject and predicate by object, with what is staged."""
        if self._open is None:
            empty = self._compacted is None and not self._last_written
            self._open = _OpenFacts(None if empty else self._folded().where("anchor and valid_to is null"), self._open_rows)
        return self._open.of(subject, predicate)

    def _next(self, more: int = 0) -> int:
        self._seq += 1 + more
        return self._seq - more

    def assert_fact(self, subject: str, predicate: str, obj: str, valid_from: str | dt.date, confidence: float | None = None, sources: list | None = None) -> int:
        """Open a version or confirm the open one; returns its version_id."""
        s, p, o = identifier(subject, "subject"), identifier(predicate, "predicate"), identifier(obj, "object")
        day, given = parse_day(valid_from, "valid_from"), _sources(sources)
        held = self._held(s, p)
        seq = self._next()
        version, _ = held.setdefault(o, (seq << ingest.SEQ_SHIFT, day))
        self._record((seq, "assert", s, p, o, day, _number(confidence), None, given, None, dt.datetime.now(dt.timezone.utc)))
        return version

    def retract_fact(self, subject: str, predicate: str, obj: str, valid_to: str | dt.date) -> int | None:
        """Close the open version; returns its id, or None if none is open."""
        s, p, o = identifier(subject, "subject"), identifier(predicate, "predicate"), identifier(obj, "object")
        day = parse_day(valid_to, "valid_to")
        held = self._held(s, p)
        if o not in held:
            return None
        version, since = held[o]
        if day < since:
            raise ValidationError(f"valid_to {day} lies before valid_from {since}")
        del held[o]
        self._record((self._next(), "retract", s, p, o, day, None, None, None, None, dt.datetime.now(dt.timezone.utc)))
        return version

    def sync_snapshot(self, subject: str, predicate: str, objects: dict[str, float | None], as_of_date: str | dt.date, sources: dict[str, list] | None = None) -> dict[str, list[int]]:
        """State everything that holds for a subject and predicate; returns the ids opened, closed and confirmed."""
        s, p = identifier(subject, "subject"), identifier(predicate, "predicate")
        day = parse_day(as_of_date, "as_of_date")
        now_held = {identifier(o, "object"): _number(c) for o, c in objects.items()}
        given = {identifier(o, "object"): _sources(x) for o, x in (sources or {}).items()}
        held = self._held(s, p)
        seq = self._next(max(0, len(now_held) - 1) >> ingest.SEQ_SHIFT)
        base = seq << ingest.SEQ_SHIFT
        place = {o: base + k for k, o in enumerate(sorted(now_held, key=str.encode))}
        done = {
            "opened": [place[o] for o in now_held if o not in held],
            "closed": sorted(v for o, (v, _) in held.items() if o not in now_held),
            "confirmed": sorted(v for o, (v, _) in held.items() if o in now_held),
        }
        for o in [o for o in held if o not in now_held]:
            del held[o]
        for o in now_held:
            held.setdefault(o, (place[o], day))
        self._record((seq, "sync", s, p, None, day, None, now_held, None, given or None, dt.datetime.now(dt.timezone.utc)))
        return done

    def load_events(self, events: DataFrame) -> DataFrame:
        """Append a bulk log (``model.EVENTS`` without recorded_at is fine); returns rejected rows with the reason.

        ``seq`` orders the bulk and is moved behind the log's own.  Rejected,
        row by row, is what the write verbs would refuse: unusable names or
        days, and retracts before the start of what they would close, which
        stays open.
        """
        if self._staged is not None:
            raise StorageError("a write batch is open")
        if "recorded_at" not in events.columns:
            events = events.withColumn("recorded_at", F.current_timestamp())
        good, bad = ingest.split_events(events.select(*EVENTS.names))
        path = scratch_path(self.spark, "bulk")
        bulk = materialize(good, "bulk", path)
        least, room, syncs, retracts = bulk.agg(F.min("seq"), F.max(ingest.extra_seqs(F.col("objects"))), F.bool_or(F.col("op") == "sync"), F.bool_or(F.col("op") == "retract")).first()
        # Numbers are drawn apart if a sync needs more than one.
        moved = bulk.withColumn("seq", (F.col("seq") - F.lit(least or 0)) * F.lit(1 + (room or 0)) + F.lit(self._seq + 1))
        kept = moved
        if retracts:
            rejected = materialize(self._inverted(moved, self._has_syncs or bool(syncs)), "rejected")
            wrong = rejected.select(*TRIPLE, "seq")
            kept = moved.join(wrong, [*TRIPLE, "seq"], "left_anti")
            bad = bad.unionByName(moved.join(wrong, [*TRIPLE, "seq"], "left_semi").withColumn("reason", F.lit("before the start")).select(*bad.columns))
        kept.select(*EVENTS.names).write.mode("append").parquet(f"{self.path}/events")
        bad = materialize(bad, "refused")
        discard(self.spark, path)
        self._last_written, self._seq = self._last_seq()
        self._open = None
        return bad

    def _inverted(self, moved: DataFrame, syncs: bool) -> DataFrame:
        """Retracts of a bulk that lie before the start of what they would close, told from the log of their subjects."""
        lines = moved.where("op = 'retract'").select(*LINE).distinct()
        log = self.events() if self._compacted is None else self.events().where(F.col("seq") > self._compacted)
        base = self._stored(self._compacted)
        anchors = None if base is None else base.where("anchor").join(lines, LINE, "left_semi")
        found = ingest.inverted_retracts(log.unionByName(moved.select(*EVENTS.names)).join(lines, LINE, "left_semi").select(*EVENTS.names), anchors, syncs)
        return found.where(F.col("seq") > self._seq)

    def load_jsonl(self, path: str) -> DataFrame:
        """Replay a log of JSON lines (``ingest.read_events``) in one append; returns rejected rows with the reason."""
        return self.load_events(ingest.read_events(self.spark, path))

    def get_entity(self, entity_id: str) -> dict | None:
        row = self.entities.where(F.col("entity_id") == identifier(entity_id, "entity_id")).first()
        return None if row is None else row.asDict()

    # --- reads --------------------------------------------------------------------------

    def as_of(self, pattern: Pattern, day: temporal.Day) -> DataFrame:
        return temporal.as_of(self.versions_for(pattern), pattern, day)

    def as_known(self, pattern: Pattern, day: temporal.Day, cutoff: str | dt.datetime) -> DataFrame:
        return temporal.as_known(self.versions_for(pattern), pattern, day, cutoff)

    def history(self, pattern: Pattern, start: temporal.Day | None = None, end: temporal.Day | None = None) -> DataFrame:
        return temporal.history(self.versions_for(pattern), pattern, start, end).orderBy(*temporal.history_order(pattern))

    def diff(self, start: temporal.Day, end: temporal.Day, pattern: Pattern | None = None) -> temporal.GraphDelta:
        return temporal.diff(self.versions, start, end, pattern)

    def day_counts(self, pattern: Pattern, start: temporal.Day, end: temporal.Day) -> DataFrame:
        return temporal.day_counts(self.versions_for(pattern), pattern, start, end)

    def series(self, pattern: Pattern, start: temporal.Day, end: temporal.Day, resolution_days: int = 1) -> temporal.GraphSeries:
        return temporal.GraphSeries(self.versions, pattern, temporal.Spine.of(start, end, resolution_days))

    def degree(self, entity: str, day: temporal.Day, weighted: bool = False) -> float:
        return metrics.degree(self.versions, entity, day, weighted)

    def edge_weight(self, subject: str, predicate: str, obj: str, day: temporal.Day) -> float | None:
        row = metrics.edge_weights(self.versions, day, Pattern(subject, predicate, obj)).first()
        return None if row is None else row["weight"]

    def track(self, metric: str, target: str | tuple, start: temporal.Day, end: temporal.Day, resolution_days: int = 1, max_depth: int = 4) -> metrics.GraphSignal:
        return track(self.versions, metric, target, start, end, resolution_days, max_depth)

    def changepoints(self, metric: str, target: str | tuple, start: temporal.Day, end: temporal.Day, resolution_days: int = 1, max_depth: int = 4, min_size: int = 2, penalty: float | None = None) -> list[dt.date]:
        return self.track(metric, target, start, end, resolution_days, max_depth).changepoints(min_size, penalty)

    def path_exists(self, a: str, b: str, day: temporal.Day, max_depth: int = 4) -> list[dict] | None:
        row = graph.shortest_paths(self.versions, a, b, day, max_depth).first()
        return None if row is None else [r.asDict() for r in row["path"]]

    def first_connected(self, a: str, b: str, start: temporal.Day | None = None, end: temporal.Day | None = None, max_depth: int = 4) -> dt.date | None:
        return graph.first_connected(self.versions, a, b, start, end, max_depth).first()[0]

    def path_history(self, a: str, b: str, start: temporal.Day, end: temporal.Day, resolution_days: int = 1, max_depth: int = 4) -> DataFrame:
        return graph.path_history(self.versions, a, b, temporal.Spine.of(start, end, resolution_days), max_depth)

    def closeness(self, entity: str, day: temporal.Day, max_depth: int = 4) -> float:
        row = graph.closeness(self.versions, day, [entity], max_depth).first()
        return 0.0 if row is None else row["closeness"]

    def betweenness_all(self, day: temporal.Day, max_depth: int = 4) -> DataFrame:
        return graph.betweenness(self.versions, day, max_depth).drop("date")

    def betweenness(self, entity: str, day: temporal.Day, max_depth: int = 4) -> float:
        row = graph.betweenness(self.versions, day, max_depth, [entity]).first()
        return 0.0 if row is None else row["betweenness"]

    def pagerank_all(self, day: temporal.Day, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
        return graph.pagerank(self.versions, day, damping, max_iterations, tolerance).drop("date")

    def pagerank(self, entity: str, day: temporal.Day, damping: float = 0.85, max_iterations: int = 100) -> float:
        row = self.pagerank_all(day, damping, max_iterations).where(F.col("entity") == entity).first()
        return 0.0 if row is None else row["pagerank"]

    def assertions_for_version(self, version_id: int) -> DataFrame:
        return provenance.evidence_of(self.assertions, version_id)

    def why_changed(self, pattern: Pattern, start: temporal.Day, end: temporal.Day) -> dict:
        return provenance.why_changed(self.versions, self.assertions, self.sources, pattern, start, end)

    def query(self, statement: str) -> DataFrame:
        """The lazy result of a reading statement."""
        from chronoweave.plans.compiler import compile_statement
        from chronoweave.plans.language import parse

        parsed = parse(statement)
        return compile_statement(parsed, self.versions if parsed.pattern is None else self.versions_for(parsed.pattern))

    def execute(self, statement: str):
        """Run one statement of the query language and return lists and dicts; ``query`` gives the lazy result."""
        from chronoweave.plans.compiler import execute

        return execute(self, statement)


def track(versions: DataFrame, metric: str, target: str | tuple, start: temporal.Day, end: temporal.Day, resolution_days: int = 1, max_depth: int = 4) -> metrics.GraphSignal:
    """A metric of one target on every date of a spine; an unknown metric or a wrong target raises."""
    if metric not in METRICS:
        raise ValidationError(f"unknown metric {metric!r}; known are {', '.join(METRICS)}")
    target = (target,) if isinstance(target, str) else tuple(target)
    if len(target) != METRICS[metric]:
        raise ValidationError(f"{metric} takes {METRICS[metric]} name(s), not {len(target)}")
    spine = temporal.Spine.of(start, end, resolution_days)
    if metric == "degree":
        return metrics.GraphSignal(metrics.densify(metrics.track_degree(versions, spine, [target[0]]), spine, 0.0))
    if metric == "weighted_degree":
        return metrics.GraphSignal(metrics.densify(metrics.track_weighted_degree(versions, spine, [target[0]]), spine, 0.0))
    if metric == "edge_weight":
        return metrics.GraphSignal(metrics.densify(metrics.track_edge_weight(versions, spine, Pattern(*target)), spine, None))
    if metric == "closeness":
        found = graph.closeness(versions, spine, [target[0]], max_depth)
    elif metric == "betweenness":
        found = graph.betweenness(versions, spine, max_depth, [target[0]])
    else:
        found = graph.pagerank(versions, spine).where(F.col("entity") == target[0])
    return metrics.GraphSignal(metrics.densify(found.withColumnRenamed(metric, "value"), spine, 0.0))


def dump_facts(versions: DataFrame, path: str) -> None:
    """Facts as JSON lines, sorted by start; NULLs are written."""
    facts = versions.orderBy("valid_from", "version_id").select(*FACTS.names)
    facts.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def _number(value: float | None) -> float | None:
    if value is None or value != value:
        return None
    return float(value)


def _sources(given: list | None) -> list[dict] | None:
    if given is None:
        return None
    found = []
    for source in given:
        record = {"url": source} if isinstance(source, str) else dict(source)
        if not isinstance(record.get("url"), str) or not record["url"]:
            raise ValidationError("a source needs a url")
        found.append({k: record.get(k) for k in ("url", "title", "domain", "published_at")})
    return found
