"""Statements to plans, and plans to plain Python values at the edge.

``compile_statement`` gives a lazy DataFrame for every reading statement, so
Catalyst plans the whole of it: filters reach the scan, LIMIT becomes a top-k.
``execute`` runs a statement against a stored graph.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.errors import QueryError
from chronoweave.operators import changepoint, graph, metrics, provenance, temporal
from chronoweave.operators.patterns import Pattern
from chronoweave.plans.language import Statement, parse
from chronoweave.sources.store import TemporalGraph, track


def compile_statement(statement: Statement | str, versions: DataFrame) -> DataFrame:
    """The lazy result of a reading statement over a ``versions`` table.

    MATCH, HISTORY, SERIES: version rows with ``bindings``.  DIFF: rows tagged
    with ``change``.  RANGE: day counts.  TRACK: (date, value).  CHANGEPOINTS:
    (date).  PATH and PATH_HISTORY: (date, hops, path).  FIRST_CONNECTED: one
    row.  WHY_CHANGED: status and counts.
    """
    s = parse(statement) if isinstance(statement, str) else statement
    builder = _BUILDERS.get(s.kind)
    if builder is None:
        raise QueryError(f"{s.kind} writes and has no plan")
    return builder(s, versions)


def _rows(s: Statement, found: DataFrame, order: list[str]) -> DataFrame:
    if s.where is not None:
        found = temporal.where_confidence(found, *s.where)
    found = found.withColumn("bindings", s.pattern.bindings())
    return found.orderBy(*order) if s.limit is None else temporal.first_rows(found, order, s.limit)


def _match(s: Statement, v: DataFrame) -> DataFrame:
    found = temporal.as_of(v, s.pattern, s.day) if s.known_by is None else temporal.as_known(v, s.pattern, s.day, s.known_by)
    return _rows(s, found, s.pattern.order())


def _history(s: Statement, v: DataFrame) -> DataFrame:
    return _rows(s, temporal.history(v, s.pattern, s.start, s.end), temporal.history_order(s.pattern))


def _diff(s: Statement, v: DataFrame) -> DataFrame:
    tagged = temporal.changes(v, s.start, s.end, s.pattern)
    return tagged if s.pattern is None else tagged.withColumn("bindings", s.pattern.bindings())


def _series(s: Statement, v: DataFrame) -> DataFrame:
    return temporal.series_rows(v, s.pattern, temporal.Spine.of(s.start, s.end, s.step)).withColumn("bindings", s.pattern.bindings())


def _track(s: Statement, v: DataFrame) -> DataFrame:
    return track(v, s.metric, s.target, s.start, s.end, s.step, s.max_depth).frame


def _changepoints(s: Statement, v: DataFrame) -> DataFrame:
    signal = _track(s, v).select(F.lit(s.metric).alias("metric"), "date", "value")
    return changepoint.changepoints(signal, ["metric"]).select("date")


def _path_history(s: Statement, v: DataFrame) -> DataFrame:
    return graph.path_history(v, s.a, s.b, temporal.Spine.of(s.start, s.end, s.step), s.max_depth)


def _why(s: Statement, v: DataFrame) -> DataFrame:
    s.pattern.require_literals("WHY_CHANGED")
    return provenance.change_status(v, s.start, s.end, s.pattern)


_BUILDERS = {
    "MATCH": _match,
    "HISTORY": _history,
    "DIFF": _diff,
    "RANGE": lambda s, v: temporal.day_counts(v, s.pattern, s.start, s.end),
    "SERIES": _series,
    "TRACK": _track,
    "CHANGEPOINTS": _changepoints,
    "PATH": lambda s, v: graph.shortest_paths(v, s.a, s.b, s.day, s.max_depth),
    "FIRST_CONNECTED": lambda s, v: graph.first_connected(v, s.a, s.b, s.start, s.end, s.max_depth),
    "PATH_HISTORY": _path_history,
    "WHY_CHANGED": _why,
}


def execute(db: TemporalGraph, text: str) -> Any:
    """Run one statement and return lists and dicts."""
    s = parse(text)
    if s.kind == "ASSERT":
        return {"version_id": db.assert_fact(*s.pattern.require_literals("ASSERT"), s.valid_from, confidence=s.confidence)}
    if s.kind == "RETRACT":
        return {"version_id": db.retract_fact(*s.pattern.require_literals("RETRACT"), s.valid_to)}
    if s.kind == "WHY_CHANGED":
        return db.why_changed(s.pattern, s.start, s.end)
    if s.kind == "DIFF":
        out = {"from": s.start, "to": s.end, **temporal.diff(db.versions, s.start, s.end, s.pattern).as_dict()}
        if s.pattern is not None:
            for name in ("edges_opened", "edges_closed", "edges_persisted"):
                out[name] = [_bound(r, s.pattern) for r in out[name]]
        return out
    if s.kind == "SERIES":
        series = db.series(s.pattern, s.start, s.end, s.step)
        return [{"date": d, "facts": [_bound(r, s.pattern) for r in rows]} for d, rows in series]
    if s.kind == "CHANGEPOINTS":
        return {"changepoints": db.changepoints(s.metric, s.target, s.start, s.end, s.step, s.max_depth)}
    if s.kind == "PATH":
        path = db.path_exists(s.a, s.b, s.day, s.max_depth)
        return {"connected": path is not None, "path": path}
    if s.kind == "FIRST_CONNECTED":
        return {"first_connected": db.first_connected(s.a, s.b, s.start, s.end, s.max_depth)}
    frame = compile_statement(s, db.versions if s.pattern is None else db.versions_for(s.pattern))
    if s.kind in ("TRACK", "PATH_HISTORY"):
        frame = frame.orderBy("date")
    rows = [r.asDict(recursive=True) for r in frame.collect()]
    if s.kind == "PATH_HISTORY":
        return [{"date": r["date"], "path": r["path"]} for r in rows]
    return rows


def _bound(row: dict, pattern: Pattern) -> dict:
    from chronoweave.operators.patterns import PARTS, Var

    return {**row, "bindings": {part.name: row[c] for part, c in zip(pattern.parts, PARTS) if isinstance(part, Var)}}


def signal_of(frame: DataFrame) -> metrics.GraphSignal:
    """A TRACK result as a signal that can be joined and segmented."""
    return metrics.GraphSignal(frame)
