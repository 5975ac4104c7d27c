"""From a relationship back to its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions.times import day_literal
from chronoweave.operators.patterns import Pattern
from chronoweave.operators.temporal import Day, changes


def unique_assertions(assertions: DataFrame) -> DataFrame:
    """Copies of an assertion brought to one row: the one ingested first.

    Every other column is equal among copies, so its minimum is its value.
    """
    rest = [c for c in assertions.columns if c not in ("assertion_id", "ingested_at")]
    return assertions.groupBy("assertion_id", *rest).agg(F.min("ingested_at").alias("ingested_at"))


def evidence_of(assertions: DataFrame, version_id: int) -> DataFrame:
    """The assertions behind one version, sorted by ingestion."""
    return assertions.where(F.col("version_id") == version_id).orderBy("ingested_at", "assertion_id")


def evidence(versions: DataFrame, assertions: DataFrame, sources: DataFrame, start: Day, end: Day) -> DataFrame:
    """Assertions that happened in [start, end] for the given versions, with their source if it is known.

    ``versions`` may be one triple or the whole table.  Sources without a row stay NULL.
    """
    window = F.col("event_time").between(day_literal(start, "start"), day_literal(end, "end"))
    known = sources.select("source_id", "url", "title", "domain").distinct()
    return (
        assertions.where(window)
        .join(versions.select("version_id", "subject_id", "predicate", "object_id"), "version_id")
        .join(known, "source_id", "left")
    )


def change_status(versions: DataFrame, start: Day, end: Day, pattern: Pattern | None = None) -> DataFrame:
    """(subject_id, predicate, object_id, status, opened, closed, persisted) of every triple.

    ``churned`` if something opened and something closed inside the window, else
    ``opened``, ``closed``, ``persisted``, else ``no_relationship``.
    """
    triple = ["subject_id", "predicate", "object_id"]
    tagged = changes(versions, start, end, pattern)
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    per = tagged.groupBy(*triple).agg(count("opened"), count("closed"), count("persisted"))
    everyone = (pattern or Pattern()).filter(versions).select(*triple).distinct()
    n = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("opened", "closed", "persisted")}
    status = (
        F.when((n["opened"] > 0) & (n["closed"] > 0), "churned").when(n["opened"] > 0, "opened").when(n["closed"] > 0, "closed")
        .when(n["persisted"] > 0, "persisted").otherwise("no_relationship")
    )
    return everyone.join(per, triple, "left").select(*triple, status.alias("status"), *(x.alias(c) for c, x in n.items()))


def why_changed(versions: DataFrame, assertions: DataFrame, sources: DataFrame, pattern: Pattern, start: Day, end: Day) -> dict:
    """Status, versions by change and evidence of one triple, as a dict for the edge of the program."""
    s, p, o = pattern.require_literals("WHY_CHANGED")
    own = pattern.filter(versions)
    tagged = [r.asDict() for r in changes(own, start, end).orderBy("valid_from", "version_id").collect()]
    parts = {c: [{k: v for k, v in r.items() if k != "change"} for r in tagged if r["change"] == c] for c in ("opened", "closed", "persisted")}
    status = "churned" if parts["opened"] and parts["closed"] else next((c for c in ("opened", "closed", "persisted") if parts[c]), "no_relationship")
    found = evidence(own, assertions, sources, start, end).orderBy("ingested_at", "assertion_id")
    proof = []
    for r in found.collect():
        row = r.asDict()
        source = {k: row.pop(k) for k in ("url", "title", "domain")}
        row["source"] = {"source_id": row["source_id"], **source} if source["url"] is not None else None
        proof.append(row)
    return {"subject_id": s, "predicate": p, "object_id": o, "status": status, **parts, "assertions": proof}
