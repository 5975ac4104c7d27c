"""The write log folded into versions, relationships, assertions, sources and entities.

Parquet rows are not updated in place, so nothing is: writes are appended as
events and the tables are a deterministic function of the log.

* An *assert* opens a version or confirms the open one.
* A *retract* closes the open one on its day.
* A *sync* states all objects of a subject and predicate: it opens and confirms
  those it lists and closes the others at their last confirmation.

A fold may start from a stored table of versions (``model.BASE``): a dump that
was restored, or the log folded so far.  One version per triple, the *anchor*,
is what later events go on from, and only triples that the new events touch
are folded at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.model import BASE, EVENTS
from chronoweave.sources.scratch import materialize

TRIPLE = ["subject_id", "predicate", "object_id"]
LINE = ["subject_id", "predicate"]
#: A version opened by an event has the id ``seq << SEQ_SHIFT | place in the event``.  A sync
#: with more objects than that leaves room for takes several numbers (``extra_seqs``), so ids
#: stay unique and grow with the log.
SEQ_SHIFT = 20


def extra_seqs(objects: Column) -> Column:
    """How many numbers after its own a sync needs for the ids of its objects."""
    return F.floor((F.greatest(F.coalesce(F.size(objects), F.lit(1)), F.lit(1)) - 1) / (1 << SEQ_SHIFT)).cast("bigint")


def split_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): events with a usable subject, predicate, object and day, and the rest with a reason."""
    bad_text = lambda c: F.col(c).isNull() | (F.length(c) == 0) | F.contains(F.col(c), F.lit("\0"))
    reason = (
        F.when(~F.coalesce(F.col("op").isin("assert", "retract", "sync"), F.lit(False)), "unknown op")
        .when(F.col("seq").isNull(), "no seq")
        .when(bad_text("subject_id"), "bad subject")
        .when(bad_text("predicate"), "bad predicate")
        .when((F.col("op") != "sync") & bad_text("object_id"), "bad object")
        .when(F.col("day").isNull(), "no day")
        .when((F.col("op") == "sync") & F.exists(F.map_keys("objects"), lambda k: (F.length(k) == 0) | F.contains(k, F.lit("\0"))), "bad object in sync")
    )
    marked = events.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def assertion_id(seq: Column, obj: Column, place: Column) -> Column:
    return F.xxhash64(seq, obj, place)


def touches(events: DataFrame) -> DataFrame:
    """(triple, seq, ord, day, confidence, recorded_at, cites): every object asserted or listed, with the ids of its assertions."""
    confidence = lambda c: F.nanvl(c, F.lit(None).cast("double"))

    def cites(given: Column) -> Column:
        ids = F.transform(given, lambda x, k: F.when(x["url"].isNotNull(), assertion_id(F.col("seq"), F.col("object_id"), k)))
        return F.coalesce(F.array_compact(ids), F.array().cast("array<bigint>")).alias("cites")

    asserted = events.where("op = 'assert'").select(*TRIPLE, "seq", F.lit(0).alias("ord"), "day", confidence(F.col("confidence")).alias("confidence"), "recorded_at", cites(F.col("sources")))
    listed = (
        events.where("op = 'sync'")
        .select(*LINE, "seq", "day", "recorded_at", "object_sources", F.posexplode(F.array_sort(F.map_entries("objects"))).alias("ord", "entry"))
        .withColumn("object_id", F.col("entry.key"))
        .select(*TRIPLE, "seq", "ord", "day", confidence(F.col("entry.value")).alias("confidence"), "recorded_at", cites(F.try_element_at("object_sources", F.col("object_id"))))
    )
    return asserted.unionByName(listed)


def _next_syncs(events: DataFrame, touched: DataFrame, salts: int = 8) -> DataFrame:
    """(triple, seq, recorded_at): per touch the next sync of its subject and predicate.

    One candidate per touch, so this never grows to objects times snapshots; a
    sync that lists the object comes out as well, and the fold sees that its own
    touch has the same seq.  The marks of syncs are copied to ``salts`` of the
    object, so that a subject with many objects is more than one group.
    """
    salt = F.pmod(F.xxhash64("object_id"), F.lit(salts)).cast("int").alias("salt")
    marks = events.where("op = 'sync'").select(*LINE, "seq", "recorded_at", F.lit(None).cast("string").alias("object_id"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    later = Window.partitionBy(*LINE, "salt").orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    both = touched.select(*LINE, "seq", "recorded_at", "object_id", salt).unionByName(marks)
    following = both.withColumn("next", F.min(F.when(F.col("object_id").isNull(), F.struct("seq", "recorded_at"))).over(later))
    return following.where("object_id is not null and next is not null").select(*TRIPLE, "next.seq", "next.recorded_at")


HELD = "struct<version_id:bigint,relationship_id:bigint,opened:bigint,properties:string>"


def _islands(events: DataFrame, base: DataFrame | None, syncs: bool) -> DataFrame:
    """(triple, island, touched, first, last_confirmed, confidence, cites, end, rel): what lies between two closings.

    ``base``: the anchors that the events go on from; open ones come first, as
    touches, closed ones only name their relationship.
    """
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    touched = touches(events).withColumns({"confirmed": F.col("day"), "held": F.lit(None).cast(HELD)})
    known = None
    if base is not None:
        held = F.struct("version_id", "relationship_id", "opened", "properties").alias("held")
        open_ = base.where("valid_to is null").select(
            *TRIPLE, F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("ord"), F.col("valid_from").alias("day"), "confidence", F.col("system_from").alias("recorded_at"),
            F.coalesce("assertion_ids", F.array().cast("array<bigint>")).alias("cites"), F.coalesce("last_confirmed", "valid_from").alias("confirmed"), held,
        )
        touched = touched.unionByName(open_)
        known = base.where("valid_to is not null").select(*TRIPLE, F.lit(0).cast("bigint").alias("seq"), held)
    more = [none("int", "ord"), none("date", "confirmed"), none("double", "confidence"), none("array<bigint>", "cites"), none(HELD, "held")]
    retracts = events.where("op = 'retract'").select(*TRIPLE, "seq", "recorded_at", "day", *more, F.lit("retract").alias("what"))
    rows = touched.withColumn("what", F.lit("touch")).unionByName(retracts)
    if syncs:
        rows = rows.unionByName(_next_syncs(events, touched).select(*TRIPLE, "seq", "recorded_at", none("date", "day"), *more, F.lit("missing").alias("what")))
    if known is not None:
        rows = rows.unionByName(known.select(*TRIPLE, "seq", none("timestamp", "recorded_at"), none("date", "day"), *more[:-1], "held", F.lit("known").alias("what")))
    touch = F.col("what") == "touch"
    line = Window.partitionBy(*TRIPLE).orderBy("seq", F.col("what") != "touch")
    # A sync closes what it does not list; one that lists the object has a touch of the same seq right before.
    closing = F.col("what") == "retract"
    if syncs:
        listed = F.max(F.when(touch, F.col("seq"))).over(line.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("listed", listed)
        closing = closing | ((F.col("what") == "missing") & ~F.coalesce(F.col("listed") == F.col("seq"), F.lit(False)))
    first = F.min_by(F.struct("day", "recorded_at", "seq", "ord", "held"), F.when(touch, F.col("seq")))
    end = F.max(F.when(F.col("closing"), F.struct("seq", "what", "day", "recorded_at")))
    cites = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(touch, F.struct("seq", "cites")))), lambda x: x["cites"]))
    return (
        rows.withColumn("closing", closing)
        .withColumn("island", F.coalesce(F.sum(F.col("closing").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .groupBy(*TRIPLE, "island")
        .agg(
            F.max(touch).alias("touched"), first.alias("first"), F.max(F.when(touch, F.col("confirmed"))).alias("last_confirmed"),
            F.max_by("confidence", F.when(touch & F.col("confidence").isNotNull(), F.col("seq"))).alias("confidence"),
            cites.alias("cites"), end.alias("end"), F.max("held.relationship_id").alias("rel"),
        )
    )


def fold(events: DataFrame, base: DataFrame | None = None, syncs: bool = True) -> DataFrame:
    """Versions (``model.BASE``) of a log without inverted retracts (``inverted_retracts``).

    ``base`` holds the anchors of triples; ``syncs`` may be False for a log that
    is known to have none, which saves their part of the plan.
    """
    triple = Window.partitionBy(*TRIPLE)
    islands = _islands(events, base, syncs)
    version = F.coalesce("first.held.version_id", F.shiftleft(F.col("first.seq"), SEQ_SHIFT) + F.col("first.ord"))
    valid_to = F.when(F.col("end.what") == "retract", F.col("end.day")).when(F.col("end.what") == "missing", F.col("last_confirmed"))
    own = F.when(F.col("touched"), version)
    return (
        islands.withColumns({"version_id": own, "relationship_id": F.coalesce(F.max("rel").over(triple), F.min(own).over(triple)), "newest": F.max(F.when(F.col("touched"), F.col("island"))).over(triple)})
        .where("touched")
        .select(
            "version_id", "relationship_id", *TRIPLE, F.col("first.day").alias("valid_from"), valid_to.alias("valid_to"), F.col("first.recorded_at").alias("system_from"),
            F.col("end.recorded_at").alias("system_to"), "last_confirmed", "confidence", F.coalesce("first.held.properties", F.lit("{}")).alias("properties"),
            F.col("cites").alias("assertion_ids"), F.coalesce("first.held.opened", "first.seq").alias("opened"), (F.col("island") == F.col("newest")).alias("anchor"),
        )
    )


def fold_onto(base: DataFrame, events: DataFrame, syncs: bool = True) -> DataFrame:
    """``base`` (``model.BASE``) brought up to date by later events; triples that they do not touch pass unchanged."""
    lines = events.select(*LINE).distinct()
    names = BASE.names
    # What an event may go on from leaves the table and comes back out of the fold; all else passes in one scan.
    goes_on = F.coalesce("touched", F.lit(False)) & F.col("anchor") & F.col("valid_to").isNull()
    passing = base.join(lines.withColumn("touched", F.lit(True)), LINE, "left").where(~goes_on)
    folded = fold(events, base.where("anchor").join(lines, LINE, "left_semi"), syncs)
    return passing.select(*names).unionByName(folded.select(*names))


def folded_versions(events: DataFrame, syncs: bool = True) -> DataFrame:
    """The versions of any log; retracts before the start of what they would close are left out and change nothing."""
    bad = inverted_retracts(events, syncs=syncs)
    return fold(events.join(bad.select(*TRIPLE, "seq"), [*TRIPLE, "seq"], "left_anti"), syncs=syncs)


def inverted_retracts(events: DataFrame, base: DataFrame | None = None, syncs: bool = True) -> DataFrame:
    """(triple, seq, day, valid_from) of the retracts that lie before the start of what is open then.

    Whether one is inverted depends on which closings before it took effect, so
    it can only be told in order.  Islands are made as if every retract closed;
    triples none of whose islands ends before its start - all, in a clean log -
    are right as they are.  The islands of the others are sorted and a task goes
    through those of its partition, one after the other, remembering one start.
    """
    islands = _islands(events, base, syncs).select(*TRIPLE, "island", F.col("first.day").alias("start"), F.col("end.what").alias("what"), F.col("end.seq").alias("seq"), F.col("end.day").alias("day"))
    suspect = F.max((F.col("what") == "retract") & (F.col("day") < F.col("start"))).over(Window.partitionBy(*TRIPLE))
    doubtful = islands.withColumn("suspect", suspect).where("suspect").drop("suspect").repartition(*TRIPLE).sortWithinPartitions(*TRIPLE, "island")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start = None, None
        for part in parts:
            found = []
            for s, p, o, begins, what, seq, day in zip(*(part[c] for c in (*TRIPLE, "start", "what", "seq", "day"))):
                if (s, p, o) != key:
                    key, start = (s, p, o), None
                if start is None and begins is not None:
                    start = begins
                if what == "missing":
                    start = None
                elif what == "retract" and start is not None:
                    if day < start:
                        found.append((s, p, o, int(seq), day, start))
                    else:
                        start = None
            yield pd.DataFrame(found, columns=[*TRIPLE, "seq", "day", "valid_from"])

    return doubtful.mapInPandas(run, "subject_id string, predicate string, object_id string, seq bigint, day date, valid_from date")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, number): the lines of text files, numbered from 1 in the order of files and lines."""
    lines = materialize(
        spark.read.text(path).select(
            "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")
        ),
        "lines",
    )
    # The rows of a block are numbered without gaps; blocks, as many as the files have splits, are added up in order.
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(offsets, ["file", "block"]).select("value", (F.col("offset") + F.col("id") - F.col("first") + 1).alias("number"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines as ``model.EVENTS``: op, s, p, o, d, c, objects, sources; numbered in the order of files and lines.

    Sources are given as objects or bare urls, in a list for an assert and in a
    list per object for a sync.  Lines that are no such event come out with
    NULLs, for ``split_events`` to find.
    """
    record = EVENTS["sources"].dataType.elementType
    fields = "op string, s string, p string, o string, d string, c double, objects map<string,double>, sources string"
    given = lambda text: F.transform(
        F.from_json(text, "array<string>"), lambda x: F.when(x.startswith("{"), F.from_json(x, record)).otherwise(F.struct(x.alias("url"), *(F.lit(None).cast("string").alias(n) for n in record.names[1:])))
    )
    per_object = F.transform_values(F.from_json("e.sources", "map<string,string>"), lambda _, v: given(v))
    columns = {
        "seq": F.col("number"), "op": F.col("e.op"), "subject_id": F.col("e.s"), "predicate": F.col("e.p"), "object_id": F.col("e.o"),
        "day": F.try_to_date(F.col("e.d"), "yyyy-MM-dd"), "confidence": F.col("e.c"), "objects": F.col("e.objects"), "sources": F.when(F.col("e.op") == "assert", given(F.col("e.sources"))),
        "object_sources": F.when(F.col("e.op") == "sync", per_object), "recorded_at": F.current_timestamp(),
    }
    parsed = numbered_lines(spark, path).where("trim(value) != ''").withColumn("e", F.from_json("value", fields))
    return parsed.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in EVENTS.fields))


def cited(events: DataFrame) -> DataFrame:
    """(triple, seq, day, recorded_at, source): one row per source given with an assert or a sync."""
    own = events.where("op = 'assert'").select(*TRIPLE, "seq", "day", "recorded_at", F.posexplode("sources").alias("pos", "source"))
    listed = (
        events.where("op = 'sync'")
        .select("subject_id", "predicate", "seq", "day", "recorded_at", F.explode("object_sources").alias("object_id", "given"))
        .select(*TRIPLE, "seq", "day", "recorded_at", F.posexplode("given").alias("pos", "source"))
    )
    return own.unionByName(listed).where("source.url is not null")


def sources_of(citations: DataFrame) -> DataFrame:
    """(source_id, url, title, domain): one row per url, the first writer's words; the id is a hash of the url."""
    return (
        citations.groupBy("source.url")
        .agg(F.min_by(F.struct("source.title", "source.domain"), F.struct("seq", "object_id", "pos")).alias("s"))
        .select(F.xxhash64("url").alias("source_id"), "url", F.coalesce("s.title", F.lit("")).alias("title"), F.coalesce("s.domain", F.lit("")).alias("domain"))
    )


def assertions_of(citations: DataFrame, versions: DataFrame) -> DataFrame:
    """One assertion per source, tied to the version that was open at its event.

    ``versions`` as ``fold`` gives them; the version is the last one of the
    triple opened at or before the event.
    """
    source = "struct<day:date,at:timestamp,pos:int,source:struct<url:string,title:string,domain:string,published_at:string>>"
    opened = versions.select(*TRIPLE, "version_id", "relationship_id", F.col("opened").alias("seq"), F.col("anchor").cast("int").alias("rank"), F.lit(None).cast(source).alias("c"))
    given = citations.select(
        *TRIPLE, F.lit(None).cast("bigint").alias("version_id"), F.lit(None).cast("bigint").alias("relationship_id"), "seq", F.lit(2).alias("rank"),
        F.struct(F.col("day"), F.col("recorded_at").alias("at"), "pos", "source").alias("c"),
    )
    line = Window.partitionBy(*TRIPLE).orderBy("seq", "rank").rowsBetween(Window.unboundedPreceding, 0)
    tied = opened.unionByName(given).withColumn("v", F.last(F.when(F.col("version_id").isNotNull(), F.struct("version_id", "relationship_id")), ignorenulls=True).over(line))
    return tied.where("c is not null").select(
        assertion_id(F.col("seq"), F.col("object_id"), F.col("c.pos")).alias("assertion_id"), "v.relationship_id", "v.version_id", F.xxhash64("c.source.url").alias("source_id"),
        F.col("c.day").alias("event_time"), F.col("c.source.published_at").alias("published_at"), F.col("c.at").alias("ingested_at"), F.lit(1).alias("polarity"),
    )


def entities_of(touched: DataFrame) -> DataFrame:
    """(entity_id, first_seen, last_seen) from asserts and confirmations; closing does not count."""
    ends = F.explode(F.array("subject_id", "object_id")).alias("entity_id")
    return touched.select(ends, "day").groupBy("entity_id").agg(F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))


def relationships_of(versions: DataFrame) -> DataFrame:
    """(relationship_id, subject_id, predicate, object_id, created_at): one row per triple."""
    return versions.groupBy("relationship_id", *TRIPLE).agg(F.min("system_from").alias("created_at"))


def entities_seen(versions: DataFrame) -> DataFrame:
    """(entity_id, first_seen, last_seen) over the days on which versions were asserted or confirmed."""
    ends = F.explode(F.array("subject_id", "object_id")).alias("entity_id")
    return versions.select(ends, "valid_from", "last_confirmed").groupBy("entity_id").agg(
        F.min(F.least("valid_from", "last_confirmed")).alias("first_seen"), F.max(F.greatest("valid_from", "last_confirmed")).alias("last_seen")
    )
