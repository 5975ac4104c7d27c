"""Schemas of the graph tables and the version of their layout."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 3

SOURCE_RECORD = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("published_at", T.StringType()),
    ]
)

#: The write log.  ``sync`` rows list what held in ``objects``; an empty map closes everything.
EVENTS = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("subject_id", T.StringType(), False),
        T.StructField("predicate", T.StringType(), False),
        T.StructField("object_id", T.StringType()),
        T.StructField("day", T.DateType(), False),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("objects", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("sources", T.ArrayType(SOURCE_RECORD)),
        T.StructField("object_sources", T.MapType(T.StringType(), T.ArrayType(SOURCE_RECORD))),
        T.StructField("recorded_at", T.TimestampType(), False),
    ]
)

VERSIONS = T.StructType(
    [
        T.StructField("version_id", T.LongType()),
        T.StructField("relationship_id", T.LongType()),
        T.StructField("subject_id", T.StringType()),
        T.StructField("predicate", T.StringType()),
        T.StructField("object_id", T.StringType()),
        T.StructField("valid_from", T.DateType()),
        T.StructField("valid_to", T.DateType()),
        T.StructField("system_from", T.TimestampType()),
        T.StructField("system_to", T.TimestampType()),
        T.StructField("last_confirmed", T.DateType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("properties", T.StringType()),
        T.StructField("assertion_ids", T.ArrayType(T.LongType())),
    ]
)

#: A stored table of versions: also the seq of the event that opened each (0 if a dump
#: did) and whether later events of its triple go on from it.
BASE = T.StructType([*VERSIONS.fields, T.StructField("opened", T.LongType()), T.StructField("anchor", T.BooleanType())])

#: One fact per line of a dump.
FACTS = T.StructType([f for f in VERSIONS.fields if f.name in ("subject_id", "predicate", "object_id", "valid_from", "valid_to", "confidence")])
