import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def day():
    return dt.date.fromisoformat


@pytest.fixture
def at():
    return lambda text: dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc)


VERSIONS = (
    "version_id bigint, relationship_id bigint, subject_id string, predicate string, object_id string, valid_from date, valid_to date, "
    "system_from timestamp, system_to timestamp, last_confirmed date, confidence double"
)


@pytest.fixture
def versions(spark, day):
    """Builder of a versions table from (s, p, o, from, to, confidence)."""

    def build(*facts):
        ids: dict = {}
        rows = []
        for k, (s, p, o, a, b, c) in enumerate(facts, 1):
            rel = ids.setdefault((s, p, o), len(ids) + 1)
            start = dt.datetime.combine(day(a), dt.time(), dt.timezone.utc)
            end = dt.datetime.combine(day(b), dt.time(), dt.timezone.utc) if b else None
            rows.append((k, rel, s, p, o, day(a), day(b) if b else None, start, end, day(b) if b else day(a), c))
        return spark.createDataFrame(rows, VERSIONS)

    return build
