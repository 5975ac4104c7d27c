"""A change feed of inserts, updates and deletes, applied to keyed streaming state.

Two incremental streams, both with their state in the state store:

1. *Change log.*  State per change id: its earliest ingestion - the position
   that orders it - and its payload.  A repeated or late copy can only lower
   the position.
2. *Current rows.*  State per key: payload, last sequence and tombstone, i.e.
   ``max(struct(sequence..., payload, tombstone))``.  The state accepts a
   change only if it is newer than the one held, in whatever order changes
   arrive.

Both emit upserts through ``foreachBatch``, each micro-batch into its own
``batch=N`` folder that a retry overwrites, so the output is idempotent.  A
reader takes the row of the greatest batch per key.  Once there are many
folders, the upserts of the current rows are brought down to one row per key.

State is aggregated map-side before it is shuffled, so a key with a third of
all changes reaches its state as one row per task.

A change whose position is lowered *after* it was emitted could leave a key
with too new a sequence.  The first stream's state therefore remembers the
position it emitted first; only a change that has fallen below it marks its
key, and marked keys are folded again from the change log, exactly.

The state of the first stream grows with the number of change ids, as any copy
of any change may still come; it lives in RocksDB on disk, not on the heap.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.sources.scratch import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def change_log(feed: DataFrame) -> DataFrame:
    """State per change id: earliest ingestion and payload.  ``feed`` may be a stream or a table.

    Changes that neither set nor remove (polarity other than 1 or -1), and
    rows without change id or key, are dropped.  Copies of a change agree in
    key and polarity, so these are part of the state's key.  ``lowered``: the
    position is below that of the micro-batch the change first came in, which
    ``current_timestamp`` - one instant per micro-batch, kept in its log -
    tells apart.  No ingestion is the lowest position.
    """
    lowest = F.coalesce(F.unix_micros("ingested_at"), F.lit(-(2**62)))
    return (
        feed.where("polarity in (1, -1) and assertion_id is not null and relationship_id is not null")
        .select("assertion_id", "relationship_id", "polarity", F.unix_micros(F.current_timestamp()).alias("came"), lowest.alias("position"))
        .groupBy("assertion_id", "relationship_id", "polarity")
        .agg(F.min("position").alias("position"), F.min(F.struct("came", "position")).alias("first"))
        .select("assertion_id", "relationship_id", "polarity", "position", (F.col("position") < F.col("first.position")).alias("lowered"))
    )


def current_rows(changes: DataFrame) -> DataFrame:
    """State per key: the newest change with its payload and tombstone, and whether a change of the key was lowered."""
    return changes.groupBy("relationship_id").agg(
        F.max(F.struct("position", "assertion_id", (F.col("polarity") == -1).alias("tombstone"))).alias("last"),
        F.max("lowered").alias("lowered"),
    )


STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


@contextmanager
def _state_settings(spark: SparkSession):
    """RocksDB state, so that state is not held on the heap; the session's own settings come back after."""
    before = {name: spark.conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def _upserts(stream: DataFrame, root: str, name: str) -> str:
    """Drain ``stream`` into batch-versioned upserts and return their folder.

    Started again with the same ``root`` it goes on where it stopped: only new
    files are read, and the state is that of the last batch.
    """
    target = f"{root}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{root}/{name}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return target


def apply_feed(spark: SparkSession, path: str, root: str | None = None, files_per_batch: int = 1_000, compact_after: int = 64) -> DataFrame:
    """(relationship_id, assertion_id): the keys that hold after all changes, with the change that last set each.

    ``path`` is a folder or file of Parquet change rows: assertion_id,
    relationship_id, polarity, ingested_at; extra columns are not read.  Given
    a ``root``, a later call goes on from where this one stopped; beyond
    ``compact_after`` micro-batches the upserts are compacted.
    """
    root = root or scratch_path(spark, "changefeed")
    schema = spark.read.parquet(path).select("assertion_id", "relationship_id", "polarity", "ingested_at").schema
    with _state_settings(spark):
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_as_source(spark, path))
        log_path = _upserts(change_log(feed), root, "changes")
        if not _has_rows(spark, log_path):
            return spark.createDataFrame([], "relationship_id bigint, assertion_id bigint")
        log_schema = spark.read.parquet(log_path).drop("batch").schema
        changes = spark.readStream.schema(log_schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{log_path}/batch=*")
        row_path = _upserts(current_rows(changes), root, "rows")
    _compact(spark, row_path, compact_after)
    rows = _newest(spark, row_path)
    settled = rows.where("not lowered").select("relationship_id", "last")
    again = spark.read.parquet(log_path).join(rows.where("lowered").select("relationship_id"), "relationship_id", "left_semi")
    refolded = current_rows(
        again.groupBy("assertion_id", "relationship_id", "polarity").agg(F.min("position").alias("position"), F.max("lowered").alias("lowered"))
    ).select("relationship_id", "last")
    return settled.unionByName(refolded).where("not last.tombstone").select("relationship_id", "last.assertion_id")


def _newest(spark: SparkSession, row_path: str) -> DataFrame:
    """(relationship_id, last, lowered): per key the upsert of the greatest batch."""
    rows = spark.read.parquet(row_path).groupBy("relationship_id").agg(F.max(F.struct("batch", "last", "lowered")).alias("r"))
    return rows.select("relationship_id", "r.last", "r.lowered")


def _compact(spark: SparkSession, row_path: str, most: int) -> None:
    """Bring all upserts down to one row per key once there are more than ``most`` batches.

    The compacted rows get the number of the newest batch and take its place,
    written beside and renamed; older batches go only after that, and upserts
    that are still there in between change nothing, being older.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(row_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    batches = sorted(int(f.getPath().getName()[6:]) for f in fs.listStatus(at(row_path)) if f.getPath().getName().startswith("batch="))
    if len(batches) <= most:
        return
    beside, newest = f"{row_path}-compacting", f"{row_path}/batch={batches[-1]}"
    _newest(spark, row_path).write.mode("overwrite").option("compression", "zstd").parquet(beside)
    fs.rename(at(newest), at(f"{row_path}-replaced"))
    fs.rename(at(beside), at(newest))
    for batch in batches[:-1]:
        fs.delete(at(f"{row_path}/batch={batch}"), True)
    fs.delete(at(f"{row_path}-replaced"), True)


def _as_source(spark: SparkSession, path: str) -> str:
    """A file source wants a folder or a glob; a single file becomes a glob of itself."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.exists(hadoop) and fs.getFileStatus(hadoop).isFile() else path


def _has_rows(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop) and not spark.read.parquet(path).isEmpty()
