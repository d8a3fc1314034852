"""Cursors over an append-only event log, and the log as a stream.

A page is the id range (after, high watermark], the watermark captured first; the entity filter applies after
the range is cut, so a page may hold fewer rows while the cursor moves on. As a stream the log is a file source
in append mode: batches are bounded by files per trigger, progress lives in the checkpoint, and duplicates of
one idempotency key are dropped.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import duplicates
from tessera.staging import shared_dir


@dataclass(frozen=True)
class Cursor:
    """Where a reader of one history stands."""

    project: str
    history: str
    after: int
    watermark: int

    def check(self, project: str, history: str) -> None:
        if (self.project, self.history) != (project, history):
            raise ValueError("CURSOR_HISTORY_MISMATCH")


def high_watermark(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("event_id"), F.lit(0).cast("bigint"))).first()[0]


def page(log: DataFrame, cursor: Cursor, limit: int, entity: Column | None = None) -> tuple[DataFrame, Cursor]:
    """(rows, next cursor): the next page; the cursor jumps to the page's last id if more rows follow, else to
    the watermark."""
    inside = log.where((F.col("event_id") > cursor.after) & (F.col("event_id") <= cursor.watermark))
    ids = [r[0] for r in inside.select("event_id").orderBy("event_id").limit(limit + 1).collect()]  # limit + 1 numbers
    last = ids[limit - 1] if len(ids) > limit else cursor.watermark
    rows = inside.where(F.col("event_id") <= last)
    if entity is not None:
        rows = rows.where(entity)
    return rows.orderBy("event_id"), replace(cursor, after=last)


def start(log: DataFrame, project: str, history: str, from_start: bool = False) -> Cursor:
    """A new cursor stands at the end of the history unless its start is asked for."""
    mark = high_watermark(log)
    return Cursor(project, history, 0 if from_start else mark, mark)


def follow(spark: SparkSession, source: str, schema, files_per_batch: int = 1, key: str | None = None, files: str = "*.parquet") -> DataFrame:
    """The files of a log folder as a stream; with a key each idempotent request passes once."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", files)
    stream = reader.parquet(source)
    return stream.dropDuplicates([key]) if key else stream


def request_conflicts(requests: DataFrame, key: str, digest: str) -> DataFrame:
    """Idempotency keys that were reused with a different request."""
    return duplicates(requests.select(key, digest).distinct(), [key])


def replay_table(spark: SparkSession, table: str, schema, transform, label: str) -> DataFrame:
    """Run a stream over what a Parquet table (a folder of parts, or one file) holds now, to its end, and return the
    sink's rows."""
    run = f"{shared_dir(spark)}/tessera-stream-{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        stream = follow(spark, table, schema, files_per_batch=1000)
    else:
        # A file source reads folders: the table's own file is picked out of its folder.
        stream = follow(spark, path.getParent().toString(), schema, files=path.getName())
    out = transform(stream)
    query = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{run}/checkpoint").trigger(availableNow=True).start(f"{run}/rows")
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{run}/rows")
