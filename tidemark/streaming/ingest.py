"""Streaming ingestion: every micro-batch becomes a block, late data included.

No watermark is set, as late rows are welcome: they make a block that overlaps others, and reads merge them. Rows from
the future wait in a staging table until they are due; that is looked at with every batch and, as Spark runs none without
new rows, by a clock of our own in between. Blocks and staging are written under the batch's number and replaced on a
retry, so a restart from the checkpoint neither loses nor repeats a row.

Staging is one table at a time: ``batch=<n>`` is what waits after batch n, ``batch=<n>.<k>`` after the k-th release since.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.series import TS
from tidemark.sources.database import Database, check_metric_name
from tidemark.storage import remove_path

_WRITING = threading.Lock()


def _staged(database: Database, metric: str, below: int | None = None) -> tuple[int, int] | None:
    """(batch, release) of the latest whole staging table, of batches below a number if one is given."""
    if not database.exists("staging", metric):
        return None
    found = []
    for status in database._fs().listStatus(database._path("staging", metric)):
        name = status.getPath().getName()
        if database.exists("staging", metric, name, "_SUCCESS"):
            batch, _, release = name.partition("=")[2].partition(".")
            if below is None or int(batch) < below:
                found.append((int(batch), int(release or 0)))
    return max(found, default=None)


def _folder(database: Database, metric: str, batch: int, release: int) -> str:
    return f"{database.root}/staging/{metric}/batch={batch}" + (f".{release}" if release else "")


def release_due(
    database: Database, metric: str, checkpoint: str, schema, *, tie_keys: Sequence[str | Column] = (), now: Callable[[], int] = time.time_ns
) -> str | None:
    """Store the waiting rows that have become due as a block; returns its id, or None if there are none.

    Only what waits after a batch that is committed is released, so a batch that is done again finds its rows as they were.
    """
    with _WRITING:
        last = _staged(database, metric)
        fs = database._fs()
        if last is None or not fs.exists(database.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/{last[0]}")):
            return None
        batch, release = last
        waits = database.spark.read.schema(schema).parquet(_folder(database, metric, batch, release))
        due = F.col(TS) <= F.lit(now())
        if waits.where(due).isEmpty():
            return None
        # the block's number is that of the release, so one that was broken off is replaced
        block = database.write_block(metric, waits.where(due), block_id=f"batch{batch:012d}.due{release + 1}", tie_keys=tie_keys)
        waits.where(~due).write.mode("overwrite").parquet(_folder(database, metric, batch, release + 1))
        if release:
            remove_path(database.spark, _folder(database, metric, batch, release))
        return block


def ingest(
    stream: DataFrame,
    database: Database,
    metric: str,
    checkpoint: str,
    *,
    tie_keys: Sequence[str | Column] = (),
    every: str | None = None,
    now: Callable[[], int] = time.time_ns,
) -> StreamingQuery:
    """Start ingesting ``stream`` (``ts_nanos`` and fields) into a metric.

    ``every`` is the interval of flushes, such as ``"10 seconds"``; without it, all that is available is taken and the
    query ends. Rows without a time belong to no block and are left out.
    """
    check_metric_name(metric)
    spark = stream.sparkSession

    def flush(batch: DataFrame, number: int) -> None:
        with _WRITING:
            rows = batch.where(F.col(TS).isNotNull())
            last = _staged(database, metric, number)
            if last is not None:
                rows = rows.unionByName(spark.read.schema(batch.schema).parquet(_folder(database, metric, *last)))
            due = F.col(TS) <= F.lit(now())
            rows.persist()
            try:
                rows.where(~due).write.mode("overwrite").parquet(_folder(database, metric, number, 0))
                database.write_block(metric, rows.where(due), block_id=f"batch{number:012d}", tie_keys=tie_keys)
            finally:
                rows.unpersist()
            # what the batch before found must stay until this one is committed; all else may go
            while (old := _staged(database, metric, last[0] if last else number)) is not None:
                remove_path(spark, _folder(database, metric, *old))

    writer = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    query = writer.start()
    if every:
        seconds = spark.sql(f"SELECT CAST(INTERVAL {every} AS INTERVAL SECOND) AS i").first()["i"].total_seconds()
        threading.Thread(target=_clock, args=(query, seconds, database, metric, checkpoint, stream.schema, tie_keys, now), daemon=True).start()
    return query


def _clock(query: StreamingQuery, seconds: float, database: Database, metric: str, checkpoint: str, schema, tie_keys, now) -> None:
    """Release what is due, again and again, as long as the query runs."""
    while not query.awaitTermination(max(1, round(seconds))):
        try:
            release_due(database, metric, checkpoint, schema, tie_keys=tie_keys, now=now)
        except Exception:
            if query.isActive:
                logging.getLogger(__name__).exception("rows of %s that are due could not be stored", metric)


def waiting(database: Database, metric: str, schema: str) -> DataFrame:
    """The rows that are not due yet."""
    last = _staged(database, metric)
    if last is None:
        return database.spark.createDataFrame([], schema)
    return database.spark.read.schema(schema).parquet(_folder(database, metric, *last))
