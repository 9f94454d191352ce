"""Checkpointed compaction of many tiny blocks into few well-sized ones.

A file stream discovers each file once and hands the files over in micro-batches; every batch is written under its
batch id, replacing whatever an earlier attempt at the same batch left, so a retry can't duplicate rows. When all
available files have been taken, the batches that haven't been merged yet are: copies of a datapoint that was persisted
more than once are reduced to one, and the rows are range-partitioned by metric and time into files of about
``target_rows`` rows, wherever in time they lie.

Layout below a workspace::

    checkpoint/                     the stream's
    staging/batch_id=<n>/           rows of a batch that isn't merged yet
    compacted/v=<n>/*.parquet       rows of the version that batches below n made, sorted by metric and time
    manifest/v=<n>/                 one row per block of that version, with the file that holds it
    stored/v=<n>/                   the old blocks that the version's batches held, with their numbers of rows

A version is written under the number of batches it takes in, rows first, manifest last, so a broken-off merge is done
again and replaces what it left. A merge reads the new batches and those blocks whose time they touch, and no other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import NANOS, floor_div
from tidemark.storage import join_small, remove_path, scratch_path

#: What every stored row has; all its other columns are its fields.
KEYS = ("metric", "ts_nanos", "block_id", "row_id")
DAY, MINUTE = 86_400 * NANOS, 60 * NANOS
#: Tasks that rows without a time are spread over.
SPREAD = 64


@dataclass(frozen=True)
class Compacted:
    """``rows``: every datapoint once (metric, ts_nanos, block_id, row_id, a struct of its fields, owner, counts, new_block);
    ``stored``: (metric, block_id, n_rows) of the old blocks; ``blocks``: the manifest of the new ones (metric, new_block,
    file, since_nanos, last_nanos, n_rows, timestamps), without times for blocks of rows that have none.
    """

    rows: DataFrame
    stored: DataFrame
    blocks: DataFrame


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers behind ``=`` in the names of a folder's whole tables."""
    fs, target = _hadoop(spark, folder)
    if not fs.exists(target):
        return []
    paths = [s.getPath() for s in fs.listStatus(target) if s.isDirectory()]
    whole = [p for p in paths if fs.exists(_hadoop(spark, f"{p}/_SUCCESS")[1])]
    return sorted(int(p.getName().partition("=")[2]) for p in whole)


def _drain(spark: SparkSession, source: str, staging: str, checkpoint: str, bytes_per_batch: int) -> None:
    """Take every available file of ``source`` once and append its persisted rows to ``staging``, batch by batch."""
    schema = spark.read.parquet(source).schema
    folder, _, name = source.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch)
    # a table may be one file instead of a folder; the stream then watches the folder for that name
    fs, target = _hadoop(spark, source)
    whole = fs.getFileStatus(target).isDirectory()
    stream = reader.parquet(source) if whole else reader.option("pathGlobFilter", name).parquet(folder)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        persisted = batch.where("block_id is not null")
        rest = [F.col(f"`{n}`") for n in schema.names if n not in KEYS] or [F.lit(False).alias("none")]
        staged = persisted.select(*KEYS, F.struct(*rest).alias("fields"))
        staged.write.mode("overwrite").option("compression", "zstd").parquet(f"{staging}/batch_id={batch_id}")

    query = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _touched(fresh: DataFrame, blocks: DataFrame) -> DataFrame:
    """``fresh`` with ``slice``: the block in whose stretch of time a row lies, from its first time to that of the next.

    Long stretches are met by their days, short ones by their minutes, so a row meets few that it doesn't lie in.
    """
    by_metric = Window.partitionBy("metric").orderBy("since_nanos", "new_block")
    slices = blocks.where("since_nanos is not null").select(
        "metric",
        F.col("new_block").alias("slice"),
        F.when(F.row_number().over(by_metric) > 1, F.col("since_nanos")).alias("begin"),
        F.lead("since_nanos").over(by_metric).alias("end"),
    )
    # times before the first block belong to it, and times behind the last to that; both have keys of their own
    open_ = F.col("begin").isNull() | F.col("end").isNull()
    long = F.col("end") - F.col("begin") > DAY

    def steps(width: int) -> Column:
        return F.transform(F.sequence(floor_div(F.col("begin"), width), floor_div(F.col("end") - 1, width)), lambda k: F.concat(F.lit(f"{width}:"), k.cast("string")))

    keys = F.when(open_, F.array(F.lit("open"))).when(F.col("end") == F.col("begin"), F.array().cast("array<string>")).when(long, steps(DAY)).otherwise(steps(MINUTE))
    keyed = slices.withColumn("key", F.explode(keys))
    own = F.array(F.lit("open"), *[F.concat(F.lit(f"{w}:"), floor_div(F.col("ts_nanos"), w).cast("string")) for w in (DAY, MINUTE)])
    timed = fresh.where("ts_nanos is not null").withColumn("_n", F.monotonically_increasing_id())
    within = (F.col("begin").isNull() | (F.col("ts_nanos") >= F.col("begin"))) & (F.col("end").isNull() | (F.col("ts_nanos") < F.col("end")))
    met = join_small(timed.withColumn("key", F.explode(own)), keyed, ["metric", "key"], null_safe=True).where(within).drop("key", "begin", "end", "_n")
    known = slices.select("metric").distinct()
    new = timed.alias("t").join(known.alias("k"), F.col("t.metric").eqNullSafe(F.col("k.metric")), "left_anti").select("t.*").drop("_n")
    lone = F.lit(None).cast("string").alias("slice")
    return met.select(*fresh.columns, "slice").unionByName(new.select("*", lone)).unionByName(fresh.where("ts_nanos is null").select("*", lone))


def _merge(spark: SparkSession, workspace: str, before: int, after: int, target_rows: int, same_but: tuple[str, ...]) -> None:
    """Make version ``after`` from version ``before`` (0: none) and the batches from ``before`` on."""
    staged = spark.read.parquet(*[f"{workspace}/staging/batch_id={n}" for n in range(before, after)])
    staged.groupBy("metric", "block_id").agg(F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").parquet(f"{workspace}/stored/v={after}")
    fresh = staged.withColumn("owner", F.when(F.col("ts_nanos").isNotNull(), F.col("block_id")))
    n_rows, kept_blocks, held = staged.count(), None, None
    if before:
        blocks = spark.read.parquet(f"{workspace}/manifest/v={before}")
        fresh = _touched(fresh, blocks)
        touched = [r["slice"] for r in fresh.where("slice is not null").select("slice").distinct().collect()]
        files = [r["file"] for r in blocks.where(F.col("new_block").isin(touched)).select("file").distinct().collect()]
        kept_blocks = blocks.where(~F.col("file").isin(files))
        if files:
            held = spark.read.parquet(*files).select(*staged.columns, "owner", F.when(F.col("ts_nanos").isNotNull(), F.col("new_block")).alias("slice"))
            n_rows += held.count()
    else:
        fresh = fresh.withColumn("slice", F.lit(None).cast("string"))
    merged = fresh if held is None else held.unionByName(fresh)

    values = [F.col("fields").getField(n) for n in staged.schema["fields"].dataType.names if n not in same_but]
    timed = F.col("ts_nanos").isNotNull()
    spread = F.when(~timed, F.pmod(F.xxhash64("row_id"), F.lit(SPREAD)))
    # equal times of a metric come into one partition, a partition holds about target_rows, and the windows need no other shuffle
    place = [*(["slice"] if before else []), "metric", "ts_nanos", "spread"]
    sliced = merged.withColumn("spread", spread).repartitionByRange(max(1, -(-n_rows // target_rows)), *place)
    copies = Window.partitionBy(*place, *values, F.when(~timed, F.col("row_id"))).orderBy("block_id", "row_id")
    same_time = Window.partitionBy(*place).orderBy("block_id", "row_id")
    old = F.when(F.col("slice").isNotNull(), F.concat(F.lit("~"), F.hex(F.crc32("slice")))).otherwise("")
    name = F.concat(F.when(timed, F.lit("cmp")).otherwise(F.lit("untimed")), F.format_string(f"{after:06d}-%06d", F.spark_partition_id()), old)
    kept = (
        sliced.withColumn("_copy", F.row_number().over(copies))
        .where("_copy = 1")
        .withColumn("owner", F.when(timed, F.min("owner").over(same_time.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        .withColumn("counts", timed & (F.row_number().over(same_time) == 1))
        .withColumn("new_block", name)
        .select(*staged.columns, "owner", "counts", "new_block")
    )
    target = f"{workspace}/compacted/v={after}"
    kept.write.mode("overwrite").option("compression", "zstd").parquet(target)
    listed = spark.read.parquet(target).groupBy("metric", "new_block", F.col("_metadata.file_path").alias("file")).agg(
        F.min("ts_nanos").alias("since_nanos"), F.max("ts_nanos").alias("last_nanos"), F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("counts"), 1)).alias("timestamps"),
    )
    if kept_blocks is not None:
        listed = kept_blocks.unionByName(listed)
    listed.coalesce(1).write.mode("overwrite").parquet(f"{workspace}/manifest/v={after}")
    for n in range(before, after):
        remove_path(spark, f"{workspace}/staging/batch_id={n}")
    if before:
        for file in files:
            remove_path(spark, file)


def compact(
    spark: SparkSession,
    source: str,
    *,
    workspace: str | None = None,
    target_rows: int = 250_000,
    same_but: tuple[str, ...] = ("ingested_at",),
    bytes_per_batch: int = 1 << 32,
) -> Compacted:
    """Compact the datapoints stored under ``source`` (columns metric, ts_nanos, block_id, row_id and any fields).

    A datapoint is a metric, a time and the values of its fields, but for ``same_but`` (when it was taken in, for one, isn't
    part of it). Stored more than once, it is kept once, from the smallest block, then the smallest row; genuine ties (one
    time, different values) are all kept. ``owner`` is the smallest block that stores the time at all. Rows without a time
    can't be identified as copies and are all kept, in blocks "untimed..." of their metric; rows without a ``block_id``
    aren't persisted yet and stay with the writer. A null metric is a metric of its own. No stored rows give an empty
    result. Files hold about ``target_rows`` rows, small metrics lying in one; a new block is what a file holds of a metric.

    ``workspace`` keeps the checkpoint and the compacted blocks: called again with it, only files that have appeared since
    are read, and only blocks whose time they touch are merged with them and replaced, so readers of the result before must
    be done. Without one, a folder below the shared one is used. A batch takes files of ``bytes_per_batch`` in all, so a
    call that was broken off goes on from the last whole batch if it named its workspace.
    """
    lasting = workspace is not None
    workspace = workspace or scratch_path(spark, "compaction")
    _drain(spark, source, f"{workspace}/staging", f"{workspace}/checkpoint", bytes_per_batch)
    before = max(_numbers(spark, f"{workspace}/manifest"), default=0)
    after = max((n + 1 for n in _numbers(spark, f"{workspace}/staging")), default=0)
    if after > before:
        _merge(spark, workspace, before, after, target_rows, same_but)
    version = max(before, after)
    if not lasting:
        remove_path(spark, f"{workspace}/checkpoint")
    blocks = spark.read.parquet(f"{workspace}/manifest/v={version}")
    files = [f"{workspace}/compacted/v={version}"]
    if len(_numbers(spark, f"{workspace}/manifest")) > 1:
        files = [r["file"] for r in blocks.select("file").distinct().collect()] or files
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{workspace}/stored").groupBy("metric", "block_id").agg(F.sum("n_rows").alias("n_rows"))
    return Compacted(spark.read.parquet(*files), stored, blocks)


def counted_timestamps(result: Compacted) -> DataFrame:
    """(metric, block_id, n_rows, timestamps): of each stored block, how many timestamps count for it.

    A distinct (metric, time) counts for the smallest block that stores it, and for no other.
    """
    owned = result.rows.where("counts").groupBy("metric", F.col("owner").alias("block_id")).agg(F.count(F.lit(1)).alias("timestamps"))
    return (
        result.stored.alias("s")
        .join(owned.alias("o"), F.col("s.metric").eqNullSafe(F.col("o.metric")) & (F.col("s.block_id") == F.col("o.block_id")), "left")
        .select("s.metric", "s.block_id", "s.n_rows", F.coalesce("o.timestamps", F.lit(0)).alias("timestamps"))
    )
