"""Databases of stored series: Parquet blocks by metric and time bucket, with a manifest of all blocks.

Layout below a database's folder (any Hadoop file system, local or ``gs://`` alike)::

    block/<metric>/block_id=<id>/ts_bucket=<n>/*.parquet    the rows of one write, sorted by time
    block_list/*.parquet                                    one row per block, the latest version of a block holds
    field_types/<metric>.json                               the fields' types, checked on every write
    error/<nanoseconds>.json                                writes that failed
    lock/<name>.lock                                        held while a metric or the manifest is written

A block is written before its manifest row, under an id that a retry repeats, so a failed or repeated write leaves
neither dangling rows nor duplicates. Readers take no locks: they read the blocks that the manifest lists.
"""

from __future__ import annotations

import json
import os
import re
import socket
import time
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timestamps import floor_div
from tidemark.operators.series import BUCKET_NANOS, TS, block_stats, bucket_range, clip
from tidemark.plans.analyze import Limit, TimeRange
from tidemark.storage import materialize, remove_path

MANIFEST = "metric string, block_id string, since_sec bigint, until_sec bigint, timestamp_num bigint, updated_at_nanos bigint"
FIELD_TYPES = (T.DoubleType, T.BooleanType, T.StringType, T.LongType, T.DecimalType, T.NullType, T.FloatType, T.IntegerType)
MAX_FIELDS = 255
#: Blocks of the manifest that the planning of a limit looks at, and that a range is read from by name.
LIMIT_BLOCKS = 10_000
#: Files of the manifest beyond which they are merged into one.
MANIFEST_FILES = 64
#: Seconds after which a lock counts as left behind by a writer that died.
LOCK_SECONDS = 3600


def check_metric_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-][A-Za-z0-9_.-]*", name):
        raise ValueError(f"not a metric's name: {name!r}")
    return name


def check_fields(schema: T.StructType) -> None:
    """At most 255 fields of scalar types behind a LONG ``ts_nanos``."""
    if not schema.fields or schema.fields[0].name != TS or schema.fields[0].dataType != T.LongType():
        raise TypeError(f"the first column must be {TS} bigint")
    if len(schema.fields) - 1 > MAX_FIELDS:
        raise TypeError(f"a series has at most {MAX_FIELDS} fields")
    for f in schema.fields[1:]:
        if not isinstance(f.dataType, FIELD_TYPES):
            raise TypeError(f"{f.name}: a field can't be {f.dataType.simpleString()}")


def latest_blocks(manifest: DataFrame) -> DataFrame:
    """The manifest with one row per metric and block, the last updated."""
    rest = [c for c in manifest.columns if c not in ("metric", "block_id")]
    newest = F.max(F.struct("updated_at_nanos", *[c for c in rest if c != "updated_at_nanos"])).alias("x")
    held = manifest.groupBy("metric", "block_id").agg(newest)
    return held.select(*[F.col(f"x.{c}").alias(c) if c in rest else F.col(c) for c in manifest.columns])


class Database:
    """One folder of metrics."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # -- files

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        root = self._path()
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, *parts: str) -> bool:
        return self._fs().exists(self._path(*parts))

    def _write_text(self, text: str, *parts: str) -> None:
        out = self._fs().create(self._path(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, *parts: str) -> str:
        stream = self._fs().open(self._path(*parts))
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    @contextmanager
    def lock(self, name: str, wait: float = 60.0) -> Iterator[None]:
        """Hold ``name`` alone among all writers of the database; those that come later wait, or give up with an error.

        The file system creates the lock's file for one of them only. A lock older than LOCK_SECONDS is taken over.
        """
        parts, until = ("lock", f"{name}.lock"), time.monotonic() + wait
        token = f"{socket.gethostname()} {os.getpid()} {uuid.uuid4().hex}"
        while not self._create(token, *parts):
            age = self._age(*parts)
            if age is not None and age > LOCK_SECONDS:
                # renamed first, as only one of several that find it so can do that
                old = ("lock", f"{name}.{uuid.uuid4().hex}")
                if self._fs().rename(self._path(*parts), self._path(*old)):
                    self._fs().delete(self._path(*old), False)
            elif time.monotonic() > until:
                raise TimeoutError(f"{name} is being written by another writer")
            else:
                time.sleep(0.05)
        try:
            yield
        finally:
            if self._holds(token, *parts):
                self._fs().delete(self._path(*parts), False)

    def _create(self, text: str, *parts: str) -> bool:
        """Write a file that doesn't exist yet; False if it does. Only one of several at once succeeds."""
        if self._fs().getUri().getScheme() == "file":  # Hadoop's own class for local files looks first and creates later
            path = self._path(*parts).toUri().getPath()
            os.makedirs(os.path.dirname(path), exist_ok=True)
            try:
                with open(path, "x") as f:
                    f.write(text)
            except FileExistsError:
                return False
            return True
        try:
            stream = self._fs().create(self._path(*parts), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.toString():
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _holds(self, token: str, *parts: str) -> bool:
        """Whether a lock is still this writer's, and wasn't taken over."""
        try:
            return self._read_text(*parts) == token
        except Py4JJavaError:
            return False

    def _age(self, *parts: str) -> float | None:
        """Seconds since a file was written, or None if it isn't there any more."""
        try:
            return time.time() - self._fs().getFileStatus(self._path(*parts)).getModificationTime() / 1000
        except Py4JJavaError as e:
            if "FileNotFound" in e.java_exception.toString():
                return None
            raise

    # -- manifest

    def manifest(self) -> DataFrame:
        """(metric, block_id, since_sec, until_sec, timestamp_num, updated_at_nanos) of all blocks."""
        if not self.exists("block_list"):
            return self.spark.createDataFrame([], MANIFEST)
        return latest_blocks(self.spark.read.schema(MANIFEST).parquet(f"{self.root}/block_list"))

    def refresh(self, metric: str | None = None) -> None:
        """Forget what is cached of this database's files."""
        self.spark.catalog.refreshByPath(f"{self.root}/block/{metric}" if metric else self.root)

    def metrics(self) -> DataFrame:
        return self.manifest().select("metric").distinct()

    # -- series

    def schema_of(self, metric: str) -> T.StructType:
        check_metric_name(metric)
        if not self.exists("field_types", f"{metric}.json"):
            raise LookupError(f"no such metric: {metric}")
        return T.StructType.fromJson(json.loads(self._read_text("field_types", f"{metric}.json")))

    def blocks_in(self, metric: str, bounds: TimeRange) -> DataFrame:
        """The manifest's rows of a metric's blocks that may hold rows of a range."""
        second, test = 10**9, F.col("metric") == metric
        if bounds.since is not None:
            test = test & (F.col("until_sec") > F.lit(bounds.since // second))
        if bounds.until is not None:
            test = test & (F.col("since_sec") <= F.lit((bounds.until - 1) // second))
        return self.manifest().where(test)

    def series(self, metric: str, bounds: TimeRange = TimeRange()) -> DataFrame:
        """Rows of a metric in a range, from the blocks that the manifest lists for it.

        Only these blocks' folders are listed; if they are more than LIMIT_BLOCKS the whole metric's are, and blocks that
        aren't listed are left out by name. The range also prunes the bucket folders and reaches the Parquet scan.
        """
        schema = self.schema_of(metric)
        blocks = [r["block_id"] for r in self.blocks_in(metric, bounds).select("block_id").limit(LIMIT_BLOCKS + 1).collect()]
        folder = f"{self.root}/block/{metric}"
        if not blocks:
            return self.spark.createDataFrame([], schema)
        kept = [T.StructField("block_id", T.StringType()), T.StructField("ts_bucket", T.LongType())]
        reader = self.spark.read.schema(T.StructType([*schema.fields, *kept])).option("basePath", folder)
        if len(blocks) <= LIMIT_BLOCKS:
            rows = reader.parquet(*[f"{folder}/block_id={b}" for b in blocks])
        else:
            rows = reader.parquet(folder).join(self.blocks_in(metric, bounds).select("block_id"), "block_id", "left_semi")
        return clip(rows.where(bucket_range(bounds)), bounds).select(*schema.names)

    def narrowed(self, metric: str, bounds: TimeRange, limit: Limit) -> TimeRange:
        """A part of the range that surely holds the timestamps that a limit asks for, as far as the manifest tells.

        Blocks that don't overlap add up to at least as many distinct timestamps as they list, so a head limit needs
        nothing behind enough of them, and a tail limit nothing before. Up to ``LIMIT_BLOCKS`` blocks from the range's
        beginning (or end) are looked at; if they don't suffice, the range stays as it is.
        """
        second, head = 10**9, limit.side == "head"
        start = bounds.since if head else bounds.until
        if limit.n <= 0 or start is None:
            return bounds
        whole = F.col("since_sec") >= -(-start // second) if head else F.col("until_sec") <= start // second
        order = ("until_sec", "since_sec") if head else (F.col("since_sec").desc(), F.col("until_sec").desc())
        blocks = self.manifest().where((F.col("metric") == metric) & whole).orderBy(*order).limit(LIMIT_BLOCKS)
        edge, seen = start, 0
        for b in blocks.select("since_sec", "until_sec", "timestamp_num").collect():
            since, until = b["since_sec"] * second, b["until_sec"] * second
            if (since < edge) if head else (until > edge):
                continue  # overlaps a block that was counted
            edge, seen = (until if head else since), seen + b["timestamp_num"]
            if seen >= limit.n:
                if head:
                    return TimeRange(bounds.since, edge if bounds.until is None else min(edge, bounds.until))
                return TimeRange(edge if bounds.since is None else max(edge, bounds.since), bounds.until)
        return bounds

    def write_block(
        self, metric: str, rows: DataFrame, *, block_id: str | None = None, tie_keys: Sequence[str | Column] = (), files: int | None = None
    ) -> str | None:
        """Store ``rows`` (``ts_nanos`` and fields) as one block; returns its id, or None if there are no rows.

        A block of the same id is replaced. Fields must have the types of the metric's first write. ``files`` is the
        number of files per bucket to aim at; by default the frame's own partitions are kept. One writer at a time writes to
        a metric; others wait.
        """
        check_metric_name(metric)
        check_fields(rows.schema)
        with self.lock(metric):
            return self._write_block(metric, rows, block_id, tie_keys, files)

    def _write_block(self, metric: str, rows: DataFrame, block_id: str | None, tie_keys: Sequence[str | Column], files: int | None) -> str | None:
        if self.exists("field_types", f"{metric}.json"):
            known = self.schema_of(metric)
            if [f.dataType for f in known] != [f.dataType for f in rows.schema]:
                raise TypeError(f"{metric} has {known.simpleString()}, not {rows.schema.simpleString()}")
            rows = rows.toDF(*known.names)
        else:
            self._write_text(rows.schema.json(), "field_types", f"{metric}.json")
        block_id = block_id or f"{time.time_ns():020d}"
        placed = rows.withColumn("ts_bucket", floor_div(F.col(TS), BUCKET_NANOS))
        if files:
            placed = placed.repartition(files, "ts_bucket")
        target = f"{self.root}/block/{metric}/block_id={block_id}"
        try:
            (
                placed.sortWithinPartitions("ts_bucket", TS, *tie_keys)
                .write.mode("overwrite").option("parquet.writer.version", "v2").partitionBy("ts_bucket").parquet(target)
            )
        except Exception as e:
            record = {"metric": metric, "block_id": block_id, "error": str(e)}
            self._write_text(json.dumps(record), "error", f"{time.time_ns()}.json")
            raise
        written = self.spark.read.schema(rows.schema).parquet(target) if self._has_rows(target) else None
        if written is None:
            remove_path(self.spark, target)
            return None
        self._list_blocks(block_stats(written, [F.lit(metric).alias("metric"), F.lit(block_id).alias("block_id")]))
        return block_id

    def _has_rows(self, target: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        return any(s.isDirectory() for s in self._fs().listStatus(path))

    def _list_blocks(self, stats: DataFrame) -> None:
        with self.lock(".block_list"):
            stats.withColumn("updated_at_nanos", F.lit(time.time_ns())).coalesce(1).write.mode("append").parquet(f"{self.root}/block_list")
            names = [f.getPath().getName() for f in self._fs().listStatus(self._path("block_list"))]
            if sum(n.endswith(".parquet") for n in names) > MANIFEST_FILES:
                self._replace_manifest(self.manifest())

    def _replace_manifest(self, rows: DataFrame) -> None:
        """The new manifest is complete before the old one is removed."""
        fresh = self._path(f"block_list-{time.time_ns()}")
        rows.coalesce(1).write.parquet(str(fresh))
        remove_path(self.spark, f"{self.root}/block_list")
        self._fs().rename(fresh, self._path("block_list"))
        self.spark.catalog.refreshByPath(f"{self.root}/block_list")

    def repair(self) -> DataFrame:
        """Rebuild the manifest from the blocks that can be read; returns the rows that were dropped or corrected.

        Unreadable files count as absent. All metrics' times are read in one scan; metric and block are told by the path.
        """
        with self.lock(".block_list"):
            before = materialize(self.manifest(), "manifest")  # as the files behind it are about to go
            reader = self.spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true")
            found = self.spark.createDataFrame([], MANIFEST)
            if self.exists("block"):
                path = F.col("_metadata.file_path")
                part = lambda n: F.url_decode(F.regexp_extract(path, r"/block/([^/]+)/block_id=([^/]+)/[^/]+/[^/]+$", n))
                times = reader.schema(f"{TS} bigint").parquet(f"{self.root}/block").select(TS, part(1).alias("metric"), part(2).alias("block_id"))
                found = block_stats(times, ["metric", "block_id"]).withColumn("updated_at_nanos", F.lit(time.time_ns()))
            self._replace_manifest(found.select(*before.columns))
        self.refresh()
        keys = ["metric", "block_id", "since_sec", "until_sec", "timestamp_num"]
        return before.join(self.manifest(), keys, "left_anti")
