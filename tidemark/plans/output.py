"""Where results go: standard output, a file, or the caller."""

from __future__ import annotations

import io
import json
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import ExitStack
from typing import TextIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.analyze import Output
from tidemark.storage import join_small, materialize, ship


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["batch"])


def arrow_batches(df: DataFrame) -> Iterator[pa.RecordBatch]:
    """The rows in order, as the Arrow batches that the executors make of them; the driver holds one partition's at most."""
    ship(df.sparkSession)
    for row in df.mapInArrow(_serialized, "batch binary").toLocalIterator():
        yield from pa.ipc.open_stream(row[0])


def table_lines(df: DataFrame) -> Iterator[str]:
    """A bordered table, streamed: the widths come from an aggregate, the rows one partition at a time."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(df.columns)])
    widths = texts.agg(*[F.max(F.char_length(c)) for c in texts.columns]).first()
    width = [max(len(name), w or 0) for name, w in zip(df.columns, widths, strict=True)]
    border = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda cells: "|" + "|".join(f" {c.ljust(w)} " for c, w in zip(cells, width, strict=True)) + "|"
    yield border
    yield line(df.columns)
    yield border
    for batch in arrow_batches(texts):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield line([_text(x) for x in row])
    yield border


def _plain(value: object) -> object:
    return value if value is None or isinstance(value, bool | int | float | str) else str(value)


def _write_values(df: DataFrame, name: str, out: TextIO) -> None:
    """A column as a JSON array."""
    out.write("[")
    begun = False
    for batch in arrow_batches(df.select(F.col(f"`{name}`").alias("c"))):
        for text in (json.dumps(_plain(x)) for x in batch.column(0).to_pylist()):
            out.write("," + text if begun else text)
            begun = True
    out.write("]")


def write_columns_json(df: DataFrame, out: TextIO) -> None:
    """One object with an array per column, written column by column, so no more than a partition is held."""
    out.write("{")
    for i, name in enumerate(df.columns):
        out.write(("," if i else "") + json.dumps(name) + ":")
        _write_values(df, name, out)
    out.write("}\n")


# The tags of the types of columns in a frame's JSON.
TAGS = {"double": "Float64", "boolean": "Bool", "string": "String", "bigint": "UInt64"}


def _json_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch a row with the JSON of every column's values, separated by commas."""
    for batch in batches:
        if batch.num_rows:
            texts = [json.dumps([_plain(x) for x in c.to_pylist()], separators=(",", ":"))[1:-1] for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.string()) for t in texts], batch.schema.names)


def write_frame_json(df: DataFrame, out: TextIO) -> None:
    """A series as one object: its times, and each field with its name, its type's tag and its values.

    The rows are computed once; what follows the first column waits in files on the driver's disk. The values of a batch of
    rows are a line in every array, so that :func:`read_frame_json` can take the file apart at its lines.
    """
    ts, *fields = df.schema.fields
    heads = ['{"ts_nanos":[\n']
    for i, f in enumerate(fields):
        tag = TAGS.get(f.dataType.simpleString())
        if tag is None:
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} has no tag")
        heads.append(("]}," if i else '],"columns":[') + f'{{"name":{json.dumps(f.name)},"t":"{tag}","c":[\n')
    ship(df.sparkSession)
    texts = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(_json_columns, ", ".join(f"c{i} string" for i in range(len(df.columns))))
    with ExitStack() as stack:
        later = [stack.enter_context(tempfile.TemporaryFile("w+", encoding="utf-8")) for _ in fields]
        out.write(heads[0])
        begun = False
        for row in texts.toLocalIterator():
            for target, text in zip([out, *later], row, strict=True):
                target.write("," if begun else "")
                target.write(text + "\n")
            begun = True
        for head, held in zip(heads[1:], later, strict=True):
            out.write(head)
            held.seek(0)
            while text := held.read(1 << 20):
                out.write(text)
    out.write("]}]}\n" if fields else '],"columns":[]}\n')


def read_frame_json(spark: SparkSession, path: str) -> DataFrame:
    """Series from files that :func:`write_frame_json` has made, each a single object; nulls stay nulls.

    Files are read in parallel, in parts of whole lines; those of a single line, as they were made before, one by a task.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id")]
    lines = materialize(spark.read.text(path).select(F.col("value").alias("text"), *place), "frame-lines")
    if not lines.where(F.col("text").startswith('{"ts_nanos":[') & (F.col("text") != '{"ts_nanos":[')).isEmpty():
        return _read_single_lines(spark, path)
    # lines between two heads are a column's; the heads are as few as the columns
    heads = lines.where(F.substring("text", 1, 1).isin("{", "]")).orderBy("file", "start", "id").collect()
    kinds, names = {tag: kind for kind, tag in TAGS.items()}, []
    if not heads:
        return spark.createDataFrame([], f"{TIMES} bigint")
    for h in heads:
        if h["file"] == heads[0]["file"] and '"t":"' in h["text"]:
            field = json.loads(h["text"][h["text"].index('{"name":') :] + "]}")
            names.append((field["name"], kinds[field["t"]]))
    places, seen = [], {}
    for h in heads:
        seen[h["file"]] = seen.get(h["file"], -1) + 1
        places.append((h["file"], h["start"], h["id"], seen[h["file"]]))
    placed = F.broadcast(spark.createDataFrame(places, "file string, head_start bigint, head_id bigint, column int"))
    behind = F.struct("head_start", "head_id") < F.struct("start", "id")
    values = lines.where(~F.substring("text", 1, 1).isin("{", "]"))
    # runs of lines in a part of the file, numbered by how many of their column came before them
    keys = ["file", "start", "id"]
    owned = values.select(*keys).join(placed, "file").where(behind).groupBy(*keys).agg(F.max("column").alias("column"))
    owned = materialize(owned, "frame-owned")
    runs = owned.groupBy("file", "start", "column").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file", "column").orderBy("start", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.withColumn("before", before).drop("n"), "frame-runs")
    numbered = join_small(owned, runs, ["file", "start", "column"]).select(*keys, "column", (F.col("before") + F.col("id") - F.col("first")).alias("chunk"))
    chunks = values.join(numbered, keys).groupBy("file", "chunk")
    texts = chunks.agg(*[F.max(F.when(F.col("column") == i, F.ltrim("text", F.lit(",")))).alias(f"f{i}") for i in range(len(names) + 1)])
    array = lambda i, kind: F.from_json(F.concat(F.lit("["), F.col(f"f{i}"), F.lit("]")), f"array<{kind}>", {"mode": "FAILFAST"})
    zipped = F.arrays_zip(*[array(i, kind).alias(f"f{i}") for i, kind in enumerate(["bigint", *[kind for _, kind in names]])])
    return _fields(texts.select(F.explode(zipped).alias("x")), names)


#: The name of a frame's times in its JSON.
TIMES = "ts_nanos"


def _fields(rows: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    return rows.select(F.col("x.f0").alias(TIMES), *[F.col("x")[f"f{i}"].cast(kind).alias(name) for i, (name, kind) in enumerate(names, 1)])


def _read_single_lines(spark: SparkSession, path: str) -> DataFrame:
    shape = spark.read.option("multiLine", "true").schema("ts_nanos array<bigint>, columns array<struct<name: string, t: string>>")
    first = shape.json(path).select("columns").first()
    kinds = {tag: kind for kind, tag in TAGS.items()}
    names = [(c["name"], kinds[c["t"]]) for c in first["columns"]] if first else []
    rows = spark.read.option("multiLine", "true").schema("ts_nanos array<bigint>, columns array<struct<c: array<string>>>").json(path)
    zipped = F.arrays_zip(F.col("ts_nanos").alias("f0"), *[F.col("columns")[i]["c"].alias(f"f{i + 1}") for i in range(len(names))])
    return _fields(rows.select(F.explode(zipped).alias("x")), names)


class _HadoopText(io.TextIOBase):
    """Text written to a path of any Hadoop file system, a megabyte at a time."""

    def __init__(self, df: DataFrame, path: str) -> None:
        self._held, self._size = [], 0
        fs, target = _file_system(df, path)
        self._stream = fs.create(target, True)

    def write(self, text: str) -> int:
        self._held.append(text)
        self._size += len(text)
        if self._size >= 1 << 20:
            self.flush()
        return len(text)

    def flush(self) -> None:
        if self._held:
            self._stream.write(bytearray("".join(self._held).encode()))
            self._held, self._size = [], 0

    def close(self) -> None:
        if not self.closed:
            self.flush()
            self._stream.close()
        super().close()


def _file_system(df: DataFrame, path: str):
    """The file system of a path and the path as it names it; a path without a scheme is a local one."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_parquet_file(df: DataFrame, path: str, compression: str) -> None:
    """One Parquet file at ``path``; the reader of a single file asks for it to be written by one task."""
    fs, target = _file_system(df, path)
    parts = target.suffix(f".{uuid.uuid4().hex}")
    df.coalesce(1).write.option("compression", compression).parquet(parts.toString())
    (part,) = [s.getPath() for s in fs.listStatus(parts) if s.getPath().getName().endswith(".parquet")]
    fs.mkdirs(target.getParent())
    fs.delete(target, False)
    fs.rename(part, target)
    fs.delete(parts, True)


def emit(df: DataFrame, output: Output, stream: TextIO | None = None) -> DataFrame | None:
    """Send a result to its destination; returns it for ``memory``. Folders of a file are made, the file is replaced.

    A file may lie on any file system that Spark can write to; on a cluster a local one is the executors' own for Parquet, so
    a shared path is to be named there.
    """
    if output.destination == "memory":
        return df
    if output.destination == "file":
        if output.format.startswith("parquet"):
            write_parquet_file(df, output.path, "snappy" if output.format == "parquet_snappy" else "none")
            return None
        with _HadoopText(df, output.path) as f:
            _write_text(df, output.format, f)
        return None
    _write_text(df, output.format, stream or sys.stdout)
    return None


def _write_text(df: DataFrame, kind: str, out: TextIO) -> None:
    if kind == "json":
        write_columns_json(df, out)
    else:
        out.writelines(line + "\n" for line in table_lines(df))
