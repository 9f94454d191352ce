"""A Spark data source for databases of binary block files: ``block/<metric>/<n>/<since>_<until>/block`` and
``block_list/<metric>.list`` below a folder that every executor can reach.

    spark.dataSource.register(BlockFiles)
    spark.read.format("tidemark_blocks").option("metric", "trades").load("/data/db")

Each block is one partition, as it is decoded as a whole. A range (``since``, ``until``, in nanoseconds) picks the blocks
from the list and is applied to their rows. Writing makes one block of each partition's rows.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from tidemark.sources import block_codec as codec
from tidemark.sources.database import check_metric_name

#: Seconds of a folder of blocks.
FOLDER_SECONDS = 100_000


def block_path(root: str, metric: str, since: int, until: int) -> Path:
    return Path(root) / "block" / metric / str(since // FOLDER_SECONDS) / f"{since}_{until}" / "block"


def list_path(root: str, metric: str) -> Path:
    return Path(root) / "block_list" / f"{metric}.list"


def metrics_of(root: str) -> list[str]:
    """The metrics that have a block list."""
    return sorted(p.name.removesuffix(".list") for p in (Path(root) / "block_list").glob("*.list"))


@dataclass
class Block(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    blocks: list[tuple[int, int, int]]


class BlockFiles(DataSource):
    """Options: ``path``, ``metric``, and for reading ``since`` and ``until``."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_blocks"

    def _where(self) -> tuple[str, str]:
        return self.options["path"].removeprefix("file://"), check_metric_name(self.options["metric"])

    def schema(self) -> StructType:
        root, metric = self._where()
        listed = codec.decode_list(list_path(root, metric).read_bytes())
        types = codec.block_types(block_path(root, metric, int(listed.since[0]), int(listed.until[0])).read_bytes())
        kinds = {codec.FLOAT: DoubleType(), codec.BOOL: BooleanType()}
        return StructType([StructField("ts_nanos", LongType()), *[StructField(f"c{i}", kinds[t]) for i, t in enumerate(types)]])

    def reader(self, schema: StructType) -> BlockReader:
        root, metric = self._where()
        bounds = [int(self.options[k]) if k in self.options else None for k in ("since", "until")]
        return BlockReader(root, metric, schema, *bounds)

    def writer(self, schema: StructType, overwrite: bool) -> BlockWriter:
        return BlockWriter(*self._where(), schema, overwrite)


class BlockReader(DataSourceReader):
    def __init__(self, root: str, metric: str, schema: StructType, since: int | None, until: int | None) -> None:
        self.root, self.metric, self.since, self.until = root, metric, since, until
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> Sequence[InputPartition]:
        listed = codec.decode_list(list_path(self.root, self.metric).read_bytes())
        pairs = sorted(set(zip(listed.since.tolist(), listed.until.tolist(), strict=True)))
        second = codec.SECOND
        return [
            Block(str(block_path(self.root, self.metric, a, b)))
            for a, b in pairs
            if (self.since is None or b * second > self.since) and (self.until is None or a * second < self.until)
        ]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        wanted = {int(n[1:]) for n in self.names if n != "ts_nanos"}
        ts, fields = codec.decode_block(Path(partition.path).read_bytes(), wanted)
        low = 0 if self.since is None else int(np.searchsorted(ts, self.since))
        high = len(ts) if self.until is None else int(np.searchsorted(ts, self.until))
        columns = [ts if n == "ts_nanos" else fields[int(n[1:])] for n in self.names]
        yield pa.RecordBatch.from_arrays([pa.array(c[low:high]) for c in columns], self.names)


class BlockWriter(DataSourceWriter):
    def __init__(self, root: str, metric: str, schema: StructType, overwrite: bool) -> None:
        self.root, self.metric, self.overwrite = root, metric, overwrite
        self.types = [f.dataType for f in schema.fields]
        if not self.types or self.types[0] != LongType() or not all(isinstance(t, DoubleType | BooleanType) for t in self.types[1:]):
            raise TypeError("a block has a bigint time and double or boolean fields")

    def write(self, iterator: Iterator) -> Written:
        rows = sorted((tuple(r) for r in iterator), key=lambda r: r[0])
        if not rows:
            return Written([])
        if any(x is None for r in rows for x in r):
            raise ValueError("a block can't hold nulls")
        columns = list(zip(*rows, strict=True))
        ts = np.array(columns[0], np.int64)
        fields = [np.array(c, bool if isinstance(t, BooleanType) else float) for c, t in zip(columns[1:], self.types[1:], strict=True)]
        since, until = int(ts[0]) // codec.SECOND, int(ts[-1]) // codec.SECOND + 1
        path = block_path(self.root, self.metric, since, until)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_name(f"block.{os.getpid()}.{time.time_ns()}")
        part.write_bytes(codec.encode_block(ts, fields))
        try:
            os.link(part, path)  # fails if another partition has written a block of the same seconds
        finally:
            part.unlink()
        return Written([(since, until, len(np.unique(ts)))])

    def commit(self, messages: list) -> None:
        blocks = [b for m in messages if m for b in m.blocks]
        path = list_path(self.root, self.metric)
        if path.exists() and not self.overwrite:
            held = codec.decode_list(path.read_bytes())
            blocks += list(zip(held.since.tolist(), held.until.tolist(), held.timestamps.tolist(), strict=True))
        if not blocks:
            return
        blocks.sort(key=lambda b: (b[1], b[0]))
        since, until, timestamps = (np.array(x, np.int64) for x in zip(*blocks, strict=True))
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_bytes(codec.encode_list(codec.BlockList(time.time_ns(), since, until, timestamps)))
        part.replace(path)

    def abort(self, messages: list) -> None:
        for m in messages:
            for since, until, _ in m.blocks if m else []:
                block_path(self.root, self.metric, since, until).unlink(missing_ok=True)
