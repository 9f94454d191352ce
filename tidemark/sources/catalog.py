"""What queries can name: databases of stored series, and tables from elsewhere that are read as series."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import timestamp_nanos
from tidemark.operators.series import TS, block_stats, clip
from tidemark.plans.analyze import Limit, TimeRange
from tidemark.sources.database import MANIFEST, Database, check_metric_name

DAY_NANOS = 86_400 * 10**9


@dataclass(frozen=True)
class External:
    """A table read as a series: its time column and fields; it is listed as one block per UTC day."""

    load: Callable[[], DataFrame]
    ts: str
    fields: tuple[str, ...]

    def series(self, bounds: TimeRange = TimeRange()) -> DataFrame:
        """The range is pushed to the scan as one on the time column itself where the column's type allows."""
        table = self.load()
        kind = dict(table.dtypes)[self.ts]
        if kind in ("timestamp_ntz", "timestamp", "date"):
            table = table.where(_typed_range(self.ts, kind, bounds))
        nanos = timestamp_nanos(F.col(self.ts), kind).alias(TS)
        return clip(table.select(nanos, *[F.col(c) for c in self.fields]), bounds)

    def manifest(self, metric: str) -> DataFrame:
        day = F.call_function("div", F.col(TS) - F.pmod(F.col(TS), F.lit(DAY_NANOS)), F.lit(DAY_NANOS))
        named = self.series().withColumn("block_id", F.format_string("day%06d", day)).withColumn("metric", F.lit(metric))
        return block_stats(named, ["metric", "block_id"]).withColumn("updated_at_nanos", F.col("until_sec") * F.lit(10**9))


def _typed_range(ts: str, kind: str, bounds: TimeRange) -> Column:
    """A range on a timestamp or date column, as literals that Parquet can compare; at most a microsecond, or for dates a
    day, too wide.
    """

    def literal(micros: int) -> Column:
        if kind == "timestamp":
            return F.timestamp_micros(F.lit(min(max(micros, -(2**62)), 2**62)))
        return F.lit(_ntz(micros)).cast("timestamp_ntz").cast(kind)

    test = F.col(ts).isNotNull()
    if bounds.since is not None:
        test = test & (F.col(ts) >= literal(bounds.since // 1000))
    if bounds.until is not None:
        test = test & (F.col(ts) <= literal(-(-bounds.until // 1000)))
    return test


def _ntz(micros: int) -> str:
    from datetime import datetime, timedelta

    limits = (-62_135_596_800_000_000, 253_402_300_799_999_999)
    return str(datetime(1970, 1, 1) + timedelta(microseconds=min(max(micros, limits[0]), limits[1])))


@dataclass
class Catalog:
    """Named databases, one of which may be the default, and external series of any database."""

    spark: SparkSession
    databases: dict[str, Database] = field(default_factory=dict)
    default: str | None = None
    externals: dict[str, External] = field(default_factory=dict)

    @classmethod
    def from_specs(cls, spark: SparkSession, specs: Sequence[str], default: str | None = None) -> Catalog:
        """From ``name=path`` texts; a bare ``path`` is named by its last part."""
        out = cls(spark, default=default)
        for spec in specs:
            m = re.fullmatch(r"(?:([A-Za-z0-9_-]+)=)?(.+)", spec)
            out.add(m[1] or m[2].rstrip("/").rpartition("/")[2], m[2])
        return out

    def add(self, name: str, root: str) -> Database:
        self.databases[name] = Database(self.spark, root)
        return self.databases[name]

    def register(self, metric: str, load: Callable[[], DataFrame], ts: str, fields: Sequence[str]) -> None:
        self.externals[check_metric_name(metric)] = External(load, ts, tuple(fields))

    def database(self, name: str | None) -> Database | None:
        """The named database, else the only one, else the default; None if there are only external series."""
        if name is not None:
            if name not in self.databases:
                raise LookupError(f"no such database: {name}")
            return self.databases[name]
        if len(self.databases) == 1:
            return next(iter(self.databases.values()))
        if self.default is not None:
            return self.database(self.default)
        if self.databases:
            raise LookupError("name a database with db=..., or set a default")
        return None

    def series(
        self, metric: str, bounds: TimeRange, database: str | None = None, refresh: bool = False, limit: Limit | None = None
    ) -> DataFrame:
        """Rows of a metric in a range; of stored ones, with a limit to come, only those that the limit can need."""
        if metric in self.externals and database is None:
            return self.externals[metric].series(bounds)
        held = self.database(database)
        if held is None:
            raise LookupError(f"no such metric: {metric}")
        if refresh:
            held.refresh(metric)
        return held.series(metric, held.narrowed(metric, bounds, limit) if limit else bounds)

    def manifest(self, database: str | None = None) -> DataFrame:
        held = self.database(database)
        out = held.manifest() if held else self.spark.createDataFrame([], MANIFEST)
        if database is None:
            for metric, external in self.externals.items():
                out = out.unionByName(external.manifest(metric))
        return out
