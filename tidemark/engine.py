"""The front door: queries as text in, DataFrames or files out."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Sequence
from typing import TextIO

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.analyze import MetaQuery, SeriesQuery, analyze
from tidemark.plans.build import build_meta, build_series
from tidemark.plans.grammar import parse
from tidemark.plans.output import emit
from tidemark.sources.catalog import Catalog
from tidemark.sources.store import WritableStore
from tidemark.storage import ship


class Engine:
    """Runs queries over a catalog.

    ``now`` returns the clock's nanoseconds for today() and its kin. ``legacy_granule`` keeps the older sub-second
    lengths of equality filters. Of queries with ``use_cache`` the last ``cache`` results are kept, and of the same query
    taken from there; ``force_sync_cloud`` computes it anew.
    """

    def __init__(
        self,
        spark: SparkSession,
        databases: Sequence[str] = (),
        *,
        default_database: str | None = None,
        now: Callable[[], int] | None = None,
        legacy_granule: bool = False,
        cache: int = 0,
    ) -> None:
        self.spark, self.now, self.legacy_granule, self.cache = spark, now, legacy_granule, cache
        self._kept: OrderedDict[str, DataFrame] = OrderedDict()
        ship(spark)
        self.catalog = Catalog.from_specs(spark, databases, default_database)

    def analyze(self, text: str) -> SeriesQuery | MetaQuery:
        return analyze(parse(text), now=self.now() if self.now else None, legacy_granule=self.legacy_granule)

    def query(self, text: str) -> DataFrame:
        """The result of a query, wherever its options would send it."""
        return self._build(self.analyze(text))

    def _build(self, query: SeriesQuery | MetaQuery) -> DataFrame:
        if isinstance(query, MetaQuery):
            return build_meta(self.catalog, query)
        if not self.cache or not query.use_cache:
            return build_series(self.catalog, query)
        key = repr(query)
        if query.refresh and key in self._kept:
            self._kept.pop(key).unpersist()
        if key not in self._kept:
            self._kept[key] = build_series(self.catalog, query).persist(StorageLevel.MEMORY_AND_DISK)
        self._kept.move_to_end(key)
        while len(self._kept) > self.cache:
            self._kept.popitem(last=False)[1].unpersist()
        return self._kept[key]

    def run(self, text: str, stream: TextIO | None = None) -> DataFrame | None:
        """Run a query and send its result where its options say; it is returned for ``output_to_memory``."""
        query = self.analyze(text)
        return emit(self._build(query), query.output, stream)

    def writable_store(self, metric: str, field_types: Sequence[str], *, database: str | None = None, **options) -> WritableStore:
        """A store for datapoints of ``metric``; persisted blocks go to the database, if there is one."""
        return WritableStore(self.spark, metric, field_types, database=self.catalog.database(database), **options)

    def repair(self, database: str | None = None) -> DataFrame:
        """Rebuild a database's manifest from what can be read."""
        held = self.catalog.database(database)
        if held is None:
            raise LookupError("there is no database to repair")
        return held.repair()
