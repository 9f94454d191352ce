"""From an analysed query to a DataFrame; the plan is Catalyst's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import floor_div, format_nanos
from tidemark.operators.series import TS, clip, limit_distinct
from tidemark.plans.analyze import MetaQuery, SeriesQuery, zone_suffix
from tidemark.plans.grammar import QueryError
from tidemark.sources.catalog import Catalog

_TIME = "__tidemark_ts"


def _projection(query: SeriesQuery, fields: list[str]) -> list[tuple[str, str]]:
    """(field, output name) in order; only these fields are read."""
    if query.selected is None:
        if query.names is None:
            return [(f, str(i + 1)) for i, f in enumerate(fields)]
        if len(query.names) != len(fields):
            raise QueryError(f"cols names {len(query.names)} columns, the metric has {len(fields)}")
        return list(zip(fields, query.names, strict=True))
    out = []
    for name in query.selected:
        at = query.names.index(name)
        if at >= len(fields):
            raise QueryError(f"{name} is column {at + 1}, the metric has {len(fields)}")
        out.append((fields[at], name))
    return out


def build_series(catalog: Catalog, query: SeriesQuery) -> DataFrame:
    """The rows in ascending time. The time comes first, as RFC3339 text or, unformatted, in nanoseconds since the epoch."""
    source = catalog.series(query.metric, query.range, query.database, query.refresh, query.limit)
    return project_series(source, query)


def project_series(source: DataFrame, query: SeriesQuery) -> DataFrame:
    projection = _projection(query, source.columns[1:])
    rows = clip(source, query.range)
    if query.limit is not None:
        rows = limit_distinct(rows, query.limit)
    time = F.col(TS)
    shown = format_nanos(time, query.offset, zone_suffix(query)) if query.format_datetime else time
    picked = rows.select(time.alias(_TIME), shown.alias("_shown"), *[F.col(f).alias(f"_f{i}") for i, (f, _) in enumerate(projection)])
    names = ["ts" if query.names is not None else "0", *[n for _, n in projection]]
    return picked.orderBy(_TIME).drop(_TIME).toDF(*names)


def build_meta(catalog: Catalog, query: MetaQuery) -> DataFrame:
    """The metadata tables; an unknown metric is an error."""
    database = catalog.database(query.database)
    if query.refresh and database is not None:
        database.refresh()
    manifest = catalog.manifest(query.database)
    if query.table == ".metrics":
        return manifest.select(F.col("metric").alias("metrics")).distinct().orderBy("metrics")
    if query.metric is not None:
        manifest = manifest.where(F.col("metric") == query.metric)
        if not manifest.limit(1).count():
            raise LookupError(f"no such metric: {query.metric}")
    by_metric = Window.partitionBy("metric")
    updated = F.timestamp_micros(floor_div(F.max("updated_at_nanos"), 1000))
    if query.table == ".describe":
        return (
            manifest.groupBy(F.col("metric").alias("metrics"))
            .agg(
                updated.alias("updated_at"),
                F.count(F.lit(1)).alias("block_num"),
                F.timestamp_seconds(F.min("since_sec")).alias("from"),
                F.timestamp_seconds(F.max("until_sec")).alias("end"),
            )
            .orderBy("metrics")
        )
    order = by_metric.orderBy("until_sec", "updated_at_nanos", "block_id")
    return manifest.select(
        F.col("metric").alias("metrics"),
        F.timestamp_micros(floor_div(F.max("updated_at_nanos").over(by_metric), 1000)).alias("updated_at"),
        F.count(F.lit(1)).over(by_metric).alias("block_num"),
        F.row_number().over(order).cast("bigint").alias("seq"),
        F.timestamp_seconds("since_sec").alias("block_list_start"),
        F.timestamp_seconds("until_sec").alias("block_list_end"),
    ).orderBy("metrics", "seq")
