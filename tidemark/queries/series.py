"""Queries of the series language and its operators over the driver's tables, with their SQL.

``events``, ``orders`` and ``lineitem`` are registered as external series; ``datapoints`` is one too, by its own times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.timestamps import epoch_nanos, format_seconds, rfc3339_nanos, seconds_of, subsecond_of, timestamp_nanos
from tidemark.operators import series
from tidemark.plans.analyze import TimeRange
from tidemark.plans.output import write_parquet_file
from tidemark.sources.database import Database
from tidemark.storage import scratch_path
from tidemark.streaming.ingest import ingest

#: The clock of today() in these queries: 2024-01-10 12:30:00 UTC.
NOW = 1_704_889_800 * 10**9

# Time column and fields of the tables read as series.
SERIES = {
    "events": ("ts", ("value", "user_id", "event_type", "event_id")),
    "orders": ("o_orderdate", ("o_totalprice", "o_custkey", "o_orderstatus", "o_orderkey")),
    "lineitem": ("l_shipdate", ("l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", "l_returnflag")),
}
COLS = {m: f"cols = [{', '.join(fields)}]" for m, (_, fields) in SERIES.items()}


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    out = Engine(spark, now=lambda: NOW)
    for metric, (ts, fields) in SERIES.items():
        out.catalog.register(metric, lambda m=metric: spark.read.parquet(f"{sf_dir}/{m}.parquet"), ts, fields)
    return out


def micros(ts: str, offset_hours: float = 0) -> str:
    """DuckDB's text of a timestamp as RFC3339 with nine digits."""
    zone = "Z" if not offset_hours else f"{'+' if offset_hours > 0 else '-'}{int(abs(offset_hours)):02}:{int(abs(offset_hours) % 1 * 60):02}"
    return f"strftime({ts} + INTERVAL ({int(offset_hours * 60)}) MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '000{zone}'"


def _language() -> dict[str, tuple[str, str]]:
    """Query text and SQL of everything that the language can say."""
    out: dict[str, tuple[str, str]] = {}
    e, ts = COLS["events"], micros("ts")
    fields = ", ".join(SERIES["events"][1])
    all_events = f"SELECT {ts} AS ts, {fields} FROM events WHERE "

    def where(name: str, condition: str, sql: str, options: str = "", shown: str = ts) -> None:
        out[name] = (f"with {e}{options} select * from events where ts {condition}", f"SELECT {shown} AS ts, {fields} FROM events WHERE {sql}")

    where("scan_star", ">= '2024-01-01'", "ts >= TIMESTAMP '2024-01-01'")
    out["project_reorder"] = (
        f"with {e} select event_type, value from events where ts >= '2024-01-15';",
        f"SELECT {ts} AS ts, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-15'",
    )
    out["project_subset"] = (
        f"with {e} select user_id from events where ts < '2024-01-15'",
        f"SELECT {ts} AS ts, user_id FROM events WHERE ts < TIMESTAMP '2024-01-15'",
    )
    out["project_ts_no_op"] = (
        f"with {e} select ts, value from events where ts < '2024-01-15'",
        f"SELECT {ts} AS ts, value FROM events WHERE ts < TIMESTAMP '2024-01-15'",
    )
    out["default_positional_names"] = (
        "select * from events where ts >= '2024-01-20'",
        f"""SELECT {ts} AS "0", value AS "1", user_id AS "2", event_type AS "3", event_id AS "4" FROM events WHERE ts >= TIMESTAMP '2024-01-20'""",
    )
    where("filter_in_range", "in ('2024-01-05', '2024-01-07 06:30')", "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07 06:30:00'")
    where("filter_in_delta_minutes", "in ('2024-01-05 03:00', +90 minutes)", "ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-05 04:30:00'")
    where("filter_in_delta_unsigned", "in ('2024-01-05 03:00', 2 hours)", "ts >= TIMESTAMP '2024-01-05 03:00:00' AND ts < TIMESTAMP '2024-01-05 05:00:00'")
    where("filter_in_clock_delta", "in ('2024-01-05', +26:15)", "ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06 02:15:00'")
    where("filter_in_anchored_delta", "in ('2024-01-05' + 1 day, + 6 hours)", "ts >= TIMESTAMP '2024-01-06' AND ts < TIMESTAMP '2024-01-06 06:00:00'")
    where("filter_in_inverted", "in ('2024-01-07', '2024-01-05')", "false")
    where("filter_gte", ">= '2024-01-11 12:00:30'", "ts >= TIMESTAMP '2024-01-11 12:00:30'")
    where("filter_gte_alt", "=> '2024-01-11 12:00:30'", "ts >= TIMESTAMP '2024-01-11 12:00:30'")
    where("filter_gt", "> '2024-01-11 12:00:30.500000000'", "ts > TIMESTAMP '2024-01-11 12:00:30.5'")
    where("filter_lte", "<= '2024-01-11 12:00:30'", "ts <= TIMESTAMP '2024-01-11 12:00:30'")
    where("filter_lte_alt", "=< '2024-01-11 12:00:30'", "ts <= TIMESTAMP '2024-01-11 12:00:30'")
    where("filter_lt", "< '2024-01-11'", "ts < TIMESTAMP '2024-01-11'")
    where("eq_day", "= '2024-01-10'", "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
    where("eq_hour", "= '2024-01-10 09:00'", "ts >= TIMESTAMP '2024-01-10 09:00:00' AND ts < TIMESTAMP '2024-01-10 10:00:00'")
    where("eq_minute", "= '2024-01-10 09:07'", "ts >= TIMESTAMP '2024-01-10 09:07:00' AND ts < TIMESTAMP '2024-01-10 09:08:00'")
    where("eq_second", "= '2024-01-10 09:07:33'", "ts >= TIMESTAMP '2024-01-10 09:07:33' AND ts < TIMESTAMP '2024-01-10 09:07:34'")
    where("eq_hour_by_delta", "= '2024-01-10' + 7 hours", "ts >= TIMESTAMP '2024-01-10 07:00:00' AND ts < TIMESTAMP '2024-01-10 08:00:00'")
    tokyo = "ts >= TIMESTAMP '2024-01-09 15:00:00' AND ts < TIMESTAMP '2024-01-10 15:00:00'"
    where("eq_day_tokyo", "= '2024-01-10'", tokyo, ", tz = Asia/Tokyo", micros("ts", 9))
    where("tz_fixed_offset_ny", "in ('2024-01-10', '2024-01-12')", "ts >= TIMESTAMP '2024-01-10 05:00:00' AND ts < TIMESTAMP '2024-01-12 05:00:00'", ", tz = America/New_York", micros("ts", -5))
    where("tz_half_hour_kolkata", "= '2024-01-10'", "ts >= TIMESTAMP '2024-01-09 18:30:00' AND ts < TIMESTAMP '2024-01-10 18:30:00'", ", tz = Asia/Kolkata", micros("ts", 5.5))
    where("tz_numeric_offset", "= '2024-01-10'", "ts >= TIMESTAMP '2024-01-10 03:30:00' AND ts < TIMESTAMP '2024-01-11 03:30:00'", ", tz = -3:30", micros("ts", -3.5))
    where("today_fixed_clock", "in today()", "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'")
    where("yesterday_fixed_clock", "= yesterday()", "ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-10'")
    where("tomorrow_fixed_clock", ">= tomorrow()", "ts >= TIMESTAMP '2024-01-11'")
    where("yesterday_clock_range", "in (yesterday(), + 9:00)", "ts >= TIMESTAMP '2024-01-09' AND ts < TIMESTAMP '2024-01-09 09:00:00'")
    where("comments_and_case", "\n // the second half\n IN ('2024-01-16',\\ +1 DAY)", "ts >= TIMESTAMP '2024-01-16' AND ts < TIMESTAMP '2024-01-17'")
    where("repeated_option", "= '2024-01-10'", tokyo, ", tz = UTC, tz = Asia/Tokyo", micros("ts", 9))
    where("format_rfc3339_nanos", "= '2024-01-12'", "ts >= TIMESTAMP '2024-01-12' AND ts < TIMESTAMP '2024-01-13'")
    where("format_rfc3339_tokyo", ">= '2024-01-12'", "ts >= TIMESTAMP '2024-01-11 15:00:00'", ", tz = Asia/Tokyo", micros("ts", 9))
    for metric in ("orders", "lineitem"):
        ts_col, names = SERIES[metric]
        shown, picked = micros(ts_col), ", ".join(names)
        cases = {
            f"head_n_gte_{metric}": (">=|3 '1998-01-01'", f"{ts_col} >= TIMESTAMP '1998-01-01'", "ASC", 3),
            f"head_n_gt_{metric}": (">|4 '1998-01-02'", f"{ts_col} > TIMESTAMP '1998-01-02'", "ASC", 4),
            f"tail_n_lte_{metric}": ("<=|5 '1998-01-03'", f"{ts_col} <= TIMESTAMP '1998-01-03'", "DESC", 5),
            f"tail_n_lt_{metric}": ("<|3 '1998-01-01'", f"{ts_col} < TIMESTAMP '1998-01-01'", "DESC", 3),
            f"limit_zero_{metric}": (">=|0 '1998-01-01'", f"{ts_col} >= TIMESTAMP '1998-01-01'", "ASC", 0),
            f"limit_over_size_{metric}": ("=<|99999 '1996-06-30'", f"{ts_col} <= TIMESTAMP '1996-06-30'", "DESC", 99999),
        }
        for name, (condition, sql, way, n) in cases.items():
            out[name] = (
                f"with {COLS[metric]} select * from {metric} where ts {condition}",
                f"SELECT {shown} AS ts, {picked} FROM (SELECT *, dense_rank() OVER (ORDER BY {ts_col} {way}) AS r FROM {metric} WHERE {sql}) WHERE r <= {n}",
            )
    return out


def _run(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir).query(text)


_DAYS = """SELECT '{m}' AS metric, date_diff('day', DATE '1970-01-01', {ts}::DATE) AS d, epoch_us(min({ts})) // 1000000 AS since,
 epoch_us(max({ts})) // 1000000 + 1 AS until, count(DISTINCT {ts}) AS n FROM {m} WHERE {ts} IS NOT NULL GROUP BY ALL"""
_BLOCKS = " UNION ALL ".join(_DAYS.format(m=m, ts=ts) for m, (ts, _) in SERIES.items())


def _meta(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir).query(name)
        return df.select(*[F.unix_seconds(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])

    return run


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).catalog.series("events", TimeRange())


EVENT_NANOS = "epoch_us(ts) * 1000 AS ts_nanos, value, user_id, event_type, event_id"
WEEK = (1_704_672_000 * 10**9, 1_705_276_800 * 10**9)  # 2024-01-08 .. 2024-01-15
IN_WEEK = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"


def epoch_nanos_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    nanos = timestamp_nanos(F.col("ts"), "timestamp_ntz")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", nanos.alias("ts_nanos"), seconds_of(nanos).alias("sec"), subsecond_of(nanos).alias("sub"))


def epoch_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    mixed = F.expr("case when o_orderkey % 2 = 0 then 1600000000L + o_orderkey else (1600000000L + o_orderkey) * 1000000000L + 7 end")
    return rows.select("o_orderkey", epoch_nanos(mixed).alias("ts_nanos"))


def rfc3339_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/trades.parquet").select("row_id", rfc3339_nanos(F.col("exec_date")).cast("string").alias("ts_nanos"))


def format_seconds_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/block_manifest.parquet").select("block_id", "updated_at_nanos", format_seconds(F.col("since_sec")).alias("since"))


def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return series.ordered(series.merge(rows.where("value < 60"), rows.where("value > 40")))


def disjoint_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, within, after = series.split(events(spark, sf_dir), TimeRange(*WEEK))
    return series.ordered(series.merge(before, within, after))


def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.clip(events(spark, sf_dir), TimeRange.from_texts("1704672000", "2024-01-15T00:00:00Z"))


def purge_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.purge(events(spark, sf_dir), TimeRange(*WEEK))


def unique_ts_per_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/datapoints.parquet").where("ts_nanos is not null and block_id is not null")
    return series.block_stats(rows, ["metric", "block_id"])


def metric_hull(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hull(spark.read.parquet(f"{sf_dir}/block_manifest.parquet"))


def custom_sorter_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = engine(spark, sf_dir).catalog.series("orders", TimeRange())
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("ts_nanos").orderBy("o_orderstatus", F.col("o_totalprice").desc(), "o_orderkey"))
    return series.ordered(rows.withColumn("place", place).select("ts_nanos", "o_orderkey", "place"), ["place"])


def _stored(spark: SparkSession, sf_dir: str) -> Database:
    """Two overlapping blocks of events in a new database."""
    database = Database(spark, scratch_path(spark, "db"))
    rows = events(spark, sf_dir)
    database.write_block("events", rows.where("event_id % 2 = 0"), block_id="even")
    database.write_block("events", rows.where("event_id % 2 = 1"), block_id="odd")
    return database


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).series("events")


def stored_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).series("events", TimeRange(*WEEK))


def persist_range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = Database(spark, scratch_path(spark, "db"))
    before, within, after = series.split(events(spark, sf_dir), TimeRange(*WEEK))
    for name, part in (("a", before), ("b", within), ("c", after)):
        database.write_block("events", part, block_id=name)
    return database.manifest().select("metric", "block_id", "since_sec", "until_sec", "timestamp_num")


def repair_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    database = _stored(spark, sf_dir)
    database.repair()
    return database.manifest().select("metric", "block_id", "since_sec", "until_sec", "timestamp_num")


def parquet_snappy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "file") + ".parquet"
    write_parquet_file(series.ordered(events(spark, sf_dir)), path, "snappy")
    return spark.read.parquet(path)


def stream_ingest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a file stream, cut into several micro-batches, into blocks."""
    source, database = scratch_path(spark, "stream-source"), Database(spark, scratch_path(spark, "db"))
    events(spark, sf_dir).repartition(4, "event_id").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    ingest(stream, database, "events", scratch_path(spark, "checkpoint")).awaitTermination()
    return database.series("events")


def columnar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON output of all events, one object with an array for each column, in a file: its length in bytes and hash."""
    path = scratch_path(spark, "file") + ".json"
    engine(spark, sf_dir).run(f"with {COLS['events']}, format = json, output_file = '{path}' select * from events where ts >= '1970-01-01'")
    whole = spark.read.format("binaryFile").load(path)
    return whole.select(F.col("length").alias("json_bytes"), F.md5("content").alias("json_md5"))


_PLAIN = [
    epoch_nanos_long, epoch_heuristic, rfc3339_parse, format_seconds_text, overlap_merge, disjoint_append, range_search, purge_range, unique_ts_per_block,
    metric_hull, custom_sorter_tiebreak, parquet_roundtrip, stored_range, persist_range_split, repair_manifest, parquet_snappy_roundtrip, stream_ingest_roundtrip, columnar_json,
]
_LANGUAGE = _language()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _run(text) for name, (text, _) in _LANGUAGE.items()}
QUERIES |= {f.__name__: f for f in _PLAIN}
QUERIES |= {
    "list_metrics": _meta("select * from .metrics"),
    "describe_metrics": _meta("select * from .describe"),
    "describe_one_metric": _meta("select * from .describe where metrics = orders"),
    "describe_ignores_ts": _meta("select * from .describe where ts >= '2024-01-01'"),
    "block_list": _meta("select * from .block_list"),
    "block_list_one_metric": _meta("select * from .block_list where metrics = events;"),
}

_DESCRIBE = f'SELECT metric AS metrics, max(until) AS updated_at, count(*) AS block_num, min(since) AS "from", max(until) AS "end" FROM ({_BLOCKS})'
_LIST = f"""SELECT metric AS metrics, max(until) OVER (PARTITION BY metric) AS updated_at, count(*) OVER (PARTITION BY metric) AS block_num,
 row_number() OVER (PARTITION BY metric ORDER BY until, d) AS seq, since AS block_list_start, until AS block_list_end FROM ({_BLOCKS})"""
_BY_PARITY = """SELECT 'events' AS metric, CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS block_id, epoch_us(min(ts)) // 1000000 AS since_sec,
 epoch_us(max(ts)) // 1000000 + 1 AS until_sec, count(DISTINCT ts) AS timestamp_num FROM events GROUP BY ALL"""
_IDENTITY = f"SELECT {EVENT_NANOS} FROM events"
_JSON_ARRAYS = " || ',' || ".join(
    f"""'"{c}":[' || coalesce(string_agg(coalesce(CAST(to_json({v}) AS VARCHAR), 'null'), ',' ORDER BY ts), '') || ']'"""
    for c, v in (("ts", micros("ts")), *((c, c) for c in SERIES["events"][1]))
)

ORACLES: dict[str, str] = {name: sql for name, (_, sql) in _LANGUAGE.items()}
ORACLES |= {
    "list_metrics": "SELECT unnest(['events', 'lineitem', 'orders']) AS metrics",
    "describe_metrics": f"{_DESCRIBE} GROUP BY metric",
    "describe_one_metric": f"{_DESCRIBE} WHERE metric = 'orders' GROUP BY metric",
    "describe_ignores_ts": f"{_DESCRIBE} GROUP BY metric",
    "block_list": _LIST,
    "block_list_one_metric": f"SELECT * FROM ({_LIST}) WHERE metrics = 'events'",
    "epoch_nanos_long": "SELECT event_id, epoch_us(ts) * 1000 AS ts_nanos, epoch_us(ts) // 1000000 AS sec, (epoch_us(ts) % 1000000) * 1000 AS sub FROM events",
    "epoch_heuristic": "SELECT o_orderkey, (1600000000 + o_orderkey) * 1000000000 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 7 END AS ts_nanos FROM orders",
    "rfc3339_parse": """SELECT row_id, CASE WHEN exec_date IS NOT NULL THEN epoch_us(date_trunc('second', upper(exec_date)::TIMESTAMPTZ)) * 1000
 + rpad(regexp_extract(exec_date, '\\.(\\d+)', 1), 9, '0')::BIGINT END::VARCHAR AS ts_nanos FROM trades""",
    "format_seconds_text": "SELECT block_id, updated_at_nanos, strftime(make_timestamp(since_sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS since FROM block_manifest",
    "overlap_merge": f"{_IDENTITY} WHERE value < 60 UNION ALL {_IDENTITY} WHERE value > 40",
    "disjoint_append": _IDENTITY,
    "columnar_json": f"SELECT strlen(j) AS json_bytes, md5(j) AS json_md5 FROM (SELECT '{{' || {_JSON_ARRAYS} || '}}' || chr(10) AS j FROM events WHERE ts >= TIMESTAMP '1970-01-01')",
    "range_search": f"{_IDENTITY} WHERE {IN_WEEK}",
    "purge_range": f"{_IDENTITY} WHERE NOT ({IN_WEEK})",
    "unique_ts_per_block": """SELECT metric, block_id, min(ts_nanos) // 1000000000 AS since_sec, max(ts_nanos) // 1000000000 + 1 AS until_sec,
 count(DISTINCT ts_nanos) AS timestamp_num FROM datapoints WHERE ts_nanos IS NOT NULL AND block_id IS NOT NULL GROUP BY ALL""",
    "metric_hull": "SELECT min(since_sec) AS since_sec, max(until_sec) AS until_sec FROM block_manifest",
    "custom_sorter_tiebreak": """SELECT epoch_us(o_orderdate) * 1000 AS ts_nanos, o_orderkey,
 row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM orders""",
    "parquet_roundtrip": _IDENTITY,
    "stored_range": f"{_IDENTITY} WHERE {IN_WEEK}",
    "persist_range_split": """SELECT 'events' AS metric, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'a' WHEN ts < TIMESTAMP '2024-01-15' THEN 'b' ELSE 'c' END AS block_id,
 epoch_us(min(ts)) // 1000000 AS since_sec, epoch_us(max(ts)) // 1000000 + 1 AS until_sec, count(DISTINCT ts) AS timestamp_num FROM events GROUP BY ALL""",
    "repair_manifest": _BY_PARITY,
    "parquet_snappy_roundtrip": _IDENTITY,
    "stream_ingest_roundtrip": _IDENTITY,
}
