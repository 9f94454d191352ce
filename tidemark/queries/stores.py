"""Queries that write something and read it back: stores with their log, databases, block files, streams and output files.

They run over the whole of ``events``, ``orders`` or ``trades``; what they read back is compared with the tables by SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.operators import series
from tidemark.operators.series import TS
from tidemark.plans.analyze import TimeRange
from tidemark.plans.output import arrow_batches, read_frame_json, write_frame_json
from tidemark.queries.series import COLS, EVENT_NANOS, IN_WEEK, NOW, WEEK, engine, events, micros
from tidemark.sources.block_files import BlockFiles
from tidemark.sources.database import Database
from tidemark.sources.json_trades import read_trades
from tidemark.sources.store import WritableStore
from tidemark.storage import scratch_path
from tidemark.streaming.ingest import ingest, release_due

FIELDS = ("double", "bigint", "string", "bigint")
NAMES = ("value", "user_id", "event_type", "event_id")


#: Points of a turn at most.
TURN = 250_000


def _push(store: WritableStore, rows: DataFrame) -> None:
    """Push all rows, in four turns or more; each takes its rows from everywhere in the table, and the driver holds one turn."""
    n = rows.count()
    size = min(TURN, max(1, -(-n // 4)))
    held = []
    for batch in arrow_batches(rows.repartition(max(4, -(-n // TURN)))):
        held.append(batch)
        if sum(b.num_rows for b in held) >= size:
            store.push_columns(pa.Table.from_batches(held))
            held = []
    if held:
        store.push_columns(pa.Table.from_batches(held))


def _pushed(spark: SparkSession, sf_dir: str, database: Database | None = None, wal: str | None = None) -> WritableStore:
    """A store to which all events were pushed."""
    store = WritableStore(spark, "events", FIELDS, database=database, wal_dir=wal)
    _push(store, events(spark, sf_dir))
    return store


def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new store finds in the log of one that went away."""
    wal = scratch_path(spark, "wal")
    _pushed(spark, sf_dir, wal=wal)
    return WritableStore(spark, "events", FIELDS, wal_dir=wal).frame().toDF(TS, *NAMES)


def wal_after_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log holds just what wasn't persisted."""
    wal = scratch_path(spark, "wal")
    _pushed(spark, sf_dir, Database(spark, scratch_path(spark, "db")), wal).persist(TimeRange(*WEEK))
    return WritableStore(spark, "events", FIELDS, wal_dir=wal).frame().toDF(TS, *NAMES)


def store_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _pushed(spark, sf_dir)
    store.purge(TimeRange(*WEEK))
    return store.frame().toDF(TS, *NAMES)


def store_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The persisted range from the database, the rest from the store."""
    database = Database(spark, scratch_path(spark, "db"))
    store = _pushed(spark, sf_dir, database)
    store.persist(TimeRange(*WEEK))
    stored = database.series("events").toDF(TS, *NAMES).withColumn("stored", F.lit(True))
    return stored.unionByName(store.frame().toDF(TS, *NAMES).withColumn("stored", F.lit(False)))


def store_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points in a range and their places among all points."""
    points, places = _pushed(spark, sf_dir).search(TimeRange(*WEEK))
    return spark.createDataFrame([(len(points), places.start, places.stop, points[0][0], points[-1][0])], "points int, low int, high int, first bigint, last bigint")


def store_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the last five distinct times."""
    store = _pushed(spark, sf_dir)
    return store.frame(store.tail(5)).toDF(TS, *NAMES)


def store_sorter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one day in the order that the store's own sorter gives them."""
    store = WritableStore(spark, "orders", ("double", "bigint"), sorter=lambda p: (-p[1][0], p[1][1]))
    rows = engine(spark, sf_dir).catalog.series("orders", TimeRange()).select(TS, F.col("o_totalprice").cast("double"), "o_orderkey")
    _push(store, rows)
    places = F.row_number().over(Window.partitionBy(TS).orderBy("at")).alias("place")
    return store.frame(place="at").select(TS, F.col("c1").alias("o_orderkey"), places)


def block_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as binary block files and back: packed times, floats and bits."""
    path = scratch_path(spark, "blocks").removeprefix("file://")
    spark.dataSource.register(BlockFiles)
    rows = events(spark, sf_dir).select(TS, "value", (F.col("event_type") == "click").alias("is_click"))
    rows.repartitionByRange(4, TS).write.format("tidemark_blocks").option("metric", "events").mode("append").save(path)
    return spark.read.format("tidemark_blocks").option("metric", "events").load(path).toDF(TS, "value", "is_click")


def json_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    spark.read.parquet(f"{sf_dir}/trades.parquet").select("exec_date", "side", "price", "size").write.option("ignoreNullFields", "false").json(path)
    lines = read_trades(spark, path, lines=True)
    return lines.select(F.col(TS).cast("string").alias(TS), "is_buy", F.when(~F.isnan("price"), F.col("price")).alias("price"))


def frame_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series as one object with its types' tags, and back."""
    path = scratch_path(spark, "frame") + ".json"
    from tidemark.plans.output import _HadoopText

    rows = series.ordered(events(spark, sf_dir))
    with _HadoopText(rows, path) as out:
        write_frame_json(rows, out)
    return read_frame_json(spark, path)


def parquet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's own Parquet file in the shared folder."""
    path = scratch_path(spark, "file") + ".parquet"
    engine(spark, sf_dir).run(f"with {COLS['events']}, format = parquet, output_file = '{path}' select value, event_id from events where ts >= '2024-01-01'")
    return spark.read.parquet(path)


def table_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of a bordered table in a file."""
    path = scratch_path(spark, "file") + ".txt"
    engine(spark, sf_dir).run(f"with {COLS['events']}, format = table, output_file = '{path}' select event_type, event_id from events where ts >= '2024-01-01'")
    cells = F.split(F.col("value"), r"\|")
    lines = spark.read.text(path).where("value like '| 2%'").select(*[F.trim(cells[i]).alias(n) for i, n in ((1, "ts"), (2, "event_type"), (3, "event_id"))])
    return lines.withColumn("event_id", F.col("event_id").cast("bigint"))


def memory_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).run(f"with {COLS['events']}, output_to_memory select user_id from events where ts = '2024-01-10'")


def unformatted_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir).query(f"with {COLS['events']}, format_datetime = false select event_id from events where ts >= '2024-01-05'")


def _by_day(spark: SparkSession, sf_dir: str) -> Database:
    """Events in a block for each of three thirds of their time, and a late block that overlaps all of them."""
    database = Database(spark, scratch_path(spark, "db"))
    rows = events(spark, sf_dir)
    late = F.col("event_id") % 10 == 0
    for name, part in zip("abc", series.split(rows.where(~late), TimeRange(*WEEK)), strict=True):
        database.write_block("events", part, block_id=name)
    database.write_block("events", rows.where(late), block_id="late")
    return database


def blocks_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that a range is read from, and its rows: those the manifest lists for it."""
    found = _by_day(spark, sf_dir).series("events", TimeRange(*WEEK))
    return found.select(F.regexp_extract(F.input_file_name(), "block_id=([^/]+)", 1).alias("block_id")).groupBy("block_id").agg(F.count(F.lit(1)).alias("n"))


def stored_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last distinct times of a stored series, with the range that the manifest narrows."""
    database = _by_day(spark, sf_dir)
    both = Engine(spark, [f"days={database.root}"], now=lambda: NOW)
    return both.query(f"with {COLS['events']} select event_id, value from events where ts <=|7 '2024-01-14 23:00'")


def named_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two databases hold a metric of one name; the query names one."""
    roots = {name: scratch_path(spark, "db") for name in ("first", "second")}
    rows = events(spark, sf_dir)
    for name, root in roots.items():
        Database(spark, root).write_block("events", rows.where((F.col("value") > 50) == F.lit(name == "first")), block_id="b")
    both = Engine(spark, [f"{k}={v}" for k, v in roots.items()], default_database="first", now=lambda: NOW)
    return both.query(f"with {COLS['events']}, db = second select value, event_id from events where ts >= '2024-01-01'")


def repair_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three blocks, one without its files, one with files that aren't Parquet: the manifest lists what can be read."""
    database = _by_day(spark, sf_dir)
    database._fs().delete(database._path("block", "events", "block_id=a"), True)
    for folder in database._fs().listStatus(database._path("block", "events", "block_id=late")):
        if folder.isDirectory():
            for status in database._fs().listStatus(folder.getPath()):
                out = database._fs().create(status.getPath(), True)
                out.write(bytearray(b"no Parquet at all"))
                out.close()
    dropped = database.repair().select("block_id").withColumn("state", F.lit("dropped"))
    return database.manifest().select("block_id").withColumn("state", F.lit("listed")).unionByName(dropped)


def due_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the future wait, and are stored when they are due though nothing new comes in."""
    source, checkpoint, database = scratch_path(spark, "stream-source"), scratch_path(spark, "checkpoint"), Database(spark, scratch_path(spark, "db"))
    events(spark, sf_dir).repartition(2).write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest(spark.readStream.schema(schema).parquet(source), database, "events", checkpoint, now=lambda: WEEK[0]).awaitTermination()
    release_due(database, "events", checkpoint, schema, now=lambda: WEEK[1])
    stored = database.series("events").withColumn("stored", F.lit(True))
    from tidemark.streaming.ingest import waiting

    return stored.unionByName(waiting(database, "events", schema).withColumn("stored", F.lit(False)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        wal_replay, wal_after_persist, store_purge, store_persist, store_search, store_tail, store_sorter, block_files_roundtrip, json_trades, frame_json_roundtrip,
        parquet_output, table_output, memory_output, unformatted_times, blocks_read, stored_limit, named_database, repair_damaged, due_rows,
    )
}

_ALL = f"SELECT {EVENT_NANOS} FROM events"
_TS = micros("ts")
_JAN = "ts >= TIMESTAMP '2024-01-01'"
_PARTS = "CASE WHEN event_id % 10 = 0 THEN 'late' WHEN ts < TIMESTAMP '2024-01-08' THEN 'a' WHEN ts < TIMESTAMP '2024-01-15' THEN 'b' ELSE 'c' END"

ORACLES: dict[str, str] = {
    "wal_replay": _ALL,
    "wal_after_persist": f"{_ALL} WHERE NOT ({IN_WEEK})",
    "store_purge": f"{_ALL} WHERE NOT ({IN_WEEK})",
    "store_persist": f"SELECT *, ts_nanos >= {WEEK[0]} AND ts_nanos < {WEEK[1]} AS stored FROM ({_ALL})",
    "store_search": f"""SELECT CAST(count(*) FILTER ({IN_WEEK}) AS INTEGER) AS points, CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-08') AS INTEGER) AS low,
 CAST(count(*) FILTER (ts < TIMESTAMP '2024-01-15') AS INTEGER) AS high, min(epoch_us(ts) * 1000) FILTER ({IN_WEEK}) AS first, max(epoch_us(ts) * 1000) FILTER ({IN_WEEK}) AS last FROM events""",
    "store_tail": f"SELECT * EXCLUDE r FROM (SELECT *, dense_rank() OVER (ORDER BY ts_nanos DESC) AS r FROM ({_ALL})) WHERE r <= 5",
    "store_sorter": """SELECT epoch_us(o_orderdate) * 1000 AS ts_nanos, o_orderkey,
 CAST(row_number() OVER (PARTITION BY o_orderdate ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders""",
    "block_files_roundtrip": "SELECT epoch_us(ts) * 1000 AS ts_nanos, value, event_type = 'click' AS is_click FROM events",
    "json_trades": """SELECT CAST(epoch_us(date_trunc('second', upper(exec_date)::TIMESTAMPTZ)) * 1000 + rpad(regexp_extract(exec_date, '\\.(\\d+)', 1), 9, '0')::BIGINT AS VARCHAR) AS ts_nanos,
 CASE WHEN upper(trim(side)) IN ('BUY', 'B') THEN TRUE WHEN upper(trim(side)) IN ('SELL', 'S') THEN FALSE END AS is_buy, CASE WHEN NOT isnan(price) THEN price END AS price
 FROM trades WHERE exec_date IS NOT NULL""",
    "frame_json_roundtrip": _ALL,
    "parquet_output": f"SELECT {_TS} AS ts, value, event_id FROM events WHERE {_JAN}",
    "table_output": f"SELECT {_TS} AS ts, event_type, event_id FROM events WHERE {_JAN}",
    "memory_output": f"SELECT {_TS} AS ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'",
    "unformatted_times": "SELECT epoch_us(ts) * 1000 AS ts, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05'",
    "blocks_read": f"SELECT {_PARTS} AS block_id, count(*) AS n FROM events WHERE {IN_WEEK} GROUP BY ALL",
    "stored_limit": f"""SELECT {_TS} AS ts, event_id, value FROM (SELECT *, dense_rank() OVER (ORDER BY ts DESC) AS r FROM events
 WHERE ts <= TIMESTAMP '2024-01-14 23:00:00') WHERE r <= 7""",
    "named_database": f"SELECT {_TS} AS ts, value, event_id FROM events WHERE {_JAN} AND value <= 50",
    "repair_damaged": f"""SELECT block_id, CASE WHEN block_id IN ('a', 'late') THEN 'dropped' ELSE 'listed' END AS state FROM (SELECT DISTINCT {_PARTS} AS block_id FROM events)""",
    "due_rows": f"SELECT *, ts_nanos <= {WEEK[1]} AS stored FROM ({_ALL})",
}
