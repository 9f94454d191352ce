import io
import json
import os
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.timestamps import format_nanos, nanos_to_date, rfc3339_nanos, timestamp_nanos
from tidemark.operators import series
from tidemark.plans.analyze import Limit, TimeRange
from tidemark.plans.grammar import QueryError
from tidemark.sources.database import Database
from tidemark.sources.json_trades import read_trades
from tidemark.sources.store import WritableStore
from tidemark.streaming.ingest import ingest, release_due, waiting

TIES = [1, 1, 7, 7, 7, 11, 12, 19, 23, 23, 40, 40, 40]


@pytest.fixture
def ties(spark):
    return spark.createDataFrame([(t, float(i), i % 2 == 0) for i, t in enumerate(TIES)], "ts_nanos bigint, c0 double, c1 boolean").repartition(3)


def times(df):
    return [r[0] for r in series.ordered(df).select("ts_nanos").collect()]


@pytest.mark.parametrize(
    ("side", "n", "expected"),
    [
        ("head", 0, []), ("tail", 0, []), ("head", 1, [1] * 2), ("head", 2, [1] * 2 + [7] * 3),
        ("tail", 2, [23, 23, 40, 40, 40]), ("tail", 1, [40] * 3), ("head", 99, TIES), ("tail", 99, TIES),
    ],
)
def test_limits_keep_ties(ties, side, n, expected):
    assert times(series.limit_distinct(ties, Limit(side, n))) == expected


def test_limit_of_nothing(ties):
    assert times(series.limit_distinct(ties.where("ts_nanos > 99"), Limit("tail", 3))) == []


def test_clip_split_purge(spark):
    df = spark.createDataFrame([(t,) for t in (28, 31, 58, 61, 61, 61, 91, 121, 151, 151, 154, None)], "ts_nanos bigint")
    assert times(series.clip(df, TimeRange(61, 151))) == [61, 61, 61, 91, 121]
    assert len(times(series.clip(df, TimeRange(61, None)))) == 8
    assert times(series.clip(df, TimeRange(151, 61))) == []
    before, within, after = series.split(df, TimeRange(58, 91))
    assert (times(before), times(within), times(after)) == ([28, 31], [58, 61, 61, 61], [91, 121, 151, 151, 154])
    assert times(series.purge(df, TimeRange(31, 154))) == [None, 28, 154]


def test_merge_keeps_duplicates_and_checks_types(spark):
    a = spark.createDataFrame([(t,) for t in (4, 6, 17, 25, 70, 71)], "ts_nanos bigint")
    b = spark.createDataFrame([(t,) for t in (3, 6, 8, 72, 99)], "ts_nanos bigint")
    assert times(series.merge(a, b)) == [3, 4, 6, 6, 8, 17, 25, 70, 71, 72, 99]
    with pytest.raises(TypeError):
        series.merge(a, b.select(F.col("ts_nanos").cast("string")))


def test_sortedness(ties):
    assert series.is_sorted(series.ordered(ties))
    assert not series.is_sorted(ties.coalesce(1).orderBy(F.col("ts_nanos").desc()))


def test_block_stats_and_rows(ties):
    (stat,) = series.block_stats(ties.withColumn("ts_nanos", F.col("ts_nanos") * 10**9), [F.lit("b").alias("block_id")]).collect()
    assert tuple(stat) == ("b", 1, 41, 7)
    assert [t for t, _ in series.to_rows(ties)] == TIES


def test_rfc3339(spark, rows):
    good = ["2021-01-01T00:00:00.1251482Z", "2021-01-01 01:00:00.5+01:00", "2021-01-01t00:00:00z", "2021-01-01T00:00:00", "2020-12-31T19:00:00.000000001-05:00", "2021-01-01T09:00:00+0900"]
    texts = good + ["x", "", None, "2021-01-01", "2021-01-01T00:00:00.5+9:00", "2021-01-01T00:00:00ZZ", "2021-01-01T00:00:00.Z5", "2021-13-01T00:00:00Z", "2021-01-01T00:00:001Z", "9999-01-01T00:00:00Z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rfc3339_nanos(F.col("t")))
    base = 1_609_459_200 * 10**9
    assert [r[1] for r in rows(df)] == [base + 125_148_200, base + 500_000_000, base, base, base + 1, base] + [None] * 10


def test_formatting_is_exact_and_free_of_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([(1_616_921_999_999_999_999,), (-1,), (0,)], "t bigint")
        shown = df.select(format_nanos(F.col("t"), 0, "Z"), format_nanos(F.col("t"), 32_400, "+09:00"), nanos_to_date(F.col("t")).cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(shown[0]) == ("2021-03-28T08:59:59.999999999Z", "2021-03-28T17:59:59.999999999+09:00", "2021-03-28")
    assert tuple(shown[1]) == ("1969-12-31T23:59:59.999999999Z", "1970-01-01T08:59:59.999999999+09:00", "1969-12-31")
    assert shown[2][0] == "1970-01-01T00:00:00.000000000Z"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zoneless_times_do_not_depend_on_the_session(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select timestamp_ntz'2021-07-01 12:34:56.789012' t, date'1969-12-31' d, timestamp_ntz'2021-03-14 02:30:00' gap")
        got = df.select(timestamp_nanos(F.col("t"), "timestamp_ntz"), timestamp_nanos(F.col("d"), "date"), timestamp_nanos(F.col("gap"), "timestamp_ntz")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(got) == (1_625_142_896_789_012_000, -86_400 * 10**9, 1_615_689_000 * 10**9)


SCHEMA = "ts_nanos bigint, c0 double, c1 double"
T0 = 1_629_745_451_715_000_000


def frame(spark, offsets):
    return spark.createDataFrame([(T0 + o * 1000, float(o), -float(o)) for o in offsets], SCHEMA)


def test_database_round_trip(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    assert db.manifest().count() == 0
    db.write_block("m.x", frame(spark, [37, 32, 34]), block_id="a")
    db.write_block("m.x", frame(spark, [35, 34, 10**9]), block_id="b")
    assert db.write_block("m.x", frame(spark, []), block_id="c") is None
    assert times(db.series("m.x")) == [T0 + o * 1000 for o in (32, 34, 34, 35, 37, 10**9)]
    assert times(db.series("m.x", TimeRange(T0 + 34_000, T0 + 37_000))) == [T0 + o * 1000 for o in (34, 34, 35)]
    listed = {r["block_id"]: (r["since_sec"], r["until_sec"], r["timestamp_num"]) for r in db.manifest().collect()}
    assert listed == {"a": (T0 // 10**9, T0 // 10**9 + 1, 3), "b": (T0 // 10**9, (T0 + 10**12) // 10**9 + 1, 3)}
    db.write_block("m.x", frame(spark, [1]), block_id="a")
    assert db.series("m.x").count() == 4, "a block of the same id is replaced"
    plan = db.series("m.x", TimeRange(T0, T0 + 1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(ts_bucket" in plan
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(ts_nanos," in plan
    with pytest.raises(TypeError):
        db.write_block("m.x", frame(spark, [1]).withColumn("c1", F.lit("x")))
    with pytest.raises(TypeError):
        db.write_block("y", frame(spark, [1]).withColumn("c1", F.array("c0")))
    with pytest.raises(ValueError):
        db.write_block(".y", frame(spark, [1]))
    with pytest.raises(LookupError):
        db.series("nothing")


def test_a_range_is_read_from_the_blocks_that_the_manifest_lists(spark, tmp_path, monkeypatch):
    db = Database(spark, f"file://{tmp_path}/db")
    for i, name in enumerate("abcd"):
        db.write_block("m", frame(spark, [i * 10**7, i * 10**7 + 5]), block_id=name)
    frame(spark, [3]).withColumn("ts_bucket", F.lit(1)).write.partitionBy("ts_bucket").parquet(f"file://{tmp_path}/db/block/m/block_id=unlisted")
    second = 10**9
    bounds = TimeRange(T0 + 10 * second, T0 + 20 * second + 6000)
    assert sorted(r[0] for r in db.blocks_in("m", bounds).select("block_id").collect()) == ["b", "c"]
    for limit in (10_000, 1):
        monkeypatch.setattr("tidemark.sources.database.LIMIT_BLOCKS", limit)
        assert times(db.series("m", bounds)) == [T0 + o * 1000 for o in (10**7, 10**7 + 5, 2 * 10**7, 2 * 10**7 + 5)]
        assert db.series("m").count() == 8, "a block that isn't listed isn't committed"
    monkeypatch.setattr("tidemark.sources.database.LIMIT_BLOCKS", 10_000)
    assert {f.split("block_id=")[1][0] for f in db.series("m", bounds).inputFiles()} == {"b", "c"}


def test_the_manifest_stays_in_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.database.MANIFEST_FILES", 3)
    db = Database(spark, f"file://{tmp_path}/db")
    for i in range(9):
        db.write_block("m", frame(spark, [i]), block_id=f"b{i % 7}")
    assert sorted(r["block_id"] for r in db.manifest().collect()) == [f"b{i}" for i in range(7)]
    assert len(list((tmp_path / "db/block_list").glob("*.parquet"))) <= 4


def test_one_writer_at_a_time(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    with db.lock("m"):
        with pytest.raises(TimeoutError), db.lock("m", wait=0.2):
            pass
        with db.lock("other", wait=0.2):
            pass
    with db.lock("m", wait=0.2):
        os.utime(tmp_path / "db/lock/m.lock", (1, 1))
        with db.lock("m", wait=0.2):
            pass  # left behind by a writer that died
    assert not list((tmp_path / "db/lock").glob("*.lock"))
    blocks = []
    threads = [threading.Thread(target=lambda i=i: blocks.append(db.write_block("m", frame(spark, [i]), block_id=f"b{i}"))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(blocks) == [f"b{i}" for i in range(4)] and db.series("m").count() == 4


def test_failed_writes_are_recorded(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    broken = spark.sql("select 1L ts_nanos, cast(raise_error('no such sensor') as double) c0")
    with pytest.raises(Exception, match="no such sensor"):
        db.write_block("m", broken, block_id="a")
    (record,) = (tmp_path / "db" / "error").glob("*.json")
    assert json.loads(record.read_text())["block_id"] == "a"
    assert db.manifest().count() == 0


def test_store_search(spark):
    store = WritableStore(spark, "m", ["double"])
    store.push([(t, (0.0,)) for t in (9, 10, 19, 20, 20, 20, 30)])
    points, places = store.search(TimeRange(20, 30))
    assert ([t for t, _ in points], places) == ([20, 20, 20], range(3, 6))
    assert store.search(TimeRange(30, 20)) == ([], range(6, 6))
    assert len(store.search(TimeRange())[0]) == 7


def test_limits_are_narrowed_by_the_manifest(spark, tmp_path):
    engine = Engine(spark, [f"db=file://{tmp_path}/db"])
    db, rng = engine.catalog.databases["db"], random.Random(1)
    held = []
    for i in range(12):
        start = rng.randrange(0, 100)
        times_ = sorted(rng.randrange(start, start + rng.choice([3, 20])) * 10**9 + rng.choice([0, 5]) for _ in range(6))
        held += times_
        db.write_block("m", spark.createDataFrame([(t,) for t in times_], "ts_nanos bigint"), block_id=f"b{i:02}")
    held.sort()
    narrowed = 0
    for side, n, at in [(s, n, a) for s in ("head", "tail") for n in (0, 1, 4, 9, 99) for a in (0, 30 * 10**9 + 5, 200 * 10**9)]:
        bounds = TimeRange(at, None) if side == "head" else TimeRange(None, at)
        inside = [t for t in held if (t >= at if side == "head" else t < at)]
        wanted = sorted(set(inside))[:n] if side == "head" else sorted(set(inside))[-n:] if n else []
        limit = Limit(side, n)
        narrow = db.narrowed("m", bounds, limit)
        narrowed += narrow != bounds
        got = times(series.limit_distinct(series.clip(db.series("m", narrow), bounds), limit))
        assert got == [t for t in inside if t in set(wanted)], (side, n, at)
    assert narrowed > 8
    query = engine.query("select * from m where ts >=|2 '1970-01-01'")
    assert query.count() == len([t for t in held if t in sorted(set(held))[:2]])
    assert "LessThan(ts_nanos," in query._jdf.queryExecution().toString()


def test_repair_drops_what_cannot_be_read(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    for name in ("a", "b", "c"):
        db.write_block("m", frame(spark, [1, 2]), block_id=name)
    for part in (tmp_path / "db/block/m/block_id=b").rglob("*.parquet"):
        part.write_bytes(b"broken")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    for part in (tmp_path / "db/block/m/block_id=c").rglob("*"):
        if part.is_file():
            part.unlink()
    dropped = db.repair()
    assert sorted(r["block_id"] for r in dropped.collect()) == ["b", "c"]
    assert [r["block_id"] for r in db.manifest().collect()] == ["a"]


def test_store_purges_and_persists_ranges(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    store = WritableStore(spark, "m", ["double", "double"], database=db, wal_dir=str(tmp_path / "wal"))
    points = [(T0 + o * 1000, (float(o), 0.0)) for o in (38, 31, 34, 37, 32, 35)]
    store.push(points[:4])
    store.push(points[4:])
    assert [t for t, _ in store.datapoints()] == sorted(t for t, _ in points)
    store.purge(TimeRange(T0 + 34_000, T0 + 35_001))
    assert [(t - T0) // 1000 for t, _ in store.datapoints()] == [31, 32, 37, 38]
    again = WritableStore(spark, "m", ["double", "double"], database=db, wal_dir=str(tmp_path / "wal"))
    assert [(t - T0) // 1000 for t, _ in again.datapoints()] == [31, 32, 37, 38], "the log holds what isn't persisted"
    assert store.persist(TimeRange(T0 + 31_000, T0 + 37_001)) is not None
    assert [(t - T0) // 1000 for t, _ in store.datapoints()] == [38]
    assert times(db.series("m", TimeRange(T0 + 32_000, T0 + 37_001))) == [T0 + 32_000, T0 + 37_000]
    assert store.persist(TimeRange(0, 1)) is None
    again = WritableStore(spark, "m", ["double", "double"], database=db, wal_dir=str(tmp_path / "wal"))
    assert [(t - T0) // 1000 for t, _ in again.datapoints()] == [38]


def test_store_sorts_ties_and_checks_types(spark):
    store = WritableStore(spark, "m", ["boolean", "double"], sorter=lambda p: (p[1][0], -p[1][1]), sort_on_read=False)
    store.push([(5, (True, 1.0)), (3, (False, 2.0)), (5, (False, 3.0)), (5, (False, 4.0))])
    assert store.datapoints() == []
    store.sort()
    assert store.datapoints() == [(3, (False, 2.0)), (5, (False, 4.0)), (5, (False, 3.0)), (5, (True, 1.0))]
    store.push([(4, (True, 0.0))])
    store.sort()
    assert [t for t, _ in store.datapoints()] == [3, 4, 5, 5, 5]
    assert [t for t, _ in store.tail(2)] == [4, 5, 5, 5]
    assert store.tail(0) == []
    with pytest.raises(TypeError):
        store.push([(1, (1.0, 1.0))])
    with pytest.raises(TypeError):
        store.push([(1, (True,))])
    with pytest.raises(RuntimeError):
        store.persist()
    store.sink()([(1, ("bad", 0.0))])
    assert len(store.datapoints()) == 5


def test_flushing_leaves_the_future(spark, tmp_path):
    db = Database(spark, f"file://{tmp_path}/db")
    store = WritableStore(spark, "m", ["double"], database=db)
    future = time.time_ns() + 10**15
    store.push([(1, (1.0,)), (future, (2.0,))])
    store.start_flushing(0.1)
    for _ in range(100):
        if len(store.datapoints()) == 1:
            break
        time.sleep(0.1)
    store.shutdown()
    assert [t for t, _ in store.datapoints()] == [future]
    assert times(db.series("m")) == [1]


def test_streaming_keeps_late_rows_and_survives_a_restart(spark, tmp_path):
    db, source, checkpoint = Database(spark, f"file://{tmp_path}/db"), str(tmp_path / "in"), str(tmp_path / "cp")
    clock = [100]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        ingest(stream, db, "m", checkpoint, now=lambda: clock[0]).awaitTermination()

    def put(values):
        spark.createDataFrame([(t, 0.0, 0.0) for t in values], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    put([50, 60, 500])
    run()
    assert times(db.series("m")) == [50, 60]
    assert times(waiting(db, "m", SCHEMA)) == [500]
    put([10, 60, 90])
    run()
    assert times(db.series("m")) == [10, 50, 60, 60, 90], "late rows are kept, and nothing twice"
    clock[0] = 1000
    put([700])
    run()
    assert times(db.series("m")) == [10, 50, 60, 60, 90, 500, 700]
    assert times(waiting(db, "m", SCHEMA)) == []


def test_due_rows_are_stored_though_nothing_comes_in(spark, tmp_path):
    db, source, checkpoint = Database(spark, f"file://{tmp_path}/db"), str(tmp_path / "in"), str(tmp_path / "cp")
    clock = [100]

    def put(values):
        spark.createDataFrame([(t, 0.0, 0.0) for t in values], SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run(**options):
        return ingest(spark.readStream.schema(SCHEMA).parquet(source), db, "m", checkpoint, now=lambda: clock[0], **options)

    release = lambda: release_due(db, "m", checkpoint, SCHEMA, now=lambda: clock[0])
    assert release() is None
    put([50, 200, 300, 400])
    run().awaitTermination()
    assert release() is None
    clock[0] = 250
    assert release() is not None and release() is None
    assert times(db.series("m")) == [50, 200] and times(waiting(db, "m", SCHEMA)) == [300, 400]
    # a release that was broken off before its staging was written is done again under the same number
    db.write_block("m", waiting(db, "m", SCHEMA).where("ts_nanos = 300"), block_id="batch000000000000.due2")
    clock[0] = 350
    release()
    assert times(db.series("m")) == [50, 200, 300]
    put([10, 500])
    query = run(every="1 second")
    for _ in range(60):
        if times(db.series("m")) == [10, 50, 200, 300]:
            break
        time.sleep(0.5)
    clock[0] = 450
    for _ in range(60):
        if 400 in times(db.series("m")):
            break
        time.sleep(0.5)
    query.stop()
    assert times(db.series("m")) == [10, 50, 200, 300, 400] and times(waiting(db, "m", SCHEMA)) == [500]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_ranges_reach_the_scan_of_tables_from_elsewhere(spark, tmp_path, kind):
    from tidemark.sources.catalog import External

    path, day = str(tmp_path / "t"), 86_400 * 10**9
    spark.range(10).select(F.col("id"), F.expr(f"cast(timestamp_seconds(id * 43200) as {kind})").alias("t")).write.parquet(path)
    held = External(lambda: spark.read.parquet(path), "t", ("id",))
    got = held.series(TimeRange(2 * day, 4 * day))
    assert sorted(r["id"] for r in got.collect()) == [4, 5, 6, 7]
    assert "GreaterThanOrEqual(t," in got._jdf.queryExecution().toString()


def test_kept_results_are_bounded(spark, tmp_path):
    one = Engine(spark, [f"main=file://{tmp_path}/main"], now=lambda: T0, cache=2)
    one.writable_store("m", ["double"]).push([])
    store = one.writable_store("m", ["double"])
    store.push([(T0, (1.0,))])
    store.persist()
    texts = [f"select * from m where ts >= '20{y}-01-01'" for y in (10, 11, 12)]
    kept = [one.query(t) for t in texts]
    assert [x.is_cached for x in kept] == [False, True, True] and one.query(texts[2]) is kept[2]
    assert one.query("with use_cache = false " + texts[2]) is not kept[2]
    assert one.query("with force_sync_cloud = true " + texts[2]) is not kept[2]


@pytest.fixture
def engine(spark, tmp_path):
    out = Engine(spark, [f"main=file://{tmp_path}/main"], now=lambda: T0)
    store = out.writable_store("trades", ["boolean", "double", "double"])
    store.push([(T0 + i // 2 * 10**9, (i % 2 == 0, float(i), 0.5)) for i in range(10)])
    store.persist()
    return out


def test_engine_end_to_end(engine):
    day = "in ('2021-08-23', + 1 day)"
    got = engine.query(f"with cols=[is_buy, price, size], tz = Asia/Tokyo select price, is_buy from trades where ts >=|2 '2021-08-23'")
    assert got.columns == ["ts", "price", "is_buy"]
    assert [tuple(r) for r in got.orderBy("price").collect()][0] == ("2021-08-24T04:04:11.715000000+09:00", 0.0, True)
    assert got.count() == 4
    assert engine.query(f"select * from trades where ts {day}").columns == ["0", "1", "2", "3"]
    raw = engine.query(f"with format_datetime = false, cols=[a,b,c] select b from trades where ts {day}")
    assert raw.schema["ts"].dataType.simpleString() == "bigint"
    with pytest.raises(QueryError):
        engine.query(f"with cols=[a,b] select * from trades where ts {day}")
    with pytest.raises(QueryError):
        engine.query(f"with cols=[a,b,c,d] select d from trades where ts {day}")
    with pytest.raises(LookupError):
        engine.query(f"with db = other select * from trades where ts {day}")
    with pytest.raises(LookupError):
        engine.query("select * from .describe where metrics = nothing")
    assert [r[0] for r in engine.query("select * from .metrics").collect()] == ["trades"]
    (block,) = engine.query("select * from .block_list where metrics = trades").collect()
    assert (block["seq"], block["block_num"]) == (1, 1)
    assert engine.query("select * from trades where ts = '1999-01-01'").collect() == []
    assert engine.repair().count() == 0


def test_only_wanted_columns_are_read(engine):
    plan = engine.query("with cols=[a,b,c] select b from trades where ts >= '2021-08-23'")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<ts_nanos:bigint,c1:double>" in plan


def test_outputs(engine, tmp_path, spark):
    head = "with cols=[a,b,c], {} select b from trades where ts < '2021-08-24'"
    out = io.StringIO()
    engine.run(head.format("format = json"), out)
    got = json.loads(out.getvalue())
    assert list(got) == ["ts", "b"] and len(got["ts"]) == 10 and sorted(got["b"]) == [float(i) for i in range(10)]
    out = io.StringIO()
    engine.run(head.format("format = table"), out)
    lines = out.getvalue().splitlines()
    assert len(lines) == 14 and lines[0] == lines[2] == lines[-1] and set(lines[0]) == {"+", "-"}
    assert "| ts " in lines[1]
    for kind, codec in (("parquet", "UNCOMPRESSED"), ("parquet_snappy", "SNAPPY")):
        import pyarrow.parquet as pq

        path = tmp_path / "new" / f"{kind}.out"
        engine.run(head.format(f"format = {kind}, output_file = '{path}'"))
        engine.run(head.format(f"format = {kind}, output_file = '{path}'"))
        meta = pq.ParquetFile(path).metadata
        assert (meta.num_rows, meta.row_group(0).column(1).compression) == (10, codec)
    path = tmp_path / "x.json"
    engine.run(head.format(f"format = json, output_file = '{path}'"))
    assert json.loads(path.read_text()) == got
    assert engine.run(head.format("output_to_memory")).count() == 10


def test_trades_from_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        json.dumps(
            [
                {"exec_date": "2021-09-27T09:42:40.741778Z", "side": "BUY", "price": 5.0, "size": 0.1},
                {"exec_date": "2021-09-27T18:42:41.1234567+09:00", "side": " sell", "price": 4.0, "size": 0.2, "id": 7},
                {"exec_date": "soon", "side": "BUY", "price": 1.0, "size": 1.0},
                {"exec_date": "2021-09-27T09:42:42Z", "price": 3},
            ]
        )
    )
    base = 1_632_735_760 * 10**9
    got = [tuple(r) for r in series.ordered(read_trades(spark, str(tmp_path))).collect()]
    assert got == [(base + 741_778_000, True, 5.0, 0.1), (base + 1_123_456_700, False, 4.0, 0.2), (base + 2 * 10**9, None, 3.0, None)]
