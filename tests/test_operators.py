"""The data-preparation operators against plain Python, with nulls, ties, repeats, empty tables and clashing names."""

import inspect
import itertools
import math
import random
from collections import defaultdict
from datetime import date, timedelta
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomalies, grid, intervals, rolling
from tidemark.operators.trades import distinct_trades
from tidemark.streaming import compaction

NAN, INF = float("nan"), float("inf")
S = 10**9


# -- grid


def gridded(spark, readings, periods):
    df = spark.createDataFrame(readings, "source string, ts_nanos bigint, value double").withColumn("cell", F.lit("clash")).withColumn("tile", F.lit(1))
    ps = spark.createDataFrame(periods, "source string, period_sec int").withColumn("value", F.lit("clash"))
    return {(r[0], r[1]): (r[2], r[3]) for r in grid.regular_grid(df, ps, tile_cells=16).collect()}


def test_grid_covers_every_cell_once_and_keeps_observed_values(spark):
    rng = random.Random(3)
    readings = [(f"s{k}", int((i * 10 + rng.random() * 9) * S), math.sin(i / 9 + k)) for k in range(5) for i in range(100) if rng.random() < 0.8]
    got = gridded(spark, readings, [(f"s{k}", 10) for k in range(5)])
    for k in range(5):
        cells = sorted({t // (10 * S) for s, t, _ in readings if s == f"s{k}"})
        assert sorted(c // 10 for s, c in got if s == f"s{k}") == list(range(cells[0], cells[-1] + 1))
    for s, t, v in readings:
        assert got[s, t // (10 * S) * 10] == (v, grid.OBSERVED)
    filled = [(got[k][0], math.sin(k[1] / 90 + int(k[0][1]))) for k in got if got[k][1] == grid.FILLED]
    assert filled and np.median([abs(a - b) for a, b in filled]) < 0.1


def test_grid_edge_cases(spark):
    bad = [("a", None, 1.0), ("a", 5 * S, None), ("a", 6 * S, NAN), ("a", 7 * S, INF), (None, S, 1.0), ("zero", S, 1.0), ("none", S, 1.0), ("un", S, 1.0)]
    good = [("a", 25 * S + 999_999_999, 0.1), ("a", 25 * S + 999_999_999, 0.1), ("a", 25 * S, 0.1), ("a", 400 * S, 4.0), ("a", 401 * S, 6.0), ("neg", -15 * S, 2.0), ("a", 50 * S, 1.7e308), ("a", 51 * S, 1.6e308)]
    got = gridded(spark, bad + good, [("a", 10), ("neg", 10), ("zero", 0), ("none", None), (None, 10), ("idle", 10)])
    assert got["a", 20] == (0.1, "observed") and got["a", 400] == (5.0, "observed") and got["neg", -20] == (2.0, "observed")
    assert got["a", 50] == (pytest.approx(1.65e308), "observed")
    assert {k[0] for k in got} == {"a", "neg"}
    assert len(got) == 40 and got["a", 210] == (None, "unsupported")
    assert gridded(spark, [], [("a", 10)]) == {}
    assert gridded(spark, good, []) == {}


def test_factorisation_beats_the_median_on_held_out_cells():
    rng = np.random.default_rng(0)
    t = np.arange(512)
    full = np.array([np.sin(t / 40 + i) * 3 + i * 10 for i in range(30)]) + rng.normal(0, 0.1, (30, 512))
    seen = full.copy()
    hidden = rng.random(full.shape) < 0.3
    seen[hidden] = np.nan
    estimate, support = grid.factorise(seen)
    assert support.all()
    error = np.abs(estimate - full)[hidden]
    assert np.median(error) < 0.15 < np.median(np.abs(np.nanmedian(seen, axis=1)[:, None] - full)[hidden])
    nothing, support = grid.factorise(np.full((3, 9), np.nan))
    assert not support.any() and np.isnan(nothing).all()


@pytest.mark.parametrize("n_sources", [3, 12])
def test_factors_tell_what_neighbours_in_time_do_not(n_sources):
    """Sources that share what no neighbour foretells: two factors of white noise."""
    rng = np.random.default_rng(1)
    full = rng.normal(0, 1, (n_sources, 2)) @ rng.normal(0, 1, (2, 512)) * 5 + rng.normal(0, 0.1, (n_sources, 512)) + 100
    seen = np.where(rng.random(full.shape) < 0.1, np.nan, full)
    hidden = np.isnan(seen)
    alone = np.abs(grid._neighbours(seen) - full)[hidden]
    assert np.median(np.abs(grid.factorise(seen)[0] - full)[hidden]) < np.median(alone) * (0.6 if n_sources > 3 else 0.9)
    # independent sources aren't mixed up
    full = rng.normal(0, 1, (n_sources, 512))
    seen = np.where(hidden, np.nan, full)
    alone = np.abs(grid._neighbours(seen) - full)[hidden]
    assert np.median(np.abs(grid.factorise(seen)[0] - full)[hidden]) < np.median(alone) * 1.1


def test_a_ramp_is_carried_on():
    values = np.arange(512.0)[None, :].copy()
    values[0, 300:303] = np.nan
    estimate, support = grid.factorise(values)
    assert support[0, 300:303].all() and np.allclose(estimate[0, 300:303], [300, 301, 302])


def test_edges_of_matrices_change_nothing(spark):
    rng = random.Random(8)
    readings = [(s, i * 10 * S, math.sin(i / 5) * k + rng.random()) for k, s in enumerate("abc") for i in range(200) if rng.random() < 0.7 and not 93 <= i < 99]
    got = gridded(spark, readings, [(s, 10) for s in "abc"])
    df = spark.createDataFrame(readings, "source string, ts_nanos bigint, value double")
    ps = spark.createDataFrame([(s, 10) for s in "abc"], "source string, period_sec int")
    whole = {(r[0], r[1]): r[3] for r in grid.regular_grid(df, ps, tile_cells=1000).collect()}
    assert {k: v[1] for k, v in got.items()} == whole  # 16 periods to a matrix or all of them


def test_held_out_cells_are_told_better_than_by_a_straight_line(spark):
    rng = random.Random(10)
    df = spark.createDataFrame([(s, i * 10 * S, 20 + rng.gauss(0, 1)) for s in "abc" for i in range(600)], "source string, ts_nanos bigint, value double")
    got = grid.held_out_errors(df, spark.createDataFrame([(s, 10) for s in "abc"], "source string, period_sec int")).collect()
    assert len(got) == 3 and all(r["cells"] > 30 for r in got) and sum(r["error"] for r in got) < sum(r["line_error"] for r in got)


# -- anomalies


def flags(spark, series, limits=None, chunk_rows=5000):
    df = spark.createDataFrame(series, "source string, row_id bigint, ts_nanos bigint, value1 double, value2 double")
    df = df.select(F.lit("t").alias("record_table"), "*", F.lit("clash").alias("chunk"), F.lit(0).alias("width"))
    out = anomalies.flagged(anomalies.measured(df, chunk_rows), {"t": ("x", "y")}, {"t": limits or anomalies.Limits()})
    return sorted((r["record_field"], r["row_id"], r["reason"]) for r in out.collect())


@pytest.mark.parametrize("chunk_rows", [5000, 60])
def test_spikes_stuck_stretches_and_shifts(spark, chunk_rows):
    rng = random.Random(1)
    rows, expected = [], []
    for i in range(1000):
        level = 50.0 if i < 500 else 90.0  # a shift for good isn't a spike
        x, y = level + i / 100 + rng.gauss(0, 1), round(rng.gauss(0, 1), 6)
        if i in (100, 101, 700):
            x += 40 if i < 500 else -40
            expected.append(("x", i, "spike"))
        if 300 <= i < 311:
            y = 0.25
            expected.append(("y", i, "stuck"))
        if 800 <= i < 810:
            y = 0.5  # ten times the same are no run yet
        if i % 97 == 0:
            x = None
        if i % 89 == 0:
            y = NAN
        if ("y", i, "stuck") in expected and (y is None or y != y):
            expected.remove(("y", i, "stuck"))
        rows.append(("s", i, i * 60 * S, x, y))
    # copies of a reading are cases as well; later ones come out of order
    rows += [("s", 5000, 100 * 60 * S, rows[100][3], rows[100][4]), ("s", 5001, 305 * 60 * S, rows[305][3], 0.25)]
    expected += [("x", 5000, "spike"), ("y", 5001, "stuck")]
    rows.append(("s", 6000, 250 * 365 * 86_400 * S, 100.0, 0.0))  # a time far off
    rng.shuffle(rows)
    assert flags(spark, rows, chunk_rows=chunk_rows) == sorted(expected)


def test_series_that_hold_by_nature(spark):
    rng = random.Random(2)
    rows, level = [], 20.0
    for i in range(600):
        if i % 40 == 0:
            level = float(rng.randint(10, 60))
        rows.append(("hold", i, i * 60 * S, 300.0 if i == 333 else level, None))
    assert flags(spark, rows) == [("x", 333, "spike")]


def test_spikes_of_a_series_that_mostly_holds_one_value(spark):
    rng = random.Random(4)
    rows, expected = [], []
    for i in range(1000):
        x = 75000.0 if rng.random() < 0.85 else rng.choice([74000.0, 76000.0])
        if i in (200, 700, 701):
            x = {200: 7.5e6, 700: 42000.0, 701: 43000.0}[i]
            expected.append(("x", i, "spike"))
        rows.append(("pegged", i, i * 60 * S, x, 9.0 if i == 555 else 0.0))
    expected.append(("y", 555, "spike"))
    # one spike is all that ever changes, and a tick of a series that hardly moves is none
    rows += [("still", 2000 + i, i * 60 * S, 750.0 if i == 20 else 7.5, 101.0 if i == 9 else 100.0) for i in range(40)]
    assert flags(spark, rows) == sorted([*expected, ("x", 2020, "spike")])


def test_a_busy_day_does_not_narrow_the_view_of_the_others(spark):
    rng = random.Random(6)
    rows, expected, day = [], [], 86_400 * S
    for d in range(10):
        n = 12000 if d == 4 else 40
        for i in range(n):
            x, y = rng.gauss(0, 1), round(rng.gauss(0, 1), 6)
            if d != 4 and 2 * d <= i < 2 * d + 12:
                y = float(d)
                expected.append(("y", len(rows), "stuck"))
            if d != 4 and i == 22:
                x = 60.0
                expected.append(("x", len(rows), "spike"))
            rows.append(("hot", len(rows), d * day + i * (day // n), x, y))
    assert flags(spark, rows) == sorted(expected)


def test_runs_of_a_field_with_few_readings(spark):
    rng = random.Random(7)
    rows = [("s", i, i * 60 * S, rng.gauss(0, 1), round(rng.gauss(0, 1), 6) if i % 40 == 0 else None) for i in range(4000)]
    rows = [(*r[:4], 0.5 if r[4] is not None and 1000 <= r[1] < 1440 else r[4]) for r in rows]
    assert flags(spark, rows, chunk_rows=60) == [("y", i, "stuck") for i in range(1000, 1440, 40)]


def test_anomaly_edge_cases(spark):
    assert flags(spark, []) == []
    few = [(None, 1, 5, 1.0, 1.0), ("a", 2, None, 99.0, 1.0), ("a", 3, 7, None, NAN), ("b", 4, 7, 1e9, INF), ("b", 5, 7, 1.0, -INF)]
    assert flags(spark, few) == []
    bad = spark.createDataFrame([("t", 1, True, None), ("t", 2, False, True), ("t", 3, True, True)], "record_table string, row_id bigint, bad1 boolean, bad2 boolean")
    got = [(r["record_field"], r["row_id"]) for r in anomalies.impossible(bad, {"t": ("x", "y")}).collect()]
    assert sorted(got) == [("x", 1), ("x", 3), ("y", 2), ("y", 3)]


@pytest.mark.parametrize("sizes", [[1] * 60, [7, 1, 40, 200, 3], [400, 400], [2000]])
def test_cutting_a_series_anywhere_changes_nothing(sizes):
    """Partitions of any sizes, with ties, copies and a sparse field, give what one partition gives."""
    rng = np.random.default_rng(len(sizes))
    n = sum(sizes)
    sources = np.sort(rng.choice(["a", "b", "c"], n, p=[0.1, 0.8, 0.1]))
    t = np.concatenate([np.sort(rng.integers(0, 2 * n, (sources == s).sum())) for s in "abc"])
    v1, v2 = np.round(rng.normal(0, 2, n)), np.where(rng.random(n) < 0.1, rng.normal(0, 1, n), np.nan)
    table = pa.table({"record_table": ["t"] * n, "source": sources, "row_id": np.arange(n), "ts_nanos": t, "value1": v1, "value2": v2})
    ends = [0]
    for size in sizes:  # equal times are never in two partitions
        end = ends[-1] + size
        while 0 < end < n and (sources[end], t[end]) == (sources[end - 1], t[end - 1]):
            end += 1
        ends.append(min(end, n))

    def run(parts, chunk_rows):
        rows = [b for p in parts for b in anomalies._judge_partition(chunk_rows, 11)(iter(p.to_batches(max_chunksize=50)))]
        judged = pa.Table.from_batches(rows).to_pandas()
        edges = judged[judged["due"].notna()].sort_values(["source", "field", "ts_nanos"], kind="stable")
        edges = pa.Table.from_pandas(edges[["record_table", "source", "field", "row_id", "ts_nanos", "value", "due"]], preserve_index=False)
        edges = edges.set_column(6, "due", edges["due"].cast(pa.bool_()))
        late = [b.to_pandas() for b in anomalies._judge_edges(chunk_rows, 11)(iter(edges.to_batches(max_chunksize=50)))]
        out = pd.concat([judged[judged["due"].isna()], *late])
        out["run"] = np.minimum(out["run"].astype(int), 11)  # beyond that a run is long, however long
        return out.sort_values(["field", "row_id"])[["source", "field", "row_id", "hour", "value", "deviation", "jump", "run", "changed"]].reset_index(drop=True)

    whole = run([table], 10**6)
    assert len(whole) == np.isfinite(v1).sum() + np.isfinite(v2).sum()
    got = run([table.slice(a, b - a) for a, b in itertools.pairwise(ends)], 60)
    pd.testing.assert_frame_equal(got, whole, check_dtype=False)


def test_a_burst_is_cut_like_any_stretch(spark):
    rng = random.Random(9)
    rows = [("s", i, 10**15 + i // 3, rng.gauss(0, 1), None) for i in range(9000)]  # 9000 readings in three microseconds
    rows += [("s", 9000 + i, i * 3600 * S, rng.gauss(0, 1), None) for i in range(200)]
    rows[4000] = ("s", 4000, rows[4000][2], 90.0, None)
    assert flags(spark, rows, chunk_rows=100) == [("x", 4000, "spike")]


def test_the_fence_follows_the_tail(spark):
    rng = np.random.default_rng(4)
    normal, heavy = rng.normal(0, 1, 20_000), rng.laplace(0, 1, 20_000)
    rows = [(s, k * 20_000 + i, i * 60 * S, float(x), None) for k, (s, v) in enumerate((("normal", normal), ("heavy", heavy))) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "source string, row_id bigint, ts_nanos bigint, value1 double, value2 double").withColumn("record_table", F.lit("t"))
    ranges = anomalies.normal_ranges(anomalies.measured(df), {"t": anomalies.Limits()})
    fences = {r["source"]: r["f"] for r in ranges.groupBy("source").agg(F.percentile("fence", 0.5).alias("f")).collect()}
    assert 4.7 < fences["normal"] < 6.0 and 8.0 < fences["heavy"] < 20.0


# -- compaction


def stored(spark, path, rows, columns="slice string, owner int, c0 double"):
    schema = f"metric string, ts_nanos bigint, block_id string, row_id bigint, {columns}"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_compaction_keeps_every_datapoint_once(spark, tmp_path):
    path = str(tmp_path / "in")
    rng = random.Random(4)
    rows = []
    for i in range(400):
        m = rng.choice(["hot", "hot", "cold", None])
        rows.append((m, None if i % 50 == 7 else rng.randrange(90), None if i % 41 == 3 else f"b{rng.randrange(12):03}", i, rng.choice("xy"), None, rng.choice([1.0, NAN, None])))
    for part in range(4):
        stored(spark, path, rows[part * 100 : part * 100 + 100])
    done = compaction.compact(spark, path, target_rows=40, same_but=())
    kept, owner = {}, {}
    key = lambda r: (r[0], r[1], r[4], str(r[6]), r[3] if r[1] is None else None)
    for r in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[3])):
        kept.setdefault(key(r), (r[2], r[3]))
        if r[1] is not None:
            owner.setdefault((r[0], r[1]), r[2])
    got = done.rows.collect()
    assert sorted((r["block_id"], r["row_id"]) for r in got) == sorted(kept.values())
    assert all(r["owner"] == owner.get((r["metric"], r["ts_nanos"])) for r in got)
    blocks = defaultdict(list)
    for r in got:
        blocks[r["metric"], r["new_block"]].append(r["ts_nanos"])
    assert len(blocks) <= 28 and all(k[1].startswith("untimed") == (None in v) for k, v in blocks.items())
    listed = {(r["metric"], r["new_block"]): (r["since_nanos"], r["last_nanos"], r["n_rows"], r["timestamps"]) for r in done.blocks.collect()}
    assert listed == {k: (None, None, len(v), 0) if None in v else (min(v), max(v), len(v), len(set(v))) for k, v in blocks.items()}
    counted = {(r[0], r[1]): (r[2], r[3]) for r in compaction.counted_timestamps(done).collect()}
    for m in {r[0] for r in rows}:
        for b in {r[2] for r in rows if r[0] == m and r[2]}:
            assert counted[m, b] == (sum(r[0] == m and r[2] == b for r in rows), sum(k[0] == m and v == b for k, v in owner.items()))


def test_compaction_goes_on_from_its_checkpoint(spark, tmp_path):
    path, work = str(tmp_path / "in"), f"file://{tmp_path}/work"
    stored(spark, path, [("m", 1, "b1", 1, "x", 0, 1.0), ("m", 2, "b1", 2, "x", 0, 1.0)])
    assert compaction.compact(spark, path, workspace=work, bytes_per_batch=1).rows.count() == 2
    stored(spark, path, [("m", 2, "b2", 3, "x", 0, 1.0), ("m", 3, "b2", 4, "x", 0, 1.0)])
    done = compaction.compact(spark, path, workspace=work, bytes_per_batch=1)
    assert sorted((r["ts_nanos"], r["row_id"]) for r in done.rows.collect()) == [(1, 1), (2, 2), (3, 4)]
    assert {(r["block_id"], r["n_rows"], r["timestamps"]) for r in compaction.counted_timestamps(done).collect()} == {("b1", 2, 2), ("b2", 2, 1)}
    batches = sorted((tmp_path / "work" / "checkpoint" / "commits").glob("[0-9]*"))
    assert len(batches) == 2, "each file was taken once"
    # nothing new leaves all as it is
    assert compaction.compact(spark, path, workspace=work).rows.count() == 3


def test_a_broken_off_merge_is_done_again(spark, tmp_path):
    path, work = str(tmp_path / "in"), f"file://{tmp_path}/work"
    stored(spark, path, [("m", i, "b1", i, "x", 0, 1.0) for i in range(9)])
    first = compaction.compact(spark, path, workspace=work)
    stored(spark, path, [("m", i, "b2", 100 + i, "x", 0, 1.0) for i in range(5, 14)])
    compaction._drain(spark, path, f"{work}/staging", f"{work}/checkpoint", 1 << 30)
    # rows of the next version are there, its manifest isn't; and a batch's number is drawn again
    first.rows.write.mode("overwrite").parquet(f"{work}/compacted/v=2")
    commits = sorted((tmp_path / "work" / "checkpoint" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    done = compaction.compact(spark, path, workspace=work)
    assert sorted((r["ts_nanos"], r["row_id"]) for r in done.rows.collect()) == [(i, i) for i in range(9)] + [(i, 100 + i - 5 + 5) for i in range(9, 14)]


@pytest.mark.parametrize("seed", range(3))
def test_runs_one_after_another_equal_one_run(spark, tmp_path, seed):
    """Whatever comes when: late rows, copies from smaller blocks, new metrics, rows without a time."""
    rng = random.Random(seed)
    day = 86_400 * S
    rows = []
    for i in range(600):
        m = rng.choice(["hot", "hot", "cold", None, f"new{i // 200}"])
        t = None if i % 60 == 7 else rng.choice([rng.randrange(60), rng.randrange(40) * S, rng.randrange(-30, 30) * 7 * day])
        rows.append((m, t, f"b{rng.randrange(30):03}", i, rng.choice("xy"), None, rng.choice([1.0, NAN, None])))
    rng.shuffle(rows)
    work, path, whole = f"file://{tmp_path}/work", str(tmp_path / "in"), str(tmp_path / "whole")
    stored(spark, whole, rows)
    for part in range(3):
        stored(spark, path, rows[part * 200 : part * 200 + 200])
        done = compaction.compact(spark, path, workspace=work, target_rows=40, same_but=())
    want = compaction.compact(spark, whole, target_rows=40, same_but=())
    key = ["metric", "ts_nanos", "block_id", "row_id", "owner"]
    assert sorted(map(str, done.rows.select(*key).collect())) == sorted(map(str, want.rows.select(*key).collect()))
    assert sorted(map(str, compaction.counted_timestamps(done).collect())) == sorted(map(str, compaction.counted_timestamps(want).collect()))
    spans = sorted((str(r["metric"]), r["since_nanos"], r["last_nanos"]) for r in done.blocks.where("since_nanos is not null").collect())
    assert all(a[2] < b[1] for a, b in itertools.pairwise(spans) if a[0] == b[0]), "blocks of a metric don't overlap"
    assert done.blocks.agg(F.max("n_rows")).first()[0] <= 120


def test_a_second_run_leaves_untouched_blocks_alone(spark, tmp_path):
    path, work, day = str(tmp_path / "in"), f"file://{tmp_path}/work", 86_400 * S
    stored(spark, path, [("m", i * day, f"b{i // 50}", i, "x", 0, 1.0) for i in range(1000)])
    first = {r["file"]: r["n_rows"] for r in compaction.compact(spark, path, workspace=work, target_rows=100).blocks.collect()}
    stored(spark, path, [("m", 500 * day + i, "late", 2000 + i, "x", 0, 1.0) for i in range(1, 4)])
    done = compaction.compact(spark, path, workspace=work, target_rows=100)
    second = {r["file"]: r["n_rows"] for r in done.blocks.collect()}
    assert len(first) >= 8 and len(set(first) & set(second)) == len(first) - 1
    assert done.rows.count() == 1003 and sum(second.values()) == 1003


def test_a_batch_is_far_smaller_than_a_large_table():
    assert inspect.signature(compaction.compact).parameters["bytes_per_batch"].default <= 8 << 30


def test_blocks_hold_about_as_many_rows_wherever_they_lie(spark, tmp_path):
    """One busy day, a burst within a second, quiet months and a stray time far off."""
    path, day = str(tmp_path / "in"), 86_400 * S
    times = [i * day // 10 for i in range(600)] + [5 * day + i * S for i in range(600)] + [9 * day + i for i in range(600)] + [250 * 365 * day]
    stored(spark, path, [("m", t, f"b{i // 7:03}", i, "x", 0, 1.0) for i, t in enumerate(times)])
    sizes = [r["count"] for r in compaction.compact(spark, path, target_rows=100).rows.groupBy("new_block").count().collect()]
    assert 12 <= len(sizes) <= 19 and max(sizes) <= 200 and sorted(sizes)[3] >= 40


def test_compaction_of_nothing(spark, tmp_path):
    path = str(tmp_path / "in")
    stored(spark, path, [])
    done = compaction.compact(spark, path)
    assert done.rows.count() == 0 == done.blocks.count() and compaction.counted_timestamps(done).count() == 0


# -- rolling totals


def test_trailing_totals(spark):
    rng = random.Random(6)
    start = date(2021, 1, 1)
    rows = [(rng.choice(["hot", "hot", "cold", None]), start + timedelta(rng.randrange(120)), Fraction(rng.randrange(100), 4)) for _ in range(150)]
    rows += [("hot", None, Fraction(1)), ("once", date(1969, 12, 30), Fraction(3)), ("hot", rows[0][1], None)]
    df = spark.createDataFrame([(e, d, None if v is None else float(v), "clash") for e, d, v in rows], "who string, d date, v double, entity string")
    daily = rolling.with_all_days(rolling.daily_totals(df, "who", "d", {"v": F.col("v").cast("decimal(20,4)")}))
    got = rolling.trailing_totals(daily, ["n_rows", "sum_v", "n_v"], (1, 7, 30)).collect()
    expected = {}
    for e in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == e and r[1]]
        if not mine:
            continue
        first, last = min(r[1] for r in mine), max(r[1] for r in mine)
        for i in range((last - first).days + 1):
            d = first + timedelta(i)
            within = {w: [r for r in mine if d - timedelta(w) < r[1] <= d] for w in (1, 7, 30)}
            expected[e, d] = [(len(x), sum(r[2] for r in x if r[2] is not None), sum(r[2] is not None for r in x)) for x in within.values()]
    assert len(got) == len(expected)
    for r in got:
        assert [(r[f"n_rows_{w}d"], Fraction(r[f"sum_v_{w}d"]), r[f"n_v_{w}d"]) for w in (1, 7, 30)] == expected[r["entity"], r["day"]]
    assert rolling.trailing_totals(daily.where("false"), ["n_rows"], (7,)).count() == 0


def test_a_trade_counts_once(spark):
    rows = [
        (1, 9, "m", 1.0, 1.0, None, "2021-01-01 00:00:00"),
        (2, 9, "m", 2.0, 1.0, "2021-01-01T00:30:00+01:00", "2021-01-02 00:00:00"),
        (3, 9, "m", 3.0, 1.0, "2020-12-31T23:30:00Z", "2021-01-03 00:00:00"),
        (4, None, "m", 4.0, 1.0, "x", None),
        (5, None, "m", 5.0, 1.0, "2021-01-01T00:00:00.1Z", None),
    ]
    df = spark.createDataFrame(rows, "row_id bigint, trade_id bigint, market string, price double, size double, exec_date string, received_at string")
    got = distinct_trades(df.withColumn("exec_nanos", F.lit("clash")).withColumn("side", F.lit(None)))
    assert sorted((r["row_id"], str(r["trade_day"])) for r in got.collect()) == [(2, "2020-12-31"), (4, "None"), (5, "2021-01-01")]


# -- intervals


def merged(rows):
    out = defaultdict(list)
    for e, a, b in sorted((r for r in rows if None not in r[1:] and r[1] < r[2]), key=lambda r: (str(r[0]), r[1])):
        if out[e] and a <= out[e][-1][1]:
            out[e][-1][1] = max(out[e][-1][1], b)
        else:
            out[e].append([a, b])
    return out


@pytest.mark.parametrize("bucket", [7, 50, 86_400])
def test_periods_and_gaps(spark, bucket):
    rng = random.Random(bucket)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), a := rng.randrange(-200, 400), a + rng.choice([0, 1, 2, 3, 5, 40, -3])) for _ in range(150)]
    rows += [("b", None, 5), ("b", 5, None), ("none", 5, 5), ("long", -100, 400), ("long", 0, 10), ("long", 500, 501), ("touch", 0, 7), ("touch", 7, 14), ("touch", 14, 15)]
    df = spark.createDataFrame(rows, "entity string, since bigint, until bigint").withColumn("bucket", F.lit("clash")).withColumn("ts", F.lit(1))
    want = merged(rows)
    assert sorted(map(str, map(tuple, intervals.periods(df, bucket).collect()))) == sorted(str((e, a, b)) for e, v in want.items() for a, b in v)
    gaps = [(e, x[1], y[0]) for e, v in want.items() for x, y in zip(v, v[1:], strict=False)]
    assert sorted(map(str, map(tuple, intervals.gaps(df, bucket).collect()))) == sorted(map(str, gaps))
    assert intervals.gaps(df.where("false"), bucket).count() == 0 == intervals.periods(df.where("false"), bucket).count()


def test_bounds_however_far_off(spark):
    least, most = -(2**63), 2**63 - 1
    rows = [("open", 0, 10), ("open", 20, most), ("open", 50, 60), ("open", 10**7, 10**7 + 5), ("ever", least, most), ("ever", 5, 6), ("begun", least, 3), ("begun", 7, 9)]
    rows += [("far", 4 * 10**12, 5 * 10**12), ("far", 5 * 10**12, 6 * 10**12), ("far", 7 * 10**12, 7 * 10**12 + 1), ("far", 2**60 + 1, 2**60 + 2), ("far", 2**60 + 3, 2**60 + 4)]
    df = spark.createDataFrame(rows, "entity string, since bigint, until bigint")
    want = merged(rows)
    assert sorted(map(tuple, intervals.periods(df).collect())) == sorted((e, a, b) for e, v in want.items() for a, b in v)
    assert sorted(map(tuple, intervals.gaps(df).collect())) == sorted((e, x[1], y[0]) for e, v in want.items() for x, y in zip(v, v[1:], strict=False))


def test_the_latest_version_of_a_block_holds(spark):
    rows = [("m", "a", 1, 5, 9, 1), ("m", "a", 1, 7, 9, 3), ("m", "a", 1, 7, 9, 3), ("m", "a", 0, 9, 9, None), ("m", None, 1, 2, 0, 1), ("m", None, 1, 2, 0, 1), ("n", "b", None, 2, 0, 1)]
    df = spark.createDataFrame(rows, "metric string, block_id string, since_sec bigint, until_sec bigint, timestamp_num bigint, updated_at_nanos bigint").withColumn("x", F.lit(1))
    assert sorted(map(str, map(tuple, intervals.latest_versions(df).collect()))) == sorted(map(str, [("m", 1, 7), ("m", 1, 2), ("m", 1, 2), ("n", None, 2)]))
