"""The queries of the general data-preparation operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import finite, rfc3339_nanos
from tidemark.operators import anomalies, grid, intervals, rolling
from tidemark.operators.trades import distinct_trades
from tidemark.storage import join_small, materialize, scratch_path
from tidemark.streaming import compaction


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _grid_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    readings = _table(spark, sf_dir, "datapoints").select(F.col("metric").alias("source"), "ts_nanos", F.col("c0").alias("value"))
    return readings, _table(spark, sf_dir, "metric_catalog").select(F.col("metric").alias("source"), "period_sec")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular_grid(*_grid_input(spark, sf_dir))


def p1_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).withColumnRenamed("source", "metric")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).where(F.col("state") != grid.OBSERVED).select(F.col("source").alias("metric"), "cell_start_sec")


_FIELDS = {"datapoints": ("c0", "c1"), "trades": ("price", "size")}


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All readings with a time, each parsed once: what can't be is told by ``bad1`` and ``bad2`` and isn't among the values."""
    catalog = _table(spark, sf_dir, "metric_catalog").select("metric", "low_limit", "high_limit")
    points = join_small(_table(spark, sf_dir, "datapoints").select("row_id", "metric", "ts_nanos", "c0", "c1"), catalog, ["metric"], "left")
    infinite = lambda c: F.abs(c) == F.lit(float("inf"))
    outside = ~F.isnan("c0") & ((F.col("c0") < F.col("low_limit")) | (F.col("c0") > F.col("high_limit")))
    trades = _table(spark, sf_dir, "trades").select("row_id", "market", "price", "size", rfc3339_nanos(F.col("exec_date")).alias("ts_nanos"))
    unfit = lambda c: ~F.isnan(c) & ((F.col(c) <= 0) | infinite(c))

    def readings(rows: DataFrame, table: str, source: str, values: tuple[Column, Column], bad: tuple[Column, Column]) -> DataFrame:
        bad = [F.coalesce(b, F.lit(False)) for b in bad]
        return rows.where("ts_nanos is not null").select(
            F.lit(table).alias("record_table"), F.col(source).alias("source"), "row_id", "ts_nanos",
            *[F.when(~b, finite(v)).alias(f"value{k}") for k, v, b in zip((1, 2), values, bad, strict=True)],
            *[b.alias(f"bad{k}") for k, b in zip((1, 2), bad, strict=True)],
        )

    # sizes spread over orders of magnitude, so they are judged by their logarithm
    return readings(points, "datapoints", "metric", (F.col("c0"), F.col("c1")), (infinite("c0") | outside, infinite("c1"))).unionByName(
        readings(trades, "trades", "market", (F.col("price"), F.ln("size")), (unfit("price"), unfit("size")))
    )


def p1_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that hold readings, with the exact value where all of a cell's readings agree."""
    kept = _grid(spark, sf_dir).where(F.col("state") == grid.OBSERVED)
    return kept.select(F.col("source").alias("metric"), "cell_start_sec", F.round("value", 6).alias("value"))


def p1_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.held_out_errors(*_grid_input(spark, sf_dir)).withColumnRenamed("source", "metric")


_LIMITS = {"datapoints": anomalies.Limits(), "trades": anomalies.Limits(frozen=(True, False), logarithm=(False, True))}


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = materialize(_series(spark, sf_dir), "series")
    return anomalies.flagged(anomalies.measured(series), _FIELDS, _LIMITS).unionByName(anomalies.impossible(series, _FIELDS))


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir)


def p2_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.stuck(anomalies.measured(materialize(_series(spark, sf_dir), "series")), _FIELDS, _LIMITS)


def p2_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anomalies.impossible(_series(spark, sf_dir), _FIELDS).drop("reason")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("record_table", "record_field", "row_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compaction.compact(spark, f"{sf_dir}/datapoints.parquet")
    return compaction.counted_timestamps(done).where("timestamps < 64").select("metric", "block_id")


def p3_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = compaction.compact(spark, f"{sf_dir}/datapoints.parquet")
    return done.rows.select("metric", "ts_nanos", "fields.c0", "fields.c1", "fields.c2", "row_id", "block_id", "owner")


def p3_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datapoints in a great many small files, compacted in two runs: what the manifest lists of each metric after the second,
    and whether files are as few and as large as they should be.
    """
    source, workspace, target = scratch_path(spark, "small-files"), scratch_path(spark, "compaction"), 20_000
    points = _table(spark, sf_dir, "datapoints").withColumn("late", F.pmod(F.xxhash64("block_id"), F.lit(5)) == 0)
    for late in (False, True):
        points.where(F.col("late") == late if late else "not coalesce(late, false)").drop("late").repartition(60, "row_id").write.mode("append").parquet(source)
        done = compaction.compact(spark, source, workspace=workspace, target_rows=target)
    n, blocks, most = F.sum("n_rows"), F.count(F.lit(1)), F.max("n_rows")
    return done.blocks.groupBy("metric").agg(
        n.alias("n_rows"), F.sum("timestamps").alias("timestamps"), F.min("since_nanos").alias("first_nanos"), F.max("last_nanos").alias("last_nanos"),
        ((most <= 3 * target) & (blocks <= 4 + 4 * n / target)).alias("well_sized"),
    )


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = distinct_trades(_table(spark, sf_dir, "trades"))
    exact = {f: F.when(finite(F.col(f)) > 0, finite(F.col(f))).try_cast("decimal(28,10)") for f in ("price", "size")}
    return rolling.with_all_days(rolling.daily_totals(trades, "market", "trade_day", exact))


def p5_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [F.col("entity").alias("market"), F.date_format("day", "yyyy-MM-dd").alias("trade_day"), F.col("n_rows").alias("trades")]
    for w in (7, 30):
        out.append(F.col(f"n_rows_{w}d").alias(f"trades_{w}d"))
        for f in ("size", "price"):
            total = F.col(f"sum_{f}_{w}d").cast("double")
            out += [total.alias(f"{f}_total_{w}d"), F.try_divide(total, F.col(f"n_{f}_{w}d")).alias(f"{f}_avg_{w}d")]
    found = rolling.trailing_totals(_daily(spark, sf_dir), ["n_rows", "sum_size", "n_size", "sum_price", "n_price"], (7, 30))
    return found.select(*out)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that add no trade to the trailing totals: those over 7 and 30 days are those of the 6 and 29 days before."""
    totals = rolling.trailing_totals(_daily(spark, sf_dir), ["n_rows"], (6, 7, 29, 30))
    before = Window.partitionBy("entity").orderBy("day")
    added = [F.col(f"n_rows_{w}d") - F.coalesce(F.lag(f"n_rows_{w - 1}d").over(before), F.lit(0)) for w in (7, 30)]
    idle = totals.withColumns({"added_7d": added[0], "added_30d": added[1]}).where("added_7d = 0 and added_30d = 0")
    return idle.select(F.col("entity").alias("market"), F.date_format("day", "yyyy-MM-dd").alias("trade_day"))


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = intervals.latest_versions(_table(spark, sf_dir, "block_manifest"))
    return held.select(F.col("metric").alias("entity"), F.col("since_sec").alias("since"), F.col("until_sec").alias("until"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.gaps(_covered(spark, sf_dir))
    return found.select(F.col("entity").alias("metric"), F.col("gap_since").alias("gap_since_sec"), F.col("gap_until").alias("gap_until_sec"))


def p6_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.periods(_covered(spark, sf_dir))
    return found.select(F.col("entity").alias("metric"), F.col("since").alias("since_sec"), F.col("until").alias("until_sec"))


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p1_observed, p1_held_out, p2_found, p2_flags, p2_stuck, p2_impossible, p3_found, p3_compacted, p3_blocks, p5_found, p5_trailing, p6_found, p6_periods)}

# One delivery of each trade, with its instant and UTC day.
ONE_DELIVERY = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(trade_id, -1), CASE WHEN trade_id IS NULL THEN row_id END
 ORDER BY exec_date IS NULL, received_at NULLS LAST, row_id) AS delivery, CAST(CAST(upper(exec_date) AS TIMESTAMPTZ) AS DATE) AS d FROM trades) WHERE delivery = 1)"""
_USABLE = "CASE WHEN isfinite({0}) AND {0} > 0 THEN CAST({0} AS DECIMAL(28,10)) END"
_CALENDAR = f"""days AS (SELECT market, d, count(*) AS n, sum({_USABLE.format("size")}) AS s, count({_USABLE.format("size")}) AS ns,
 sum({_USABLE.format("price")}) AS p, count({_USABLE.format("price")}) AS np FROM {ONE_DELIVERY} WHERE d IS NOT NULL GROUP BY ALL),
 ends AS (SELECT market, min(d) AS lo, max(d) AS hi FROM days GROUP BY ALL),
 cal AS (SELECT market, CAST(unnest(range(lo, hi + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM ends)"""


def _trailing_sql() -> str:
    parts = []
    for w in (7, 30):
        over = f"OVER (PARTITION BY market ORDER BY d RANGE BETWEEN INTERVAL {w - 1} DAY PRECEDING AND CURRENT ROW)"
        parts.append(f"CAST(sum(coalesce(n, 0)) {over} AS BIGINT) AS trades_{w}d")
        for name, v, c in (("size", "s", "ns"), ("price", "p", "np")):
            # by way of text, as DuckDB's own cast of a long decimal isn't always the nearest double
            total = f"CAST(CAST(sum(coalesce({v}, 0)) {over} AS VARCHAR) AS DOUBLE)"
            parts.append(f"{total} AS {name}_total_{w}d")
            parts.append(f"{total} / CAST(nullif(sum(coalesce({c}, 0)) {over}, 0) AS BIGINT) AS {name}_avg_{w}d")
    return f"""WITH {_CALENDAR} SELECT market, strftime(d, '%Y-%m-%d') AS trade_day, coalesce(n, 0) AS trades, {", ".join(parts)}
 FROM cal LEFT JOIN days USING (market, d)"""


_LATEST = """(SELECT metric, since_sec AS s, until_sec AS u FROM (SELECT *, row_number() OVER (PARTITION BY block_id
 ORDER BY updated_at_nanos DESC NULLS LAST, until_sec DESC NULLS LAST, since_sec DESC NULLS LAST) AS v FROM block_manifest) WHERE v = 1 AND since_sec < until_sec)"""
_EDGES = f"(SELECT *, max(u) OVER (PARTITION BY metric ORDER BY s, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_LATEST})"
_OWNED = """(SELECT metric, ts_nanos, min(block_id) AS block_id FROM datapoints WHERE ts_nanos IS NOT NULL AND block_id IS NOT NULL GROUP BY ALL)"""
_KEPT = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, ts_nanos, c0, c1, c2, CASE WHEN ts_nanos IS NULL THEN row_id END ORDER BY block_id, row_id) AS copy,
 min(block_id) OVER (PARTITION BY metric, ts_nanos) AS first_block FROM datapoints WHERE block_id IS NOT NULL) WHERE copy = 1)"""

# Trades' times in nanoseconds, by way of the text's own fraction.
_NANOS = """epoch_us(date_trunc('second', upper(exec_date)::TIMESTAMPTZ)) * 1000 + rpad(regexp_extract(exec_date, '\\.(\\d+)', 1), 9, '0')::BIGINT"""
# Runs of one value, by time and value, copies counted once; then how many readings lie outside long runs and change the value.
_STUCK = f"""WITH s AS (SELECT 'datapoints' AS record_table, 'c0' AS record_field, metric AS source, row_id, ts_nanos AS t, c0 AS v FROM datapoints LEFT JOIN metric_catalog USING (metric)
 WHERE isfinite(c0) AND NOT coalesce(c0 < low_limit OR c0 > high_limit, FALSE) UNION ALL SELECT 'datapoints', 'c1', metric, row_id, ts_nanos, c1 FROM datapoints WHERE isfinite(c1)
 UNION ALL SELECT 'trades', 'price', market, row_id, {_NANOS}, price FROM trades WHERE isfinite(price) AND price > 0 AND exec_date IS NOT NULL),
 d AS (SELECT DISTINCT record_table, record_field, source, t, v FROM s WHERE t IS NOT NULL),
 c AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY record_table, record_field, source ORDER BY t, v) <> v, TRUE) AS changed FROM d),
 r AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY record_table, record_field, source ORDER BY t, v ROWS UNBOUNDED PRECEDING) AS run FROM c),
 l AS (SELECT *, count(*) OVER (PARTITION BY record_table, record_field, source, run) AS length FROM r),
 m AS (SELECT s.record_table, s.record_field, s.source, s.row_id, length, changed FROM s JOIN l ON s.record_table = l.record_table AND s.record_field = l.record_field
 AND s.source IS NOT DISTINCT FROM l.source AND s.t = l.t AND s.v = l.v),
 q AS (SELECT record_table, record_field, source, count(*) FILTER (length <= 10) AS loose, count(*) FILTER (length <= 10 AND changed) AS change, count(*) FILTER (changed) AS runs FROM m GROUP BY ALL)
 SELECT m.record_table, m.record_field, m.row_id FROM m JOIN q ON m.record_table = q.record_table AND m.record_field = q.record_field AND m.source IS NOT DISTINCT FROM q.source
 WHERE length > 10 AND coalesce(change / nullif(loose, 0), 1) >= 0.7 AND coalesce(change / nullif(runs, 0), 1) >= 0.7"""

ORACLES: dict[str, str] = {
    "p2_stuck": _STUCK,
    "p1_found": """WITH u AS (SELECT d.metric, m.period_sec AS p, (d.ts_nanos // 1000000000) // m.period_sec AS cell FROM datapoints d JOIN metric_catalog m USING (metric)
 WHERE ts_nanos IS NOT NULL AND isfinite(c0)), b AS (SELECT metric, p, min(cell) AS lo, max(cell) AS hi FROM u GROUP BY ALL),
 g AS (SELECT metric, p, unnest(range(lo, hi + 1)) AS cell FROM b)
 SELECT metric, cell * p AS cell_start_sec FROM g ANTI JOIN u USING (metric, cell)""",
    "p1_observed": """SELECT metric, (ts_nanos // 1000000000) // period_sec * period_sec AS cell_start_sec, round(CASE WHEN min(c0) = max(c0) THEN min(c0) ELSE avg(c0) END, 6) AS value
 FROM datapoints JOIN metric_catalog USING (metric) WHERE ts_nanos IS NOT NULL AND isfinite(c0) GROUP BY metric, period_sec, cell_start_sec""",
    "p2_impossible": """SELECT record_table, record_field, row_id FROM (SELECT 'datapoints' AS record_table, unnest(['c0', 'c1']) AS record_field, row_id, unnest([coalesce(isinf(c0) OR (NOT isnan(c0) AND (c0 < low_limit OR c0 > high_limit)), FALSE), coalesce(isinf(c1), FALSE)]) AS bad
 FROM datapoints LEFT JOIN metric_catalog USING (metric) WHERE ts_nanos IS NOT NULL UNION ALL SELECT 'trades', unnest(['price', 'size']), row_id,
 unnest([coalesce(NOT isnan(price) AND (price <= 0 OR isinf(price)), FALSE), coalesce(NOT isnan(size) AND (size <= 0 OR isinf(size)), FALSE)]) FROM trades WHERE exec_date IS NOT NULL) WHERE bad""",
    "p3_found": f"""SELECT metric, block_id FROM (SELECT DISTINCT metric, block_id FROM datapoints WHERE block_id IS NOT NULL)
 LEFT JOIN (SELECT metric, block_id, count(*) AS n FROM {_OWNED} GROUP BY ALL) USING (metric, block_id) WHERE coalesce(n, 0) < 64""",
    "p3_compacted": f"""SELECT metric, ts_nanos, c0, c1, c2, row_id, block_id, CASE WHEN ts_nanos IS NOT NULL THEN first_block END AS owner FROM {_KEPT}""",
    "p3_blocks": f"""SELECT metric, count(*) AS n_rows, count(DISTINCT ts_nanos) AS timestamps, min(ts_nanos) AS first_nanos, max(ts_nanos) AS last_nanos, TRUE AS well_sized
 FROM {_KEPT} GROUP BY metric""",
    "p5_found": f"WITH {_CALENDAR} SELECT market, strftime(d, '%Y-%m-%d') AS trade_day FROM cal ANTI JOIN days USING (market, d)",
    "p5_trailing": _trailing_sql(),
    "p6_found": f"SELECT metric, before AS gap_since_sec, s AS gap_until_sec FROM {_EDGES} WHERE before < s",
    "p6_periods": f"""SELECT metric, min(s) AS since_sec, max(u) AS until_sec FROM (SELECT *, sum(CASE WHEN before >= s THEN 0 ELSE 1 END)
 OVER (PARTITION BY metric ORDER BY s, u ROWS UNBOUNDED PRECEDING) AS k FROM {_EDGES}) GROUP BY metric, k""",
}
