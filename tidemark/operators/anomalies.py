"""Implausible readings, judged by what is normal for their source.

A reading's deviation is its distance from the median of the readings around it. Quantile sketches of the deviations
are kept per source, field and hour of day and merged across partitions; readings beyond the sketches' interquartile
fences, expanded by a factor, are spikes if the change against the readings before and after them is as implausible.
Stretches of zero variance are flagged in series that otherwise change with nearly every reading.

Readings are sorted once by source and time over all partitions, and each partition is judged as it streams by, some
thousand values at a time, so neither a busy source nor a burst within it makes a task hold more. Only the values at the
edges of a partition, which lack neighbours there, are handed on with the values around them and judged after that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timestamps import NANOS
from tidemark.storage import discard, join_small, materialize, settings, ship

#: Readings around a reading that its deviation is measured against, on either side.
REACH = 10
#: Interquartile ranges of a normal distribution in standard deviations.
IQR_SIGMAS = 1.349
#: Parts of the deviations whose quantiles tell the shape of the tail, for large sources and ever smaller ones, and the
#: size of the sketch that holds them (rank errors below half a percent).
TAILS, TAIL_SKETCH = (0.03, 0.06, 0.12, 0.25, 0.5), 800
#: Groups whose sketches (20 kB each) a task holds before it sorts its readings by group instead.
GROUPS = 2048
#: Departures from a value that three quarters of a series hold, in all and as a part of its readings, that are too few to
#: have a usual size; and the part of that value which then stands for it.
FEW, FEW_PART, LEVEL_PART = 2, 0.0025, 0.01


@dataclass(frozen=True)
class Limits:
    """``max_run``: a value may stay the same for so many distinct times. ``min_change``: part of the readings that must
    change for a series to count as one that changes with nearly every reading. ``frozen``: fields judged for runs.
    ``logarithm``: fields that are logarithms, whose level is no measure of what a small part of it is.
    """

    max_run: int = 10
    min_change: float = 0.7
    frozen: tuple[bool, bool] = (True, True)
    logarithm: tuple[bool, bool] = (False, False)
    min_context: int = 200
    min_readings: int = 7


def _sides(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The medians of the REACH values before and after each; NaN where there are fewer than three."""
    before = pd.Series(v).rolling(REACH, min_periods=3).median().to_numpy()
    after = np.full(len(v), np.nan)
    after[: max(0, len(v) - REACH)] = before[REACH:]
    end = v[::-1][:REACH]
    after[::-1][1 : len(end)] = pd.Series(end).rolling(REACH, min_periods=3).median().to_numpy()[: len(end) - 1]
    return np.r_[np.nan, before[:-1]], after


def _measure(t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each value, in order of time: its deviation from the values around it; its jump, the least change against those
    around, before and after it where they agree in direction; its run length in distinct times; and whether the value
    changed with it.
    """
    by = np.lexsort((v, t))
    t, v = t[by], v[by]
    new = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])]  # copies of a reading count once
    which = np.cumsum(new) - 1
    t, v = t[new], v[new]
    deviation = v - pd.Series(v).rolling(2 * REACH + 1, center=True, min_periods=1).median().to_numpy()
    jump = deviation.copy()
    for side in _sides(v):
        step = np.where(np.isnan(side), deviation, v - side)
        nearer = np.where(np.abs(step) < np.abs(jump), step, jump)
        jump = np.where(np.sign(step) == np.sign(jump), nearer, 0.0)
    change = np.r_[True, v[1:] != v[:-1]]
    run_id = np.cumsum(change) - 1
    length = np.bincount(run_id, weights=np.r_[True, t[1:] != t[:-1]] | change).astype(np.int32)
    out = []
    for x in (deviation, jump, length[run_id], change):
        back = np.empty(len(by), x.dtype)
        back[by] = x[which]
        out.append(back)
    return tuple(out)


READING = (
    "record_table string, source string, field int, row_id bigint, hour int, value double, deviation double, jump double, "
    "run int, changed boolean, ts_nanos bigint, due boolean"
)
_NAMES = [x.split()[0] for x in READING.split(", ")]


class _Rows:
    """Judged values, and values of edges (with ``ts_nanos`` and ``due``), gathered into batches."""

    def __init__(self) -> None:
        self.keys, self.parts, self.size = [], [], 0

    def add(self, key: tuple[str, str, int], row: np.ndarray, t: np.ndarray, v: np.ndarray, judged: tuple = (), due: np.ndarray | None = None) -> None:
        n = len(row)
        if n:
            self.keys.append((*key, n))
            held = judged or (np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int32), np.zeros(n, bool))
            self.parts.append((row, t, v, *held, np.full(n, due is not None), np.zeros(n, bool) if due is None else due))
            self.size += n

    def take(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        tables, sources, fields, sizes = zip(*self.keys, strict=True)
        row, t, v, deviation, jump, run, changed, edge, due = (np.concatenate(x) for x in zip(*self.parts, strict=True))

        def named(names: tuple) -> pa.Array:
            return pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)), pa.array(names, pa.string())).cast(pa.string())

        hour = (t // (3600 * NANOS) % 24).astype(np.int32)
        columns = [named(tables), named(sources), pa.array(np.repeat(np.array(fields, np.int32), sizes)), pa.array(row), pa.array(hour), pa.array(v)]
        columns += [pa.array(x, mask=edge) for x in (deviation, jump, run, changed)] + [pa.array(t, mask=~edge), pa.array(due, mask=~edge)]
        self.keys, self.parts, self.size = [], [], 0
        yield pa.RecordBatch.from_arrays(columns, _NAMES)


class _Stretch:
    """The values of one field of one source in a partition, in order of time, as far as they are still needed.

    ``margin`` distinct times on either side are what a value is judged by. ``open_left``: the source's earlier values may
    lie in another partition.
    """

    def __init__(self, key: tuple[str, str, int], margin: int, open_left: bool) -> None:
        self.key, self.margin, self.open_left = key, margin, open_left
        self.t, self.row, self.v, self.due = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        self.own = 0  # the first value that isn't judged yet

    def add(self, t: np.ndarray, row: np.ndarray, v: np.ndarray, due: np.ndarray) -> None:
        self.t, self.row, self.v, self.due = (np.concatenate(x) for x in ((self.t, t), (self.row, row), (self.v, v), (self.due, due)))

    def _begins(self) -> np.ndarray:
        """Where each distinct time begins."""
        return np.flatnonzero(np.r_[True, self.t[1:] != self.t[:-1]])

    def _judge(self, lo: int, hi: int, out: _Rows) -> None:
        wanted = np.arange(lo, hi)[self.due[lo:hi]]
        if len(wanted):
            measured = tuple(x[wanted] for x in _measure(self.t, self.v))
            out.add(self.key, self.row[wanted], self.t[wanted], self.v[wanted], measured)

    def _edges(self, edge: np.ndarray, due: np.ndarray, out: _Rows) -> None:
        out.add(self.key, self.row[edge], self.t[edge], self.v[edge], due=due[edge])

    def advance(self, chunk_rows: int, out: _Rows) -> None:
        """Judge what has enough values after it, once that is a chunk, and forget what no other value needs."""
        if len(self.t) - self.own < chunk_rows:
            return
        m, begins = self.margin, self._begins()
        if len(begins) < 3 * m + 2:
            return
        if self.open_left:
            edge = np.arange(len(self.t)) < begins[2 * m]
            self._edges(edge, np.arange(len(self.t)) < begins[m], out)
            self.own, self.open_left = int(begins[m]), False
        cut = int(begins[-(m + 1)])  # more values of the last time may be to come
        if cut - self.own < chunk_rows // 2:
            return
        self._judge(self.own, cut, out)
        keep = int(begins[max(0, len(begins) - 2 * m - 1)])
        self.t, self.row, self.v, self.due = self.t[keep:], self.row[keep:], self.v[keep:], self.due[keep:]
        self.own = cut - keep

    def finish(self, open_right: bool, out: _Rows) -> None:
        n = len(self.t)
        if not n:
            return
        m, begins, at = self.margin, self._begins(), np.arange(n)
        lo, hi, k = self.own, n, len(begins)
        edge, due = np.zeros(n, bool), np.zeros(n, bool)
        if self.open_left:
            lo = int(begins[m]) if k > m else n
            edge |= at < (begins[2 * m] if k > 2 * m else n)
            due |= at < lo
        if open_right:
            hi = int(begins[max(0, k - m)])
            edge |= at >= begins[max(0, k - 2 * m)]
            due |= at >= hi
        self._edges(edge, due, out)
        if lo < hi:
            self._judge(lo, hi, out)


def _segments(batch: pa.RecordBatch, names: list[str]) -> list[tuple[tuple, int, int]]:
    """The runs of rows of a batch that agree in the columns ``names``: (their values, begin, end)."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for name in names:
        codes = batch.column(name).dictionary_encode().indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    begins = np.flatnonzero(new)
    keys = zip(*(batch.column(name).take(pa.array(begins)).to_pylist() for name in names), strict=True)
    return [(key, int(a), int(b)) for key, a, b in zip(keys, begins, np.r_[begins[1:], batch.num_rows], strict=True)]


def _judge_partition(chunk_rows: int, margin: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows of a partition, each with both values."""
        out, key, held = _Rows(), None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            t, row = (batch.column(c).to_numpy() for c in ("ts_nanos", "row_id"))
            values = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("value1", "value2")]
            for its, a, b in _segments(batch, ["record_table", "source"]):
                if its != key:
                    for stretch in held:
                        stretch.finish(False, out)
                    held = [_Stretch((*its, k), margin, key is None) for k in (1, 2)]
                    key = its
                for stretch, v in zip(held, values, strict=True):
                    at = a + np.flatnonzero(np.isfinite(v[a:b]))
                    stretch.add(t[at], row[at], v[at], np.ones(len(at), bool))
                    stretch.advance(chunk_rows, out)
            if out.size >= 10_000:
                yield from out.take()
        for stretch in held:
            stretch.finish(True, out)
        yield from out.take()

    return judge


def _judge_edges(chunk_rows: int, margin: int):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted values of edges, all of a field and source in one partition; those that are due are judged."""
        out, stretch = _Rows(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, row, v = (batch.column(c).to_numpy() for c in ("ts_nanos", "row_id", "value"))
            due = batch.column("due").to_numpy(zero_copy_only=False)
            for key, a, b in _segments(batch, ["record_table", "source", "field"]):
                if stretch is None or key != stretch.key:
                    if stretch:
                        stretch.finish(False, out)
                    stretch = _Stretch(key, margin, False)
                stretch.add(t[a:b], row[a:b], v[a:b], due[a:b])
                stretch.advance(chunk_rows, out)
            if out.size >= 10_000:
                yield from out.take()
        if stretch:
            stretch.finish(False, out)
        yield from out.take()

    return judge


def measured(series: DataFrame, chunk_rows: int = 5000, max_run: int = 10) -> DataFrame:
    """The judged values (:data:`READING`) of ``series`` (record_table, source, row_id, ts_nanos, value1, value2).

    Rows without a time are left out; null, NaN and infinite values are missing. A null source is a source of its own.
    ``max_run`` is the greatest of the limits that the readings are judged by: a value is judged by one distinct time more
    than that, and more than ``REACH``, on either side. ``series`` is read twice, first to find the bounds of the sort, so it
    should be a written table. A task holds some chunks and the readings of one time.
    """
    spark = series.sparkSession
    ship(spark)
    needed = series.select("record_table", F.coalesce("source", F.lit("\0")).alias("source"), "row_id", "ts_nanos", "value1", "value2")
    keys = ["record_table", "source", "ts_nanos"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = needed.where("ts_nanos is not null").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    margin = max(REACH, max_run) + 1
    judged = materialize(ordered.mapInArrow(_judge_partition(chunk_rows, margin), READING), "judged")
    edges = judged.where("due is not null").select("record_table", "source", "field", "row_id", "ts_nanos", "value", "due")
    edges = edges.repartition("record_table", "source", "field").sortWithinPartitions("record_table", "source", "field", "ts_nanos")
    late = materialize(edges.mapInArrow(_judge_edges(chunk_rows, margin), READING), "judged-edges")
    return judged.where("due is null").unionByName(late).drop("ts_nanos", "due")


def _quantile(sketch: str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(p))


def _iqr(sketch: str) -> Column:
    return _quantile(sketch, 0.75) - _quantile(sketch, 0.25)


def _normal(tail: float) -> float:
    """So many standard deviations from the mean, on either side, leave ``tail`` of a normal distribution outside."""
    return NormalDist().inv_cdf(1 - tail / 2)


def _fence(sigmas: float) -> Column:
    """Where the tail of a source's deviations, carried on from two of its quantiles, is as thin as a normal one at ``sigmas``.

    The size of deviations as a power of a normal one's, taken from the quantiles, is between 1 and 2; small sources have
    no far quantiles, so nearer ones stand in for them. A normal tail is the least.
    """
    out = F.lit(None)
    for tail in reversed(TAILS):
        far, near = tail, min(0.5, 5 * tail)
        power = F.ln(_quantile("size", 1 - far) / _quantile("size", 1 - near)) / float(np.log(_normal(far) / _normal(near))) if near > far else F.lit(1.0)
        power = F.when(_quantile("size", 1 - near) > 0, F.least(F.greatest(power, F.lit(1.0)), F.lit(2.0))).otherwise(F.lit(1.0))
        reach = _quantile("size", 1 - far) * F.pow(F.lit(sigmas / _normal(far)), power)
        out = F.when(F.col("n") * tail >= 3, reach).otherwise(out)
    return F.greatest(out, sigmas / IQR_SIGMAS * _iqr("dev"))


def normal_ranges(readings: DataFrame, limits: dict[str, Limits], sigmas: float = 5.0) -> DataFrame:
    """(record_table, source, field, hour, fence, restless): the size of a jump beyond which a value is a spike, null where
    there is none, and whether the series changes with nearly every reading. The rules are those of :func:`flagged`.

    One sketch of the deviations, of their sizes, of the values and of the departures (deviations that aren't 0) is kept per
    source, field and hour and merged over the hours for the source as a whole.
    """
    keys = ["record_table", "source", "field"]
    loose = F.col("run") <= 10
    departure = F.when(F.col("deviation") != 0, F.abs("deviation"))
    hourly = readings.groupBy(*keys, "hour").agg(
        F.kll_sketch_agg_double("deviation").alias("dev"),
        F.kll_sketch_agg_double(F.abs("deviation"), F.lit(TAIL_SKETCH)).alias("size"),
        F.kll_sketch_agg_double("value").alias("val"),
        F.kll_sketch_agg_double(departure).alias("off"),
        F.count(departure).alias("away"),
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(loose, 1)).alias("loose"),
        F.count(F.when(loose & F.col("changed"), 1)).alias("change"),
        F.count(F.when(F.col("changed"), 1)).alias("runs"),
    )
    # a task sees few sources, but an hour and field of each is a group; sorting all readings by them would cost far more memory
    with settings(readings.sparkSession, objectHashAggregate_sortBased_fallbackThreshold=str(GROUPS)):
        hourly = materialize(hourly, "hour-sketches")
    whole = hourly.groupBy(*keys).agg(
        *[F.kll_merge_agg_double(c).alias(c) for c in ("dev", "val", "off")],
        F.kll_merge_agg_double("size", F.lit(TAIL_SKETCH)).alias("size"),
        *[F.sum(c).alias(c) for c in ("n", "away", "loose", "change", "runs")],
    )
    # of the readings outside long runs, how many change the value; of all runs, how many are short
    rate, short = (F.coalesce(F.try_divide("change", c), F.lit(1.0)) for c in ("loose", "runs"))
    few = F.col("away") <= F.greatest(F.lit(float(FEW)), FEW_PART * F.col("n"))
    level = F.when(_limit(limits, lambda x, k: x.logarithm[k]), F.lit(1.0)).otherwise(F.abs(_quantile("val", 0.5)))
    step = F.when(F.col("away") > 0, _quantile("off", 0.5))
    step = F.when(few, F.least(step, LEVEL_PART * level)).otherwise(step)
    held = F.when(_iqr("val") > 0, sigmas / IQR_SIGMAS * _iqr("val")).otherwise(2 * sigmas / IQR_SIGMAS * step)
    whole = whole.select(
        *keys,
        _iqr("dev").alias("all_dev"),
        ((_iqr("dev") <= 0) | (rate < 0.3)).alias("holds"),
        F.when((_iqr("dev") <= 0) | (rate < 0.3), held).otherwise(_fence(sigmas)).alias("all_fence"),
        (F.col("n") >= _limit(limits, lambda x, k: x.min_readings)).alias("known"),
        (F.least(rate, short) >= _limit(limits, lambda x, k: x.min_change)).alias("restless"),
    )
    own_hour = ~F.col("holds") & (F.col("n") >= _limit(limits, lambda x, k: x.min_context)) & (F.col("iqr") > 0)
    fence = F.when(own_hour, F.col("all_fence") * F.col("iqr") / F.col("all_dev")).otherwise(F.col("all_fence"))
    here = hourly.select(*keys, "hour", "n", _iqr("dev").alias("iqr")).join(whole, keys)
    out = materialize(here.select(*keys, "hour", F.when(F.col("known"), fence).alias("fence"), "restless"), "normal-ranges")
    discard(hourly)
    return out


def _limit(limits: dict[str, Limits], value) -> Column:
    """A limit or name that depends on the record table and the field."""
    out = F.lit(None)
    for name in limits:
        for k in (0, 1):
            out = F.when((F.col("record_table") == name) & (F.col("field") == k + 1), F.lit(value(limits[name], k))).otherwise(out)
    return out


def flagged(readings: DataFrame, fields: dict[str, tuple[str, str]], limits: dict[str, Limits], sigmas: float = 5.0) -> DataFrame:
    """(record_table, record_field, row_id, reason) of the values that are spikes or stuck.

    ``readings`` are those of :func:`measured`; ``fields`` names value1 and value2 of each record table. A deviation is a
    spike's where it is as unlikely as one of ``sigmas`` standard deviations is in a normal distribution; the scale is the
    hour's, the shape of the tail the source's. Where an hour of a source has fewer than ``min_context`` readings or a range
    of 0 the source's own scale is used; a source with fewer than ``min_readings`` has no normal range and no spikes.
    In series that hold their value by nature the values' own interquartile range is the scale. Where three quarters of a
    series hold one value that is 0, and the median of the departures from the readings around is the scale; where
    departures are too few for that (:data:`FEW`, :data:`FEW_PART`), at most a hundredth of the value held, so that any
    departure counts from a series that holds 0.
    """
    rows = _judged(readings, limits, sigmas)
    found = rows.withColumn("reason", F.when(F.col("spike"), F.lit("spike")).when(F.col("stuck"), F.lit("stuck"))).where("reason is not null")
    return found.select("record_table", _limit(fields, lambda x, k: x[k]).alias("record_field"), "row_id", "reason")


def stuck(readings: DataFrame, fields: dict[str, tuple[str, str]], limits: dict[str, Limits]) -> DataFrame:
    """(record_table, record_field, row_id) of the values in stretches of zero variance, spikes or not."""
    rows = _judged(readings, limits, 5.0).where("stuck")
    return rows.select("record_table", _limit(fields, lambda x, k: x[k]).alias("record_field"), "row_id")


def _judged(readings: DataFrame, limits: dict[str, Limits], sigmas: float) -> DataFrame:
    rows = join_small(readings, normal_ranges(readings, limits, sigmas), ["record_table", "source", "field", "hour"])
    long = F.col("run") > _limit(limits, lambda x, k: x.max_run)
    return rows.withColumns({"spike": F.abs("jump") > F.col("fence"), "stuck": F.col("restless") & long & _limit(limits, lambda x, k: x.frozen[k])})


def impossible(series: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """(record_table, record_field, row_id, reason) of the values of ``series`` that physics or meaning rule out, as
    ``bad1`` and ``bad2`` tell; nulls pass.
    """
    parts = []
    for k in (0, 1):
        bad = series.where(f"bad{k + 1}").withColumn("field", F.lit(k + 1))
        parts.append(bad.select("record_table", _limit(fields, lambda x, k: x[k]).alias("record_field"), "row_id", F.lit("impossible").alias("reason")))
    return parts[0].unionByName(parts[1])
