"""Operators on series: frames whose first key is LONG ``ts_nanos``; all other columns are fields by position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import floor_div
from tidemark.plans.analyze import Limit, TimeRange
from tidemark.storage import ship

TS = "ts_nanos"
#: Nanoseconds of a storage bucket (10**5 seconds).
BUCKET_NANOS = 10**14


def in_range(bounds: TimeRange, ts: Column | None = None) -> Column:
    """The predicate of a half-open range; an inverted range holds nothing."""
    ts = F.col(TS) if ts is None else ts
    test = F.lit(True)
    if bounds.since is not None:
        test = test & (ts >= F.lit(bounds.since))
    if bounds.until is not None:
        test = test & (ts < F.lit(bounds.until))
    return test


def bucket_range(bounds: TimeRange) -> Column:
    """The predicate on the ``ts_bucket`` partition that follows from a range, so that whole folders are skipped."""
    test = F.lit(True)
    if bounds.since is not None:
        test = test & (F.col("ts_bucket") >= bounds.since // BUCKET_NANOS)
    if bounds.until is not None:
        test = test & (F.col("ts_bucket") <= (bounds.until - 1) // BUCKET_NANOS)
    return test


def clip(df: DataFrame, bounds: TimeRange) -> DataFrame:
    """Rows in the range; rows without a time are in none."""
    return df.where(in_range(bounds) & F.col(TS).isNotNull())


def split(df: DataFrame, bounds: TimeRange) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(before, within, after) a range."""
    before = F.lit(False) if bounds.since is None else F.col(TS) < F.lit(bounds.since)
    after = F.lit(False) if bounds.until is None else F.col(TS) >= F.lit(bounds.until)
    return df.where(before), clip(df, bounds), df.where(after & ~before)


def purge(df: DataFrame, bounds: TimeRange) -> DataFrame:
    """All rows but those in the range."""
    return df.where(~in_range(bounds) | F.col(TS).isNull())


def _few_distinct(n: int, last: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's n first or last distinct times; memory is bounded by n, whatever the number of ties."""
        held = np.zeros(0, np.int64)
        for batch in batches:
            times = batch.column(0).to_numpy()
            if len(held) == n:  # next to all later times lie beyond those held
                times = times[times > held[0]] if last else times[times < held[-1]]
            held = np.unique(np.r_[held, times])
            held = held[-n:] if last else held[:n]
        yield pa.RecordBatch.from_arrays([pa.array(held)], [TS])

    return keep


def limit_distinct(df: DataFrame, limit: Limit) -> DataFrame:
    """Rows of the first or last n distinct timestamps, with all ties.

    Only the times are looked at to find the bound: each partition hands on n of them at most, and the rows are then
    filtered by the bound itself, so neither ties nor payloads are ever gathered in one place.
    """
    if limit.n <= 0:
        return df.where(F.lit(False))
    ship(df.sparkSession)
    last = limit.side == "tail"
    times = df.where(F.col(TS).isNotNull()).select(TS).mapInArrow(_few_distinct(limit.n, last), f"{TS} bigint").distinct()
    edge = times.orderBy(F.col(TS).desc() if last else F.col(TS).asc()).limit(limit.n)
    bound = edge.agg((F.min if last else F.max)(TS)).scalar()
    return df.where(F.col(TS) >= bound if last else F.col(TS) <= bound)


def ordered(df: DataFrame, tie_keys: Sequence[str | Column] = ()) -> DataFrame:
    """Ascending in time; ``tie_keys`` order the rows of one timestamp."""
    return df.orderBy(TS, *tie_keys)


def merge(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Bag union of series with the same fields, overlapping or not; duplicates are kept.

    Fields of different number or type are an error, as silently widened types would change stored blocks.
    """
    for other in others:
        if [f.dataType for f in other.schema] != [f.dataType for f in first.schema]:
            raise TypeError(f"series differ: {first.schema.simpleString()} and {other.schema.simpleString()}")
    out = first
    for other in others:
        out = out.union(other)
    return out


def hull(df: DataFrame) -> DataFrame:
    """(since_sec, until_sec): the interval from the least since to the greatest until."""
    return df.agg(F.min("since_sec").alias("since_sec"), F.max("until_sec").alias("until_sec"))


def block_stats(df: DataFrame, block: Sequence[str | Column]) -> DataFrame:
    """Of each block its seconds (until exclusive) and number of distinct timestamps."""
    return df.groupBy(*block).agg(
        floor_div(F.min(TS), 10**9).alias("since_sec"),
        (floor_div(F.max(TS), 10**9) + 1).alias("until_sec"),
        F.count_distinct(TS).alias("timestamp_num"),
    )


def is_sorted(df: DataFrame) -> bool:
    """Whether each partition ascends in time, and the partitions follow each other."""
    spans = df.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i"), TS)
    w = Window.partitionBy("p").orderBy("i")
    steps = spans.withColumn("prev", F.lag(TS).over(w))
    within = steps.where(F.col("prev") > F.col(TS)).limit(1).count() == 0
    ends = [r for r in spans.groupBy("p").agg(F.min(TS).alias("lo"), F.max(TS).alias("hi")).orderBy("p").collect()]
    return within and all(a["hi"] <= b["lo"] for a, b in zip(ends, ends[1:], strict=False))


def to_rows(df: DataFrame) -> Iterator[tuple[int, tuple]]:
    """Datapoints (time, field values), one at a time, in order."""
    for row in ordered(df).toLocalIterator():
        values = row.asDict()
        ts = values.pop(TS)
        yield ts, tuple(values.values())
