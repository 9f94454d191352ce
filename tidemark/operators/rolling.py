"""Trailing totals over calendar days by block decomposition.

Days are cut into blocks as long as the window. Within a block, prefix and suffix sums are kept; the window that ends
on a day is the suffix of the block before, from the window's first day on, and the prefix of the day's own block. So
each total costs one addition, however long the window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_totals(df: DataFrame, entity: str, day: str, values: Mapping[str, Column]) -> DataFrame:
    """(entity, day, n_rows, sum_X, n_X ...) of the days that have rows; nulls among the values are left out of both.

    Rows without a day belong to no day and are left out; a null entity is an entity of its own.
    """
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for name, value in values.items():
        aggs += [F.sum(value).alias(f"sum_{name}"), F.count(value).alias(f"n_{name}")]
    return df.where(F.col(day).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(day).alias("day")).agg(*aggs)


def with_all_days(daily: DataFrame) -> DataFrame:
    """Adds the days without rows between an entity's first and last day, with zero counts and sums."""
    by_day = Window.partitionBy("entity").orderBy("day")
    bounded = daily.withColumn("_until", F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), F.col("day")))
    spread = bounded.withColumn("_day", F.explode(F.sequence("day", "_until")))
    given = F.col("_day") == F.col("day")
    cols = [
        F.when(given, F.coalesce(F.col(c.name), F.lit(0))).otherwise(F.lit(0)).cast(c.dataType).alias(c.name)
        for c in daily.schema.fields
        if c.name not in ("entity", "day")
    ]
    return spread.select("entity", F.col("_day").alias("day"), *cols)


def trailing_totals(daily: DataFrame, measures: Sequence[str], windows: Sequence[int]) -> DataFrame:
    """Adds ``<measure>_<L>d`` for each window of L days: the total over the day and the L - 1 days before it.

    ``daily`` has (entity, day, measures) with every day from the entity's first to its last; days before the first
    count as zero. Integer and decimal measures are exact and don't depend on the order of addition. An empty input
    gives an empty result. All windows share the partitioning by entity: one shuffle.
    """
    number = F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))
    by_day = Window.partitionBy("entity").orderBy("day")
    out, extra = daily, []
    types = {f.name: f.dataType for f in daily.schema.fields}
    for length in windows:
        block = f"_block{length}"
        out = out.withColumn(block, F.floor(number / length)).withColumn(f"_pos{length}", F.pmod(number, F.lit(length)))
        up = Window.partitionBy("entity", block).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy("entity", block).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
        for m in measures:
            out = out.withColumn(f"_prefix{length}_{m}", F.sum(m).over(up).cast(types[m]))
        for m in measures:
            out = out.withColumn(f"_suffix{length}_{m}", F.sum(m).over(down).cast(types[m]))
        extra += [block, f"_pos{length}"] + [f"_{k}{length}_{m}" for k in ("prefix", "suffix") for m in measures]
    for length in windows:
        block, pos = f"_block{length}", F.col(f"_pos{length}")
        first_block = F.first(block).over(by_day)
        for m in measures:
            suffix = f"_suffix{length}_{m}"
            # the window's first day may lie before the entity's first; then all of the block before counts
            at_start = F.when(first_block == F.col(block) - 1, F.first(suffix).over(by_day)).otherwise(F.lit(0))
            before = F.coalesce(F.lag(suffix, length - 1).over(by_day), at_start)
            total = F.col(f"_prefix{length}_{m}") + F.when(pos == length - 1, F.lit(0)).otherwise(before)
            out = out.withColumn(f"{m}_{length}d", total.cast(types[m]))
    return out.drop(*extra)
