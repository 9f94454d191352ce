"""Continuous periods and gaps of intervals per entity.

Overlapping intervals are merged by Spark's ``session_window`` with a row-specific duration. An entity may hold any
share of the rows, so the merge runs per (entity, time bucket): each bucket gets one carried interval for what earlier
buckets still cover, so that all gaps are found within buckets by ``lag``, and period ends by ``lead`` over the one
summary row that each bucket keeps. Within a bucket only the place of a start in it and the length up to its end matter,
so bounds may lie as far off as whole numbers go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialize


def latest_versions(manifest: DataFrame) -> DataFrame:
    """(metric, since_sec, until_sec): of several rows of a block the one with the greatest ``updated_at_nanos``.

    Ties are broken by the greater ``until_sec``, then ``since_sec``, then ``metric``, nulls first; rows with a null
    ``block_id`` are blocks of their own. The aggregate combines on the map side, so no block_id is too frequent.
    """
    order = ["updated_at_nanos", "until_sec", "since_sec", "metric"]
    named = manifest.where("block_id is not null").groupBy("block_id").agg(F.max(F.struct(*order)).alias("x"))
    lone = manifest.where("block_id is null")
    cols = ["metric", "since_sec", "until_sec"]
    return named.select(*[f"x.{c}" for c in cols]).unionByName(lone.select(*cols))


def _pieces(intervals: DataFrame, bucket_sec: int) -> DataFrame:
    """(entity, bucket, since, until, prev_end): merged pieces with the end of all coverage before each of them."""
    bounds = intervals.select("entity", F.col("since").cast("bigint"), F.col("until").cast("bigint")).where("since < until")
    bucket = F.expr(f"since div {bucket_sec} - if(since % {bucket_sec} < 0, 1, 0)")
    valid = bounds.select("entity", bucket.alias("bucket"), "since", "until")
    valid = materialize(valid, "intervals")  # read twice, and costly to find out if versions had to be compared
    buckets = valid.groupBy("entity", "bucket").agg(F.max("until").alias("top"))
    before = Window.partitionBy("entity").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(buckets.withColumn("carry", F.max("top").over(before)), "carried")
    start = F.try_multiply(F.col("bucket"), F.lit(bucket_sec).cast("bigint"))  # an entity's first bucket may begin before all numbers
    carry_rows = carried.where(F.col("carry") > start).select("entity", "bucket", start.alias("since"), F.col("carry").alias("until"))
    all_rows = valid.unionByName(carry_rows).withColumn("ts", F.timestamp_seconds(F.pmod("since", F.lit(bucket_sec))))
    # what is longer than a bucket reaches beyond all starts in it, however long
    longest = f"least(coalesce(try_subtract(until, since), {bucket_sec + 1}), {bucket_sec + 1})"
    length = F.expr(f"make_interval(0, 0, 0, 0, 0, 0, cast({longest} as decimal(18, 6)))")
    merged = all_rows.groupBy("entity", "bucket", F.session_window("ts", length).alias("w")).agg(
        F.min("since").alias("since"), F.max("until").alias("until")
    )
    in_bucket = Window.partitionBy("entity", "bucket").orderBy("since")
    first_prev = carried.select("entity", "bucket", "carry")
    joined = merged.alias("m").join(
        first_prev.alias("c"), F.col("m.entity").eqNullSafe(F.col("c.entity")) & (F.col("m.bucket") == F.col("c.bucket"))
    )
    reached = F.max("until").over(in_bucket.rowsBetween(Window.unboundedPreceding, -1))
    return joined.select("m.entity", "m.bucket", "m.since", "m.until", "c.carry").withColumn("prev_end", F.coalesce(F.greatest(reached, "carry"), reached, "carry"))


def gaps(intervals: DataFrame, bucket_sec: int = 86_400) -> DataFrame:
    """(entity, gap_since, gap_until): maximal uncovered stretches between two covered ones of an entity.

    ``intervals`` has (entity, since, until) in whole seconds, until exclusive. Intervals with a null bound or with since
    not below until cover nothing. Touching intervals leave no gap. A null entity is an entity of its own; an empty input
    gives an empty result.
    """
    return (
        _pieces(intervals, bucket_sec)
        .where(F.col("prev_end") < F.col("since"))
        .select("entity", F.col("prev_end").alias("gap_since"), F.col("since").alias("gap_until"))
    )


def periods(intervals: DataFrame, bucket_sec: int = 86_400) -> DataFrame:
    """(entity, since, until): the continuous covered periods; the same rules as :func:`gaps` hold."""
    pieces = _pieces(intervals, bucket_sec)
    starts = F.col("prev_end").isNull() | (F.col("prev_end") < F.col("since"))
    by_bucket = pieces.groupBy("entity", "bucket").agg(
        F.max("until").alias("top"), F.min_by(F.when(starts, F.col("prev_end")), F.when(starts, F.col("since"))).alias("first_end")
    )
    later = Window.partitionBy("entity").orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("entity")
    closing = by_bucket.select(
        "entity", "bucket", F.coalesce(F.first("first_end", ignorenulls=True).over(later), F.max("top").over(whole)).alias("next_end")
    )
    in_bucket = Window.partitionBy("entity", "bucket").orderBy("since")
    begun = pieces.where(starts).withColumn("lead_end", F.lead("prev_end").over(in_bucket))
    return (
        begun.alias("b")
        .join(closing.alias("c"), F.col("b.entity").eqNullSafe(F.col("c.entity")) & (F.col("b.bucket") == F.col("c.bucket")))
        .select("b.entity", "b.since", F.coalesce("b.lead_end", "c.next_end").alias("until"))
    )
