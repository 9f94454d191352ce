"""Exact percentiles per group by a full distributed sort with per-partition counts, for columns of any size.

The values are range-partitioned by (group, value) and sorted within partitions; each partition numbers its own rows,
the counts of all partitions give every partition's offset in its groups, and each row tells from its offset whether it
is one of the two neighbouring order statistics of a wanted position; only those are gathered and interpolated. The error
is zero.

What portions (days, files, partitions) keep for later combination is their table of value counts: such tables are
combined by union, and the percentiles of the union are exactly those of all rows together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timestamps import finite
from tidemark.storage import discard, join_small, materialize, ship


def long_values(df: DataFrame, group: str, values: Sequence[str], row_key: str) -> DataFrame:
    """(grp, field, value, weight, salt) of every finite value; null, NaN and infinite values have no rank and are left out.

    The salt comes from ``row_key``, a column that tells rows apart, so that equal values can be spread over partitions in
    a way that a repeated task repeats.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("field"), finite(F.col(v).cast("double")).alias("value")) for v in values])
    return (
        df.select(F.col(group).alias("grp"), F.explode(pairs).alias("x"), F.pmod(F.xxhash64(row_key), F.lit(65_536)).cast("int").alias("salt"))
        .where("x.value is not null")
        .select("grp", "x.field", (F.col("x.value") + F.lit(0.0)).alias("value"), F.lit(1).cast("bigint").alias("weight"), "salt")
    )


def value_counts(long: DataFrame) -> DataFrame:
    """The mergeable summary of a portion: how often each value occurs in each group. Its rows need no salt."""
    return long.groupBy("grp", "field", "value").agg(F.sum("weight").alias("weight"), F.lit(0).alias("salt"))


def _number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weight before each row within its (group, field), for rows of one partition in sorted order; O(1) state."""
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        grp = batch.column("grp").dictionary_encode()
        field = batch.column("field").dictionary_encode()
        codes = np.stack([pc.fill_null(grp.indices, -1).to_numpy(), field.indices.to_numpy()])
        weight = batch.column("weight").to_numpy()
        start = np.flatnonzero(np.r_[True, (codes[:, 1:] != codes[:, :-1]).any(axis=0)])
        before = np.cumsum(weight) - weight
        base = np.repeat(before[start], np.diff(np.r_[start, batch.num_rows]))
        within = before - base
        first = (batch.column("grp")[0].as_py(), batch.column("field")[0].as_py())
        if first == last:
            within[: start[1] if len(start) > 1 else None] += seen
        tail = (batch.column("grp")[-1].as_py(), batch.column("field")[-1].as_py())
        seen = int(within[-1] + weight[-1])
        last = tail
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within)], [*batch.schema.names, "before"])


def exact_percentiles(long: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(grp, field, n, prob, value) for each group, field and probability in ``probs``.

    ``long`` has (grp, field, value, weight, salt); see :func:`long_values` and :func:`value_counts`. The value is
    ``lo + (hi - lo) * fraction`` of the order statistics around position ``prob * (n - 1)``. A null group is a group
    of its own; a group without finite values has no row; an empty input gives an empty result. Ties may be of any
    number: a salt in the sort key lets the range partitioner split equal values over partitions.
    """
    spark = long.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*long.drop("salt").schema.fields, T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType())])
    values = materialize(long, "values")  # as the range partitioner reads it twice
    ordered = (
        values.repartitionByRange(parts, "grp", "field", "value", "salt")
        .sortWithinPartitions("grp", "field", "value")
        .drop("salt")
        .withColumn("part", F.spark_partition_id())
    )
    runs = materialize(ordered.mapInArrow(_number_rows, schema), "sorted-runs")
    discard(values)
    counts = runs.groupBy("grp", "field", "part").agg(F.sum("weight").alias("held"))
    by_group = Window.partitionBy("grp", "field")
    offsets = counts.select(
        "grp", "field", "part",
        (F.sum("held").over(by_group.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")).alias("offset"),
        F.sum("held").over(by_group).alias("n"),
    )
    # of each wanted position, the places of its two neighbours in the partition's own count
    places = []
    for i, p in enumerate(probs):
        lo = F.floor(F.lit(float(p)) * (F.col("n") - 1))
        places += [(lo - F.col("offset")).alias(f"lo{i}"), (F.least(lo + 1, F.col("n") - 1) - F.col("offset")).alias(f"hi{i}")]
    offsets = materialize(offsets.select("grp", "field", "part", "n", *places), "offsets")
    # a row is picked by its own position, before anything is copied; the test is a plain one, as it sees all rows
    placed = join_small(runs, offsets, ["grp", "field", "part"], null_safe=True)
    wanted = F.lit(False)
    for i in range(len(probs)):
        wanted = wanted | ((F.col("before") <= F.col(f"hi{i}")) & (F.col("before") + F.col("weight") > F.col(f"lo{i}")))
    found = placed.where(wanted).repartition("grp", "field")
    targets = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col(f"lo{i}").alias("lo_at"), F.col(f"hi{i}").alias("hi_at")) for i, p in enumerate(probs)])
    found = found.select("grp", "field", "n", "value", "before", (F.col("before") + F.col("weight")).alias("behind"), F.explode(targets).alias("x"))
    held = lambda place: F.when((F.col("before") <= F.col(place)) & (F.col(place) < F.col("behind")), F.col("value"))
    position = F.col("x.prob") * (F.col("n") - 1)
    found = found.select("grp", "field", "n", "x.prob", (position - F.floor(position)).alias("fraction"), held("x.lo_at").alias("lo"), held("x.hi_at").alias("hi"))
    return (
        found.where("lo is not null or hi is not null")
        .groupBy("grp", "field", "n", "prob", "fraction")
        .agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"))
        .select("grp", "field", "n", "prob", F.expr("case when fraction = 0 then lo else lo + (hi - lo) * fraction end").alias("value"))
    )
