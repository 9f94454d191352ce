"""Executed trades from JSON files into series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timestamps import rfc3339_nanos

SCHEMA = "exec_date string, side string, price double, size double"


def read_trades(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(ts_nanos, is_buy, price, size) of files that hold an array of objects each or, with ``lines``, an object per line.

    ``exec_date`` is RFC3339 text. Side is compared without regard to case and blanks; a null or unknown side gives null.
    Objects without a readable time belong to no series and are left out.
    """
    side = F.upper(F.trim("side"))
    is_buy = F.when(side.isin("BUY", "B"), True).when(side.isin("SELL", "S"), False)
    rows = spark.read.schema(SCHEMA).option("multiLine", str(not lines).lower()).json(path)
    return rows.select(rfc3339_nanos(F.col("exec_date")).alias("ts_nanos"), is_buy.alias("is_buy"), "price", "size").where("ts_nanos is not null")
