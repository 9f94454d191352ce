"""Executed trades with one row per trade."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timestamps import nanos_to_date, rfc3339_nanos

COLUMNS = ("row_id", "trade_id", "market", "price", "size", "exec_date", "received_at")


def distinct_trades(trades: DataFrame) -> DataFrame:
    """One delivery of each ``trade_id``: one with a readable time if there is any, then the earliest received, then the
    smallest ``row_id``. Rows with a null ``trade_id`` are trades of their own. The result has :data:`COLUMNS`,
    ``exec_nanos`` and ``trade_day``; other columns are left out.
    """
    timed = trades.select(*COLUMNS, rfc3339_nanos(F.col("exec_date")).alias("exec_nanos"))
    own = F.when(F.col("trade_id").isNull(), F.col("row_id"))
    order = Window.partitionBy("trade_id", own).orderBy(F.col("exec_nanos").isNull(), F.col("received_at").asc_nulls_last(), "row_id")
    kept = timed.withColumn("_delivery", F.row_number().over(order)).where("_delivery = 1").drop("_delivery")
    return kept.withColumn("trade_day", nanos_to_date(F.col("exec_nanos")))
