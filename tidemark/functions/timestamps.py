"""Column expressions on LONG nanoseconds since the epoch; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NANOS = 1_000_000_000
UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


def rfc3339_nanos(text: Column) -> Column:
    """Nanoseconds of an RFC3339 text; ``T``/``t``/blank, ``Z``/``z`` and numeric offsets are all accepted.

    A text without an offset is UTC. Null, empty or unreadable texts and instants beyond the LONG range give null.
    """
    upper = F.upper(F.trim(text))
    tail = F.substring(upper, 20, 40)  # behind the whole seconds; what remains for patterns is short
    fraction = F.regexp_extract(tail, r"^\.(\d{1,9})", 1)
    zone = F.regexp_extract(tail, r"([+-]\d{2}:?\d{2})$", 1)
    whole = F.concat(F.substring(upper, 1, 19), F.when(zone == "", F.lit("Z")).otherwise(zone))
    seconds = F.unix_seconds(F.try_to_timestamp(whole))
    nanos = F.try_add(F.try_multiply(seconds, F.lit(NANOS).cast("bigint")), F.rpad(fraction, 9, "0").cast("bigint"))
    return F.when(tail.rlike(r"^(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$") & (F.length(upper) >= 19), nanos)


def floor_div(value: Column, by: int) -> Column:
    """Whole-number division rounded down; a division through doubles would lose the last digits of nanoseconds."""
    step = F.lit(by).cast("bigint")
    return F.call_function("div", value - F.pmod(value, step), step)


def nanos_to_date(nanos: Column) -> Column:
    """The UTC day of LONG nanoseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), floor_div(nanos, 86_400 * NANOS).cast("int"))


def finite(value: Column) -> Column:
    """The value, or null where it is null, NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def epoch_nanos(value: Column) -> Column:
    """LONG epoch of unknown unit: below 10**10 it is seconds, else nanoseconds."""
    return F.when(value < F.lit(10_000_000_000).cast("bigint"), F.try_multiply(value, F.lit(NANOS).cast("bigint"))).otherwise(value)


def timestamp_nanos(column: Column, kind: str) -> Column:
    """LONG nanoseconds of a timestamp (with or without zone), date, RFC3339 text or LONG epoch column, by its type name."""
    if kind in ("timestamp_ntz", "date"):
        # a zoneless time counts from a zoneless epoch, as a cast would bring in the session's time zone
        since = column.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")
        part = lambda unit: F.extract(F.lit(unit), since).cast("bigint")
        micros = F.extract(F.lit("SECOND"), since) * F.lit(1_000_000)
        seconds = (part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")
        zone = SparkSession.active().conf.get("spark.sql.session.timeZone")
        exact = seconds * F.lit(60_000_000).cast("bigint") + micros.cast("bigint")
        return F.try_multiply(F.unix_micros(column.cast("timestamp")) if zone in UTC_NAMES else exact, F.lit(1_000).cast("bigint"))
    if kind == "timestamp":
        return F.try_multiply(F.unix_micros(column), F.lit(1_000).cast("bigint"))
    return rfc3339_nanos(column) if kind == "string" else column.cast("bigint")


def format_nanos(nanos: Column, offset_seconds: int, suffix: str) -> Column:
    """RFC3339 text with nine fractional digits at a fixed offset, whatever the session's time zone."""
    seconds = floor_div(nanos, NANOS) + F.lit(offset_seconds).cast("bigint")
    shifted = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        floor_div(seconds, 86_400).cast("int"), F.lit(0), F.lit(0), F.pmod(seconds, F.lit(86_400)).cast("decimal(18,6)")
    )
    text = F.substring(shifted.cast("string"), 1, 19)
    part = F.lpad(F.pmod(nanos, F.lit(NANOS)).cast("string"), 9, "0")
    return F.concat(F.translate(text, " ", "T"), F.lit("."), part, F.lit(suffix))


def format_seconds(seconds: Column, offset_seconds: int = 0, suffix: str = "Z") -> Column:
    """RFC3339 text of whole seconds."""
    return F.concat(F.substring(format_nanos(seconds * F.lit(NANOS).cast("bigint"), offset_seconds, ""), 1, 19), F.lit(suffix))


def seconds_of(nanos: Column) -> Column:
    return floor_div(nanos, NANOS)


def subsecond_of(nanos: Column) -> Column:
    return F.pmod(nanos, F.lit(NANOS).cast("bigint"))
