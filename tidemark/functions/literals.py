"""Plan-time literals: datetimes, durations, clock offsets and granules, all as whole nanoseconds."""

from __future__ import annotations

import re
from datetime import UTC, datetime

SECOND = 1_000_000_000
MINUTE, HOUR, DAY = 60 * SECOND, 3600 * SECOND, 86_400 * SECOND

# The duration units of the language, with or without a plural s.
UNITS = {"micro": 1_000, "milli": 1_000_000, "second": SECOND, "minute": MINUTE, "hour": HOUR, "day": DAY}

_DATETIME = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?)?")
_CLOCK = re.compile(r"(\d{1,2})(?::([0-5]\d)(?::([0-5]\d))?)?")


def parse_datetime(text: str) -> int:
    """Nanoseconds of a local ``date [hour:minute[:second[.fraction]]]``, counted as if it were UTC."""
    m = _DATETIME.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a datetime: {text!r}")
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    whole = datetime(year, month, day, hour, minute, second, tzinfo=UTC)
    return int(whole.timestamp()) * SECOND + int((m[7] or "").ljust(9, "0"))


def parse_duration(number: str, unit: str) -> int:
    """Nanoseconds of a number of units."""
    name = unit.lower()
    return int(number) * UNITS[name if name in UNITS else name.removesuffix("s")]


def parse_clock(text: str) -> int:
    """Nanoseconds of ``H``, ``H:MM`` or ``HH:MM:SS``."""
    m = _CLOCK.fullmatch(text)
    if not m:
        raise ValueError(f"not a clock offset: {text!r}")
    hours, minutes, seconds = (int(x or 0) for x in m.groups())
    return hours * HOUR + minutes * MINUTE + seconds * SECOND


def day_start(now_nanos: int, offset_seconds: int, days: int = 0) -> int:
    """Local midnight of today plus ``days``, as local nanoseconds."""
    local = now_nanos + offset_seconds * SECOND
    return local - local % DAY + days * DAY


def granule(local_nanos: int, legacy: bool = False) -> int:
    """The length that an equality with a local datetime covers: the coarsest unit that the datetime is a multiple of.

    ``legacy`` reproduces the sub-second lengths of older deployments, which were assigned the other way round.
    """
    for unit in (DAY, HOUR, MINUTE, SECOND):
        if local_nanos % unit == 0:
            return unit
    if legacy:
        return 1_000 if local_nanos % 1_000 else 1_000_000 if local_nanos % 1_000_000 else 1
    return 1_000_000 if local_nanos % 1_000_000 == 0 else 1_000 if local_nanos % 1_000 == 0 else 1


def nanos_from_text(text: str) -> int:
    """A timestamp from text: an integer below 10**10 is seconds, any other integer nanoseconds, else RFC3339."""
    if re.fullmatch(r"\d+", text):
        number = int(text)
        return number * SECOND if number < 10**10 else number
    m = re.fullmatch(r"(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?([Zz]|[+-]\d{2}:\d{2})", text)
    if not m:
        raise ValueError(f"not a timestamp: {text!r}")
    zone = "+00:00" if m[4] in "Zz" else m[4]
    whole = datetime.fromisoformat(f"{m[1]}T{m[2]}{zone}")
    return int(whole.timestamp()) * SECOND + int((m[3] or "").ljust(9, "0"))
