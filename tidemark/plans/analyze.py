"""From a parsed query to what is to be computed: a half-open range of nanoseconds, a limit and a projection."""

from __future__ import annotations

import time
from dataclasses import dataclass

from tidemark.functions.literals import SECOND, day_start, granule, nanos_from_text, parse_datetime
from tidemark.functions.zones import offset_text, zone_offset
from tidemark.plans.grammar import DatetimeExpr, MetricFilter, ParsedQuery, QueryError, TimeFilter

META_TABLES = (".metrics", ".describe", ".block_list")


@dataclass(frozen=True)
class TimeRange:
    """Half-open ``[since, until)`` in UTC nanoseconds; either side may be open."""

    since: int | None = None
    until: int | None = None

    @classmethod
    def from_texts(cls, since: str | None, until: str | None) -> TimeRange:
        """From epochs (seconds below 10**10, else nanoseconds) or RFC3339 texts."""
        return cls(*(None if x is None else nanos_from_text(x) for x in (since, until)))


@dataclass(frozen=True)
class Limit:
    """The first (``head``) or last (``tail``) ``n`` distinct timestamps, with all their rows."""

    side: str
    n: int


@dataclass(frozen=True)
class Output:
    """Where a result goes: ``stdout``, ``file`` (with a path) or ``memory``, in which format."""

    destination: str = "stdout"
    format: str = "table"
    path: str | None = None


# The formats that each destination takes.
ALLOWED_FORMATS = {
    "stdout": {"json", "table"},
    "file": {"json", "table", "parquet", "parquet_snappy"},
    "memory": {"table"},
}


@dataclass(frozen=True)
class SeriesQuery:
    metric: str
    range: TimeRange
    limit: Limit | None
    #: names of the fields by position, if given
    names: tuple[str, ...] | None
    #: selected names in order; None for all
    selected: tuple[str, ...] | None
    offset: int = 0
    format_datetime: bool = True
    output: Output = Output()
    database: str | None = None
    use_cache: bool = True
    refresh: bool = False


@dataclass(frozen=True)
class MetaQuery:
    table: str
    metric: str | None
    output: Output = Output()
    database: str | None = None
    refresh: bool = False


def _output(options: dict[str, object]) -> Output:
    kind = str(options.get("format", "table"))
    path, memory = options.get("output_file"), bool(options.get("output_to_memory"))
    if path and memory:
        raise QueryError("output_file and output_to_memory exclude each other")
    destination = "memory" if memory else "file" if path else "stdout"
    if kind not in ALLOWED_FORMATS[destination]:
        raise QueryError(f"format {kind} can't go to {destination}")
    return Output(destination, kind, str(path) if path else None)


def time_range(filter_: TimeFilter, offset: int, now: int, legacy_granule: bool = False) -> tuple[TimeRange, Limit | None]:
    """The range and limit of a filter on ``ts`` at a fixed offset (seconds), with ``now`` for today()."""

    def local(x: DatetimeExpr) -> int:
        days = {"yesterday": -1, "today": 0, "tomorrow": 1}
        try:
            base = day_start(now, offset, days[x.base]) if x.is_function else parse_datetime(x.base)
        except ValueError as e:
            raise QueryError(str(e)) from None
        return base + x.delta

    shift = offset * SECOND
    start = local(filter_.first)
    at = start - shift
    if filter_.second is not None and filter_.op != "in":
        raise QueryError(f"{filter_.op} takes one datetime, not a range")
    if filter_.op == "in" and filter_.second is not None:
        second = filter_.second
        return TimeRange(at, at + second if isinstance(second, int) else local(second) - shift), None
    if filter_.op == "in" and not filter_.first.is_function:
        raise QueryError("in takes a range or a function")
    if filter_.op in ("in", "="):
        return TimeRange(at, at + granule(start, legacy_granule)), None
    side = "head" if filter_.op[0] == ">" else "tail"
    limit = None if filter_.limit is None else Limit(side, filter_.limit)
    bounds = {">=": TimeRange(at, None), ">": TimeRange(at + 1, None), "<=": TimeRange(None, at + 1), "<": TimeRange(None, at)}
    return bounds[filter_.op], limit


def analyze(query: ParsedQuery, *, now: int | None = None, legacy_granule: bool = False) -> SeriesQuery | MetaQuery:
    """What a parsed query asks for; ``now`` (nanoseconds) fixes the clock of today() and its kin."""
    opts = query.options
    output = _output(opts)
    database = opts.get("db")
    refresh = bool(opts.get("force_sync_cloud", False))
    if query.metric in META_TABLES:
        metric = query.where.metric if isinstance(query.where, MetricFilter) else None
        if metric and query.metric == ".metrics":
            raise QueryError(".metrics takes no filter on metrics")
        return MetaQuery(query.metric, metric, output, database, refresh)
    if query.metric.startswith("."):
        raise QueryError(f"a metric's name can't begin with a dot: {query.metric}")
    if isinstance(query.where, MetricFilter):
        raise QueryError("a filter on metrics only works on .describe and .block_list")
    if query.where is None:
        raise QueryError("a metric needs a filter on ts")
    try:
        offset = zone_offset(str(opts.get("tz", "UTC")))
    except ValueError as e:
        raise QueryError(str(e)) from None
    names = tuple(opts["cols"]) if "cols" in opts else None
    selected = None
    if query.columns is not None:
        selected = tuple(c for c in query.columns if c != "ts" or (names and "ts" in names))
        unknown = [c for c in selected if not names or c not in names]
        if unknown:
            raise QueryError(f"no such column: {', '.join(unknown)}; name the columns with cols=[...]")
        if len(set(selected)) < len(selected):
            raise QueryError("a column is selected twice")
    if names and len(set(names) - {"_"}) < len([n for n in names if n != "_"]):
        raise QueryError("cols names a column twice")
    bounds, limit = time_range(query.where, offset, time.time_ns() if now is None else now, legacy_granule)
    return SeriesQuery(
        query.metric, bounds, limit, names, selected, offset, bool(opts.get("format_datetime", True)),
        output, database, bool(opts.get("use_cache", True)), refresh,
    )


def zone_suffix(query: SeriesQuery) -> str:
    return offset_text(query.offset)
