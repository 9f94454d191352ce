"""Parsing and analysis of queries; no Spark needed."""

import pytest

from tidemark.functions.literals import DAY, HOUR, MINUTE, SECOND, granule, nanos_from_text, parse_datetime
from tidemark.functions.zones import ZONES, zone_offset
from tidemark.plans.analyze import Limit, MetaQuery, Output, TimeRange, analyze
from tidemark.plans.grammar import QueryError, parse

NOW = parse_datetime("2021-09-27 12:34:56")


def ask(text):
    return analyze(parse(text), now=NOW)


def span(condition, options=""):
    return ask(f"{options} select * from trades where ts {condition}").range


def at(text):
    return parse_datetime(text)


GOOD = [
    "select * from trades where ts in ('2021-09-27', '2021-09-28')",
    "SELECT * FROM trades WHERE TS IN ('2021-09-27', 2 hours);",
    "with tz = Asia/Tokyo, cols = [is_buy, price, _], format = json, output_file = '/tmp/x.json', use_cache = false select price, is_buy from a.b-c_d where ts = today()",
    "with db = main, force_sync_cloud = true, format_datetime=false select * from x where ts in (yesterday(),+ 9:00)",
    "with output_to_memory select * from x where ts in today()",
    "select * from x where ts >=|2 '2021-09-27 09:42:40.741778000'",
    "select * from x where ts <=|10 '2021-09-27'",
    "select * from x where ts <|10 '2021-09-27' - 1 day",
    "select * // all of it\n from x\\ where ts => '2021-09-27' ;",
    "select * from .describe where metrics = trades",
    "select * from .block_list",
]


@pytest.mark.parametrize("text", GOOD)
def test_good_queries(text):
    ask(text)


BAD = [
    "select * from trades",
    "select price from trades where ts = today()",
    "with cols=[a] select b from trades where ts = today()",
    "with cols=[a,] select a from trades where ts = today()",
    "with cols=[select] select * from trades where ts = today()",
    "select * from trades where metrics = trades",
    "select * from .metrics where metrics = trades",
    "select * from trades where ts in (today(), 9:00)",
    "select * from trades where ts in '2021-09-27'",
    "select * from trades where ts = 2021-09-27",
    "select * from trades where ts > ('2021-09-27', '2021-09-28')",
    "select *from2 x where ts = today()",
    "selects * from x where ts = today()",
    "select * from x where ts = '2021-13-27'",
    "select * from x where ts = today() // no newline",
    "select * from x where ts = today() and ts > today()",
    "select * from .hidden where ts = today()",
    "with tz = Mars/Base select * from x where ts = today()",
    "with format = parquet select * from x where ts = today()",
    "with format = json, output_to_memory select * from x where ts = today()",
    "with output_file = '/tmp/x', output_to_memory select * from x where ts = today()",
    "with cols=[a, b] select a, a from x where ts = today()",
]


@pytest.mark.parametrize("text", BAD)
def test_bad_queries(text):
    with pytest.raises(QueryError):
        ask(text)


def test_ranges():
    a, b = at("2021-09-27 09:42"), at("2021-09-27 09:45")
    assert span("in ('2021-09-27 09:42', +3 minute)") == TimeRange(a, b)
    assert span("in ('2021-09-27 09:42', '2021-09-27 09:45')") == TimeRange(a, b)
    assert span("in ('2021-09-27 09:40' + 2 minutes, 3 minutes)") == TimeRange(a, b)
    assert span("in ('2021-09-27 09:40' + 2 minutes, '2021-09-27 09:45')") == TimeRange(a, b)
    assert span(">= '2021-09-27 09:42'") == TimeRange(a, None) == span("=> '2021-09-27 09:42'")
    assert span("> '2021-09-27 09:42'") == TimeRange(a + 1, None)
    assert span("<= '2021-09-27 09:42'") == TimeRange(None, a + 1) == span("=< '2021-09-27 09:42'")
    assert span("< '2021-09-27 09:42'") == TimeRange(None, a)
    assert span("in (yesterday(), + 9:00)") == TimeRange(at("2021-09-26"), at("2021-09-26 09:00"))
    assert span("in today()") == span("= today()") == TimeRange(at("2021-09-27"), at("2021-09-28"))
    assert span("= tomorrow() - 12:30") == TimeRange(at("2021-09-27 11:30"), at("2021-09-27 11:31"))


def test_limits():
    q = ask("select * from x where ts >|2 '2021-09-27'")
    assert (q.limit, q.range.since) == (Limit("head", 2), at("2021-09-27") + 1)
    assert ask("select * from x where ts =<|7 '2021-09-27'").limit == Limit("tail", 7)


@pytest.mark.parametrize(
    ("text", "length"),
    [("2021-09-27", DAY), ("2021-09-27 23:00", HOUR), ("2021-09-27 23:10", MINUTE), ("2021-09-27 23:00:01", SECOND), ("2021-09-27 23:00:01.5", 1_000_000)],
)
def test_equality_covers_the_granule_of_the_local_time(text, length):
    r = span(f"= '{text}'", "with tz = Asia/Tokyo")
    assert r == TimeRange(at(text) - 9 * HOUR, at(text) - 9 * HOUR + length)


def test_granules_below_a_second():
    assert [granule(SECOND + x) for x in (1, 1_000, 1_000_000)] == [1, 1_000, 1_000_000]
    assert [granule(SECOND + x, legacy=True) for x in (1, 1_000, 1_000_000)] == [1_000, 1_000_000, 1]


def test_zones():
    assert len(ZONES) == 96
    assert zone_offset("America/New_York") == -5 * 3600
    assert zone_offset("Asia/Kathmandu") == 5 * 3600 + 45 * 60
    assert zone_offset("+9") == zone_offset("+09:00") == zone_offset("Asia/Tokyo")
    with pytest.raises(ValueError):
        zone_offset("asia/tokyo")


def test_today_is_local():
    r = analyze(parse("with tz = Pacific/Auckland select * from x where ts = today()"), now=at("2021-09-27 13:00")).range
    assert r == TimeRange(at("2021-09-27 12:00"), at("2021-09-28 12:00"))


def test_timestamps_from_text():
    assert nanos_from_text("9999999999") == 9_999_999_999 * SECOND
    assert nanos_from_text("10000000000") == 10_000_000_000
    assert nanos_from_text("2021-09-27T09:42:40.7417780Z") == at("2021-09-27 09:42:40.741778")
    assert nanos_from_text("2021-09-27T18:42:40+09:00") == at("2021-09-27 09:42:40")
    assert TimeRange.from_texts(None, "10") == TimeRange(None, 10 * SECOND)
    with pytest.raises(ValueError):
        nanos_from_text("yesterday")


@pytest.mark.parametrize(
    ("options", "formats"),
    [("", {"json", "table"}), (", output_file = '/x/y'", {"json", "table", "parquet", "parquet_snappy"}), (", output_to_memory", {"table"})],
)
def test_output_matrix(options, formats):
    for kind in ("json", "table", "parquet", "parquet_snappy"):
        text = f"with format = {kind}{options} select * from x where ts = today()"
        if kind in formats:
            assert ask(text).output.format == kind
        else:
            with pytest.raises(QueryError):
                ask(text)


def test_meta_queries():
    assert ask("select * from .describe where ts > today()") == MetaQuery(".describe", None)
    assert ask("with output_file='/a' select * from .block_list where metrics=a.b") == MetaQuery(".block_list", "a.b", Output("file", "table", "/a"))


def test_last_of_repeated_options_holds():
    assert ask("with tz = UTC, tz = Asia/Tokyo select * from x where ts = today()").offset == 9 * 3600
