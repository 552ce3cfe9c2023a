"""Schedules as strings, and their ticks against a scan of every second's local time."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from jobframe.sources.ticks import FIELDS, Schedule, parse_field, parse_schedule, ticks


def numbers(text, field):
    f = dict((x[0], x) for x in FIELDS)[field]
    got = parse_field(text, *f)
    return list(range(f[1], f[2] + 1)) if got is None else list(got)


@pytest.mark.parametrize("text, field, want", [
    ("*", "hour", list(range(24))), ("?", "day of month", list(range(1, 32))), ("5", "minute", [5]), ("1,3,2", "hour", [1, 2, 3]),
    ("10-13", "second", [10, 11, 12, 13]), ("*/15", "minute", [0, 15, 30, 45]), ("5/20", "minute", [5, 25, 45]),
    ("1-10/4", "hour", [1, 5, 9]), ("Jan,mar-May", "month", [1, 3, 4, 5]), ("SUN,Monday,sat", "day of week", [1, 2, 7]),
    ("Mon-Fri", "day of week", [2, 3, 4, 5, 6]), ("2020/40", "year", [2020, 2060, 2100])])
def test_fields(text, field, want):
    assert numbers(text, field) == want


@pytest.mark.parametrize("text", ["", "* * * * *", "0 0 0 0 0 0 0 0", "60 * * * * *", "* * 24 * * *", "* * * 0 * *", "* * * * 13 *",
                                  "* * * * * 8", "* * * * * 0", "5-1 * * * * *", "*/0 * * * * *", "a * * * * *", "* * * * foo *",
                                  "1,,2 * * * * *", "-1 * * * * *", "@never"])
def test_no_schedules(text):
    with pytest.raises(ValueError):
        parse_schedule(text)


def test_short_forms_and_weekdays():
    assert parse_schedule("@weekly") == Schedule((0,), (0,), (0,), None, None, (7,))
    assert parse_schedule("0 30 9 ? * Mon-Fri 2024", "Europe/Berlin") == Schedule(
        (0,), (30,), (9,), None, None, (1, 2, 3, 4, 5), "Europe/Berlin", (2024,))


def scan(first, last, s, step=60):
    zone = ZoneInfo(s.tz)
    out = []
    for t in range(-(-first // step) * step, last + 1, step):
        x = dt.datetime.fromtimestamp(t, zone)
        if all(want is None or have in want for want, have in (
                (s.seconds, x.second), (s.minutes, x.minute), (s.hours, x.hour), (s.days, x.day), (s.months, x.month),
                (s.weekdays, x.isoweekday()), (s.years, x.year))):
            out.append((t, x.strftime("%Y-%m-%d %H:%M:%S")))
    return out


@pytest.mark.parametrize("zone", ["America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu"])
def test_a_year_with_clock_changes_against_a_scan(spark, zone):
    first, last = 1_704_000_000, 1_704_000_000 + 366 * 86_400
    for text in ("0 0,30 1-3 * * *", "0 */20 2 ? Mar,Apr,Oct,Nov Sun", "0 15 23 29-31 * *"):
        s = parse_schedule(text, zone)
        got = ticks(spark, first, last, s).selectExpr("unix_seconds(tick_ts) AS t", "string(local_ts) AS l").collect()
        assert sorted((r["t"], r["l"]) for r in got) == scan(first, last, s)


def test_seconds_and_bounds(spark):
    first, last = 1_711_846_790, 1_711_846_890  # across the change of 2024-03-31 in Berlin
    for text in ("*/7 * * * * *", "* * * * * *", "5 0 3 * * *"):
        s = parse_schedule(text, "Europe/Berlin")
        got = ticks(spark, first, last, text, tz="Europe/Berlin").selectExpr("unix_seconds(tick_ts) AS t", "string(local_ts) AS l")
        assert sorted((r["t"], r["l"]) for r in got.collect()) == scan(first, last, s, 1)


def test_rows_made_are_those_of_the_ticks(spark):
    df = ticks(spark, 0, 10 * 365 * 86_400, "0 0 12 1 1 *")
    assert df.count() == 10
    assert "Range (-1, 365" in df._jdf.queryExecution().toString()  # days, not seconds
