"""Calendar ticks (S10): one job per schedule instant in a time zone.

A schedule is a string of six or seven fields (or sets of numbers). The days of a bounded range come from ``spark.range``
(distributed, never one big array) and are filtered by the calendar fields; each day that is left is expanded by the
hours, minutes and seconds of the schedule, so the rows made are those of the ticks. A local time that a clock change
skips has no tick; one that it repeats has two.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobframe.operators.envelope import generated_id

# Fixed values of the schedule format: names of months and of days of the week (1 = Sunday), and short forms.
MONTHS = "january february march april may june july august september october november december".split()
DAYS = "sunday monday tuesday wednesday thursday friday saturday".split()
SHORT_FORMS = {"@yearly": "0 0 0 1 1 *", "@monthly": "0 0 0 1 * *", "@weekly": "0 0 0 * * 1", "@daily": "0 0 0 * * *",
               "@hourly": "0 0 * * * *"}
FIELDS = (("second", 0, 59, ()), ("minute", 0, 59, ()), ("hour", 0, 23, ()), ("day of month", 1, 31, ()),
          ("month", 1, 12, MONTHS), ("day of week", 1, 7, DAYS), ("year", 1970, 2100, ()))


@dataclass(frozen=True)
class Schedule:
    """Numbers that match, None for all. All fields must match, the days of month and of week too."""

    seconds: tuple[int, ...] | None = (0,)
    minutes: tuple[int, ...] | None = None
    hours: tuple[int, ...] | None = None
    days: tuple[int, ...] | None = None
    months: tuple[int, ...] | None = None
    weekdays: tuple[int, ...] | None = None     # 1 = Monday … 7 = Sunday
    tz: str = "UTC"
    years: tuple[int, ...] | None = None


def parse_field(text: str, name: str, low: int, high: int, names=()) -> tuple[int, ...] | None:
    """Numbers of one field: lists of ``*``, ``?``, a number or name, a range, each with ``/step`` (of a single number:
    from there on). None for all."""

    def number(x: str) -> int:
        if x.isdigit():
            n = int(x)
        else:
            found = [i for i, full in enumerate(names) if len(x) >= 3 and x.lower() in (full, full[:3])]
            if not found:
                raise ValueError(f"{x!r} is no {name}")
            n = low + found[0]
        if not low <= n <= high:
            raise ValueError(f"{name} {n} is not in {low}..{high}")
        return n

    out: set[int] = set()
    for item in text.split(","):
        m = re.fullmatch(r"(?:(?P<all>[*?])|(?P<a>\w+)(?:-(?P<b>\w+))?)(?:/(?P<step>\d+))?", item)
        if not m or m["step"] == "0":
            raise ValueError(f"{item!r} is no {name} field")
        a = low if m["all"] else number(m["a"])
        b = high if m["all"] or (m["step"] and not m["b"]) else number(m["b"] or m["a"])
        if a > b:
            raise ValueError(f"{name} range {item!r} runs backwards")
        out.update(range(a, b + 1, int(m["step"] or 1)))
    return None if len(out) == high - low + 1 else tuple(sorted(out))


def parse_schedule(text: str, tz: str = "UTC") -> Schedule:
    """``second minute hour day-of-month month day-of-week [year]`` or a short form; days of the week run from 1 (Sunday)
    to 7, names may be short or whole. Raises ValueError for anything else."""
    parts = SHORT_FORMS.get(text.strip().lower(), text).split()
    if len(parts) not in (6, 7):
        raise ValueError(f"schedule {text!r} has {len(parts)} fields, not 6 or 7")
    seconds, minutes, hours, days, months, week, years = (
        parse_field(p, *f) for p, f in zip([*parts, "*"][:7], FIELDS, strict=True))
    weekdays = week and tuple(sorted((d - 2) % 7 + 1 for d in week))
    return Schedule(seconds, minutes, hours, days, months, weekdays, tz, years)


def ticks(spark: SparkSession, start_epoch_s: int, end_epoch_s: int, sched: Schedule | str,
          source: str = "cron", payload: str = "{}", tz: str = "UTC") -> DataFrame:
    """Jobs for every instant t (UTC, start ≤ t ≤ end) matching ``sched`` (a string is read with ``tz``) in its zone."""
    if isinstance(sched, str):
        sched = parse_schedule(sched, tz)
    day = 86_400
    found = spark.range(start_epoch_s // day - 1, end_epoch_s // day + 2)  # local days, as days since 1970
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col("id").cast("int"))
    for numbers, value in ((sched.days, F.dayofmonth(date)), (sched.months, F.month(date)), (sched.years, F.year(date)),
                           (sched.weekdays, (F.col("id") + 3) % 7 + 1)):
        if numbers is not None:
            found = found.where(value.isin(list(numbers)))
    found = found.select((F.col("id") * day).alias("local"))
    for numbers, high, unit in ((sched.hours, 24, 3600), (sched.minutes, 60, 60), (sched.seconds, 60, 1)):
        steps = F.array(*[F.lit(n * unit) for n in (range(high) if numbers is None else numbers)])
        found = found.select("local", F.explode(steps).alias("more")).select((F.col("local") + F.col("more")).alias("local"))
    # the zone's offset a day before and a day after: they differ where a clock change is near, and only an instant that
    # shows the local time is one
    offset = lambda s: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(s), sched.tz)) - s
    near = F.array_distinct(F.array(*[F.col("local") - offset(F.col("local") + d) for d in (-day, day)]))
    found = found.select("local", F.explode(near).alias("at")).where(F.col("at").between(start_epoch_s, end_epoch_s))
    found = found.where(F.col("at") + offset(F.col("at")) == F.col("local"))
    out = found.select(F.timestamp_seconds("at").alias("tick_ts"), F.timestamp_seconds("local").alias("local_ts"))
    return out.select(
        generated_id(F.lit(source), F.col("tick_ts")).alias("id"), F.lit(source).alias("source"),
        F.lit(payload).alias("payload"), F.lit(None).cast("string").alias("correlation_key"),
        F.create_map().cast("map<string,string>").alias("labels"), "tick_ts", "local_ts")
