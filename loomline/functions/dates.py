"""Date and duration functions over columns. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the days from Sunday on.
WEEKDAYS = ("日", "月", "火", "水", "木", "金", "土")
#: How long ago, and the days of a log.
JUST_NOW, MINUTES_AGO, HOURS_AGO, DAYS_AGO, MONTHS_AGO = "今", "分前", "時間前", "日前", "ヶ月前"
TODAY, YESTERDAY, YEAR, MONTH, DAY = "今日", "昨日", "年", "月", "日"


def seconds_between(start: Column, end: Column) -> Column:
    """With fractions; works for timestamps with and without a time zone."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def minute_text(ts: Column) -> Column:
    return F.date_format(F.date_trunc("minute", ts), "yyyy-MM-dd HH:mm")


def relative_time(ts: Column, now: Column, fallback: Column | None = None, whole_days: bool = False) -> Column:
    """How long ago: now, minutes, hours, days, or months of 30 days, by another time where ts is null; empty if both are.

    whole_days: nothing finer than days; less than a day is 0 days, times to come are negative days.
    """
    ts = ts if fallback is None else F.coalesce(ts, fallback)
    minutes = F.floor(seconds_between(ts, now) / 60)
    hours, days = F.floor(seconds_between(ts, now) / 3600), F.floor(seconds_between(ts, now) / 86400)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    given = F.when(ts.isNull(), "")
    finer = given if whole_days else given.when(minutes < 1, JUST_NOW).when(minutes < 60, text(minutes, MINUTES_AGO)).when(hours < 24, text(hours, HOURS_AGO))
    return finer.when(days < 30, text(days, DAYS_AGO)).otherwise(text(F.floor(days / 30), MONTHS_AGO))


def separator_label(ts: Column, now: Column) -> Column:
    """The day above its messages: today, yesterday, month and day, with the year if it is another."""
    day, today = F.to_date(ts), F.to_date(now)
    weekday = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.dayofweek(day))
    label = F.concat(F.month(day), F.lit(MONTH), F.dayofmonth(day), F.lit(f"{DAY} ("), weekday, F.lit(")"))
    return F.when(day == today, TODAY).when(day == F.date_sub(today, 1), YESTERDAY).when(F.year(day) == F.year(today), label).otherwise(F.concat(F.year(day), F.lit(YEAR), label))


def same_day(a: Column, b: Column) -> Column:
    return F.to_date(a) == F.to_date(b)


def date_time(ts: Column) -> Column:
    return F.coalesce(F.date_format(ts, "yyyy/MM/dd HH:mm"), F.lit("-"))


def duration_text(minutes: Column) -> Column:
    hours = F.floor(minutes / 60)
    rest = F.concat((minutes % 60).cast("string"), F.lit("分"))
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("時間"), rest)).otherwise(rest)


def duration_minutes(start: Column, end: Column) -> Column:
    """Minutes, a half rounded up; 0 if negative or if either time is missing."""
    return F.coalesce(F.greatest(F.lit(0), F.floor(seconds_between(start, end) / 60 + 0.5)), F.lit(0)).cast("long")


def parse_date_time(text: Column) -> Column:
    """YYYY/MM/DD HH:MM; the 29th to 31st of a shorter month run over into the next one, other impossible parts give null."""
    fits = text.rlike(r"^\d{4}/\d{1,2}/\d{1,2}\s+\d{1,2}:\d{2}$")
    plain = F.trim(F.translate(text, "\t\n\u000b\f\r\u0085\u2028\u2029:", "        /"))  # parts without a further pattern: what is between slashes and white space
    date, time = F.substring_index(plain, " ", 1), F.substring_index(plain, " ", -1)
    part = lambda t, i: F.when(fits, F.split_part(t, F.lit("/"), F.lit(i))).cast("int")
    year, month, day, hour, minute = (part(t, i) for t, i in ((date, 1), (date, 2), (date, 3), (time, 1), (time, 2)))
    fine = month.between(1, 12) & day.between(1, 31) & hour.between(0, 23) & minute.between(0, 59)
    first = F.try_make_timestamp_ntz(year, month, F.lit(1), hour, minute, F.lit(0))
    return F.when(fine, F.timestamp_add("DAY", day - 1, first))


def session_times_status(start_text: Column, end_text: Column, start: Column | None = None, end: Column | None = None) -> Column:
    """ok, bad_start, bad_end or end_not_after_start for two texts; an empty one counts as not given. start, end: what parse_date_time gave for them, if that is at hand."""
    start, end = parse_date_time(start_text) if start is None else start, parse_date_time(end_text) if end is None else end
    given = lambda t: F.coalesce(t != "", F.lit(False))
    return F.when(given(start_text) & start.isNull(), "bad_start").when(given(end_text) & end.isNull(), "bad_end").when(start >= end, "end_not_after_start").otherwise("ok")


def new_time_spent(current: Column, new_start: Column, new_end: Column, old_start: Column, old_end: Column) -> Column:
    """Minutes after a session's times were changed; as before if the session has no end."""
    changed = F.greatest(F.lit(0), current - duration_minutes(old_start, old_end) + duration_minutes(new_start, new_end))
    return F.when(new_start.isNull() | new_end.isNull(), current).otherwise(changed)


def shows_edited(created: Column, updated: Column) -> Column:
    """Edited at least five minutes from its creation."""
    return F.coalesce(F.abs(seconds_between(created, updated)) >= 300, F.lit(False))


def hides_created(created: Column, completed: Column) -> Column:
    return F.coalesce(F.abs(seconds_between(created, completed)) < 300, F.lit(False))


def edited_label(created: Column, updated: Column) -> Column:
    """The time alone on the day of creation, else with the date."""
    return F.when(same_day(created, updated), F.date_format(updated, "HH:mm")).otherwise(F.date_format(updated, "yyyy/MM/dd HH:mm"))


def months_over(ts: Column, months: int) -> Column:
    """So many months on or back at the same day of the month; a day that the month lacks runs over into the next one, as it does in calendars that count days."""
    month = F.add_months(F.trunc(ts, "month"), months)
    return F.date_add(month, F.dayofmonth(ts) - 1)
