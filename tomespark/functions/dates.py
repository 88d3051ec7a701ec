"""Day numbers and the wording of days."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(t: Column) -> Column:
    return F.year(t) * 400 + F.dayofyear(t)


def side(t: Column) -> Column:
    """0 and 1 by turns, a day each, since the start of 2000."""
    return F.datediff(F.to_date(t), F.lit("2000-01-01").cast("date")) % 2


def whole_days(t: Column, now: datetime) -> Column:
    """Full periods of 24 hours since ``t``; not the difference of dates."""
    seconds = F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.date_trunc("second", t.cast("timestamp")))
    return F.floor(seconds / 86400)


def when(t: Column, now: datetime) -> Column:
    days = F.datediff(F.lit(now.date()), F.to_date(t))
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(F.lit("on "), F.dayofmonth(t).cast("string"), F.lit(" "), F.date_format(t, "MMMM")))


def published(item: Column, updated: Column, now: datetime) -> Column:
    """An item's time: published, else updated, else now; more than a day ahead of now is now."""
    t = F.coalesce(item, updated, F.lit(now))
    return F.when(t > F.lit(now) + F.expr("INTERVAL 24 HOURS"), F.lit(now)).otherwise(t)


def ago(then: Column, now: Column) -> Column:
    """How long ago something was, in words."""
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, " min ago")).when(seconds < 48 * 3600, part(3600, " h ago")).otherwise(part(86400, " days ago"))


def untouched(days: Column) -> Column:
    """For how many days something was left alone, in words."""
    from tomespark.functions.text import number_word

    return F.when(days == 0, "since today").when(days == 1, "one day").otherwise(F.concat(number_word(days), F.lit(" days")))
