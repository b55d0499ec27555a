"""Page dates stay the strings that they were; these functions only tell which are valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"
TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?"
    r"(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?\z"
)
ZONED = r"(Z|[+-][0-9]{2}:[0-9]{2})\z"


def is_calendar_date(c: Column) -> Column:
    """Whether the first ten characters are a day of the Gregorian calendar; year 0 is one."""
    day = F.substring(c, 1, 10)
    # A year of 0000 has the leap days of 2000.
    known = F.when(day.startswith("0000"), F.concat(F.lit("2000"), F.substring(day, 5, 6))).otherwise(day)
    return F.coalesce(day.rlike(DATE) & known.try_cast("date").isNotNull(), F.lit(False))


def is_iso_time(c: Column, zoned: bool = False) -> Column:
    ok = c.rlike(TIME) & is_calendar_date(c)
    return F.coalesce(ok & c.rlike(ZONED) if zoned else ok, F.lit(False))


def page_date(age: Column) -> Column:
    """The first valid absolute time, else the first valid plain date, else null."""
    return F.coalesce(
        F.get(F.filter(age, lambda x: is_iso_time(x)), 0),
        F.get(F.filter(age, lambda x: x.rlike(DATE) & is_calendar_date(x)), 0),
    )


def retrieval_time(c: Column) -> Column:
    """The time if it is valid and has a zone; never the present."""
    return F.when(is_iso_time(c, zoned=True), c)


def local_stamp(ts: Column) -> Column:
    """Day of the session's time zone, as log files are named."""
    return F.date_format(ts, "yyyy-MM-dd")


def local_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSxxx")
