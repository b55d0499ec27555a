"""Log files: one JSON line a request, in a folder a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.functions import dates


def log_rows(stats: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the day of the session's time zone and the stamp with its offset, both from the one column `ts`."""
    return stats.withColumns({"date": dates.local_stamp(F.col(ts)), "stamp": dates.local_iso(F.col(ts))}).drop(ts)


def append(stats: DataFrame, folder: str, ts: str = "ts") -> None:
    log_rows(stats, ts).write.mode("append").partitionBy("date").json(folder)
