"""First and last instant of calendar periods."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTHS = {"minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days",
           "month": "1 month", "quarter": "3 months", "year": "1 year"}


def period_start(ts: Column, period: str, first_day: str = "sunday") -> Column:
    """Start of the minute, hour, day, week, month, quarter or year around ``ts``."""
    if period == "week" and first_day == "sunday":
        day = F.expr("INTERVAL '1' DAY")
        return F.date_trunc("week", ts + day) - day
    return F.date_trunc(period, ts)


def period_end(ts: Column, period: str, first_day: str = "sunday") -> Column:
    """Last microsecond of the period around ``ts``."""
    return period_start(ts, period, first_day) + F.expr(f"INTERVAL {LENGTHS[period]}") - F.expr("INTERVAL '0.000001' SECOND")
