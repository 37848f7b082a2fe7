"""Dates and times of reports and jobs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(at: Column) -> Column:
    """ISO text of a timestamp; the session zone is UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def age_seconds(at: Column, now: Column) -> Column:
    """Whole seconds between two timestamps."""
    return F.unix_timestamp(now) - F.unix_timestamp(at)
