"""Dates of issues and releases."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def created(column: str = "create_time") -> Column:
    """``2008-06-06T21:01:46.000+0000`` without its last nine characters, as a timestamp without zone; null if it isn't one."""
    return F.expr(f"try_cast(substring({column}, 1, length({column}) - 9) AS timestamp_ntz)")


def release_date(column: str = "release_date") -> Column:
    return F.to_date(column, "yyyy-MM-dd")


def month(column: Column) -> Column:
    """D3: the axis text of a month."""
    return F.date_format(column, "yyyy-MM")
