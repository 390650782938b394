"""Row predicates shared by the reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def as_column(value) -> Column:
    """A column from a Column or a column name."""
    return value if isinstance(value, Column) else F.col(value)


def require_utc() -> None:
    """Hours and days are those of UTC; a session in another zone would cut them elsewhere."""
    session = SparkSession.getActiveSession()
    zone = session.conf.get("spark.sql.session.timeZone") if session else "UTC"
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"the session's time zone is {zone}; gaugeworks.sources.session.configure sets UTC")


def moment(as_of: datetime | str | Column | None) -> Column:
    """The report's current time: the given instant, or the query's start time."""
    if as_of is None:
        return F.current_timestamp()
    if isinstance(as_of, Column):
        return as_of
    return F.lit(as_of).cast("timestamp")


def switch(value) -> bool:
    """An option that is on or off; anything but a bool is an error, text like "false" above all."""
    if not isinstance(value, bool):
        raise ValueError(f"True or False is expected, not {value!r}")
    return value


def optional_eq(col, value) -> Column:
    """Equality when a value is given; otherwise any row whose column is not NULL."""
    col = as_column(col)
    return col.isNotNull() if value is None else col == F.lit(value)


def flag_in(col, include: bool) -> Column:
    """Rows with the flag off, and with ``include`` also those with the flag on."""
    switch(include)
    col = as_column(col)
    return col.isNotNull() if include else ~col


def overlaps(first, last, start, end) -> Column:
    """Closed interval [first, last] touches [start, end]; NULL bounds do not match.

    Written as two plain comparisons so that both reach the Parquet scan.
    """
    return (as_column(first) <= end) & (as_column(last) >= start)


def since(ts, as_of, days: int) -> Column:
    """At or after the midnight ``days`` days before ``as_of``."""
    require_utc()
    return as_column(ts) >= F.date_trunc("day", moment(as_of)) - F.make_dt_interval(days=F.lit(days))


def require(df: DataFrame, options: DataFrame, condition: Column, keys=()) -> DataFrame:
    """``df`` where the option table holds a row that meets ``condition``, else no rows."""
    met = options.filter(condition)
    if keys:
        return df.join(met.select(*keys), list(keys), "left_semi")
    return df.filter(met.exists())
