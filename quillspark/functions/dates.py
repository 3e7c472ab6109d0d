"""Date parsing, fallback chains and period keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import ColumnOrName, col


def parse_ts(c: ColumnOrName) -> Column:
    """ISO date or timestamp text to TIMESTAMP; null when it does not parse."""
    return F.try_to_timestamp(F.nullif(F.btrim(col(c)), F.lit("")))


def created_or(created: ColumnOrName, fallback: ColumnOrName) -> Column:
    return F.coalesce(parse_ts(created), col(fallback))


def is_malformed(created: ColumnOrName) -> Column:
    return col(created).isNotNull() & parse_ts(created).isNull()


def iso_week(ts: ColumnOrName) -> Column:
    year = F.extract(F.lit("YEAROFWEEK"), col(ts)).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(col(ts)).cast("string"), 2, "0"))


def year_month(ts: ColumnOrName) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def period_key(ts: ColumnOrName, period: str) -> Column:
    return iso_week(ts) if period == "week" else year_month(ts)


def iso_text(ts: ColumnOrName) -> Column:
    """Millisecond ISO text in UTC."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def age_days(ts: ColumnOrName, as_of: Column) -> Column:
    """Whole days between a timestamp and the clock argument."""
    return F.floor((F.unix_micros(as_of) - F.unix_micros(col(ts))) / F.lit(86_400_000_000)).cast("int")


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.expr(f"INTERVAL {int(days)} DAYS")


def clock(as_of: str) -> Column:
    """The frozen clock every time-dependent operator takes as an argument."""
    return F.lit(as_of).cast("timestamp")


def review_date(last_reviewed: ColumnOrName, updated: ColumnOrName, mtime: ColumnOrName) -> Column:
    return F.coalesce(parse_ts(last_reviewed), parse_ts(updated), col(mtime))


def review_date_source(last_reviewed: ColumnOrName, updated: ColumnOrName) -> Column:
    return (
        F.when(parse_ts(last_reviewed).isNotNull(), "last_reviewed")
        .when(parse_ts(updated).isNotNull(), "updated")
        .otherwise("mtime")
    )


def baseline_date(
    last_reviewed: ColumnOrName,
    reviewed: ColumnOrName,
    date: ColumnOrName,
    created: ColumnOrName,
) -> Column:
    """Last review, else the authored date. The first *present* field of each pair decides."""
    return F.coalesce(
        parse_ts(F.coalesce(col(last_reviewed), col(reviewed))),
        parse_ts(F.coalesce(col(date), col(created))),
    )
