"""Dates and times held as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import pattern
from ..relation import PlanError, col, kind, new_name, operation, refuse, to_text
from .texts import DATES, TIMES, moment

UNITS = {"days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0}


def read(df: DataFrame, column: str, formats: list[str]) -> Column:
    """A column of texts or times as timestamps; a text that can't be read ends the query."""
    if isinstance(kind(df, column), (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return col(column).cast("timestamp_ntz")
    at = moment(to_text(df, column), formats)
    return refuse(col(column).isNotNull() & at.isNull(), "conversion.invalid_datetime", at)


@operation("table.date_extract")
def date_extract(df: DataFrame, column: str, parts: list[str] = ("year", "month", "day"), prefix: str = "", date_format: str | None = None, invalid: str = "null") -> DataFrame:
    at = read(df, column, [date_format] if date_format else [*TIMES, *DATES])
    table = {"year": F.year, "month": F.month, "day": F.day, "quarter": F.quarter, "weekday": F.weekday, "week": F.weekofyear, "hour": F.hour, "minute": F.minute, "second": F.second}
    for p in parts:
        if p not in table:
            raise PlanError(f"there is no part {p!r}")
        df = df.withColumn(new_name(f"{prefix or column + '_'}{p}"), table[p](at).cast("long"))
    return df


@operation("table.date_format")
def date_format(df: DataFrame, column: str, input_format: str, output_column: str, output_format: str = "%Y-%m-%d", invalid: str = "null") -> DataFrame:
    return df.withColumn(new_name(output_column), F.date_format(read(df, column, [input_format]), pattern(output_format)))


@operation("table.date_add")
def date_add(df: DataFrame, column: str, input_format: str, amount: int, unit: str, output_column: str, output_format: str = "%Y-%m-%d", invalid: str = "null") -> DataFrame:
    """Years and months follow the calendar and end at the last day of a month."""
    at, n = read(df, column, [input_format]), int(amount)
    names = {"years": "years", "months": "months", "weeks": "weeks", "days": "days", "hours": "hours", "minutes": "mins", "seconds": "secs"}
    if unit not in names:
        raise PlanError(f"there is no unit {unit!r}")
    moved = F.try_add(at, F.make_interval(**{names[unit]: F.lit(n)}))
    return df.withColumn(new_name(output_column), F.date_format(moved, pattern(output_format)))


@operation("table.date_diff")
def date_diff(df: DataFrame, start_column: str, end_column: str, input_format: str, unit: str, output_column: str, invalid: str = "null") -> DataFrame:
    if unit not in UNITS:
        raise PlanError(f"there is no unit {unit!r}")
    micros = lambda c: F.unix_micros(read(df, c, [input_format]).cast("timestamp"))
    return df.withColumn(new_name(output_column), (micros(end_column) - micros(start_column)) / 1e6 / UNITS[unit])


@operation("table.timezone_convert")
def timezone_convert(df: DataFrame, column: str, input_format: str, source_timezone: str, target_timezone: str, output_column: str, output_format: str = "%Y-%m-%d %H:%M:%S", invalid: str = "null", ambiguous: str = "reject") -> DataFrame:
    """Local times that a change of clocks skips or repeats end the query."""
    at = read(df, column, [input_format])
    utc = F.to_utc_timestamp(at.cast("timestamp"), source_timezone)
    back = F.from_utc_timestamp(utc, source_timezone).cast("timestamp_ntz")
    hour = F.expr("interval 1 hour")
    earlier = F.from_utc_timestamp(utc - hour, source_timezone).cast("timestamp_ntz")
    later = F.from_utc_timestamp(utc + hour, source_timezone).cast("timestamp_ntz")
    utc = refuse(back != at, "conversion.nonexistent_local_time", utc)
    utc = refuse((earlier == at) | (later == at), "conversion.ambiguous_local_time", utc)
    return df.withColumn(new_name(output_column), F.date_format(F.from_utc_timestamp(utc, target_timezone), pattern(output_format)))
