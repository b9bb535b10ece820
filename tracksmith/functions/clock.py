"""Clock strings, the month * 31 + day calendar, spreadsheet serials and repaired time stamps, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import EPOCH_MS_FROM


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _part(time: Column | str, k: int) -> Column:
    return F.split(_col(time), ":")[k].cast("int")


def date_num(ts: Column | str) -> Column:
    """month * 31 + day: one number for each day of a year; the year is not in it."""
    return F.month(_col(ts)) * 31 + F.dayofmonth(_col(ts))


def clock(time: Column | str) -> Column:
    """Hours and minutes of "HH:MM:SS", without padding: "8:5"."""
    return F.concat(_part(time, 0).cast("string"), F.lit(":"), _part(time, 1).cast("string"))


def seconds(time: Column | str) -> Column:
    return _part(time, 0) * 3600 + _part(time, 1) * 60 + _part(time, 2)


def minutes(time: Column | str) -> Column:
    """Whole minutes; seconds are cut off."""
    return _part(time, 0) * 60 + _part(time, 1)


def hours(time: Column | str) -> Column:
    return _part(time, 0) + _part(time, 1) / 60.0 + _part(time, 2) / 3600.0


def minutes_between(first: Column | str, last: Column | str) -> Column:
    """Minutes from "H:M" to "H:M"; negative over midnight."""
    return minutes(last) - minutes(first)


def day_of_serial(text: Column | str) -> Column:
    """The date of a text "d-m-Y"."""
    return F.to_date(_col(text), "d-M-y")


def time_of_serial(serial: Column | str, two_days_late: bool = False) -> Column:
    """The time of a spreadsheet's day number; counted from 1900-01-01 it comes out two days late."""
    epoch = F.lit("1900-01-01" if two_days_late else "1899-12-30").cast("timestamp")
    return F.timestamp_micros((F.unix_micros(epoch) + F.round(_col(serial).cast("double") * 86_400_000_000.0)).cast("long"))


def iso(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")


#: Spellings tried in turn after ISO.
SPELLINGS = ("yyyy/MM/dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "yyyyMMddHHmmss", "MMM d yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss", "yyyy/MM/dd", "dd/MM/yyyy")


def repaired(value: Column | str) -> Column:
    """A time from text: epoch seconds, or milliseconds above 1e10, ISO with or without a zone, or one of SPELLINGS; else null."""
    text = F.trim(_col(value).cast("string"))
    number = text.try_cast("double")
    numeric = F.rlike(text, F.lit(r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]+)?$")) & (F.length(F.regexp_extract(text, r"^[0-9]+", 0)) != 14)
    scaled = F.when(number > EPOCH_MS_FROM, number * 1000.0).otherwise(number * 1_000_000.0)
    epoch = F.when(F.abs(scaled) < 2.5e17, F.timestamp_micros(scaled.try_cast("long")))
    tried = [F.try_to_timestamp(text, F.lit(s)) for s in SPELLINGS]
    return F.when(numeric, epoch).otherwise(F.coalesce(text.try_cast("timestamp"), *tried))
