"""Timestamps of the project's records as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})\z"


def zoned_timestamp(text: Column | str) -> Column:
    """An ISO 8601 text with a zone as a timestamp; null for anything else, impossible dates too."""
    c = F.col(text) if isinstance(text, str) else text
    return F.when(c.rlike(_ZONED), F.try_to_timestamp(F.replace(c, F.lit(" "), F.lit("T"))))


def in_window(at: Column, early: tuple[str, str], late: tuple[str, str]) -> Column:
    """P20, P21: 'early', 'late' or 'outside' by inclusive dates; null for null. The windows must not overlap."""
    if not early[0] <= early[1] < late[0] <= late[1]:
        raise ValueError("the early window must end before the late one starts")
    day = F.to_date(at)
    return F.when(at.isNull(), None).when(day.between(*map(F.lit, early)), "early").when(day.between(*map(F.lit, late)), "late").otherwise("outside")


def partial_date(text: Column | str) -> Column:
    """``struct<at, precision>`` of a year, month, day or UTC time; null for other texts."""
    c = F.trim(text)
    kind = (
        F.when(c.rlike(r"^\d{4}\z"), "year").when(c.rlike(r"^\d{4}-\d{2}\z"), "month").when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), "day")
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z\z"), "datetime")
    )
    full = F.when(kind == "year", F.concat(c, F.lit("-01-01"))).when(kind == "month", F.concat(c, F.lit("-01"))).otherwise(c)
    at = F.when(kind == "datetime", F.try_to_timestamp(c)).otherwise(F.try_to_timestamp(full, F.lit("yyyy-MM-dd")))
    return F.when(kind.isNotNull() & at.isNotNull(), F.struct(at.alias("at"), kind.alias("precision")))


def earliest_date(texts: Column | str) -> Column:
    """The earliest of several partial dates."""
    return F.array_min(F.array_compact(F.transform(texts, partial_date)))


def rfc822_date(text: Column | str) -> Column:
    """``Mon, 02 Jan 2006 15:04:05 GMT`` as a timestamp; null for another form or a wrong weekday."""
    c = F.col(text) if isinstance(text, str) else text
    at = F.when(c.rlike(r"^[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} GMT\z"), F.try_to_timestamp(F.substring(c, 6, 20), F.lit("dd MMM yyyy HH:mm:ss")))
    return F.when(F.date_format(at, "EEE") == F.substring(c, 1, 3), at)
