"""Times with an offset, as instants and as text in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(raw: Column) -> Column:
    """The instant of an ISO time with a zone or an offset (``-0800``, ``-08:00``, ``Z``), one without is in UTC; null if it is no time."""
    text = F.regexp_replace(F.trim(raw), r"([+-]\d{2})(\d{2})$", "$1:$2")
    text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?!:)", "$1:00")
    zoned = F.when(text.rlike(r"(?:[Zz]|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), zoned.try_cast("timestamp"))


def utc_text(at: Column) -> Column:
    """An instant as ISO text in UTC with milliseconds, whatever the session's zone."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
