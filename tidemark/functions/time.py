"""Moments from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(c: str | Column) -> Column:
    """A timestamp from an ISO text: with an offset or `Z` as it says, else in UTC whatever the session's zone; a date is its midnight; null for anything else."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    dated = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit("T00:00:00Z")))
    timed = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ].*([zZ]|[+-]\d{2}:?\d{2})$"), F.regexp_replace(F.upper(text), r"([+-]\d{2})(\d{2})$", "$1:$2"))
    return F.try_to_timestamp(F.coalesce(dated, timed, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d"), F.concat(text, F.lit("Z")))))
