"""Date functions over ISO and HL7 texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def with_zone(c: Column) -> Column:
    """A date as midnight UTC, a zone-less date-time with ``Z``; anything else as it is."""
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(c, F.lit("T00:00:00Z")))
        .when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?$"), F.concat(c, F.lit("Z")))
        .otherwise(c)
    )


def date_only(c: Column) -> Column:
    return F.substring_index(c, "T", 1)


def states_time_of_day(c: Column) -> Column:
    return c.rlike(r"T\d{2}:\d{2}")


# The ISO forms that are taken as they are.
ISO_FORM = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2})?)?$"


def hl7_date(c: Column) -> Column:
    """A clinical-document time as ISO: a date, or a date-time with the offset it states.

    ISO values stay as they are; below day precision there is none.  Digits that stop
    inside hour, minute or second keep the day, and so does an odd tail; a zone on a bare
    day is dropped, fractions of a second too.
    """
    text = F.trim(c)
    zone = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    digits = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(zone)), r"\.\d+$", "")
    n, piece = F.length(digits), lambda at: F.substring(digits, at, 2)
    day = F.concat_ws("-", F.substring(digits, 1, 4), piece(5), piece(7))
    offset = F.regexp_replace(zone, r"^([+-]\d{2})(\d{2})$", "$1:$2")
    time = F.concat(day, F.lit("T"), piece(9), F.lit(":"), F.when(n >= 12, piece(11)).otherwise("00"), F.lit(":"), F.when(n >= 14, piece(13)).otherwise("00"), offset)
    return F.when(text.rlike(ISO_FORM), text).when(digits.rlike(r"^\d{8,}$"), F.when((n == 10) | (n == 12) | (n >= 14), time).otherwise(day))


def file_date(c: Column) -> Column:
    """Date of a variant file's header (``yyyy-mm-dd`` or ``yyyymmdd``); null for anything else."""
    plain = F.regexp_replace(c, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}$"), plain)


def age_group(birth: Column, today: Column) -> Column:
    """pediatric, young_adult, adult or senior by whole years at `today`; null without a date."""
    years = F.floor(F.months_between(today, birth) / 12)
    return F.when(years < 18, "pediatric").when(years < 40, "young_adult").when(years < 65, "adult").when(years >= 65, "senior")
