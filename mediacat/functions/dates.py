"""Date resolution as one Column expression: the first candidate that parses and lies in range wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name patterns of dated files, and the first day that counts.
WHATSAPP_ANDROID = r"^(?:IMG|VID|AUD|PTT|DOC|STK)-(\d{8})-WA\d+"
WHATSAPP_DESKTOP = r"WhatsApp (?:Image|Video) (\d{4}-\d{2}-\d{2}) at (\d{1,2}\.\d{2}\.\d{2})(?: ?([AP]M))?"
CAMERA = r"^(?:IMG_|PXL_|Screenshot_)?(\d{8})[_-](\d{6})"
EARLIEST = "1990-01-01"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def _stamp(text: Column, form: str) -> Column:
    return F.try_to_timestamp(text, F.lit(form)).cast("timestamp_ntz")


def in_range(stamp: Column, today: Column) -> Column:
    return F.to_date(stamp).between(F.lit(EARLIEST).cast("date"), F.date_add(today, 1))


def exif_stamp(text: Column) -> Column:
    return _stamp(F.substring(F.btrim(text, F.lit("\x00 ")), 1, 19), "yyyy:MM:dd HH:mm:ss")


def pdf_stamp(text: Column) -> Column:
    """``D:`` may be missing, 8 or 14 digits, the zone is ignored."""
    digits = _part(F.btrim(text), r"^(?:D:)?(\d{14}|\d{8})", 1)
    return F.when(F.length(digits) == 14, _stamp(digits, "yyyyMMddHHmmss")).when(F.length(digits) == 8, _stamp(digits, "yyyyMMdd"))


def mtime_stamp(mtime: Column) -> Column:
    """Null for what is no time of the years 1 to 9999."""
    return F.when((mtime >= -62135596800) & (mtime < 253402300800), F.timestamp_seconds(F.floor(mtime)).cast("timestamp_ntz"))


def iso_day(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd")


def iso(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


def _candidate(stamp: Column, source: str, day_only: bool = False) -> Column:
    return F.struct(stamp.alias("stamp"), F.lit(source).alias("source"), F.lit(day_only).alias("day_only"))


def name_candidate(name: Column) -> Column:
    """struct(stamp, source, day_only) of the first name pattern that matches, which alone is the name's candidate; null if none does."""
    android, desktop, camera = (F.regexp_like(name, F.lit(p)) for p in (WHATSAPP_ANDROID, WHATSAPP_DESKTOP, CAMERA))
    half = _part(name, WHATSAPP_DESKTOP, 3)
    day_time = F.concat(_part(name, WHATSAPP_DESKTOP, 1), F.lit(" "), _part(name, WHATSAPP_DESKTOP, 2))
    clock = F.when(half != "", _stamp(F.concat(day_time, F.lit(" "), half), "yyyy-MM-dd h.mm.ss a")).otherwise(_stamp(day_time, "yyyy-MM-dd H.mm.ss"))
    return (
        F.when(android, _candidate(_stamp(_part(name, WHATSAPP_ANDROID, 1), "yyyyMMdd"), "whatsapp_android", True))
        .when(desktop, _candidate(clock, "whatsapp_desktop"))
        .when(camera, _candidate(_stamp(F.concat(_part(name, CAMERA, 1), _part(name, CAMERA, 2)), "yyyyMMddHHmmss"), "camera_name"))
    )


def resolve_date(name: Column, today: Column, exif: Column, document: Column, mtime: Column) -> Column:
    """struct(taken_at, date_source): name, EXIF, document, modification time, in that order; null if none is valid.

    exif, document: timestamp_ntz; mtime: seconds since the epoch; today: the date that counts as now.  The candidates are an array, so that
    each pattern and format is evaluated once a row."""
    candidates = F.array(name_candidate(name), _candidate(exif, "exif"), _candidate(document, "document"), _candidate(mtime_stamp(mtime), "mtime"))
    valid = F.filter(candidates, lambda c: F.coalesce(in_range(c["stamp"], today), F.lit(False)))
    shown = F.transform(F.slice(valid, 1, 1), lambda c: F.struct(F.when(c["day_only"], iso_day(c["stamp"])).otherwise(iso(c["stamp"])).alias("taken_at"), c["source"].alias("date_source")))
    return F.get(shown, 0)


def display_date(taken_at: Column) -> Column:
    """dd/mm/yyyy, with hh:mm if the time is known."""
    day = F.concat_ws("/", F.substring(taken_at, 9, 2), F.substring(taken_at, 6, 2), F.substring(taken_at, 1, 4))
    return F.when(F.length(taken_at) > 10, F.concat(day, F.lit(" "), F.substring(taken_at, 12, 5))).otherwise(day)


def month_bounds(month: Column) -> Column:
    """struct(date_from, date_to) of a yyyy-MM month."""
    first = F.concat(month, F.lit("-01"))
    return F.struct(first.alias("date_from"), F.date_format(F.last_day(F.try_to_date(first)), "yyyy-MM-dd").alias("date_to"))
