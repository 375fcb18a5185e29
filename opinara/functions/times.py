"""Times as columns.  The session's zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats of a text time, tried in this order.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def epoch_time(c: Column, millis_above: int = 10_000_000_000) -> Column:
    """Epoch seconds, or milliseconds above the limit; 0 and null give null."""
    t = F.when(c > millis_above, F.timestamp_millis(c.cast("long"))).otherwise(F.timestamp_seconds(c.cast("long")))
    return F.when(c != 0, t)


def text_time(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS])


def flex_timestamp(c: Column, numeric: bool, dates: bool = True, parse_numeric_strings: bool = False) -> Column:
    """A time from epoch numbers or from texts.  By default a text with digits alone is no time."""
    if numeric:
        return epoch_time(c)
    digits = F.when(F.trim(c).rlike("^[0-9]+$"), epoch_time(F.trim(c).try_cast("long")))
    parts = ([text_time(c)] if dates else []) + ([digits] if parse_numeric_strings or not dates else [])
    return F.coalesce(*parts)


def epoch_to_str(c: Column) -> Column:
    return F.date_format(epoch_time(c, 1_000_000_000_000), "yyyy-MM-dd HH:mm:ss")


def epoch_to_date(c: Column) -> Column:
    return F.date_format(epoch_time(c, 1_000_000_000_000), "yyyy-MM-dd")


def str_to_epoch(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Epoch seconds of a text time, 0 if it is none."""
    return F.coalesce(F.unix_seconds(F.try_to_timestamp(c, F.lit(fmt))), F.lit(0).cast("long"))


def _rfc2822(c: Column, offset: bool) -> Column:
    m = F.map_from_arrays(F.array(*map(F.lit, MONTHS)), F.array(*[F.lit(f"{i:02d}") for i in range(1, 13)]))
    p = r"^\w{3} (\w{3}) (\d{2}) (\d{2}:\d{2}:\d{2}) ([+-]\d{4}) (\d{4})$"
    g = [F.regexp_extract(c, p, i) for i in range(1, 6)]
    zone = F.concat(F.substring(g[3], 1, 3), F.lit(":"), F.substring(g[3], 4, 2)) if offset else F.lit("+00:00")
    return F.try_to_timestamp(F.concat(g[4], F.lit("-"), F.try_element_at(m, g[0]), F.lit("-"), g[1], F.lit(" "), g[2], zone), F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def rfc2822_time(c: Column) -> Column:
    """The instant of a time such as ``Mon Jan 02 15:04:05 +0800 2023``."""
    return _rfc2822(c, True)


def rfc2822_china(c: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(rfc2822_time(c), "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")


def rfc2822_epoch_naive(c: Column) -> Column:
    """Epoch seconds as if the time were UTC whatever its offset."""
    return F.unix_seconds(_rfc2822(c, False))


def day_range_bounds(start: Column, end: Column) -> tuple[Column, Column]:
    """Epoch seconds of the first second of ``start`` and the last one of ``end``."""
    return F.unix_seconds(start.cast("timestamp")), F.unix_seconds(F.date_add(end, 1).cast("timestamp")) - 1
