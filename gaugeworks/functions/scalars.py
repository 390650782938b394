"""Scalar expressions: durations, units, rounding, decoding, names and time buckets."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.predicates import as_column, moment, require_utc

INT_MAX = 2_147_483_647


# numbers


def int_div(a, b) -> Column:
    """Integer quotient, cut towards zero; NULL when the divisor is 0."""
    a, b = as_column(a), b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a.cast("bigint"), F.nullif(b.cast("bigint"), F.lit(0).cast("bigint")))


def ratio(a, b) -> Column:
    """a / b in double; NULL when b is 0 or NULL."""
    return F.try_divide(as_column(a).cast("double"), as_column(b).cast("double"))


def pct(a, b) -> Column:
    """100 * a / b as a single-precision number."""
    return (ratio(a, b) * 100.0).cast("float")


def round_dec(c, digits: int) -> Column:
    """Round a double half away from zero on its decimal value.

    Rounding the binary value directly gives different results from engine to engine. A number too
    large for the decimal has no fraction to round.
    """
    c = as_column(c)
    return F.coalesce(F.round(c.try_cast("decimal(38,9)"), digits).cast("double"), c)


def clamp0(c) -> Column:
    """The value, or 0 where it is negative or NULL."""
    return F.greatest(F.coalesce(as_column(c), F.lit(0)), F.lit(0))


def pages_to_mb(c) -> Column:
    """8-KB pages to MB."""
    return as_column(c) / F.lit(128.0)


def pages_to_kb(c) -> Column:
    """8-KB pages to KB."""
    return as_column(c) * F.lit(8)


def size_text(c, unit: str, digits: int) -> Column:
    """A number as text with its unit, rounded half up."""
    number = as_column(c).cast(f"decimal(38,{digits})").cast("string")
    return F.concat(number, F.lit(f" {unit}"))


def pages_text_mb(c) -> Column:
    """8-KB pages as ``"12.34 MB"``, exact in decimal."""
    return size_text(as_column(c).cast("decimal(28,0)") * F.lit(Decimal("0.0078125")), "MB", 2)


def pages_text_kb(c) -> Column:
    """8-KB pages as ``"96 KB"``."""
    return size_text(pages_to_kb(c), "KB", 0)


# durations


def unwrap_ms(ms) -> Column:
    """Milliseconds of a counter that went past the 32-bit range and turned negative."""
    ms = as_column(ms).cast("bigint")
    wrapped = F.lit(INT_MAX).cast("bigint") + F.abs(F.lit(-INT_MAX).cast("bigint") - ms)
    return F.when(ms < 0, wrapped).otherwise(ms)


def _padded(c: Column, width: int) -> Column:
    return F.right(F.concat(F.lit("0" * width), c.cast("string")), F.lit(width))


def duration_text(ms, zero_as_null: bool = True) -> Column:
    """Milliseconds as ``DDD HH:MM:SS.FFF``."""
    ms = as_column(ms).cast("bigint")
    seconds = int_div(ms, 1000)
    text = F.concat(
        _padded(int_div(seconds, 86400), 3),
        F.lit(" "),
        _padded(int_div(seconds, 3600) % 24, 2),
        F.lit(":"),
        _padded(int_div(seconds, 60) % 60, 2),
        F.lit(":"),
        _padded(seconds % 60, 2),
        F.lit("."),
        _padded(ms % 1000, 3),
    )
    return F.when(ms != 0, text) if zero_as_null else text


def boundary_diff(unit: str, a, b) -> Column:
    """How many ``second``, ``minute`` or ``hour`` boundaries lie between a and b."""
    size = {"second": 1, "minute": 60, "hour": 3600}[unit]

    def boundary(ts):
        return F.floor(F.unix_micros(as_column(ts)) / F.lit(1_000_000 * size))

    return (boundary(b) - boundary(a)).cast("bigint")


def millis_between(a, b) -> Column:
    """Milliseconds from a to b."""
    return F.unix_millis(as_column(b)) - F.unix_millis(as_column(a))


# time buckets


def window_bounds(as_of, window: int = 0, hours_back: int = -1) -> tuple[Column, Column]:
    """Start and end of the look-back window; the end is the top of an hour."""
    require_utc()
    end = F.date_trunc("hour", moment(as_of) + F.make_dt_interval(hours=F.lit(window)))
    return end + F.make_dt_interval(hours=F.lit(hours_back)), end


def hour_bucket(ts, tz: str = "UTC") -> tuple[Column, Column]:
    """Start and end of the UTC hour that holds ``ts``, shown in ``tz``."""
    require_utc()
    start = F.date_trunc("hour", as_column(ts))
    return F.from_utc_timestamp(start, tz), F.from_utc_timestamp(start + F.expr("INTERVAL 1 HOUR"), tz)


def to_server_time(ts, utc_offset: timedelta | int = 0) -> Column:
    """A UTC instant shifted by the server's offset (a timedelta, or minutes)."""
    if not isinstance(utc_offset, timedelta):
        utc_offset = timedelta(minutes=utc_offset)
    return as_column(ts) + F.lit(utc_offset)


def weekday_name(ts) -> Column:
    return F.date_format(as_column(ts), "EEEE")


def weekday_no(ts) -> Column:
    """Sunday is 1."""
    return F.dayofweek(as_column(ts))


# text and codes


def decode_enum(col, names: Mapping[int, str]) -> Column:
    """The name of a code; NULL for an unknown one."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), as_column(col).cast("int"))


def blank_to_null(c) -> Column:
    return F.nullif(as_column(c), F.lit(""))


def quote_name(c) -> Column:
    """A name in brackets, with closing brackets doubled."""
    return F.concat(F.lit("["), F.replace(as_column(c), F.lit("]"), F.lit("]]")), F.lit("]"))


def qualified_name(schema, name) -> Column:
    return F.concat(quote_name(schema), F.lit("."), quote_name(name))


def parse_name(name: str, part: int) -> str | None:
    """Part of a dotted name, counted from the right (1 is the object, 3 the database).

    Parts may stand in brackets, in which a dot is an ordinary character and ``]]`` is a bracket.
    """
    parts, current, quoted, at = [], "", False, 0
    while at < len(name):
        ch, pair = name[at], name[at : at + 2]
        if quoted and pair == "]]":
            current, at = current + "]", at + 1
        elif ch in "[]":
            quoted = ch == "["
        elif ch == "." and not quoted:
            parts.append(current)
            current = ""
        else:
            current += ch
        at += 1
    parts.append(current)
    return parts[-part] or None if part <= len(parts) else None


UTF16 = "UTF-16LE"


def statement_slice(text, start, end) -> Column:
    """The statement between two byte offsets of UTF-16 text.

    An end of -1 means the end of the text; an empty slice gives the whole text. Offsets count UTF-16
    units, two for a character beyond the basic plane; such a character that an offset cuts in half is
    left out.
    """
    text, start, end = as_column(text), as_column(start), as_column(end)
    units = F.encode(text, UTF16)
    stop = F.when(end == -1, F.octet_length(units)).otherwise(end)
    piece = F.substring(units, (int_div(start, 2) * 2 + 1).cast("int"), ((int_div(stop - start, 2) + 1) * 2).cast("int"))
    n = F.octet_length(piece)
    high_byte = lambda at: F.hex(F.substring(piece, at, F.lit(1)))
    # the second half of a pair in front, the first half of one at the end
    before = F.when(high_byte(F.lit(2)).between("DC", "DF"), 2).otherwise(0)
    behind = F.when(high_byte(n).between("D8", "DB"), 2).otherwise(0)
    whole = F.substring(piece, before + 1, n - before - behind)
    return F.coalesce(F.nullif(F.decode(whole, UTF16), F.lit("")), text)


def dir_of(path: str) -> str:
    """Directory of a path with its closing separator; either kind of slash counts."""
    return path[: max(path.rfind("\\"), path.rfind("/")) + 1]


def coalesce_time(c, default: str) -> Column:
    return F.coalesce(as_column(c), F.lit(default).cast("timestamp"))
