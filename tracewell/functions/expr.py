"""Column helpers: patterns as the log formats mean them, and scalars that give null where nothing is known."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rx(pattern: str) -> str:
    """A Java pattern in which only ``\\n`` ends a line, so a stray ``\\r`` inside a line is ordinary text."""
    return f"(?d){pattern}"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(rx(pattern))


def grab(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, possibly empty; null where nothing matches."""
    return F.when(matches(text, pattern), F.regexp_extract(text, rx(pattern), group))


def some(text: Column, pattern: str, group: int = 1) -> Column:
    """As ``grab``, with an empty group (as of an optional one) null."""
    return F.nullif(F.regexp_extract(text, rx(pattern), group), F.lit(""))


def whole(value: Column, kind: str = "int") -> Column:
    """An integer where the text is one, else null."""
    return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast(kind))


def truth(token: Column) -> Column:
    t = F.lower(F.trim(token))
    return F.when(t.isin("true", "yes"), True).when(t.isin("false", "no"), False)


def known(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v.cast("string"), F.lit("")) for v in values])


def resolve_uid(token: Column) -> Column:
    """``u<U>a<A>`` is ``U * 100000 + 10000 + A``; digits are themselves; anything else is unknown."""
    pattern = r"^u([0-9]+)a([0-9]+)$"
    user, app = (F.regexp_extract(token, pattern, i).try_cast("int") for i in (1, 2))
    return F.when(token.rlike(pattern), user * 100000 + 10000 + app).when(token.rlike("^[0-9]+$"), token.try_cast("int"))


def context_type(context: Column) -> Column:
    """The third part of a security context, or all of it if it has fewer."""
    return F.coalesce(F.get(F.split(context, ":"), F.lit(2)), context)


def cut_detail(detail: Column, most: int = 600) -> Column:
    """At most ``most`` characters, with a mark that tells the full length."""
    mark = F.concat(F.substring(detail, 1, most), F.lit("... [truncated, "), F.length(detail).cast("string"), F.lit(" chars total]"))
    return F.when(F.length(detail) > most, mark).otherwise(detail)


def cut_micros(line: Column) -> Column:
    """Log times of six fraction digits at the start of a line, with three."""
    return F.regexp_replace(line, r"^(\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3})\d{3}\b", "$1")


def snoop_time(raw: Column) -> Column:
    """The HCI log's microseconds as an ISO time with milliseconds."""
    return F.date_format(F.timestamp_micros(raw - F.lit(0x00DCDDB30F2F8000)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_time(micros: Column) -> Column:
    """Epoch microseconds as an ISO time in UTC, without a fraction where that is zero."""
    t = F.timestamp_micros(micros)
    return F.when(micros % 1000000 == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def minute_of_day(timestamp: Column) -> Column:
    """Minutes since midnight of any of the log formats; null where there is no time."""
    pattern = r"(?:^|[ T]|\d-)(\d{2})[:-](\d{2})(?:[:.-]\d{2}|$)"
    clock = r"(\d{2}):(\d{2}):\d{2}"
    dashed = r"^\d{4}-\d{2}-\d{2}-(\d{2})-(\d{2})-"
    part = lambda i: F.coalesce(some(timestamp, clock, i), some(timestamp, dashed, i), some(timestamp, pattern, i)).try_cast("int")
    return part(1) * 60 + part(2)


def near_minute(minute: Column, centre: Column, width: Column) -> Column:
    """Whether two minutes of the day are within ``width``, across midnight; unknown minutes are not."""
    apart = F.abs(minute - centre)
    return F.coalesce(F.least(apart, 1440 - apart) <= width, F.lit(False))


def row_mentions(query: Column, *columns: str) -> Column:
    """Whether the row, as JSON, has the trimmed query in any case; an empty query is in every row."""
    wanted = F.lower(F.trim(query))
    return (wanted == "") | F.lower(F.to_json(F.struct(*columns))).contains(wanted)


def hci_word(payload: Column, at: int) -> Column:
    """Two bytes from ``at`` (counted from 0), little-endian."""
    return byte(payload, at) + byte(payload, at + 1) * 256


def byte(payload: Column, at: int | Column) -> Column:
    """One byte as an integer; null past the end."""
    pos = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    one = F.decode(F.substring(payload, pos, F.lit(1)), "ISO-8859-1")
    return F.when(one != "", F.ascii(one))


def mac(payload: Column, at: int | Column) -> Column:
    """Six bytes as ``aa:bb:..``; null past the end."""
    pos = at + 1 if isinstance(at, Column) else F.lit(at + 1)
    text = F.lower(F.hex(F.substring(payload, pos, F.lit(6))))
    return F.when(F.length(text) == 12, F.regexp_replace(text, "(..)(?!$)", "$1:"))
