"""Site dates as naive wall times at UTC+3, elapsed hours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from yakinma.functions.rounding import py_round
from yakinma.functions.text import let, normalize_space

#: Month names as the site writes them (fixed values).
MONTHS = ("Ocak", "Şubat", "Mart", "Nisan", "Mayıs", "Haziran", "Temmuz", "Ağustos", "Eylül", "Ekim", "Kasım", "Aralık")
_TEXT = r"(?iu)(\d{1,2})\s+(" + "|".join(MONTHS) + r")(?:\s+(\d{4}))?\s+(\d{1,2}):(\d{2})"
_NUMERIC = r"(\d{1,2})[./-](\d{1,2})[./-](\d{4})(?:\s+(\d{1,2}):(\d{2}))?"
_ISO = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_datetime(text: Column, reference: Column) -> Column:
    """TIMESTAMP_NTZ of an ISO text (an offset is turned into UTC+3), of ``2 Ocak 2026 03:30`` or ``28.09.2026
    14:30`` anywhere in it; a missing year is that of ``reference`` (a date), or the one before if the date lies more
    than 31 days behind it. Null for anything else, calendar errors included."""

    def stamp(day: Column, clock: Column) -> Column:
        return F.concat(day, F.lit(" "), clock).try_cast("timestamp_ntz")

    def of(v: Column) -> Column:
        part = lambda p, i: F.regexp_extract(v, p, i)
        clock = F.when(part(_ISO, 2) == "", "00:00").otherwise(part(_ISO, 2))
        off = part(_ISO, 3)
        digits = F.regexp_replace(off, "[+:-]", "")
        minutes = F.when(F.startswith(off, F.lit("-")), -1).otherwise(1) * (F.left(digits, F.lit(2)).try_cast("int") * 60 + F.right(digits, F.lit(2)).try_cast("int"))
        shift = F.when(off == "", 0).when(off == "Z", 180).otherwise(180 - minutes)
        iso = stamp(part(_ISO, 1), clock) + F.make_dt_interval(mins=shift)
        # İ and I have no single-letter lower case to compare with, so upper-case names that hold them are unknown
        names = F.array(*[F.lit(m.lower()) for m in MONTHS])
        month = F.nullif(F.array_position(names, F.lower(part(_TEXT, 2))), F.lit(0))
        time = F.concat(F.lpad(part(_TEXT, 4), 2, "0"), F.lit(":"), part(_TEXT, 5))
        named = lambda y: stamp(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(part(_TEXT, 1), 2, "0")), time)
        year = F.year(reference)
        this = named(year)
        text_date = F.when(month.isNull(), None).when(part(_TEXT, 3) != "", named(part(_TEXT, 3))).when(F.to_date(this) > F.date_add(reference, 31), named(year - 1)).otherwise(this)
        hm = F.when(part(_NUMERIC, 4) == "", "00:00").otherwise(F.concat(F.lpad(part(_NUMERIC, 4), 2, "0"), F.lit(":"), part(_NUMERIC, 5)))
        number = stamp(F.concat_ws("-", part(_NUMERIC, 3), F.lpad(part(_NUMERIC, 2), 2, "0"), F.lpad(part(_NUMERIC, 1), 2, "0")), hm)
        return F.when(F.regexp_like(v, F.lit(_ISO)) & iso.isNotNull(), iso).when(F.regexp_like(v, F.lit(_TEXT)), text_date).when(F.regexp_like(v, F.lit(_NUMERIC)), number)

    return let(normalize_space(text), of)


def first_datetime(texts: Sequence[Column], reference: Column) -> Column:
    return F.coalesce(*[parse_datetime(t, reference) for t in texts])


def elapsed_hours(start: Column, end: Column) -> Column:
    """Hours to two decimals; null if either is missing or the end lies before the start."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.when(end >= start, py_round(micros / F.lit(3.6e9), 2))
