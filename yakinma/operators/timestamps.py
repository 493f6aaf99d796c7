"""Normalise timestamps of mixed formats, precisions and zones to UTC instants.

Parsing is native SQL: each string is rewritten by one regular expression of its family into a
fixed list of parts, and calendar values are validated arithmetically, so nothing throws under ANSI.
Local times are resolved by an as-of join with zone-offset intervals on the local time line, exploded
to (zone, year): two matching intervals mean the wall time occurs twice, none means it was skipped,
one gives the offset. The interval table holds every IANA zone for 1970-2040; it does not grow with the
data (about 43 000 rows), so it is broadcast. Years outside it are resolved by Spark's own zone rules.

Results: null, empty, relative or impossible strings denote no moment; an unknown zone word denotes
none; a local time whose key has no zone denotes none; a twice-occurring wall time is the earlier
instant, a skipped one is read with the offset before the change.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Offsets in minutes of zone abbreviations (fixed values).
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "TRT": 180, "MSK": 180, "IST": 330, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

#: Month names and abbreviations, folded to plain lower-case letters (fixed values).
MONTHS = {
    1: "ocak oca january jan januar janner", 2: "subat sub february feb februar", 3: "mart mar march marz maerz mrz",
    4: "nisan nis april apr", 5: "mayis may mai", 6: "haziran haz june jun juni", 7: "temmuz tem july jul juli",
    8: "agustos agu august aug", 9: "eylul eyl september sep sept", 10: "ekim eki october oct oktober okt",
    11: "kasim kas november nov", 12: "aralik ara december dec dezember dez",
}

FIRST_YEAR, LAST_YEAR = 1970, 2040

_OFF = r"(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})?"
_ZONE = r"(?:\[?([A-Za-z][A-Za-z0-9_+\-/]*)\]?)?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?i:(AM|PM)\b)?(?:\s*Uhr)?"
_WORD = r"([\p{L}\p{M}]+)"
#: family: (test, pattern, parts). Parts are year|month|day|hour|minute|second|fraction|half|offset|zone.
_FAMILIES = [
    (r"^\D*\d{4}[-/.]\d", rf"^\D*?(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:T|[ ,]\s*){_CLOCK}\s*{_OFF}\s*{_ZONE})?$", "$1|$3|$4|$5|$6|$7|$8|$9|$10|$11"),
    (r"^\d{8}T\d{4}", rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})?{_OFF}$", "$1|$2|$3|$4|$5|$6|||$7|"),
    (r"^\D*\d{1,2}[-/.]\d{1,2}[-/.]\d", rf"^\D*?(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:(?:T|[ ,]\s*){_CLOCK}\s*{_OFF}\s*{_ZONE})?$", "$4|$3|$1|$5|$6|$7|$8|$9|$10|$11"),
    (r"^\D*\d{1,2}\.?\s*\p{L}", rf"^\D*?(\d{{1,2}})\.?\s*{_WORD}\.?,?(?:\s*(\d{{4}}))?(?:,?\s+(?:(?i:saat|um|at)\s+)?{_CLOCK}\s*{_OFF}\s*{_ZONE})?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (r"^[\p{L}\p{M}., ]+\d{1,2}(?:st|nd|rd|th)?,? ", rf"^(?:\p{{L}}+,\s*)?{_WORD}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}\s*{_OFF}\s*{_ZONE})?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
]


def _date(y: str, m: str, d: str) -> str:
    """SQL for a date, null where the calendar has none."""
    return f"try_cast(concat_ws('-', lpad({y}, 4, '0'), {m}, {d}) AS date)"


def _rules_of(zone: str) -> bytes:
    """The zone's file, which aliases share; the name itself where there is no such file."""
    import zoneinfo

    for folder in zoneinfo.TZPATH:
        if (path := Path(folder, zone)).is_file():
            return path.read_bytes()
    return zone.encode()


@lru_cache(maxsize=1)
def offset_intervals() -> pa.Table:
    """Rows (zone, y, iv) with iv the offset intervals, as local [from, to) in microseconds and offset,
    that touch a local year or end before it. Built from the zone database of the driver's Python."""
    import zoneinfo

    lo = int(pd.Timestamp(f"{FIRST_YEAR - 1}-12-01").timestamp())
    hi = int(pd.Timestamp(f"{LAST_YEAR + 1}-02-01").timestamp())
    grid = np.arange(lo, hi, 5 * 86400, dtype=np.int64)

    def offsets(t: np.ndarray, zone: str) -> np.ndarray:
        idx = pd.DatetimeIndex(t.astype("datetime64[s]")).tz_localize("UTC").tz_convert(zone)
        return (idx.tz_localize(None).asi8 // (10**9 if idx.unit == "ns" else 1)) - t

    begins = np.array([pd.Timestamp(f"{y}-01-01").timestamp() for y in range(FIRST_YEAR, LAST_YEAR + 2)]).astype(np.int64)
    n_years = LAST_YEAR - FIRST_YEAR + 1
    names, known, blocks = [], {}, []
    for zone in sorted(zoneinfo.available_timezones()):
        if zone == "localtime":
            continue
        rules = _rules_of(zone)
        if rules in known:  # another name of the same rules
            names.append(zone)
            blocks.append(known[rules])
            continue
        try:
            o = offsets(grid, zone)
        except Exception:  # noqa: BLE001, S112 - a name that pandas doesn't know isn't a usable zone
            continue
        at = np.flatnonzero(o[1:] != o[:-1])
        a, b, before = grid[at], grid[at + 1], o[at]
        while len(a) and (b - a).max() > 1:  # bisect all changes at once
            mid = (a + b) // 2
            same = offsets(mid, zone) == before
            a, b = np.where(same, mid, a), np.where(same, b, mid)
        starts = np.concatenate([[lo], b])
        ends = np.concatenate([b, [hi]])
        offs = np.concatenate([o[:1], offsets(b, zone)]) if len(b) else o[:1]
        ls, le = starts + offs, ends + offs
        # an interval that ended within two days before the year gives the offset before a change at its start
        year, hit = np.nonzero((ls[None, :] < begins[1:, None]) & (le[None, :] > begins[:-1, None] - 2 * 86400))
        known[rules] = (np.bincount(year, minlength=n_years), ls[hit] * 10**6, le[hit] * 10**6, offs[hit] * 10**6)
        names.append(zone)
        blocks.append(known[rules])
    sizes, *parts = (np.concatenate([x[i] for x in blocks]) for i in range(4))
    values = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in parts], ["ls", "le", "off"])
    iv = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)
    years = np.tile(np.arange(FIRST_YEAR, LAST_YEAR + 1, dtype=np.int32), len(names))
    return pa.table({"zone": pa.array(np.repeat(np.array(names, dtype=object), n_years), pa.string()), "y": pa.array(years), "iv": iv})


@lru_cache(maxsize=1)
def zone_names() -> tuple[str, ...]:
    return tuple(sorted(set(offset_intervals().column("zone").to_pylist())))


def interval_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(offset_intervals(), "zone string, y int, iv array<struct<ls:bigint,le:bigint,off:bigint>>")


def fold_month(c: Column) -> Column:
    """Plain lower-case letters of a month's name in any case or Unicode form."""
    plain = F.lower(F.translate(c, "ıİIçÇğĞöÖşŞüÜäÄ", "iiiccggoossuuaa"))
    return F.regexp_replace(plain, r"\p{M}", "")


def parse_parts(df: DataFrame, text: str, scraped_at: str) -> DataFrame:
    """Add ``local_us`` (wall time in microseconds), ``off_us`` (offset, if written), ``zone`` (name, if
    written), ``unix_us`` (bare integers) and ``ok``; a row denotes a moment only where ``ok``."""
    s = F.trim(F.regexp_replace(F.col(text), r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " "))
    df = df.withColumn("_s", s)
    parts = F.when(F.col("_s").rlike(r"^-?\d+$"), F.lit(None).cast("string"))
    for test, pattern, order in _FAMILIES:
        parts = parts.when(F.col("_s").rlike(test), F.regexp_replace("_s", pattern, order + "|#"))
    df = df.withColumn("_p", F.split(parts, r"\|"))
    df = df.withColumn("_p", F.when((F.size("_p") == 11) & (F.col("_p")[10] == "#"), F.col("_p")))
    p = lambda i: F.col("_p")[i]
    number = lambda i: p(i).try_cast("int")
    names = F.create_map(*[F.lit(x) for m, ws in MONTHS.items() for w in ws.split() for x in (w, m)])
    half = F.lower(p(7))
    hour = number(3)
    df = df.withColumns(
        {
            "_y0": F.when(F.length(p(0)) == 2, number(0) + 2000).otherwise(number(0)),
            "_m": F.when(p(1).rlike(r"^\d"), number(1)).otherwise(F.try_element_at(names, fold_month(p(1)))),
            "_d": number(2),
            "_h": F.when(half == "", F.coalesce(hour, F.lit(0))).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0)).otherwise(99),
            "_i": F.coalesce(number(4), F.lit(0)),
            "_sec": F.coalesce(number(5), F.lit(0)),
            "_us": F.rpad(F.substring(p(6), 1, 6), 6, "0").try_cast("int"),
            "_off": p(8),
            "_zone": p(9),
            "_day": F.to_date(F.substring(F.col(scraped_at), 1, 10).try_cast("date")),
        }
    )
    # a date without a year: that of the scrape, or the one before if more than 31 days after its day
    this = _date("year(_day)", "_m", "_d")
    df = df.withColumn("_date", F.expr(f"CASE WHEN _p[0] <> '' THEN {_date('_y0', '_m', '_d')} WHEN {this} > _day + 31 THEN {_date('year(_day) - 1', '_m', '_d')} ELSE {this} END"))
    sign = F.when(F.col("_off").startswith("-"), -1).otherwise(1)
    digits = F.rpad(F.regexp_replace("_off", r"[+:\-]", ""), 4, "0").try_cast("int")
    minutes = F.when(F.col("_off") == "Z", 0).when(F.col("_off") != "", sign * (F.floor(digits / 100) * 60 + digits % 100))
    short = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    minutes = F.coalesce(minutes, F.try_element_at(short, F.upper("_zone")))
    whole = F.col("_s").rlike(r"^-?\d+$")
    n = F.col("_s").try_cast("bigint")
    return df.withColumns(
        {
            "local_us": F.expr("CASE WHEN _h < 24 AND _i < 60 AND _sec < 60 THEN (cast(unix_date(_date) AS bigint) * 86400 + _h * 3600 + _i * 60 + _sec) * 1000000 + coalesce(_us, 0) END"),
            "off_us": minutes.cast("long") * 60_000_000,
            "zone": F.when(minutes.isNull() & (F.col("_zone") != ""), F.col("_zone")),
            "unix_us": F.when(whole & (F.length("_s") <= 11), n * 1_000_000).when(whole & (F.length("_s") <= 15), n * 1000),
        }
    ).drop("_s", "_p", "_y0", "_m", "_d", "_h", "_i", "_sec", "_us", "_off", "_zone", "_day", "_date")


def resolve_local(df: DataFrame, local: str, zone: str) -> DataFrame:
    """As-of join of wall times to the zone's offset intervals; adds ``utc_us`` and ``how``
    (``unique``, ``ambiguous``, ``skipped``)."""
    table = F.broadcast(interval_table(df.sparkSession).withColumnsRenamed({"zone": "_z", "y": "_yr"}))  # bounded: zones x years
    year = F.year(F.date_from_unix_date(F.floor(F.col(local) / 86_400_000_000).cast("int")))
    df = df.withColumn("_year", year).join(table, (F.col(zone) == F.col("_z")) & (F.col("_year") == F.col("_yr")), "left")
    df = df.withColumns(
        {
            "_in": F.filter("iv", lambda x: (x["ls"] <= F.col(local)) & (F.col(local) < x["le"])),
            "_gone": F.array_max(F.transform(F.filter("iv", lambda x: x["le"] <= F.col(local)), lambda x: F.struct(x["le"], x["off"]))),
        }
    )
    n = F.size("_in")
    known = F.concat_ws(" ", F.lit(""), F.concat(F.lit(" "), F.col(zone), F.lit(" ")))
    names = F.lit(" " + " ".join(zone_names()) + " ")
    outside = F.when((F.col("_year") < FIRST_YEAR) | (F.col("_year") > LAST_YEAR), F.when(F.contains(names, F.trim(known)), F.col(zone)))
    builtin = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(local)), outside))
    how = F.when(n == 1, "unique").when(n == 2, "ambiguous").when((n == 0) & F.col("_gone").isNotNull(), "skipped")
    utc = (
        F.when(n == 1, F.col(local) - F.col("_in")[0]["off"])
        .when(n == 2, F.col(local) - F.greatest(F.col("_in")[0]["off"], F.col("_in")[1]["off"]))
        .when(n == 0, F.col(local) - F.col("_gone")["off"])
        .otherwise(builtin)
    )
    return df.withColumns({"utc_us": utc, "how": how}).drop("_z", "_yr", "_year", "iv", "_in", "_gone")


def to_instants(df: DataFrame, fields: Sequence[str], id_col: str, key: str, scraped_at: str, zones: DataFrame, zone_key: str, zone_col: str) -> DataFrame:
    """(id, field, epoch_us, how) for each field that denotes a moment. ``zones`` maps keys to zone names;
    Spark broadcasts it when its measured size allows, and joins by shuffle otherwise."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    long = df.select(F.col(id_col).alias("id"), F.col(key).alias("_key"), F.col(scraped_at).cast("string").alias("_scraped"), each.alias("e"))
    long = long.select("id", "_key", "_scraped", "e.field", "e.text").where(F.col("text").isNotNull())
    parsed = parse_parts(long, "text", "_scraped")
    zones = zones.select(F.col(zone_key).alias("_zkey"), F.col(zone_col).alias("_home")).dropDuplicates(["_zkey"])
    parsed = parsed.join(zones, parsed["_key"] == zones["_zkey"], "left")
    # rows with an offset keep a null zone, so they match no interval
    parsed = parsed.withColumn("_at", F.expr("IF(unix_us IS NULL AND off_us IS NULL, coalesce(zone, _home), NULL)"))
    done = resolve_local(parsed, "local_us", "_at")
    epoch = F.coalesce("unix_us", F.col("local_us") - F.col("off_us"), "utc_us")
    how = F.when(F.col("unix_us").isNotNull(), "unix").when(F.col("off_us").isNotNull(), "offset").otherwise(F.coalesce("how", F.lit("rules")))
    # a generator, not a filter: a filter would be pushed below the projections and repeat every parse in its condition
    one = F.filter(F.array(F.struct(epoch.alias("epoch_us"), how.alias("how"))), lambda x: x["epoch_us"].isNotNull())
    return done.select("id", "field", F.inline(one))
