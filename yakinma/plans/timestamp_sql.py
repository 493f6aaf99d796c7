"""The SQL that the timestamp queries are compared with: another parser, and the zone rules of the other engine."""

from __future__ import annotations

from yakinma.operators.timestamps import ABBREVIATIONS, MONTHS
from yakinma.plans import fragments as Q

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*((?i:(?:AM|PM)\b)?)(?:\s*Uhr)?"
_TAIL = _CLOCK + r"\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})?\s*(?:\[?([A-Za-z][A-Za-z0-9_+\-/]*)\]?)?"
_REST = ["h", "i", "s", "f", "p", "o", "z"]
#: (test, pattern, names of its groups)
_FORMS = [
    (r"^\D*\d{4}[-/.]\d", rf"^\D*?(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:(?:T|[ ,]\s*){_TAIL})?$", ["y", "m", "d", *_REST]),
    (r"^\d{8}T\d{4}", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2}|[+-]\d{2})?$", ["y", "m", "d", "h", "i", "s", "o"]),
    (r"^\D*\d{1,2}[-/.]\d{1,2}[-/.]\d", rf"^\D*?(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}})(?:(?:T|[ ,]\s*){_TAIL})?$", ["d", "m", "y", *_REST]),
    (r"^\D*\d{1,2}\.?\s*\p{L}", rf"^\D*?(\d{{1,2}})\.?\s*([\p{{L}}\p{{M}}]+)\.?,?(?:\s*(\d{{4}}))?(?:,?\s+(?:(?i:saat|um|at)\s+)?{_TAIL})?$", ["d", "m", "y", *_REST]),
    (r"^[\p{L}\p{M}., ]+\d{1,2}(?:st|nd|rd|th)?,? ", rf"^(?:\p{{L}}+,\s*)?([\p{{L}}\p{{M}}]+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_TAIL})?$", ["m", "d", "y", *_REST]),
]
_ALL = ["y", "m", "d", *_REST]


def _form(pattern: str, names: list[str]) -> str:
    fields = ", ".join(f"{n} := e.{n}" if n in names else f"{n} := ''" for n in _ALL)
    return Q.let(f"regexp_extract(s, {Q.lit(pattern)}, {Q.strings(names)})", "e", f"struct_pack({fields})")


_CASES = " ".join(f"WHEN regexp_matches(s, {Q.lit(t)}) THEN {_form(p, n)}" for t, p, n in _FORMS)
_MONTH = "MAP {" + ", ".join(f"{Q.lit(w)}: {m}" for m, ws in MONTHS.items() for w in dict.fromkeys(ws.split())) + "}"
_SHORT = "MAP {" + ", ".join(f"{Q.lit(k)}: {v}" for k, v in ABBREVIATIONS.items()) + "}"
_int = "coalesce(try_cast({0} AS INT), 0)".format
_date = "try_cast(lpad({0}::VARCHAR, 4, '0') || '-' || lpad(mo::VARCHAR, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE)".format


def _resolved(fields: tuple[str, ...]) -> str:
    """CTEs up to ``r``: the parsed fields with the later and the earlier instant of their wall times."""
    digits = "rpad(regexp_replace(x.o, '[+:-]', '', 'g'), 4, '0')"
    return f"""WITH f AS (SELECT id, company, try_cast(substr(scraped_at, 1, 10) AS DATE) AS day, unnest({Q.strings(fields)}) AS field, unnest([{', '.join(fields)}]) AS raw FROM complaints),
s AS (SELECT *, {Q.space('raw')} AS s FROM f WHERE raw IS NOT NULL),
x AS (SELECT *, CASE WHEN regexp_full_match(s, '-?\\d+') THEN NULL {_CASES} END AS x FROM s),
m AS (SELECT *, CASE WHEN regexp_matches(x.m, '^\\d') THEN try_cast(x.m AS INT) ELSE {_MONTH}[regexp_replace(lower(translate(x.m, 'ıİIçÇğĞöÖşŞüÜäÄ', 'iiiccggoossuuaa')), '\\p{{M}}', '', 'g')] END AS mo FROM x),
d AS (SELECT *, CASE WHEN x.y <> '' THEN {_date("(CASE WHEN length(x.y) = 2 THEN '20' || x.y ELSE x.y END)")} WHEN {_date('year(day)')} > day + 31 THEN {_date('(year(day) - 1)')} ELSE {_date('year(day)')} END AS date,
CASE WHEN x.p = '' THEN {_int('x.h')} WHEN {_int('x.h')} BETWEEN 1 AND 12 THEN {_int('x.h')} % 12 + CASE WHEN lower(x.p) = 'pm' THEN 12 ELSE 0 END ELSE 99 END AS h,
CASE WHEN x.o = 'Z' THEN 0 WHEN x.o <> '' THEN (CASE WHEN starts_with(x.o, '-') THEN -1 ELSE 1 END) * ({_int(f'substr({digits}, 1, 2)')} * 60 + {_int(f'substr({digits}, 3, 2)')}) ELSE {_SHORT}[upper(x.z)] END AS off FROM m),
l AS (SELECT *, CASE WHEN h < 24 AND {_int('x.i')} < 60 AND {_int('x.s')} < 60 THEN epoch_us(date::TIMESTAMP) + (h * 3600 + {_int('x.i')} * 60 + {_int('x.s')})::BIGINT * 1000000 + coalesce(try_cast(rpad(substr(x.f, 1, 6), 6, '0') AS INT), 0) END AS local,
CASE WHEN regexp_full_match(s, '-?\\d+') AND length(s) <= 11 THEN try_cast(s AS BIGINT) * 1000000 WHEN regexp_full_match(s, '-?\\d+') AND length(s) <= 15 THEN try_cast(s AS BIGINT) * 1000 END AS unix FROM d),
z AS (SELECT l.*, CASE WHEN off IS NULL THEN CASE WHEN x.z <> '' THEN x.z ELSE c.time_zone END END AS zone FROM l LEFT JOIN company_profiles c USING (company)),
t AS (SELECT *, CASE WHEN zone IN (SELECT name FROM pg_timezone_names()) AND local IS NOT NULL THEN timezone(zone, make_timestamp(local)) END AS late FROM z),
r AS (SELECT *, CASE WHEN timezone(zone, late - INTERVAL 1 HOUR) = make_timestamp(local) THEN late - INTERVAL 1 HOUR WHEN timezone(zone, late - INTERVAL 30 MINUTE) = make_timestamp(local) THEN late - INTERVAL 30 MINUTE ELSE late END AS utc FROM t)"""


_EPOCH = "coalesce(unix, local - off::BIGINT * 60000000, epoch_us(utc))"


def instants(fields: tuple[str, ...]) -> str:
    """A SELECT of (id, field, epoch_us)."""
    return f"{_resolved(fields)}\nSELECT id, field, {_EPOCH} AS epoch_us FROM r WHERE {_EPOCH} IS NOT NULL"


def resolution(fields: tuple[str, ...], first_year: int, last_year: int) -> str:
    """A SELECT of (field, how, n, first_us, last_us)."""
    return f"""{_resolved(fields)}, h AS (SELECT field, {_EPOCH} AS e, CASE WHEN unix IS NOT NULL THEN 'unix' WHEN off IS NOT NULL THEN 'offset' WHEN year(make_timestamp(local)) NOT BETWEEN {first_year} AND {last_year} THEN 'rules'
WHEN timezone(zone, late) <> make_timestamp(local) THEN 'skipped' WHEN utc <> late THEN 'ambiguous' ELSE 'unique' END AS how FROM r)
SELECT field, how, count(*) AS n, min(e) AS first_us, max(e) AS last_us FROM h WHERE e IS NOT NULL GROUP BY ALL"""
